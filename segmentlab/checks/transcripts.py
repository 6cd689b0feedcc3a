"""Queries on transcript lines."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.views import with_views
from segmentlab.checks.views import SPACE
from segmentlab.functions.text import WRONG_SCRIPT
from segmentlab.operators import transcripts as t
from segmentlab.plans.translate import translate
from segmentlab.session import shared_dir
from segmentlab.sources import transcripts as files
from segmentlab.sources.media import with_content

MERGED = f"""{with_views("segments")},
flagged AS (
  SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w
                  AND start_time - lag(end_time) OVER w <= 0.8::DOUBLE THEN 0 ELSE 1 END AS opens
  FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM flagged),
merged AS (
  SELECT job_id, min(seq) AS seq, min(start_time) AS start_time, arg_max(end_time, seq) AS end_time,
         string_agg(original_text, ' ' ORDER BY seq) AS original_text,
         CASE WHEN coalesce(first(translated_text ORDER BY seq), '') = '' THEN first(translated_text ORDER BY seq)
              ELSE string_agg(nullif(translated_text, ''), ' ' ORDER BY seq) END AS translated_text,
         max(speaker) AS speaker, count(*) AS n_lines
  FROM numbered GROUP BY job_id, run)
"""


@query("merge_segments", MERGED + "SELECT * FROM merged")
def _(v):
    return t.merge_segments(v.segments)


@query("word_budget", MERGED + """
SELECT job_id, seq, cast(greatest(2, round_even((end_time - start_time) * 5.5::DOUBLE, 0)) AS BIGINT) AS max_words
FROM merged""")
def _(v):
    return t.with_word_budget(t.merge_segments(v.segments)).select("job_id", "seq", "max_words")


CHUNKS = f"""{with_views("lines")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS pos FROM lines),
chunks AS (SELECT * EXCLUDE (pos), pos // 20 AS chunk, pos % 20 AS id, pos FROM ranked)
"""
REQUESTS = CHUNKS + """,
said AS (SELECT *, concat('[', coalesce(nullif(speaker, ''), 'UNKNOWN'), '] ', original_text) AS line FROM chunks),
contexts AS (
  SELECT n.job_id, n.chunk, coalesce(string_agg(p.line, chr(10) ORDER BY p.pos), '') AS context
  FROM (SELECT job_id, chunk, min(pos) AS pos FROM said GROUP BY job_id, chunk) n
  LEFT JOIN said p ON p.job_id = n.job_id AND p.pos BETWEEN n.pos - 5 AND n.pos - 1
  GROUP BY n.job_id, n.chunk)
"""


def _chunks(v):
    return t.chunk_segments(v.lines)


@query("chunk_segments", CHUNKS + "SELECT job_id, seq, chunk, id FROM chunks")
def _(v):
    return _chunks(v).select("job_id", "seq", "chunk", "id")


@query("chunk_context", REQUESTS + "SELECT * FROM contexts")
def _(v):
    return t.chunk_context(_chunks(v))


@query("build_requests", REQUESTS + """
SELECT c.job_id, c.chunk, count(*) AS n_items, sum(c.id)::BIGINT AS id_sum,
       sum(greatest(2, round_even((c.end_time - c.start_time) * 5.5::DOUBLE, 0)))::BIGINT AS words_sum,
       string_agg(coalesce(c.speaker, 'UNKNOWN') || ':' || c.original_text, '|' ORDER BY c.id) AS item_texts,
       CASE WHEN any_value(x.context) = '' THEN 'None' ELSE any_value(x.context) END AS context, 'vi' AS variant
FROM chunks c JOIN contexts x ON x.job_id = c.job_id AND x.chunk = c.chunk GROUP BY c.job_id, c.chunk""")
def _(v):
    requests = t.build_requests(_chunks(v), "Tiếng Việt (VN)", "plain")
    items = requests.withColumn("_i", F.from_json(
        "items", "array<struct<id:bigint,speaker:string,max_words:bigint,text:string>>"))
    total = lambda field: F.aggregate(F.transform("_i", lambda i: i[field]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return items.select(
        "job_id", "chunk", "n_items", total("id").alias("id_sum"), total("max_words").alias("words_sum"),
        F.array_join(F.transform("_i", lambda i: F.concat(i["speaker"], F.lit(":"), i["text"])), "|").alias("item_texts"),
        "context", "variant")


def _echo(request: dict) -> str:
    """A deterministic stand-in for a model: some requests fail, some items are left out."""
    items = json.loads(request["items"])
    if len(items) > 1 and request["chunk"] % 5 == 4:
        raise RuntimeError("no answer")
    if len(items) == 1 and len(items[0]["text"]) % 3 == 0:
        raise RuntimeError("no answer")
    kept = [i for i in items if len(items) == 1 or i["id"] % 7 != 3]
    return "Here: " + json.dumps([{"id": i["id"], "translated": "x " + i["text"]} for i in kept], ensure_ascii=False)


def _echo_json(request: dict) -> str:
    return _echo(request).removeprefix("Here: ")


@query("batch_infer", CHUNKS + """
, sized AS (SELECT *, count(*) OVER (PARTITION BY job_id, chunk) AS n FROM chunks)
SELECT job_id, chunk, id, 'x ' || original_text AS translated FROM sized
WHERE CASE WHEN n > 1 AND chunk % 5 <> 4 THEN id % 7 <> 3 ELSE length(original_text) % 3 <> 0 END""")
def _(v):
    requests = t.build_requests(_chunks(v), "vi", "plain")
    return t.parse_responses(t.batch_infer(requests, _echo_json))


# One answer per chunk, made by Spark from the lines: string ids, repeated ids, strays, empty translations.
def _answers(v):
    entry = F.when(F.col("id") % 7 == 3, F.lit('"just text"')).otherwise(F.concat(
        F.lit('{"id": '), F.when(F.col("id") % 5 == 1, F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"')))
        .when(F.col("id") % 5 == 2, F.concat(F.col("id").cast("string"), F.lit(".75")))
        .when(F.col("id") == 13, "null").otherwise(F.col("id").cast("string")),
        # Of a repeated key the last value counts.
        F.when(F.col("id") % 4 == 2, F.lit(', "translated": "first"')).otherwise(""), F.lit(', "translated": '), F.when(F.col("id") % 11 == 4, '""').otherwise(F.to_json(F.struct("original_text")).substr(
            F.lit(18), F.length(F.to_json(F.struct("original_text"))) - 18)), F.lit("}")))
    again = F.when(F.col("id") == 5, F.lit(', {"id": 5, "translated": "again"}')).otherwise("")
    entries = _chunks(v).select("job_id", "chunk", "id", F.concat(entry, again).alias("entry"))
    grouped = entries.groupBy("job_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "entry"))).alias("_e"))
    whole = F.concat(F.lit("Sure:\n["), F.array_join(F.col("_e.entry"), ",\n"), F.lit("]"))
    return grouped.select("job_id", "chunk", F.when((F.col("chunk") + F.col("job_id")) % 6 == 5, "[{broken").otherwise(whole).alias("response"))


PARSED = CHUNKS + """, parsed AS (
SELECT job_id, chunk, id, CASE WHEN id = 5 THEN 'again' ELSE original_text END AS translated FROM chunks
WHERE (chunk + job_id) % 6 <> 5 AND id % 7 <> 3 AND id % 11 <> 4 AND id <> 13 AND id % 5 <> 2 OR
      (chunk + job_id) % 6 <> 5 AND id % 7 <> 3 AND id % 11 <> 4 AND id % 5 = 2)
"""


@query("parse_responses", PARSED + "SELECT * FROM parsed")
def _(v):
    return t.parse_responses(_answers(v))


@query("unread_responses", CHUNKS + """
SELECT DISTINCT job_id, chunk, 'not readable as JSON' AS reason FROM chunks WHERE (chunk + job_id) % 6 = 5""")
def _(v):
    return t.unread_responses(_answers(v))


@query("align_translations", PARSED + """
SELECT c.job_id, c.seq, c.chunk, c.id, coalesce(p.translated, c.original_text) AS translated_text, p.id IS NULL AS is_missing
FROM chunks c LEFT JOIN parsed p ON p.job_id = c.job_id AND p.chunk = c.chunk AND p.id = c.id""")
def _(v):
    return t.align_translations(_chunks(v), t.parse_responses(_answers(v))).select(
        "job_id", "seq", "chunk", "id", "translated_text", "is_missing")


@query("missing_items", PARSED + """
SELECT job_id, seq, chunk, id FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE p.job_id = c.job_id AND p.chunk = c.chunk AND p.id = c.id)""")
def _(v):
    return t.missing_items(_chunks(v), t.parse_responses(_answers(v))).select("job_id", "seq", "chunk", "id")


_TRIM = f"'^{SPACE}+|{SPACE}+$', '', 'g'"


@query("translation_gate", with_views("segments") + f""",
all_jobs AS (SELECT DISTINCT job_id FROM segments UNION ALL SELECT DISTINCT -1 - job_id FROM segments WHERE job_id % 10 = 0),
marked AS (SELECT job_id, CASE WHEN coalesce(translated_text, '') = '' OR
    regexp_replace(translated_text, {_TRIM}) = regexp_replace(original_text, {_TRIM}) THEN 1 ELSE 0 END AS bad
  FROM segments WHERE seq > 0 OR job_id % 2 = 0)
SELECT j.job_id, count(m.job_id) AS total, coalesce(sum(bad), 0)::BIGINT AS untranslated,
       CASE WHEN count(m.job_id) > 0 AND count(m.job_id) = sum(bad) THEN 'FAILED' WHEN sum(bad) > 0 THEN 'PARTIAL' ELSE 'OK' END AS gate
FROM all_jobs j LEFT JOIN marked m ON m.job_id = j.job_id GROUP BY j.job_id""")
def _(v):
    segments = v.segments
    jobs = segments.select("job_id").union(segments.filter("job_id % 10 = 0").select((-1 - F.col("job_id")).alias("job_id")))
    return t.translation_gate(segments.filter("seq > 0 OR job_id % 2 = 0"), jobs)


@query("script_leak", with_views("segments") + f"""
SELECT job_id, count(*) AS total, count(*) FILTER (regexp_matches(coalesce(translated_text, ''), '{WRONG_SCRIPT}')) AS leaking
FROM segments GROUP BY job_id""")
def _(v):
    return t.script_leak(v.segments)


@query("repair_script_leak", with_views("segments") + f""",
again AS (SELECT job_id, seq, CASE WHEN seq % 2 = 0 THEN concat('clean ', original_text) ELSE '好' END AS said FROM segments WHERE job_id % 3 <> 0),
leaky AS (SELECT *, regexp_matches(coalesce(translated_text, ''), '{WRONG_SCRIPT}') AS was_leaking FROM segments),
stripped AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translated_text, '{WRONG_SCRIPT}', '', 'g'),
    '{SPACE}+([,.;:!?])', '\\1', 'g'), '{SPACE}{{2,}}', ' ', 'g'), {_TRIM}) AS bare FROM leaky)
SELECT s.job_id, s.seq, was_leaking,
       CASE WHEN NOT was_leaking THEN translated_text
            WHEN coalesce(said, '') <> '' AND NOT regexp_matches(said, '{WRONG_SCRIPT}') THEN said ELSE bare END AS translated_text
FROM stripped s LEFT JOIN again a ON a.job_id = s.job_id AND a.seq = s.seq""")
def _(v):
    again = v.sql("""SELECT job_id, seq, CASE WHEN seq % 2 = 0 THEN concat('clean ', original_text) ELSE '好' END AS translated_text
                     FROM segments WHERE job_id % 3 <> 0""", "segments")
    return t.repair_script_leak(v.segments, again).select("job_id", "seq", "was_leaking", "translated_text")


_UNITS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Tiếng Việt' WHEN 1 THEN 'English (US)' WHEN 2 THEN 'Português (Brasil)' ELSE lang END AS target_lang,
    substr(text, 1, 60) AS target_style FROM docs"""


@query("cache_key", with_views("docs") + f""", units AS ({_UNITS})
SELECT doc_id, regexp_replace(lower(target_lang), '[^\\p{{L}}\\p{{N}}_]', '_', 'g') AS lang_key,
       substr(regexp_replace(lower(target_style), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 1, 24) AS style_key FROM units""")
def _(v):
    return t.with_cache_key(v.sql(_UNITS, "docs")).select("doc_id", "lang_key", "style_key")


_STAGED = "SELECT job_id, stage, seq FROM segments, (SELECT 'transcribe' AS stage UNION ALL SELECT 'translate' UNION ALL SELECT 'synthesize') s"


@query("pending_work", with_views("segments") + f""", units AS ({_STAGED})
SELECT * FROM units WHERE NOT (stage = 'transcribe' OR stage = 'translate' AND (job_id + seq) % 3 = 0)""")
def _(v):
    units = v.sql(_STAGED, "segments")
    done = units.filter("stage = 'transcribe' OR stage = 'translate' AND (job_id + seq) % 3 = 0")
    return t.pending_work(units, done, ["job_id", "stage", "seq"])


_DOCS = """SELECT job_id, seq, start_time, end_time, speaker, CASE WHEN seq % 5 = 3 THEN '  ' ELSE concat('  ', original_text, chr(10)) END AS text,
                  cast(floor(seq / 500) AS bigint) AS part FROM lines"""


def _documents(v):
    """Transcript documents as the recogniser writes them, up to 500 turn numbers each; every other one is a bare list."""
    line = F.struct("seq", F.when(F.col("seq") % 9 != 0, F.col("start_time")).alias("start"), F.col("end_time").alias("end"), "text", "speaker")
    grouped = v.sql(_DOCS, "lines").groupBy("job_id", "part").agg(F.sort_array(F.collect_list(line)).alias("_l"))
    bare = F.transform("_l", lambda s: s.dropFields("seq"))
    document = F.when(F.col("part") % 2 == 0, F.to_json(F.struct(bare.alias("segments")))).otherwise(F.to_json(bare))
    return grouped.select((F.col("job_id") * 1000000 + F.col("part")).alias("job_id"), document.alias("document"))


@query("read_transcripts", with_views("lines") + f""", raw AS ({_DOCS}),
kept AS (SELECT * FROM raw WHERE trim(text) <> '')
SELECT job_id * 1000000 + part AS job_id, row_number() OVER (PARTITION BY job_id, part ORDER BY seq) - 1 AS seq,
       CASE WHEN seq % 9 = 0 THEN 0 ELSE start_time END AS start_time, end_time,
       regexp_replace(text, {_TRIM}) AS original_text, speaker FROM kept""")
def _(v):
    # Written as files first, one for each document, and read as such.
    folder = f"{shared_dir(v.spark)}/transcripts-{uuid.uuid4().hex}"
    named = _documents(v).select(F.concat(F.col("job_id").cast("string"), F.lit(".json")).alias("filename"), F.col("document").cast("binary").alias("content"))
    with_content(named, folder)
    job = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("bigint")
    return files.read_transcripts(v.spark, folder, job).drop("translated_text")


# Every third document is spoilt in one way or another.
_SPOIL = """CASE job_id % 12 WHEN 0 THEN left(document, length(document) - 2) WHEN 3 THEN '{"other": 1}' WHEN 6 THEN '' WHEN 9 THEN NULL ELSE document END"""


def _numbered(v):
    """Documents with a number of their own as ``job_id``."""
    return _documents(v).selectExpr("cast(job_id / 1000000 AS bigint) * 7 + job_id % 1000000 AS job_id", "document")


@query("transcript_rejects", with_views("lines") + f""", raw AS ({_DOCS}),
numbered AS (SELECT DISTINCT job_id * 7 + part AS job_id FROM raw)
SELECT job_id, CASE job_id % 12 WHEN 0 THEN 'not readable as JSON' WHEN 3 THEN 'no segments' ELSE 'empty' END AS reject_reason, count(*) AS n
FROM (SELECT job_id * 7 + part AS job_id FROM raw GROUP BY job_id, part) WHERE job_id % 3 = 0 GROUP BY job_id""")
def _(v):
    spoilt = _numbered(v).withColumn("document", F.expr(_SPOIL))
    return files.transcript_rejects(spoilt).groupBy("job_id", "reject_reason").agg(F.count("*").alias("n"))


# Written to real files and read back.
@query("export_transcripts", with_views("lines") + """
SELECT job_id, seq, start_time, end_time, original_text, translated_text, speaker FROM lines""")
def _(v):
    path = f"{shared_dir(v.spark)}/export-{uuid.uuid4().hex}"
    files.export_transcripts(v.lines, path, buckets=64)
    return files.read_export(v.spark, path, "bigint")


@query("transcript_arrays", with_views("lines") + """
SELECT job_id, count(*) AS n_lines, sum(length(original_text))::BIGINT AS chars,
       string_agg(original_text || '>' || translated_text || '>' || coalesce(speaker, 'null') || '>' || (start_time * 1000)::BIGINT, '|' ORDER BY seq) AS lines
FROM lines GROUP BY job_id""")
def _(v):
    parts = files.transcript_arrays(v.lines).withColumn("_l", F.from_json(
        "document", "array<struct<start:double,end:double,text:string,translated:string,speaker:string>>"))
    line = F.transform("_l", lambda s: F.concat_ws(
        ">", s["text"], s["translated"], F.coalesce(s["speaker"], F.lit("null")),
        F.bround(s["start"] * 1000, 0).cast("bigint").cast("string")))
    chars = F.aggregate(F.transform("_l", lambda s: F.length(s["text"])), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return parts.select("job_id", "n_lines", chars.alias("chars"), F.array_join(line, "|").alias("lines"))


@query("read_segments_job", with_views("segments") + """
SELECT job_id, id, start_time, original_text FROM segments WHERE job_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1)""")
def _(v):
    wanted = v.table("orders").filter("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("job_id"))
    return files.segments_for_jobs(v.segments, wanted).select("job_id", "id", "start_time", "original_text")


# A table of all lines, then every third job written again, and every seventh emptied.
@query("write_segments", with_views("segments") + """
SELECT job_id, seq, start_time, CASE WHEN job_id % 3 = 0 THEN concat('new ', original_text) ELSE original_text END AS original_text
FROM segments WHERE (job_id % 3 > 0 OR seq % 2 = 0) AND job_id % 7 > 0""")
def _(v):
    path = f"{shared_dir(v.spark)}/table-{uuid.uuid4().hex}"
    files.write_segments(v.segments, path)
    again = v.segments.filter("job_id % 3 = 0 AND seq % 2 = 0 AND job_id % 7 > 0").withColumn(
        "original_text", F.concat(F.lit("new "), F.col("original_text")))
    files.write_segments(again, path, jobs=v.segments.filter("job_id % 3 = 0 OR job_id % 7 = 0").select("job_id").distinct())
    return files.read_segments(v.spark, path).select("job_id", "seq", "start_time", "original_text")


def _leaky(request: dict) -> str:
    """As :func:`_echo_json`; asked in a batch, some answers hold a character of the wrong script."""
    items = json.loads(request["items"])
    answers = json.loads(_echo_json(request))
    leaks = len(items) > 1
    return json.dumps([{**a, "translated": a["translated"] + (" 好" if leaks and a["id"] % 4 == 0 else "")} for a in answers],
                      ensure_ascii=False)


@query("translate_plan", with_views("lines") + """,
flagged AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start_time - lag(end_time) OVER w <= 0.8::DOUBLE THEN 0 ELSE 1 END AS opens
  FROM lines WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM flagged),
merged AS (SELECT job_id, min(seq) AS seq, string_agg(original_text, ' ' ORDER BY seq) AS said FROM numbered GROUP BY job_id, run),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS pos FROM merged),
sized AS (SELECT *, pos // 20 AS chunk, pos % 20 AS id, count(*) OVER (PARTITION BY job_id, pos // 20) AS n FROM ranked),
asked AS (SELECT *, n > 1 AND chunk % 5 <> 4 AND id % 7 <> 3 AS in_batch FROM sized)
SELECT job_id, seq, chunk, id, CASE WHEN in_batch OR length(said) % 3 <> 0 THEN 'x ' || said ELSE said END AS translated_text,
       NOT in_batch AND length(said) % 3 = 0 AS is_missing, in_batch AND id % 4 = 0 AS was_leaking FROM asked""")
def _(v):
    return translate(v.lines, _leaky, "Tiếng Việt", "plain").select(
        "job_id", "seq", "chunk", "id", "translated_text", "is_missing", "was_leaking")
