"""Queries on media files, ingest decisions and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.jobs import LATEST
from segmentlab.checks.views import with_views
from segmentlab.operators import quality as q
from segmentlab.operators.ingest import watch_eligible, watch_summary
from segmentlab.session import shared_dir
from segmentlab.sources.media import list_folder, scan_media, validate_media, with_content, with_header
from segmentlab.sources.voices import read_voices
from segmentlab.streaming.watch import _bucket as watch_bucket
from segmentlab.streaming.watch import job_log, watch_batch

_WATCHED = """SELECT filename, cast('1998-01-01 00:00:00' AS timestamp) + INTERVAL '1' SECOND * (n % 100 * 20) AS modified_at FROM files"""
_COPIES = """SELECT filename, cast('1998-01-01 00:00:00' AS timestamp) + INTERVAL '1' SECOND * (n % 100 * 20 + n % 3 - 1) AS modified_at FROM files WHERE n % 4 = 1"""
_NOW = "1998-01-01 00:16:42"
DECIDED = with_views("jobs", "files") + f""", {LATEST}, watched AS ({_WATCHED}), copies AS ({_COPIES}),
decided AS (SELECT w.filename, CASE WHEN NOT regexp_matches(lower(w.filename), '\\.(mp4|mkv|avi|mov|webm)$') THEN 'ignore'
    WHEN l.status <> 'FAILED' THEN 'skip_job' WHEN w.modified_at <= c.modified_at THEN 'skip_copy'
    WHEN w.modified_at > TIMESTAMP '{_NOW}' - INTERVAL 5 SECOND THEN 'defer' ELSE 'import' END AS decision
  FROM watched w LEFT JOIN latest l ON l.filename = w.filename LEFT JOIN copies c ON c.filename = w.filename)
"""


def _decided(v):
    return watch_eligible(v.sql(_WATCHED, "files"), v.jobs, v.sql(_COPIES, "files"), F.lit(_NOW).cast("timestamp"))


@query("watch_eligible", DECIDED + "SELECT * FROM decided")
def _(v):
    return _decided(v)


@query("watch_summary", DECIDED + """SELECT count(*) FILTER (decision = 'import') AS imported, count(*) FILTER (decision LIKE 'skip%') AS skipped,
    count(*) FILTER (decision = 'defer') AS deferred FROM decided""")
def _(v):
    return watch_summary(_decided(v))


# Files of every container kind, a wrong one, and one cut short; the limit is 40 bytes.
@query("media_header_valid", with_views("files") + """, judged AS (SELECT filename, CASE WHEN filename LIKE '%.txt' THEN 'unsupported extension'
    WHEN n % 8 >= 5 THEN 'not a known container' WHEN 12 + n % 60 > 40 THEN 'too large' END AS reject_reason FROM files)
SELECT filename, reject_reason, reject_reason IS NULL AS is_valid FROM judged""")
def _(v):
    head = F.expr("""CASE n % 8 WHEN 0 THEN '000000206674797069736f6d' WHEN 1 THEN '00000008776964650000002A'
        WHEN 2 THEN '1A45DFA3A34286810142F781' WHEN 3 THEN '52494646AABBCCDD41564920' WHEN 4 THEN '000000086D64617400000000'
        WHEN 5 THEN '52494646AABBCCDD57415645' WHEN 6 THEN '0000002066747970' ELSE 'FFD8FFE000104A4649460001' END""")
    padding = F.when(F.col("n") % 8 == 6, "").otherwise(F.expr("repeat('00', cast(n % 60 AS int))"))
    folder = f"{shared_dir(v.spark)}/heads-{uuid.uuid4().hex}"
    with_content(v.files.select("filename", F.unhex(F.concat(head, padding)).alias("content")), folder)
    return validate_media(with_header(list_folder(v.spark, folder)), 40).select("filename", "reject_reason", "is_valid")


_EXPECTED = "SELECT n AS asset, filename AS path FROM files"
_LISTING = "SELECT filename AS path, CASE WHEN n % 9 = 0 THEN cast(0 AS bigint) ELSE n + 1 END AS length FROM files WHERE n % 5 <> 2"
VALID = f"""valid AS (SELECT asset, l.path IS NOT NULL AND length > 0 AS file_valid,
    CASE WHEN l.path IS NULL THEN 'file not found' WHEN length = 0 THEN 'file empty' ELSE 'ok' END AS file_reason
  FROM ({_EXPECTED}) e LEFT JOIN (SELECT path, max(length) AS length FROM ({_LISTING}) x GROUP BY path) l ON l.path = e.path)"""
SILENT = """loud AS (SELECT asset, sqrt(avg(value * value)) AS rms, sqrt(avg(value * value)) >= 0.001::DOUBLE AS not_silent FROM series GROUP BY asset)"""
_PAIRS = """SELECT asset, cast(count(*) AS double) AS original_duration, CASE WHEN asset % 13 = 0 THEN cast(0 AS double) ELSE cast(20 + asset % 50 AS double) END AS new_duration
    FROM series GROUP BY asset"""
STRETCH = f"""pairs AS ({_PAIRS}), stretched AS (SELECT *, CASE WHEN new_duration > 0 THEN original_duration / new_duration END AS stretch,
    CASE WHEN new_duration > 0 THEN original_duration / new_duration <= 1.5 ELSE false END AS stretch_ok FROM pairs)"""


@query("file_valid", with_views("files") + f", {VALID} SELECT * FROM valid")
def _(v):
    return q.file_valid(v.sql(_EXPECTED, "files"), v.sql(_LISTING, "files"))


@query("not_silent", with_views("series") + f", {SILENT} SELECT asset, round(rms, 9) AS rms, not_silent FROM loud")
def _(v):
    return q.not_silent(v.series).withColumn("rms", F.round("rms", 9))


@query("stretch_within", with_views("series") + f", {STRETCH} SELECT * FROM stretched")
def _(v):
    return q.stretch_within(v.sql(_PAIRS, "series"))


@query("gate_report", with_views("files", "series") + f""", {VALID}, {SILENT}, {STRETCH}
SELECT asset, coalesce(file_valid, false) AS file_valid, coalesce(not_silent, false) AS not_silent, coalesce(stretch_ok, false) AS stretch_ok,
       CASE WHEN file_valid AND not_silent AND stretch_ok THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM valid FULL JOIN loud USING (asset) FULL JOIN stretched USING (asset)""")
def _(v):
    return q.gate_report(
        (q.file_valid(v.sql(_EXPECTED, "files"), v.sql(_LISTING, "files")), "file_valid"),
        (q.not_silent(v.series), "not_silent"), (q.stretch_within(v.sql(_PAIRS, "series")), "stretch_ok"))


def _dropped(v) -> tuple[str, str, str]:
    """Small media files of all names in a folder of their own, with places for copies and for the ledger. Files are written by tasks."""
    root = f"{shared_dir(v.spark)}/watch-{uuid.uuid4().hex}"
    names = v.files
    with_content(names.select("filename", F.expr("unhex(repeat('00', cast(n % 5 + 1 AS int)))").alias("content")), f"{root}/folder")
    return root, f"{root}/folder", f"{root}/copies"


_SEEN = "SELECT filename, n FROM files"


@query("scan_media", with_views("files") + f""", seen AS ({_SEEN})
SELECT filename, n % 5 + 1 AS length FROM seen WHERE regexp_matches(lower(filename), '\\.(mp4|mkv|avi|mov|webm)$')""")
def _(v):
    _, folder, _ = _dropped(v)
    return scan_media(v.spark, folder).select("filename", "length")


# Three looks at one folder: nothing is settled yet; all is; and the second look once more, which changes nothing. Then half of the jobs have failed
# and their files are newer than the copies; those are taken in again.
@query("watch_stream", with_views("files") + f""", seen AS ({_SEEN}), media AS (SELECT * FROM seen WHERE regexp_matches(lower(filename), '\\.(mp4|mkv|avi|mov|webm)$')),
twice AS (SELECT filename, 1 AS look FROM media UNION ALL SELECT filename, 3 FROM media WHERE n % 2 = 0)
SELECT filename, 'QUEUED' AS status, 'Tiếng Việt' AS target_lang, 'Tiêu chuẩn' AS target_style, '16gb' AS vram_profile, false AS enable_lipsync, true AS enable_ocr, 'blur' AS ocr_mode,
       'multi' AS voice_mode, '' AS voice_preset, true AS auto_resume, look FROM twice""")
def _(v):
    root, folder, copies = _dropped(v)
    with_content(v.sql("SELECT filename FROM files WHERE n < 0", "files").withColumn("content", F.lit(b"")), copies)
    log = f"{root}/jobs"
    later = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    settings = {"enable_ocr": True}
    watch_batch(v.spark, folder, copies, log, 0, settle=600, settings=settings)
    for _ in range(2):
        watch_batch(v.spark, folder, copies, log, 1, settle=600, settings=settings, now=later)
    failed = job_log(v.spark, log).join(v.sql("SELECT filename FROM files WHERE n % 2 = 0", "files").hint("merge"), "filename", "left_semi")
    failed = failed.select(*(c for c in job_log(v.spark, log).columns)).withColumn("status", F.lit("FAILED")).withColumn("created_at", later + F.expr("INTERVAL 1 HOUR"))
    failed.withColumn("name_bucket", watch_bucket(F.col("filename"))).repartition("name_bucket").write.partitionBy("name_bucket").parquet(f"{log}/batch=2")
    for _ in range(2):
        watch_batch(v.spark, folder, copies, log, 3, settle=600, settings=settings, now=later + F.expr("INTERVAL 2 HOURS"))
    rows = v.spark.read.parquet(log).filter("status = 'QUEUED'").withColumn("look", F.col("batch").cast("int"))
    return rows.drop("name_bucket", "batch", "job_id", "created_at", "updated_at", "results", "error")


# One voice per part, in one catalogue file.
@query("read_voices", """SELECT concat('v', p_partkey) AS id, p_name AS name, p_brand AS country, NULL::VARCHAR AS flag,
    CASE WHEN p_partkey % 2 = 0 THEN 'vi' ELSE 'en' END AS lang, 'f' AS gender FROM part""")
def _(v):
    root = f"{shared_dir(v.spark)}/voices-{uuid.uuid4().hex}"
    voice = F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("country"),
                     F.when(F.col("p_partkey") % 2 == 0, "vi").otherwise("en").alias("lang"), F.lit("f").alias("gender"), F.lit("x.wav").alias("file"), F.lit("said").alias("ref_text"))
    # A catalogue is one small document by its nature; here it is made of a dimension table.
    v.table("part").agg(F.to_json(F.struct(F.collect_list(voice).alias("voices"))).alias("value")).coalesce(1).write.text(root)
    return read_voices(v.spark, root)
