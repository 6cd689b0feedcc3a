"""Transcript lines: merge, budget, chunk, request, align, check.

Segments are rows ``job_id, seq, start_time, end_time, original_text,
translated_text, speaker``; ``(job_id, seq)`` is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from segmentlab.functions import fixed, text
from segmentlab.operators import blocks


def duration() -> Column:
    return F.col("end_time") - F.col("start_time")


def _merge_lines(lines: GroupedData) -> DataFrame:
    grouped = lines.agg(
        F.min("seq").alias("seq"),
        F.min_by("start_time", "seq").alias("start_time"),
        F.max_by("end_time", "last_seq").alias("end_time"),
        F.max("last_seq").alias("last_seq"),
        F.max("speaker").alias("speaker"),
        F.min_by("translated_text", "seq").alias("translated_text"),
        F.sum("n_lines").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("seq", "original_text", "said"))).alias("_lines"),
    )

    def joined(field: str) -> Column:
        kept = F.filter(F.transform("_lines", lambda r: r[field]), lambda t: ~text.is_blank(t))
        return F.array_join(kept, " ")

    return (
        grouped.withColumn("original_text", joined("original_text")).withColumn("said", joined("said"))
        .drop("_lines")
    )


def open_pieces(segments: DataFrame, *also: str) -> DataFrame:
    """Segments in the form runs are merged in: ``said`` gathers every non-empty
    translation, ``translated_text`` stays that of the first line."""
    return segments.select(
        "job_id", "seq", F.col("seq").alias("last_seq"), "start_time", "end_time", "original_text",
        "translated_text", F.coalesce("translated_text", F.lit("")).alias("said"), "speaker",
        F.lit(1).cast("bigint").alias("n_lines"), *also,
    )


def merge_pieces(pieces: DataFrame, max_gap: float = fixed.MAX_GAP) -> DataFrame:
    def starts_new(window):
        same_speaker = F.col("speaker").eqNullSafe(F.lag("speaker").over(window))
        near = F.col("start_time") - F.lag("end_time").over(window) <= max_gap
        return ~(same_speaker & near)

    return blocks.merge_runs(pieces, ["job_id"], "seq", starts_new, _merge_lines, blocks.block_of(F.col("seq")))


def close_pieces(pieces: DataFrame) -> DataFrame:
    translated = F.when(text.is_blank(F.col("translated_text")), F.col("translated_text")).otherwise(F.col("said"))
    return pieces.select(
        "job_id", "seq", "start_time", "end_time", "original_text",
        translated.alias("translated_text"), "speaker", "n_lines",
    )


def merge_segments(segments: DataFrame, max_gap: float = fixed.MAX_GAP) -> DataFrame:
    """Merge neighbouring lines of one speaker that are at most ``max_gap`` seconds apart.

    A missing speaker equals a missing speaker. The merged end is that of the
    last line. Translations are joined only if the first line has one. Texts
    are expected trimmed, as the reader leaves them.
    """
    return close_pieces(merge_pieces(open_pieces(segments), max_gap))


def with_word_budget(segments: DataFrame) -> DataFrame:
    """Adds ``max_words``: 5.5 words a second, half-even, at least two."""
    budget = text.half_even(F.coalesce(duration(), F.lit(0.0)) * fixed.WORDS_PER_SECOND)
    return segments.withColumn("max_words", F.greatest(F.lit(fixed.MIN_WORDS), budget).cast("bigint"))


def chunk_segments(segments: DataFrame, size: int = fixed.CHUNK_SIZE) -> DataFrame:
    """Adds ``chunk`` and ``id`` (0-based inside the chunk) by position in the job."""
    ranked = blocks.running(
        segments, ["job_id"], ["seq"], F.lit(1).cast("bigint"), "sum", "_pos", blocks.block_of(F.col("seq")))
    pos = F.col("_pos") - 1
    return (
        ranked.withColumn("chunk", F.floor(pos / size).cast("bigint"))
        .withColumn("id", F.pmod(pos, F.lit(size)).cast("bigint")).drop("_pos")
    )


def _speaker() -> Column:
    return F.when(text.is_blank(F.col("speaker")), fixed.NO_SPEAKER).otherwise(F.col("speaker"))


def _gather(chunks: DataFrame, item: Column, window: int, size: int) -> DataFrame:
    """One row per chunk with its ``items`` and the last lines of the chunk before.

    A chunk that has a successor is full, so its tail is the rows with the last
    ``window`` ids. Those rows are sent to their own chunk and to the next one:
    one shuffle, and no group holds more than ``size + window`` rows.
    """
    if window > size:
        raise ValueError("the context window may not be larger than a chunk")
    own = F.struct(F.col("chunk").alias("to"), F.lit(True).alias("own"))
    after = F.struct((F.col("chunk") + 1).alias("to"), F.lit(False).alias("own"))
    sent = chunks.withColumn("_item", item).withColumn("_send", F.explode(
        F.when(F.col("id") >= size - window, F.array(own, after)).otherwise(F.array(own))))
    line = F.struct("id", F.concat(F.lit("["), _speaker(), F.lit("] "), F.col("original_text")).alias("line"))
    is_own = F.col("_send.own")
    grouped = sent.groupBy("job_id", F.col("_send.to").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.when(is_own, F.col("_item")))).alias("items"),
        F.sort_array(F.collect_list(F.when(~is_own, line))).alias("_before"))
    return grouped.filter(F.size("items") > 0).withColumn(
        "context", F.array_join(F.col("_before.line"), "\n")).drop("_before")


def chunk_context(chunks: DataFrame, window: int = fixed.CONTEXT_LINES, size: int = fixed.CHUNK_SIZE) -> DataFrame:
    """``job_id, chunk, context``: the last source lines of the chunk before."""
    return _gather(chunks, F.struct("id"), window, size).select("job_id", "chunk", "context")


SYSTEM_TEXT = {
    "vi": "Dịch phụ đề sang {lang} theo phong cách {style}. Không vượt quá max_words. "
          "Trả về một mảng JSON gồm id và translated.",
    "other": "Translate these subtitles into {lang} in the style {style}. Stay within max_words. "
             "Answer with a JSON array of id and translated.",
}
USER_TEXT = "Context, not to be translated:\n{context}\n\nLines:\n{items}"


def _fill(template: str, **values: Column) -> Column:
    filled = F.lit(template)
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return filled


def prompt_variant(lang: Column) -> Column:
    low = F.lower(lang)
    vietnamese = low.startswith(fixed.VIETNAMESE_PREFIX) | low.isin(*fixed.VIETNAMESE_NAMES)
    return F.when(vietnamese, "vi").otherwise("other")


def build_requests(chunks: DataFrame, lang: Column | str, style: Column | str,
                   system_text: dict[str, str] | None = None, user_text: str = USER_TEXT,
                   window: int = fixed.CONTEXT_LINES, size: int = fixed.CHUNK_SIZE) -> DataFrame:
    """One row per chunk: ``items`` (JSON), ``context``, prompt ``variant`` and both texts.

    The wording of the prompts is the caller's; short defaults are supplied. ``lang``
    and ``style`` hold for all rows.
    """
    lang = F.lit(lang) if isinstance(lang, str) else lang
    style = F.lit(style) if isinstance(style, str) else style
    wording = {**SYSTEM_TEXT, **(system_text or {})}
    item = F.struct("id", _speaker().alias("speaker"), "max_words", F.col("original_text").alias("text"))
    gathered = _gather(with_word_budget(chunks), item, window, size)
    context = F.when(F.col("context") == "", fixed.NO_CONTEXT).otherwise(F.col("context"))
    full = gathered.select(
        "job_id", "chunk", F.size("items").cast("bigint").alias("n_items"), F.to_json("items").alias("items"),
        context.alias("context"), prompt_variant(lang).alias("variant"), lang.alias("lang"), style.alias("style"))
    chosen = F.when(F.col("variant") == "vi", _fill(wording["vi"], lang=F.col("lang"), style=F.col("style")))
    other = _fill(wording["other"], lang=F.col("lang"), style=F.col("style"))
    return full.withColumn("system", chosen.otherwise(other)).withColumn(
        "user", _fill(user_text, context=F.col("context"), items=F.col("items"))).drop("lang", "style")


def batch_infer(requests: DataFrame, fn: Callable[[dict], str], concurrency: int | None = None) -> DataFrame:
    """Run a caller-supplied ``fn(request) -> text`` once per request row.

    A request that raises is tried once more; after that its items are sent one
    by one and the answers are put into one array. An item that still fails is
    left out, so that :func:`align_translations` falls back to its source text.
    ``concurrency`` bounds how many requests run at the same time.
    """
    import json

    def one_by_one(request: dict) -> str:
        answers = []
        for item in json.loads(request["items"]):
            single = {**request, "items": json.dumps([{**item, "id": 0}], ensure_ascii=False), "context": fixed.NO_CONTEXT}
            try:
                reply = json.loads(fn(single))
                first = reply[0] if isinstance(reply, list) else reply
                answers.append({"id": item["id"], "translated": first["translated"]})
            except Exception:
                continue
        return json.dumps(answers, ensure_ascii=False)

    def answer(request: dict) -> str:
        for _ in range(2):
            try:
                return fn(request)
            except Exception:
                continue
        return one_by_one(request)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [answer(r) for r in batch.to_dict("records")]
            yield batch[["job_id", "chunk"]].assign(response=replies)

    spread = requests.repartition(concurrency) if concurrency else requests
    job_type = requests.schema["job_id"].dataType.simpleString()
    return spread.mapInPandas(run, f"job_id {job_type}, chunk bigint, response string")


def _entries(col: str) -> Column:
    """The JSON texts of the entries of an answer; NULL if it cannot be read."""
    span = F.regexp_extract(F.col(col), r"(?s)\[.*\]", 0)
    alone = text.strip(F.col(col))
    return F.when(span != "", F.from_json(span, "array<string>")).when(
        F.from_json(alone, "map<string,string>").isNotNull(), F.array(alone))


def parse_responses(responses: DataFrame, col: str = "response") -> DataFrame:
    """Answers as rows ``job_id, chunk, id, translated``.

    The widest ``[...]`` span is read, else the whole text; a lone object counts
    as a list of one. Entries that are no objects, have no usable id or no
    translation are skipped; of a repeated id the last entry is kept, of a repeated key in an
    entry the last value. Answers that cannot be read are in :func:`unread_responses`.
    """
    # An outer explode: a plain one makes Spark test the size first and parse every answer twice.
    exploded = responses.select("job_id", "chunk", F.posexplode_outer(_entries(col)).alias("_pos", "_text")).filter("_pos IS NOT NULL")
    typed = exploded.withColumn("_entry", F.try_parse_json("_text"))
    # An entry with a repeated key has no variant; its last values are read as text.
    again = F.from_json(F.when(F.col("_entry").isNull(), F.col("_text")), "id string, translated string")
    fields = typed.withColumn("_again", again).selectExpr(
        "job_id", "chunk", "_pos",
        "coalesce(schema_of_variant(try_variant_get(_entry, '$.id', 'variant')), CASE WHEN _again.id IN ('true', 'false') THEN 'BOOLEAN' ELSE 'TEXT' END) AS id_type",
        "coalesce(try_variant_get(_entry, '$.id', 'string'), _again.id) AS id_text",
        "coalesce(schema_of_variant(try_variant_get(_entry, '$.translated', 'variant')), CASE WHEN _again.translated IS NOT NULL THEN 'STRING' END) AS said_type",
        "coalesce(try_variant_get(_entry, '$.translated', 'string'), _again.translated) AS translated",
    )
    whole = F.expr(r"try_cast(regexp_extract(id_text, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS bigint)")
    ident = (
        F.when(F.col("id_type") == "BOOLEAN", (F.col("id_text") == "true").cast("bigint"))
        .when(F.col("id_type") == "STRING", whole)
        .otherwise(F.expr("try_cast(try_cast(id_text AS double) AS bigint)"))
    )
    usable = fields.filter(F.col("said_type") == "STRING").select(
        "job_id", "chunk", "_pos", ident.alias("id"), "translated"
    ).filter(F.col("id").isNotNull() & (F.col("translated") != ""))
    return usable.groupBy("job_id", "chunk", "id").agg(F.max_by("translated", "_pos").alias("translated"))


def unread_responses(responses: DataFrame, col: str = "response") -> DataFrame:
    """Answers of which nothing can be read: ``job_id, chunk, reason``."""
    reason = F.when(F.trim(F.coalesce(F.col(col), F.lit(""))) == "", "empty").when(_entries(col).isNull(), "not readable as JSON")
    return responses.select("job_id", "chunk", reason.alias("reason")).filter("reason IS NOT NULL")


def align_translations(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Every line with its translation; a missing one takes the source text and is flagged."""
    answers = responses.select("job_id", "chunk", "id", F.col("translated").alias("_said"))
    return (
        chunks.drop("translated_text").join(answers, ["job_id", "chunk", "id"], "left")
        .withColumn("is_missing", F.col("_said").isNull())
        .withColumn("translated_text", F.coalesce("_said", "original_text")).drop("_said")
    )


def missing_items(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Lines no answer came back for; they are sent again one by one."""
    return chunks.join(responses, ["job_id", "chunk", "id"], "left_anti")


def translation_gate(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: lines, untranslated lines, and OK / PARTIAL / FAILED. Jobs without lines are OK."""
    same = text.strip(F.col("translated_text")) == text.strip(F.coalesce("original_text", F.lit("")))
    untranslated = text.is_blank(F.col("translated_text")) | same
    counts = segments.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(untranslated).alias("untranslated"))
    full = jobs.select("job_id").distinct().join(counts, "job_id", "left").na.fill(0, ["total", "untranslated"])
    gate = (
        F.when((F.col("total") > 0) & (F.col("untranslated") == F.col("total")), "FAILED")
        .when(F.col("untranslated") > 0, "PARTIAL").otherwise("OK")
    )
    return full.withColumn("gate", gate)


def flag_script_leak(segments: DataFrame) -> DataFrame:
    return segments.withColumn("is_leaking", text.has_wrong_script(F.col("translated_text")))


def script_leak(segments: DataFrame) -> DataFrame:
    """Per job: lines and lines whose translation holds wrong-script characters."""
    return flag_script_leak(segments).groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if("is_leaking").alias("leaking"))


def repair_script_leak(segments: DataFrame, retranslations: DataFrame) -> DataFrame:
    """A leaking line takes its new translation if that is clean, else it is stripped."""
    again = retranslations.select("job_id", "seq", F.col("translated_text").alias("_again"))
    clean = ~text.is_blank(F.col("_again")) & ~text.has_wrong_script(F.col("_again"))
    repaired = F.when(clean, F.col("_again")).otherwise(text.without_wrong_script(F.col("translated_text")))
    return (
        flag_script_leak(segments).join(again, ["job_id", "seq"], "left")
        .withColumn("translated_text", F.when(F.col("is_leaking"), repaired).otherwise(F.col("translated_text")))
        .drop("_again").withColumnRenamed("is_leaking", "was_leaking")
    )


def with_cache_key(units: DataFrame, lang: str = "target_lang", style: str = "target_style") -> DataFrame:
    """Adds ``lang_key`` and ``style_key`` (24 characters)."""
    style_key = F.substring(text.slug(F.coalesce(F.col(style), F.lit(""))), 1, fixed.STYLE_KEY_CHARS)
    return units.withColumn("lang_key", text.slug(F.col(lang))).withColumn("style_key", style_key)


def pending_work(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose output does not exist yet."""
    return units.join(done.select(*keys), keys, "left_anti")
