"""From transcript lines to checked translations with the caller's model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.operators import transcripts as t
from segmentlab.session import written


def _one_by_one(lines: DataFrame, fn: Callable[[dict], str], lang: str, style: str, concurrency: int | None) -> DataFrame:
    """Answers for single lines ``job_id, chunk, id``, each asked on its own without context."""
    number = F.col("chunk") * fixed.CHUNK_SIZE + F.col("id")
    alone = lines.withColumn("chunk", number).withColumn("id", F.lit(0).cast("bigint"))
    requests = t.build_requests(alone, lang, style, window=0)
    answers = t.parse_responses(t.batch_infer(requests, fn, concurrency)).filter("id = 0")
    return answers.select(
        "job_id", F.floor(F.col("chunk") / fixed.CHUNK_SIZE).cast("bigint").alias("chunk"),
        F.pmod("chunk", F.lit(fixed.CHUNK_SIZE)).cast("bigint").alias("id"), "translated")


def translate(segments: DataFrame, fn: Callable[[dict], str], lang: str, style: str,
              concurrency: int | None = None) -> DataFrame:
    """Merge, chunk, ask, ask again for what is missing, align, and repair wrong script.

    Answers are written before they are read, so that no model call is made twice.
    Adds ``is_missing`` (the source text stands in) and ``was_leaking``.
    """
    chunks = written(t.chunk_segments(t.merge_segments(segments)), "chunks")
    first = written(t.parse_responses(t.batch_infer(t.build_requests(chunks, lang, style), fn, concurrency)), "answers")
    again = written(_one_by_one(t.missing_items(chunks, first), fn, lang, style, concurrency), "again")
    aligned = t.align_translations(chunks, first.unionByName(again))
    low = lang.lower()
    if not (low.startswith(fixed.VIETNAMESE_PREFIX) or low in fixed.VIETNAMESE_NAMES):
        return aligned.withColumn("was_leaking", F.lit(False))
    aligned = written(aligned, "aligned")
    leaking = t.flag_script_leak(aligned).filter("is_leaking")
    fresh = _one_by_one(leaking, fn, lang, style, concurrency).withColumnRenamed("translated", "translated_text")
    retold = written(fresh.join(leaking.select("job_id", "chunk", "id", "seq"), ["job_id", "chunk", "id"]), "retold")
    return t.repair_script_leak(aligned, retold)
