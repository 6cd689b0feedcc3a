"""Checks on finished assets, one row per asset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.functions import fixed


def file_valid(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected assets (``asset, path``) against a listing (``path, length``)."""
    found = listing.groupBy("path").agg(F.max("length").alias("_length"))
    reason = F.when(F.col("_length").isNull(), "file not found").when(F.col("_length") == 0, "file empty")
    return expected.join(found, "path", "left").select(
        "asset", reason.isNull().alias("file_valid"), F.coalesce(reason, F.lit("ok")).alias("file_reason"))


def not_silent(series: DataFrame, rms: float = fixed.SILENCE_RMS) -> DataFrame:
    """Root mean square of each series (``asset, value``)."""
    level = series.groupBy("asset").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return level.withColumn("not_silent", F.coalesce(F.col("rms") >= rms, F.lit(False)))


def stretch_within(pairs: DataFrame, ratio: float = fixed.MAX_STRETCH) -> DataFrame:
    """Original against new duration (``asset, original_duration, new_duration``)."""
    value = F.when(F.col("new_duration") > 0, F.col("original_duration") / F.col("new_duration"))
    return pairs.withColumn("stretch", value).withColumn(
        "stretch_ok", F.coalesce(F.col("stretch") <= ratio, F.lit(False)))


def gate_report(*checks: tuple[DataFrame, str]) -> DataFrame:
    """One row per asset with every flag and the verdict; a flag that is missing fails."""
    slim = [df.select("asset", flag) for df, flag in checks]
    flags = [flag for _, flag in checks]
    joined = reduce(lambda a, b: a.join(b, "asset", "full"), slim)
    joined = joined.select("asset", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    passed = reduce(lambda a, b: a & b, [F.col(f) for f in flags])
    return joined.withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))
