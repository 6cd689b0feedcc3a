"""Which new files of a watched folder are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.operators.jobs import latest_job


def has_media_extension(filename: Column) -> Column:
    extension = F.lower(F.regexp_extract(filename, r"(?s)^.*[^.].*\.([^.]+)$", 1))
    return extension.isin(*fixed.MEDIA_EXTENSIONS)


def watch_eligible(files: DataFrame, jobs: DataFrame, copies: DataFrame, now: Column,
                   settle: float = 5.0) -> DataFrame:
    """Decision per watched file (``filename, modified_at``).

    ``import``; ``skip_job`` if its latest job has not failed; ``skip_copy`` if the
    copy taken before is not older; ``defer`` while it is still being written;
    ``ignore`` for other extensions. ``copies``: ``filename, modified_at``.
    """
    media = files.filter(has_media_extension(F.col("filename")))
    other = files.filter(~has_media_extension(F.col("filename"))).select("filename", F.lit("ignore").alias("decision"))
    latest = latest_job(jobs, media.select("filename")).select("filename", F.col("status").alias("_status"))
    copied = copies.groupBy("filename").agg(F.max("modified_at").alias("_copied_at"))
    age = F.unix_micros(now) - F.unix_micros("modified_at")
    decision = (
        F.when(F.col("_status") != "FAILED", "skip_job")
        .when(F.col("modified_at") <= F.col("_copied_at"), "skip_copy")
        .when(age < int(settle * 1_000_000), "defer")
        .otherwise("import")
    )
    decided = media.join(latest, "filename", "left").join(copied, "filename", "left").select(
        "filename", decision.alias("decision"))
    return decided.unionByName(other)


def watch_summary(decisions: DataFrame) -> DataFrame:
    """Counts as one row: imported, skipped, deferred."""
    return decisions.agg(
        F.count_if(F.col("decision") == "import").alias("imported"),
        F.count_if(F.col("decision").startswith("skip")).alias("skipped"),
        F.count_if(F.col("decision") == "defer").alias("deferred"))
