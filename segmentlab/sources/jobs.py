"""Job tables written over the years: files of several schemas, read as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentlab.functions import fixed


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Columns that came later, where a row is older or leaves them empty: their published defaults."""
    for column, value in fixed.JOB_DEFAULTS.items():
        typed = F.lit(value)
        if column in jobs.columns:
            # Flags were numbers once.
            own = F.col(column).cast("boolean") if isinstance(value, bool) else F.col(column)
            typed = F.coalesce(own, typed)
        jobs = jobs.withColumn(column, typed)
    return jobs


def read_jobs(spark: SparkSession, *paths: str) -> DataFrame:
    """Job rows of all files under ``paths``, whatever columns each has.

    Files of one folder are read as one with their columns united; a column whose type changed belongs in folders of its own, as these
    are united by name after the defaults are in. No file is read more than once.
    """
    if not paths:
        raise ValueError("no path given")
    tables = [with_defaults(spark.read.option("mergeSchema", "true").parquet(p)) for p in paths]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
