"""Reviewer edits as a stream.

Accepted edits are appended to a log and laid over the segments when they are
read, so an edit costs its own size and not that of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmentlab.operators.jobs import apply_edits, last_edits
from segmentlab.sources.transcripts import BUCKETS, job_bucket


def judged_edits(batch: DataFrame, segments: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The edits with ``_known``: TRUE where their job has such a line. Of a table with ``job_bucket`` folders only those
    of the edited jobs are read; at most ``buckets`` numbers come to the driver for that."""
    lines = segments
    if "job_bucket" in segments.columns:
        touched = batch.select(job_bucket(F.col("job_id").cast(segments.schema["job_id"].dataType), buckets).alias("b")).distinct().collect()
        lines = segments.filter(F.col("job_bucket").isin(*(r.b for r in touched))) if touched else segments.limit(0)
    lines = lines.join(batch.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "id", F.lit(True).alias("_known"))
    return batch.join(lines, ["job_id", "id"], "left")


def edit_stream(edits: DataFrame, segments: DataFrame | Callable[[], DataFrame], log: str, checkpoint: str,
                trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """``edits``: ``job_id, id, seq, translated_text``. Edits of lines their job does
    not have go to ``log/rejected``, the last one per line of each batch to ``log/accepted``.

    ``segments`` may be a function: then every batch sees the lines as they are by then. Give it with ``job_bucket`` (``read_segments(…,
    with_bucket=True)``), so that a batch reads only the buckets of the jobs it edits.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        judged = judged_edits(batch, segments() if callable(segments) else segments, buckets).persist()
        try:
            last_edits(judged.filter("_known")).write.mode("overwrite").parquet(f"{log}/accepted/batch={batch_id}")
            judged.filter("_known IS NULL").select(*batch.columns).write.mode("overwrite").parquet(f"{log}/rejected/batch={batch_id}")
        finally:
            judged.unpersist()
            batch.unpersist()

    return (
        edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def edited_segments(spark: SparkSession, segments: DataFrame, log: str) -> DataFrame:
    """Segments with the accepted edits so far."""
    return apply_edits(segments, spark.read.parquet(f"{log}/accepted").drop("batch"))
