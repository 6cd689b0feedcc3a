"""Watching a folder for media files.

What was decided is kept in a ledger: one folder per look at the watched folder (its batch), inside of it one per bucket of the
file name. A look reads only the buckets of the files that it sees, and a look that takes nothing in leaves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmentlab.functions import fixed
from segmentlab.operators.ingest import watch_eligible
from segmentlab.sources.media import LISTING, scan_media
from segmentlab.sources.transcripts import exists

JOB_ROW = ("job_id string, filename string, status string, target_lang string, target_style string, vram_profile string, "
           "enable_lipsync boolean, enable_ocr boolean, ocr_mode string, voice_mode string, voice_preset string, auto_resume boolean, "
           "created_at timestamp, updated_at timestamp, results string, error string")
INTERVAL = "20 seconds"
NAME_BUCKETS = 64


def _bucket(filename: Column) -> Column:
    return F.pmod(F.xxhash64(filename), F.lit(NAME_BUCKETS)).cast("int")


def job_log(spark: SparkSession, path: str, filenames: DataFrame | None = None) -> DataFrame:
    """All job rows written so far, or those in the buckets of the given names; empty before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], JOB_ROW)
    log = spark.read.schema(f"{JOB_ROW}, batch long, name_bucket int").parquet(path)
    if filenames is not None:
        # At most NAME_BUCKETS numbers.
        seen = [r.b for r in filenames.select(_bucket(F.col("filename")).alias("b")).distinct().collect()]
        log = log.filter(F.col("name_bucket").isin(*seen)) if seen else log.limit(0)
    return log.drop("batch", "name_bucket")


def new_jobs(files: DataFrame, jobs: DataFrame, copies: DataFrame, now: Column, settle: float = 5.0,
             settings: dict[str, object] | None = None) -> DataFrame:
    """Queued job rows (:data:`JOB_ROW`) for the files to be taken in, with the watcher's ``settings`` over the published ones.

    The id is derived from name and time of the file, so the same file version always gives the same job.
    """
    chosen = watch_eligible(files, jobs, copies, now, settle).filter("decision = 'import'")
    key = F.concat_ws("|", "filename", F.unix_micros("modified_at").cast("string"))
    values = {**fixed.WATCH_SETTINGS, **(settings or {})}
    unknown = set(values) - set(fixed.WATCH_SETTINGS)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    rows = files.join(chosen.select("filename"), "filename", "left_semi").select(
        F.substring(F.sha2(key, 256), 1, 16).alias("job_id"), "filename", F.lit("QUEUED").alias("status"), *(F.lit(v).alias(k) for k, v in values.items()),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).alias("results"), F.lit(None).alias("error"))
    return rows.select(*(F.col(c).cast(t).alias(c) for c, t in (f.split() for f in JOB_ROW.split(", "))))


def watch_batch(spark: SparkSession, folder: str, input_folder: str, jobs_path: str, batch_id: int,
                settle: float = 5.0, settings: dict[str, object] | None = None, now: Column | None = None) -> None:
    """One look at the folder; new job rows go to ``jobs_path``. A batch that has been written is not decided again."""
    place = f"{jobs_path}/batch={batch_id}"
    if exists(spark, f"{place}/_SUCCESS"):
        return
    files = scan_media(spark, folder).select("filename", "modified_at").persist()
    copies = scan_media(spark, input_folder).select("filename", "modified_at").persist()
    rows = None
    try:
        # Listed once, and before anything is joined to them: Spark sees how large the lists are.
        files.count(), copies.count()
        rows = new_jobs(files, job_log(spark, jobs_path, files), copies, F.current_timestamp() if now is None else now, settle, settings).persist()
        if not rows.isEmpty():
            bucketed = rows.withColumn("name_bucket", _bucket(F.col("filename"))).repartition("name_bucket")
            bucketed.write.mode("overwrite").partitionBy("name_bucket").parquet(place)
    finally:
        for held in (rows, files, copies):
            if held is not None:
                held.unpersist()


def compact_log(spark: SparkSession, jobs_path: str, target: str) -> None:
    """The ledger as one batch of few files at ``target``; the old one stays as it is."""
    log = job_log(spark, jobs_path).withColumn("name_bucket", _bucket(F.col("filename")))
    log.repartition("name_bucket").write.mode("overwrite").partitionBy("name_bucket").parquet(f"{target}/batch=-1")


def watch_stream(spark: SparkSession, folder: str, input_folder: str, jobs_path: str, checkpoint: str,
                 settle: float = 5.0, once: bool = False, settings: dict[str, object] | None = None) -> StreamingQuery:
    """Look at ``folder`` every 20 seconds, or ``once`` at what is there.

    The file source reports a path a single time, but a file that is still being
    written, or is dropped again after its job failed, must be looked at again. So
    a clock drives the batches and every batch lists the folder; with ``once`` new
    files are the trigger. A repeated batch changes nothing.
    """
    if once:
        ticks = spark.readStream.format("binaryFile").schema(LISTING).load(folder).select("path")
        trigger = {"availableNow": True}
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("value")
        trigger = {"processingTime": INTERVAL}
    return (
        ticks.writeStream.foreachBatch(lambda _, n: watch_batch(spark, folder, input_folder, jobs_path, n, settle, settings))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
