"""Transcript files in and out."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentlab.functions import text
from segmentlab.operators import blocks

# All as text, so that a number in quotes or a text without them is no reason to lose a document.
_LINE = "array<struct<start:string,`end`:string,text:string,speaker:string,translated:string>>"
_BROKEN = "_broken"
BUCKETS = 1024


def _read(documents: DataFrame, col: str) -> DataFrame:
    """Adds ``_lines`` and ``reject_reason`` (NULL where the document is readable)."""
    body = F.regexp_extract(F.col(col), r"^[\s\ufeff]*+([^\s\ufeff])", 1)  # the first character that is no space
    as_list = F.from_json(F.when(body.startswith("["), F.col(col)), _LINE)
    as_object = F.from_json(F.when(body.startswith("{"), F.col(col)), f"segments {_LINE}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    parsed = documents.withColumn("_list", as_list).withColumn("_object", as_object)
    lines = F.coalesce("_list", F.when(F.col(f"_object.{_BROKEN}").isNull(), F.col("_object.segments")))
    reason = (
        F.when(F.col(col).isNull() | (body == ""), "empty").when(F.col("_lines").isNotNull(), None)
        .when(F.col("_object").isNotNull() & F.col(f"_object.{_BROKEN}").isNull(), "no segments").otherwise("not readable as JSON"))
    return parsed.withColumn("_lines", lines).withColumn("reject_reason", reason).drop("_list", "_object")


def parse_transcripts(documents: DataFrame, col: str = "document") -> DataFrame:
    """Transcript documents, one per row with its ``job_id``, as segments.

    A document is ``{"segments": [...]}`` or a bare list. Missing times are 0,
    blank lines are dropped, texts trimmed; ``seq`` counts the lines that stay. Documents that
    cannot be read have no rows here and one in :func:`transcript_rejects`.
    """
    kept = F.filter(F.col("_lines"), lambda s: text.strip(F.coalesce(s["text"], F.lit(""))) != "")
    rows = _read(documents, col).select("job_id", F.posexplode_outer(kept).alias("seq", "_s")).filter("seq IS NOT NULL")
    return rows.select(
        "job_id", F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("_s.start").try_cast("double"), F.lit(0.0)).alias("start_time"),
        F.coalesce(F.col("_s.end").try_cast("double"), F.lit(0.0)).alias("end_time"),
        text.strip(F.col("_s.text")).alias("original_text"), F.col("_s.translated").alias("translated_text"),
        F.col("_s.speaker").alias("speaker"))


def transcript_rejects(documents: DataFrame, col: str = "document") -> DataFrame:
    """Documents that give no list of lines, with the reason: ``job_id``, other columns, ``reject_reason``."""
    return _read(documents, col).filter("reject_reason IS NOT NULL").drop(col, "_lines")


def _documents(spark: SparkSession, path: str, job_id: Column | None) -> DataFrame:
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    # The path is encoded as in a URI, where a plus is a plus.
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.substring_index(F.substring_index(place, "/", -2), "/", 1)
    return files.select((folder if job_id is None else job_id).alias("job_id"), place.alias("path"), F.col("value").alias("document"))


def read_transcripts(spark: SparkSession, path: str, job_id: Column | None = None) -> DataFrame:
    """Transcript files, one document each; the job is the file's folder unless told otherwise."""
    return parse_transcripts(_documents(spark, path, job_id))


def read_rejects(spark: SparkSession, path: str, job_id: Column | None = None) -> DataFrame:
    """The files that :func:`read_transcripts` cannot use: ``job_id, path, reject_reason``."""
    return transcript_rejects(_documents(spark, path, job_id))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """Segments as JSON, one per line: ``job_id, seq, line``."""
    line = F.struct(F.col("job_id"), F.col("seq"), F.col("start_time").alias("start"), F.col("end_time").alias("end"),
                    F.col("original_text").alias("text"), F.col("translated_text").alias("translated"), "speaker")
    return segments.select("job_id", "seq", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


def export_transcripts(segments: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Lines of :func:`transcript_lines` as text files, in order of job and number, in folders by bucket of the job.

    The form is the same for every size; a long job is several files of its bucket.
    """
    lines = transcript_lines(segments).withColumn("job_bucket", job_bucket(F.col("job_id"), buckets))
    placed = lines.repartition("job_bucket", blocks.block_of(F.col("seq"))).sortWithinPartitions("job_bucket", "job_id", "seq")
    placed.select("job_bucket", "line").write.mode("overwrite").partitionBy("job_bucket").text(path)


def read_export(spark: SparkSession, path: str, job_type: str = "string") -> DataFrame:
    """Exported lines as segments again."""
    schema = f"job_id {job_type}, seq bigint, start double, `end` double, text string, translated string, speaker string"
    rows = spark.read.schema("value string, job_bucket int").text(path).select(F.from_json("value", schema).alias("_s")).select("_s.*")
    return rows.select("job_id", "seq", F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("text").alias("original_text"),
                       F.col("translated").alias("translated_text"), "speaker")


def transcript_arrays(segments: DataFrame) -> DataFrame:
    """Whole jobs as one JSON array each, for callers that need one: ``job_id, n_lines, document``. A job is one row then."""
    line = F.struct(
        "seq", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("original_text").alias("text"),
        F.col("translated_text").alias("translated"), "speaker")
    grouped = segments.groupBy("job_id").agg(F.sort_array(F.collect_list(line)).alias("_lines"), F.count("*").alias("n_lines"))
    bare = F.transform("_lines", lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "text", "translated", "speaker")]))
    return grouped.select("job_id", "n_lines", F.to_json(bare, {"ignoreNullFields": "false"}).alias("document"))


def segments_for_jobs(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """All segments of the given jobs, by job, start and id."""
    wanted = jobs.select("job_id").distinct()
    return blocks.lookup(segments, wanted, ["job_id"], "id", "left_semi").orderBy("job_id", "start_time", "id")


def job_bucket(job: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


def write_segments(segments: DataFrame, path: str, buckets: int = BUCKETS, jobs: DataFrame | None = None, version: int | None = None) -> int:
    """Replace all rows of ``jobs`` (of the jobs in ``segments`` if not given); other jobs stay as they are. Gives the write version.

    A job of ``jobs`` without rows in ``segments`` is emptied.

    Nothing is read or rewritten: a write adds its own lines under ``lines`` and then, which makes them count, one row per
    written job under ``jobs``. Readers take the newest version of each job, so a write costs what it writes. A write that broke
    off leaves lines that nobody reads. Both parts are in folders by version (the time of writing unless given; the same one again
    replaces itself), the lines also by a hash bucket of the job; a long job is spread over several files. :func:`compact_segments` sheds old versions.
    """
    version = time.time_ns() if version is None else version
    bucket = job_bucket(F.col("job_id"), buckets).alias("job_bucket")
    lines = segments.select("*", bucket).repartition("job_bucket", blocks.block_of(F.col("seq")))
    lines.write.mode("overwrite").partitionBy("job_bucket").parquet(f"{path}/lines/write_version={version}")
    named = segments.select("job_id")
    if jobs is not None:
        named = named.unionByName(jobs.select("job_id"))
    # Thin rows: few files that hold their bucket as a column.
    named.distinct().select("job_id", bucket).write.mode("overwrite").parquet(f"{path}/jobs/write_version={version}")
    return version


def compact_segments(spark: SparkSession, path: str, target: str, buckets: int = BUCKETS) -> None:
    """The newest rows of the table at ``path`` as a new table of one version at ``target``; the old one stays as it is."""
    write_segments(read_segments(spark, path), target, buckets, version=0)


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and its path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _folder(spark, path)
    return system.exists(place)


def read_segments(spark: SparkSession, path: str, jobs: list | None = None, buckets: int = BUCKETS, with_bucket: bool = False) -> DataFrame:
    """The written segments, of each job those of its newest write; a short list of jobs reads only their buckets.

    ``with_bucket`` keeps ``job_bucket``: a filter on it reads the folders of those buckets only.
    """
    lines, known = spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/jobs")
    if jobs is not None:
        wanted = sorted({r[0] for r in spark.createDataFrame([(j,) for j in jobs], ["job_id"]).select(
            job_bucket(F.col("job_id").cast(known.schema["job_id"].dataType), buckets)).collect()})
        chosen = F.col("job_bucket").isin(*wanted) & F.col("job_id").isin(*jobs)
        lines, known = lines.filter(chosen), known.filter(chosen)
    newest = known.groupBy("job_bucket", "job_id").agg(F.max("write_version").alias("write_version"))
    current = blocks.lookup(lines, newest, ["job_bucket", "job_id", "write_version"], "seq", "left_semi").drop("write_version")
    return current if with_bucket else current.drop("job_bucket")
