"""Media files: listing without reading them, and the check of their first bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.operators.ingest import has_media_extension

HEADER_BYTES = 12
STORE_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: Entries of a folder that a task hands on at once.
LISTED = 10_000


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All files in ``folder`` itself, not in folders below: ``path, filename, modified_at, length``. Hidden names are left out.

    The folder is listed when the table is read, each time anew; persist it where it is read more than once. One task
    walks the folder and hands on its entries in small pieces, and rows are dealt out from there: neither the driver nor
    that task holds the list. Spark's own file source would hold all of it in the driver and make a task of every 32 files.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(folder)
    root = system.makeQualified(place).toString().rstrip("/")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import batched
        from urllib.parse import quote

        from pyarrow import fs

        for _ in batches:
            for piece in batched(_entries(*_system(root, fs, quote)), LISTED):
                yield pd.DataFrame(piece, columns=["filename", "ms", "length"])

    found = spark.range(0, 1, 1, 1).mapInPandas(walk, "filename string, ms long, length long")
    dealt = found.repartition(2 * spark.sparkContext.defaultParallelism, "filename")
    return dealt.select(F.concat(F.lit(root + "/"), "filename").alias("path"), "filename", F.timestamp_millis("ms").alias("modified_at"), "length")


def _entries(system, inner: str) -> Iterator[tuple[str, int, int]]:
    """Name, time in ms and length of the files right in a folder."""
    from pyarrow import fs

    def hidden(name: str) -> bool:
        return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inner) as entries:
            for entry in entries:
                try:
                    if not hidden(entry.name) and entry.is_file():
                        about = entry.stat()
                        yield entry.name, about.st_mtime_ns // 1_000_000, about.st_size
                except FileNotFoundError:  # gone since the walk began
                    continue
    else:
        for about in system.get_file_info(fs.FileSelector(inner)):
            if about.type == fs.FileType.File and not hidden(about.base_name):
                yield about.base_name, (about.mtime_ns or 0) // 1_000_000, about.size


def scan_media(spark: SparkSession, folder: str) -> DataFrame:
    """The media files of :func:`list_folder`, by their names."""
    return list_folder(spark, folder).filter(has_media_extension(F.col("filename")))


def with_header(media: DataFrame) -> DataFrame:
    """Adds ``head``, the first bytes of each file, or ``read_error``. Tasks open the files of their
    own rows and read a few bytes of each, however large it is."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        from pyarrow import fs

        def first_bytes(path: str) -> tuple[bytes | None, str | None]:
            try:
                system, inner = _system(path, fs, quote)
                with system.open_input_stream(inner) as stream:
                    return stream.read(HEADER_BYTES), None
            except (OSError, ValueError) as problem:
                return None, str(problem)

        for batch in batches:
            heads, errors = zip(*map(first_bytes, batch["path"])) if len(batch) else ((), ())
            yield batch.assign(head=list(heads), read_error=list(errors))

    slim = media.select("path", "filename", "length")
    return slim.mapInPandas(read, "path string, filename string, length bigint, head binary, read_error string")


def with_content(files: DataFrame, folder: str) -> None:
    """Writes ``filename, content`` as one file each into ``folder``; tasks write their own rows, and a repeated task the same files again."""
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        from pyarrow import fs

        system, inner = _system(folder, fs, quote)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"]):
                with system.open_output_stream(f"{inner}/{name}") as stream:
                    stream.write(bytes(content))
            yield batch[["filename"]]

    written = files.select("filename", "content").repartition("filename").mapInPandas(put, "filename string")
    written.write.format("noop").mode("overwrite").save()
    spark = files.sparkSession
    make_folder(spark, folder)


def make_folder(spark: SparkSession, folder: str) -> None:
    """An empty folder, where no file made one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def _system(path: str, fs, quote):
    """The file system of ``path`` as tasks open it, and the path there."""
    # Spark's names of object stores that have another one here.
    for theirs, ours in STORE_SCHEMES.items():
        if path.startswith(theirs):
            path = ours + path[len(theirs):]
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def validate_media(headers: DataFrame, max_bytes: int = fixed.MAX_MEDIA_BYTES) -> DataFrame:
    """``is_valid`` and ``reject_reason`` from ``head`` (first bytes) and ``length``."""
    head = F.col("head")
    kinds = [F.lit(bytearray(t, "ascii")) for t in fixed.MP4_BOX_TYPES]
    mp4 = F.substring(head, 5, 4).isin(*kinds)
    matroska = F.substring(head, 1, 4) == F.unhex(F.lit(fixed.EBML_MAGIC))
    avi = (F.substring(head, 1, 4) == F.lit(bytearray(b"RIFF"))) & (F.substring(head, 9, 4) == F.lit(bytearray(b"AVI ")))
    known = (F.length(head) >= HEADER_BYTES) & (mp4 | matroska | avi)
    unread = F.col("read_error").isNotNull() if "read_error" in headers.columns else F.lit(False)
    reason = (
        F.when(~has_media_extension(F.col("filename")), "unsupported extension").when(unread, "not readable")
        .when(~F.coalesce(known, F.lit(False)), "not a known container")
        .when(F.col("length") > max_bytes, "too large")
    )
    return headers.withColumn("reject_reason", reason).withColumn("is_valid", F.col("reject_reason").isNull()).drop("head")
