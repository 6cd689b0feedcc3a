"""The voice catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentlab.functions import fixed

_TYPE = ("voices array<struct<id:string,name:string,country:string,flag:string,lang:string,"
         "gender:string,file:string,ref_text:string,source:string>>")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """All columns, file names and reference texts included."""
    return spark.read.schema(_TYPE).json(path, multiLine=True).select(F.explode("voices").alias("_v")).select("_v.*")


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    """Public columns only."""
    return read_catalogue(spark, path).select(*fixed.PUBLIC_VOICE_FIELDS)


def usable_presets(catalogue: DataFrame, listing: DataFrame) -> DataFrame:
    """Presets whose file is in the listing (``filename``)."""
    return catalogue.join(listing.select(F.col("filename").alias("file")), "file", "left_semi").select("id", "ref_text")
