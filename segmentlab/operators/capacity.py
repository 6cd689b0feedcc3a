"""Memory in use over time from reservation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.operators import blocks

MICROS_PER_BLOCK = 60_000_000
AMOUNT = "decimal(18,6)"


def oversized_requests(reservations: DataFrame, total_gb: float) -> DataFrame:
    """Requests that could never be granted."""
    return reservations.filter(F.col("gb") > total_gb)


def capacity_sweep(reservations: DataFrame, total_gb: float) -> DataFrame:
    """Gigabytes held per pool at every instant something changes.

    ``reservations``: ``pool, gb, acquired_us, released_us`` (microseconds; NULL
    while held). Requests above the total are left out. Changes of one instant are
    summed before the running sum, so releases and acquisitions at equal time
    net out; the running sum is cut into minutes, so a pool of any size is spread.
    """
    granted = reservations.filter(F.col("gb") <= total_gb)
    amount = F.col("gb").cast(AMOUNT)

    def change(at: str, delta: Column):
        return F.struct(F.col(at).alias("at_us"), delta.cast(AMOUNT).alias("delta"))

    moves = granted.select("pool", F.explode(F.array(
        change("acquired_us", amount), change("released_us", -amount))).alias("_m")).select("pool", "_m.*")
    net = moves.filter("at_us IS NOT NULL").groupBy("pool", "at_us").agg(F.sum("delta").alias("delta"))
    level = blocks.running(net, ["pool"], ["at_us"], F.col("delta"), "sum", "in_use",
                           blocks.block_of(F.col("at_us"), MICROS_PER_BLOCK))
    return level.select("pool", "at_us", F.col("in_use").cast("double").alias("in_use"),
                        (F.col("in_use") > total_gb).alias("is_over"))


def capacity_report(levels: DataFrame) -> DataFrame:
    """Peak and number of instants over budget per pool."""
    return levels.groupBy("pool").agg(
        F.max("in_use").alias("peak"), F.count_if("is_over").alias("over"), F.count("*").alias("instants"))
