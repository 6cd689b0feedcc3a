"""Ordered work over groups of any size.

A window over ``partitionBy(job)`` puts one job into one task, and one job may
hold a third of all rows. The helpers here cut every group into blocks of its
order column, do the ordered work inside each block, and hand on only one small
summary row per block. The wide rows are shuffled once, by (group, block); the
last window of each helper sees one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

ROWS = 65_536
COPIES = 64


def block_of(order: Column, size: int | None = None) -> Column:
    """Block number of a whole-number order column."""
    return F.floor(order / F.lit(size or ROWS)).cast("bigint")


def fits_broadcast(df: DataFrame) -> bool:
    """Is Spark's own size estimate of ``df`` within its broadcast limit?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: str | list[str],
           how: str = "inner") -> DataFrame:
    """Join ``rows`` to a table with few rows per key, whatever share one key has.

    If Spark's estimate allows a broadcast of ``per_key``, it is broadcast: rows are
    not shuffled and no key is hot. It is said outright, because the estimate of ``rows``
    does not count what an ``explode`` adds and may be the smaller one. Beyond that size the rows of a key
    are dealt out over :data:`COPIES` shares by a hash of their ``spread`` columns
    and every share gets its copy of the other side; shares that are still large
    are split further by the adaptive skew join. No task gets a whole key, and the
    result is not left partitioned by the bare key.
    """
    if fits_broadcast(per_key):
        return rows.join(F.broadcast(per_key), keys, how)
    spread = [spread] if isinstance(spread, str) else spread
    share = F.pmod(F.xxhash64(*spread), F.lit(COPIES)).cast("int")
    copies = per_key.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("_share", share).join(copies, [*keys, "_share"], how).drop("_share")


def lookup_many(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join like :func:`lookup`, for a ``per_key`` whose keys grow with the rows: no side is broadcast by its estimate.

    Both sides are shuffled. A key of more than :data:`ROWS` rows is dealt out over :data:`COPIES` shares, all others are
    one. ``rows`` is read once more to count; the hot keys, at most one for so many rows, are what is broadcast.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > ROWS).select(*keys, F.lit(COPIES - 1).alias("_top"))
    share = F.when(F.col("_top").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(COPIES))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_share", share).drop("_top")
    copies = per_key.join(F.broadcast(hot), keys, "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.coalesce("_top", F.lit(0))))).drop("_top")
    return dealt.join(copies.hint("merge"), [*keys, "_share"]).drop("_share")


def up_to_here(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, how: str, name: str,
            block: Column) -> DataFrame:
    """Adds the running ``sum`` or ``max`` of ``value`` within ``keys``."""
    fold = {"sum": F.sum, "max": F.max}[how]
    part = [*keys, "_block"]
    # Said outright: rows that come in partitioned by a bare key would keep the whole group in one task.
    rows = df.withColumn("_block", block).withColumn("_value", value).repartition(*part)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*part).agg(fold("_value").alias("_total"))
        .select(*part, fold("_total").over(before).alias("_carry"))
    )
    here = fold("_value").over(up_to_here(part, order))
    if how == "sum":
        result = F.coalesce(here, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        result = F.greatest(here, F.col("_carry"))
    return rows.join(carry, part).withColumn(name, result).drop("_block", "_value", "_carry")


def following(df: DataFrame, keys: list[str], order: str, name: str, block: Column) -> DataFrame:
    """Adds the next value of ``order`` within ``keys``; ``order`` is unique per key."""
    part = [*keys, "_block"]
    rows = df.withColumn("_block", block).repartition(*part)
    firsts = rows.groupBy(*part).agg(F.min(order).alias("_first"))
    after = Window.partitionBy(*keys).orderBy("_block")
    carry = firsts.select(*part, F.lead("_first").over(after).alias("_carry"))
    here = F.lead(order).over(Window.partitionBy(*part).orderBy(order))
    return rows.join(carry, part).withColumn(name, F.coalesce(here, F.col("_carry"))).drop("_block", "_carry")


def merge_runs(rows: DataFrame, keys: list[str], order: str,
               starts_new: Callable[[Window], Column],
               merge: Callable[[GroupedData], DataFrame], block: Column) -> DataFrame:
    """Merge neighbouring rows into runs (gaps and islands).

    ``starts_new(window)`` tells whether a row opens a new run, looking back
    with ``lag``. ``merge`` turns the rows of a run into one row with the same
    columns, so that runs can be merged again: runs are first built inside each
    block; then only the first and the last run of every block, which may go on
    in a neighbouring block, are merged across blocks.
    """
    part = [*keys, "_block"]
    # Said outright, because rows that are already partitioned by a bare key (after a
    # join, say) would otherwise be left there, with the whole group in one task.
    placed = rows.withColumn("_block", block).repartition(*part)
    pieces = _runs(placed, part, order, starts_new, merge)
    pieces = pieces.withColumn("_last", F.max("_run").over(Window.partitionBy(*part)))
    at_edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    inner = pieces.filter(~at_edge).drop("_block", "_run", "_last")
    # A block's last run follows its first only if nothing lies between, and even
    # then it was split off inside the block; so it always opens a new run.
    split_off = F.col("_run") > 1
    edges = _runs(
        pieces.filter(at_edge).withColumn("_split_off", split_off).drop("_block", "_run", "_last"),
        keys, order, lambda w: F.col("_split_off") | starts_new(w), merge,
    ).drop("_run")
    return inner.unionByName(edges)


def _runs(rows, part, order, starts_new, merge):
    opens = F.coalesce(starts_new(Window.partitionBy(*part).orderBy(order)), F.lit(True))
    numbered = (
        rows.withColumn("_opens", opens.cast("bigint"))
        .withColumn("_run", F.sum("_opens").over(up_to_here(part, [order])))
    )
    return merge(numbered.groupBy(*part, "_run"))
