"""Mixing sources to target weights by hash-random order, prefix sums and an exact cut.

Every document gets a hash-random key. Within a source, documents are taken in the order of their
keys: whole epochs first, then the prefix of one more epoch whose words reach the budget exactly; the document at
the cut is taken up to it. Prefix sums are distributed: as keys are uniform, their leading
digits cut each source into ranges of even size, so a hot source is 4096 groups instead of one;
a window runs inside each range and another over the range totals.

Sources are weighed in code point order, an absent source last. A target stops at ``most`` times
its source's size; the rest is shared again by weight. That is a water level: sources sorted by
size over weight reach their limit first. An absent text has size 0. Rows that repeat a doc_id
with the same size and source are counted before any shuffle by key and handed out one after
the other. Sources without words get the target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentlab.llm.common import WORD, whole_text
from segmentlab.session import written

WEIGHTS = (5, 2, 1)
#: Times that a document may be used.
MOST = 3
#: Leading hex digits of the key that name a range.
DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source, from (source, source_size): weight and target. One row per source goes through one ordering."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    # Of sources sorted by limit over weight, those below the level are full.
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    share = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("left", left).withColumn("share", share).withColumn(
        "full", F.col("limit") * F.col("share") <= F.col("left") * F.col("weight"))
    first = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    first = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = F.when(~F.col("full"), F.struct("left", "share"))
    level = level.withColumn("open", F.first(open_, ignorenulls=True).over(first))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("open.left").cast("double") * F.col("weight") / F.col("open.share"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, digits: int = DIGITS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, epochs (full repeats)."""
    slim = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix")
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = slim.withColumn("key", key).withColumn("range", F.substring("key", 1, digits))
    words = F.col("size") * F.col("rows")
    ranges = keyed.groupBy("source", "range").agg(F.sum(words).alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("a").join(
        targets.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "range", "start", "source_size", "target")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    starts = starts.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("offset", F.coalesce(F.sum(words).over(inside), F.lit(0))).alias("a").join(
        starts.alias("b"), F.expr("a.source <=> b.source AND a.range = b.range"))
    each = placed.select("a.*", "start", "source_size", "target", "epochs", "rest",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    ahead = F.col("start") + F.col("offset") + F.col("copy") * F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return each.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), "epochs")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 3 AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER ()) - coalesce(sum(lim) OVER o, 0) AS lft, (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS share
      FROM w WINDOW o AS (ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim * share <= lft * weight AS full_ FROM l),
u AS (SELECT lft, share FROM f WHERE NOT full_ ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(lim AS DOUBLE)
             ELSE CAST((SELECT lft FROM u) AS DOUBLE) * weight / CAST((SELECT share FROM u) AS DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - ahead)) END AS taken
FROM p
"""
