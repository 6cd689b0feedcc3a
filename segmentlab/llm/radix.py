"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their leading bytes, then each group by the bytes that follow,
until a group is a single document or all its documents have ended. Two documents that
end in the same group are equal byte for byte, so no digest decides anything. The
stretch of bytes read per round grows fourfold: a text of a gigabyte takes 13 rounds, and
only documents that still share their whole prefix with another take part in a round.

A round counts each (group, bytes) pair by a partial aggregate and joins the counts to the
documents. A group of copies with a third of all rows is one row per task in the
aggregate; in the join it is split at run time, because that side is a plain sort-merge
join. Every round is written to the shared folder, so a lost executor costs one round.

Absent texts count as empty, and all empty texts are equal. Among equal texts, the row with the
most code points stays, then the smallest doc_id (an absent one last), then any one of fully
equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.llm.common import SPACE, keep_keys, row_key, whole_text
from segmentlab.session import written

#: Bytes read in the first round, and the factor from round to round.
WIDTH, GROWTH = 64, 4
_REST = 2**31 - 1
_KEYS = ["g", "p", "head", "ended"]


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """Cuts the next ``width`` bytes off the rest of each document."""
    return (rows.withColumn("ended", F.octet_length("rest") <= width)
            .withColumn("head", F.substring("rest", 1, width))
            .withColumn("rest", F.substring("rest", width + 1, _REST)))


def _shared(parts: DataFrame, *more) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(F.count("*").alias("n"), *more)


def radix_groups(docs: DataFrame, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    """One row per document: rid, doc_id, n_points, text_sha256, and its group (r, g, p) of n rows.

    ``r, g, p`` name a group only where ``n`` is over one.
    """
    text = whole_text()
    norm = F.regexp_replace(text, SPACE + "+", "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"),
        F.lit(0).cast("long").alias("g"), F.lit(b"").alias("p"), norm.cast("binary").alias("rest"))
    parts, shared = _parts(rows, width), _shared(_parts(rows.select("g", "p", "rest"), width))
    # Until a row has a lasting number, the bytes themselves name its group.
    named = (parts.withColumn("text_sha256", F.sha2(F.concat("head", "rest"), 256))
             .join(shared, _KEYS).withColumn("p", F.col("head"))
             .withColumn("rid", F.monotonically_increasing_id()))
    done, r = None, 0
    while True:
        over = F.col("ended") | (F.col("n") == 1)
        step = written(named.select(
            "rid", "doc_id", "n_points", "text_sha256", F.lit(r).alias("r"), "g", "p", "n", over.alias("over"),
            F.when(~over, F.col("rest")).alias("rest")), f"radix-{r}")
        ended = step.where("over").drop("over", "rest")
        done = ended if done is None else done.unionByName(ended)
        live = step.where(~F.col("over")).drop("over", "n", "r")
        if live.isEmpty():
            return done
        r, width = r + 1, width * growth
        parts = _parts(live, width)
        shared = _shared(parts.select("rid", *_KEYS), F.min("rid").alias("least"))
        named = parts.join(shared, _KEYS).withColumn("g", F.col("least")).withColumn("p", F.lit(b"")).drop("least")


def exact_dedup(docs: DataFrame, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, width, growth).drop("n_points")


def _judged(docs: DataFrame, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    groups = radix_groups(docs, width, growth)
    single = groups.where("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points")
    many = groups.where("n > 1")
    best = many.groupBy("r", "g", "p").agg(
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("doc"), (-F.col("rid")).alias("rid"))).alias("best"))
    copies = many.join(best, ["r", "g", "p"]).select(
        "doc_id", F.bitwise_not("best.doc").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == -F.col("best.rid")).alias("kept"), "text_sha256", "n_points")
    return single.unionByName(copies)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each set of equal texts, all columns kept.

    A row is found again by its doc_id, length and text together, so absent and repeated doc_ids do not matter.
    """
    kept = _judged(docs).where("kept").select(row_key(F.col("doc_id"), F.col("n_points"), F.col("text_sha256")).alias("key"))
    text = whole_text()
    norm = F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256)
    return keep_keys(docs, row_key(F.col("doc_id").cast("long"), F.length(text), norm), kept)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
