"""Benchmark decontamination by greedy string tiling.

Documents and items meet at shared token seeds (shingles of ``LEAST`` words, or the whole item where it is shorter).
For each pair that shares enough of them, the longest common stretches of words that do not overlap yet
are marked again and again, found by running Karp-Rabin hashes of falling length, until none of
``LEAST`` words is left. As tiles may lie in any order, reordered passages count in full. A
document is contaminated by an item if its tiles cover ``COVERED`` of the item's words.

Seeds of the benchmark are a bitmap of fixed size in the scan of the documents; what passes it is
joined exactly, so the benchmark may have any size. Pairs that cannot reach the coverage by their
number of shared seeds are not tiled: every tile of n words holds n - LEAST + 1 seeds.

Absent and empty items match nothing; absent and empty documents are clean. Rows that repeat are judged each; a
row without doc_id is reported with an absent doc_id, an item without item_id with an absent item_id. If one of the tables
is empty there are no pairs; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.llm.common import bitmap, marked, per_text
from segmentlab.llm.shingles import shingles, window_hashes, words
from segmentlab.session import written

#: Shortest tile in words, and the share of an item's words that tiles must cover.
LEAST, COVERED = 5, 0.5
#: Bits of the bitmap of seeds (8 MiB).
BITS = 26

_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))


class _Rolling:
    """Karp-Rabin hashes of all windows of any length, from prefix sums."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens) + 1
        up, self.down = np.full(n, _FACTOR), np.full(n, _INVERSE)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(self.down)
        self.sums = np.zeros(n, "uint64")
        np.cumsum(tokens * up[:-1], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]


def _free(taken: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    sums = np.concatenate(([0], np.cumsum(taken)))
    return np.flatnonzero(sums[size:] == sums[:-size])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in the item, start in the document, words) of the tiles."""
    found: list[tuple[int, int, int]] = []
    least = min(least, len(item))
    size = min(len(item), len(doc))
    if not least or size < least:
        return found
    mark_i, mark_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    roll_i, roll_d = _Rolling(item), _Rolling(doc)
    while True:
        by_hash = defaultdict(list)
        hashes = roll_i.windows(size)
        for p in _free(mark_i, size):
            by_hash[hashes[p]].append(int(p))
        starts = _free(mark_d, size)
        hashes = roll_d.windows(size)[starts]
        hit = np.isin(hashes, np.fromiter(by_hash, "uint64", len(by_hash))) if by_hash else np.zeros(0, bool)
        matches = []
        for t, h in zip(starts[hit].tolist(), hashes[hit]):
            for p in by_hash[h]:
                k = size
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and not mark_i[p + k] and not mark_d[t + k]:
                    k += 1
                if (item[p:p + size] == doc[t:t + size]).all():
                    matches.append((k, p, t))
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not mark_i[p:p + k].any() and not mark_d[t:t + k].any():
                mark_i[p:p + k] = mark_d[t:t + k] = True
                found.append((p, t, k))
        if size == least:
            return found
        # A stretch cut short by a longer tile is found again at the next, shorter length.
        size = max(least, size // 2 if size > 2 * least else size - 1)


def _coverage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "item_words", "covered", "n_tiles", "text_sha256"]
    for batch in batches:
        for row in batch.to_pylist():
            hashes, begin = words([row["item"], row["text"]])
            found = tiles(hashes[:begin[1]], hashes[begin[1]:])
            values = (row["doc_id"], row["item_id"], int(begin[1]), sum(k for *_, k in found), len(found))
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in values), pa.array([hashlib.sha256(row["text"].encode()).hexdigest()])], names)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, item_words, covered (words), n_tiles, coverage."""
    return _leaks(docs, benchmark, least, covered).drop("text_sha256")


def _leaks(docs: DataFrame, benchmark: DataFrame, least: int, covered: float) -> DataFrame:
    """:func:`leaks` with the digest of the document's text."""
    spark = docs.sparkSession

    def item_seeds(texts):
        h, first, count = shingles(texts, least)
        return [h.view("int64")[a:b].tolist() for a, b in zip(first[:-1], first[1:])], count

    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item"))
                    .dropDuplicates(["item_id", "item"])
                    .withColumn("key", F.monotonically_increasing_id()), "items")
    seeded = written(per_text(items, "seeds array<long>, item_words int", lambda: item_seeds, key="key", text="item"), "seeds")
    seeds = seeded.select("key", "item_words", F.explode("seeds").alias("h"))
    seeds = seeds.groupBy("key", "item_words", "h").agg(F.count("*").alias("times"))
    sizes = sorted({min(least, r[0]) for r in seeded.where("item_words > 0").select(F.least("item_words", F.lit(least))).distinct().collect()})
    wanted = spark.sparkContext.broadcast(bitmap(seeds.select("h"), BITS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                hits: list[set[int]] = [set() for _ in texts]
                for size in sizes:
                    h, first = _windows(texts, size, least)
                    on = np.flatnonzero(marked(bits, h, BITS))
                    for i, x in zip((np.searchsorted(first, on, "right") - 1).tolist(), h[on].view("int64").tolist()):
                        hits[i].add(x)
                keep = [i for i, x in enumerate(hits) if x]
                if keep:
                    rows = part.take(pa.array(keep))
                    lists = pa.array([sorted(hits[i]) for i in keep], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], ["doc_id", "text", "hits"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = written(slim.mapInArrow(probe, "doc_id long, text string, hits array<long>").withColumn("rid", F.monotonically_increasing_id()), "near")
    shared = near.select("rid", F.explode("hits").alias("h")).join(seeds, "h").groupBy("rid", "key", "item_words").agg(F.sum("times").alias("shared"))
    # Tiles that cover c words hold c / least seeds at least.
    enough = shared.where(F.col("shared") * F.least(F.lit(least), "item_words") >= F.col("item_words") * covered).select("rid", "key")
    # Pairs first take the short item, then the text, each by its own number.
    pairs = enough.join(items, "key").join(near.select("rid", "doc_id", "text"), "rid").select("doc_id", "item_id", "item", "text")
    measured = pairs.mapInArrow(_coverage, "doc_id long, item_id long, item_words long, covered long, n_tiles long, text_sha256 string")
    return measured.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= covered)


def _windows(texts, size: int, least: int):
    """All windows of ``size`` words per document, hashed as an item of that many words is; and where each document's begin."""
    hashes, begin = words(texts)
    n = np.maximum(np.diff(begin) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(begin[:-1] - first[:-1], n) + np.arange(first[-1])
    return window_hashes(hashes, at, at + size, least), first


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """``docs`` without the rows whose text an item contaminates, whatever their doc_id."""
    bad = _leaks(docs, benchmark, least, covered).select(F.col("text_sha256").alias("_bad_key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("_text_key", F.sha2(text, 256)).join(bad, F.col("_text_key") == F.col("_bad_key"), "left_anti").select(*docs.columns)
