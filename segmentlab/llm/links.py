"""All links of the n-gram Jaccard join, and how many each document has.

``jaccard.ngram_join`` gives components; here no link between different sets is left out. Documents with equal sets
are one class, links are between classes, and a document's number of links is counted from class sizes, so copies
are never expanded into pairs. The method is that of ``jaccard``: classes meet at the shingles of their
prefixes in the global order, overlaps are counted per fragment of the order and summed per pair.

Links lie inside components, and ``jaccard`` finds those from a number of links that follows the number of classes. So a second
pass only compares classes of one component, each pair once. A component of many classes is cut into blocks, and block meets block
in a tile, so it is dealt over many tasks. A tile reads the fragments one after the other, adds each one's overlaps to a table of at most
about ``BLOCK`` by ``BLOCK`` pairs, and holds no set as a whole. What leaves it is one row per class, its links counted; pairs leave it only where
they are the result (``links``). In a component of n classes n (n - 1) / 2 pairs are compared, as matrix products; rows shuffled
are n times the number of its blocks.

Absent texts and texts without words link with nothing. Repeated rows and equal texts are of one class and linked with one
another. Rows without doc_id count as documents; a class of such rows only has no representative. An empty table gives
no rows. Extra columns are not looked at. A long text only has a long set: its fragments are arrays of a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.llm import jaccard
from segmentlab.llm.common import per_text
from segmentlab.session import written

#: Classes of a block, about; a component of more is compared block by block.
BLOCK = 1024
#: Shingles of a fragment that are counted at once.
COLUMNS = 4096


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(doc_id, n, cid) per document, written, and the salt under which class numbers tell all sets apart."""
    salt = 0
    while True:
        def numbers(texts: list[str | None], salt: int = salt) -> list:
            found = jaccard.sets(texts, size)
            return [[len(s) for s in found], [jaccard.class_of(s, salt) for s in found],
                    [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]]

        members = written(per_text(docs, "n long, cid long, full binary", lambda: numbers), "link-classes")
        if members.groupBy("cid").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").isEmpty():
            return members.drop("full"), salt
        salt += 1


def _tiles(per_class: DataFrame, roots: DataFrame, segments: DataFrame) -> DataFrame:
    """(root, a, b, f, cid, own, n, class_size, part): fragment f of a class of block ``own``, once for every block it is compared with."""
    blocks = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    grouped = roots.join(F.broadcast(blocks), "root", "left").select(F.col("node").alias("cid"), "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = grouped.join(per_class.select("cid", "class_size"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    facing = segments.join(placed, "cid").withColumn("other", F.explode_outer(F.expr("sequence(0, blocks - 1)")))
    return facing.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "f", "cid", "own", "n", "class_size", "part")


class _Tile:
    """Overlaps of two blocks of a component, or of one with itself, summed over the fragments."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        #: cid: (row of the table, set size, class size), of either block; one for both if they are the same.
        self.sides: list[dict[int, tuple[int, int, int]]] = [{}] if a == b else [{}, {}]
        self.table = np.zeros((0, 0), "int64")

    def add(self, cid: list[int], own: list[int], n: list[int], class_size: list[int], parts: list[np.ndarray]) -> None:
        """One fragment of all classes that have any shingle in it; a class that several tasks have cut counts once."""
        seen, found = set(), []
        for c, o, k, size, part in zip(cid, own, n, class_size, parts):
            if c not in seen:
                seen.add(c)
                side = int(o != self.a)
                found.append((side, self.sides[side].setdefault(c, (len(self.sides[side]), k, size))[0], part))
        height, width = len(self.sides[0]), len(self.sides[-1])
        grown = np.zeros((height, width), "int64")
        grown[:self.table.shape[0], :self.table.shape[1]] = self.table
        self.table = grown
        # Shingles of one class only are in no overlap.
        values, column, times = np.unique(np.concatenate([p for *_, p in found]), return_inverse=True, return_counts=True)
        length = [len(p) for *_, p in found]
        shared = times > 1
        keep = shared[column]
        column = (np.cumsum(shared) - 1)[column][keep]
        side, row = (np.repeat([f[i] for f in found], length)[keep] for i in (0, 1))
        order = np.argsort(column, kind="stable")
        side, row, column = side[order], row[order], column[order]
        total = int(shared.sum())
        for low in range(0, total, COLUMNS):
            high = min(low + COLUMNS, total)
            at = slice(*np.searchsorted(column, [low, high]))
            one = [np.zeros((rows, high - low), "float32") for rows in ((height,) if self.a == self.b else (height, width))]
            for i, matrix in enumerate(one):
                own_ = side[at] == i
                matrix[row[at][own_], column[at][own_] - low] = 1
            self.table += (one[0] @ one[-1].T).astype("int64")

    def linked(self, percent: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Classes, set sizes and class sizes of the blocks, and which pairs link; a class never with itself."""
        cids = [np.array([*s], "int64") for s in self.sides]
        n, size = ([np.array([v[i] for v in s.values()], "int64") for s in self.sides] for i in (1, 2))
        similar = self.table * 100 >= (n[0][:, None] + n[-1][None, :] - self.table) * percent
        if self.a == self.b:
            np.fill_diagonal(similar, False)
        return cids, n, size, similar


def _compared(tiles: DataFrame, percent: int, schema: str, finish) -> DataFrame:
    """``finish(tile, percent)`` of every tile, a record batch of ``schema``."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, tile, held = None, None, None, [[], [], [], [], []]

        def flush() -> None:
            nonlocal held
            if held[0]:
                tile.add(*held)
                held = [[], [], [], [], []]

        for batch in batches:
            at_root, at_a, at_b, at_f = (batch.column(i).to_pylist() for i in range(4))
            rest = [batch.column(i).to_pylist() for i in range(4, 8)]
            lists = batch.column(8)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                now = (at_root[i], at_a[i], at_b[i])
                if now != key:
                    flush()
                    if tile is not None:
                        yield from finish(tile, percent)
                    key, f, tile = now, at_f[i], _Tile(at_a[i], at_b[i])
                elif at_f[i] != f:
                    flush()
                    f = at_f[i]
                for known, column in zip(held, rest):
                    known.append(column[i])
                held[4].append(values[ends[i]:ends[i + 1]])
        flush()
        if tile is not None:
            yield from finish(tile, percent)

    return tiles.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "f").mapInArrow(compare, schema)


def _counts(tile: _Tile, percent: int) -> Iterator[pa.RecordBatch]:
    cids, _, size, similar = tile.linked(percent)
    for cid, others, links_ in ((cids[0], size[-1], similar), (cids[-1], size[0], similar.T))[:len(cids)]:
        any_ = links_.any(axis=1)
        if any_.any():
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cid[any_], links_.sum(axis=1)[any_], (links_ @ others)[any_])], ["cid", "n_classes", "n_others"])


def _pairs(tile: _Tile, percent: int) -> Iterator[pa.RecordBatch]:
    cids, n, _, similar = tile.linked(percent)
    x, y = np.nonzero(np.triu(similar) if tile.a == tile.b else similar)
    for at in range(0, len(x), 10_000):
        i, j = x[at:at + 10_000], y[at:at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cids[0][i], cids[-1][j], n[0][i], n[-1][j], tile.table[i, j])], ["x", "y", "nx", "ny", "both"])


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, cid) and classes (cid, least, class_size), both written, components (node, root) and tiles."""
    members, salt = _classes(docs, size)
    per_class = written(members.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")), "link-sizes")
    roots, segments = jaccard.roots_of(docs, per_class, salt, size, percent)
    return members, per_class, roots, _tiles(per_class, roots, segments)


def links(docs: DataFrame, size: int = jaccard.WORDS, percent: int = jaccard.PERCENT) -> DataFrame:
    """Every link between different sets: a and b (smallest doc_ids of the two classes), their set sizes n_a and n_b, and overlap."""
    _, per_class, _, tiles = _grouped(docs, size, percent)
    similar = _compared(tiles, percent, "x long, y long, nx long, ny long, both long", _pairs)
    x, y = (per_class.select(F.col("cid").alias(c), F.col("least").alias(f"least_{c}")) for c in "xy")
    named = similar.join(x, "x").join(y, "y")
    turn = F.col("least_x") > F.col("least_y")
    return named.select(*(F.when(turn, F.col(b)).otherwise(F.col(a)).alias(name) for name, a, b in (
        ("a", "least_x", "least_y"), ("b", "least_y", "least_x"), ("n_a", "nx", "ny"), ("n_b", "ny", "nx"))), F.col("both").alias("overlap"))


def _counted(per_class: DataFrame, tiles: DataFrame, percent: int) -> DataFrame:
    """Classes (cid, least, class_size) with n_classes (other classes linked with) and n_links (other documents linked with)."""
    counts = _compared(tiles, percent, "cid long, n_classes long, n_others long", _counts)
    counted = counts.groupBy("cid").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_others").alias("n_others"))
    return per_class.join(counted, "cid", "left").select(
        "cid", "least", "class_size", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), (F.coalesce("n_others", F.lit(0)) + F.col("class_size") - 1).alias("n_links"))


def _of_words(column: str, wordless) -> Column:
    return F.when(F.col("n") > 0, F.col(column)).otherwise(wordless).cast("long").alias(column)


def link_counts(docs: DataFrame, size: int = jaccard.WORDS, percent: int = jaccard.PERCENT) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id with its set), class_size, n_classes (other classes linked with),
    n_links (other documents linked with, those of its own class too)."""
    members, per_class, _, tiles = _grouped(docs, size, percent)
    classes = _counted(per_class, tiles, percent).withColumnRenamed("least", "class_id")
    return members.join(classes, "cid", "left").select(
        "doc_id", _of_words("class_id", F.col("doc_id")), *(_of_words(c, F.lit(v)) for c, v in (("class_size", 1), ("n_classes", 0), ("n_links", 0))))


def linked_groups(docs: DataFrame, size: int = jaccard.WORDS, percent: int = jaccard.PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (other documents linked with)."""
    members, per_class, roots, tiles = _grouped(docs, size, percent)
    placed = _counted(per_class, tiles, percent).join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    per_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(per_root, "root").select("cid", "component_id", "n_links")
    return members.join(classes, "cid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), _of_words("component_id", F.col("doc_id")), _of_words("n_links", F.lit(0)))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
u AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
k AS (SELECT x, count(*) AS n_links FROM e GROUP BY x),
c AS (SELECT r, r AS o FROM d UNION SELECT e.y, c.o FROM c JOIN e ON e.x = c.r),
m AS (SELECT c.o AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links FROM s JOIN m ON m.r = s.r LEFT JOIN k ON k.x = s.r
"""
