"""Conversation prefix trie: every distinct beginning of the conversations, its members and what sharing it saves.

Conversations are sorted as sequences of turns, equal ones as one row, and each row knows how many turns it shares with the row before
(LCP). A beginning of d turns owns one interval of rows, and its ends are where the LCP falls under d. Each candidate beginning
(a row and its LCP) finds both ends on its own by binary search over a sparse table of range minima, left and right
independently; there is no stack and no walk over the rows. What a node needs is then read off the two ends: members, leaves and sums
are differences of prefix sums, the smallest conversation is a range minimum, the parent is the interval of the higher end.

The sorted rows lie in blocks (``BLOCK`` rows, more only beyond ``BLOCKS`` blocks), each with its own sparse table. An end outside
of the block is looked up in a sparse table over the minima of blocks, which has at most ``BLOCKS`` entries whatever the input, and
then among the falling minima of the block it is in, by a join. A node's beginnings inside one block are one row
before that join, so a beginning that a third of all conversations shares is a row per block.

Where members are the same down a chain of nodes, the chain is found once and then spread out. A conversation is one row, as a
text is: a list of its turns' digests (128 bits) and lengths. The texts themselves are shuffled nowhere. Digests of the members that end at a node are
made from streams of sorted ids, packed beforehand by ranges of ids, so an unbounded list is in no memory.

An absent role or text counts as empty; turns of equal number go by their digest; rows without conv_id belong to no conversation and are left out;
repeated rows are turns of their own; turns of any length are whole. An empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentlab.session import written

#: Rows of a block, and the most blocks that there may be (beyond, blocks are larger).
BLOCK, BLOCKS = 1 << 10, 1 << 16
#: Characters of a turn's digest; bits of a range of ids that are packed together.
_DIGEST, _PACK = 32, 16


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns`` (list of digest and size), ordered by turn, an absent one first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, _DIGEST).alias("digest"),
            F.length(text).cast("long").alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100, shared: int = 6) -> DataFrame:
    """Each conversation with its first ``h`` turns replaced by those of conversation ``conv_id - conv_id % every``;
    ``h`` is the checksum of the decimal conv_id modulo ``shared``."""
    bases = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared).alias("given"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(bases, "base", "left")
    given = F.when(F.col("given").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("given", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(given, rest).alias("turns"))


def _ends(named: DataFrame) -> DataFrame:
    """name, ends: the digest of the decimal ids of each group, ascending, joined by commas."""
    parts = named.groupBy("name", F.shiftright("conv_id", _PACK).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, hashlib.sha256()
        for batch in batches:
            found: list[tuple[bytes, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == name:
                    digest.update(b",")
                else:
                    if name is not None:
                        found.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["name", "ends"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends"])

    return parts.repartition("name").sortWithinPartitions("name", "part").select("name", "ids").mapInArrow(run, "name binary, ends string")


def _shared_turns(a: str, b: str) -> int:
    """Turns that two sequences of digests have in common at their start."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a.startswith(b[:half * _DIGEST]) else (low, half - 1)
    return low


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a partition and compares each with the one before; the first has no LCP yet."""
    names, pid, at, last = ["pid", "at", "key", "lcp", "before", "depth", "n", "least", "ends", "prior", "total"], TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lcp, before, prior, total = [], [], [], []
        for key, own in zip(keys, sizes):
            lcp.append(None if last is None else _shared_turns(last, key))
            before.append(None if last is None else len(last) // _DIGEST)
            prior.append(np.cumsum([0, 0, *own[:-1]]))
            total.append(sum(own))
            last = key
        n = len(keys)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, pid, "int32")), pa.array(np.arange(at, at + n)), batch.column(0), pa.array(lcp, pa.int32()), pa.array(before, pa.int32()),
            pa.array([len(s) for s in sizes], pa.int32()), batch.column(2), batch.column(3), batch.column(4),
            pa.array(prior, pa.list_(pa.int64())), pa.array(total, pa.int64())], names)
        at += n


def sorted_rows(conversations: DataFrame) -> tuple[DataFrame, int]:
    """One row per distinct sequence, numbered in order, and their number.

    i; lcp (with row i - 1; -1 for the first); ended (1 if row i goes on where row i - 1 ends); depth; n and least (conversations, smallest id); ends; prior (size of what
    comes before the last turn at depth 0, 1, …); mass (size of all turns, times n); fresh (size of the turns beyond the LCP); skipped (of those within).
    """
    spark = conversations.sparkSession
    named = conversations.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t.digest), "").alias("key"), F.transform("turns", lambda t: t.size).alias("sizes"))
    named = written(named.withColumn("name", F.unhex(F.sha2("key", 256))), "trie-sequences")
    groups = named.groupBy("name", "key", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).join(_ends(named.select("name", "conv_id")), "name")
    rows = written(groups.repartitionByRange("key").sortWithinPartitions("key").select("key", "sizes", "n", "least", "ends").mapInArrow(
        _compared, "pid int, at long, key string, lcp int, before int, depth int, n long, least long, ends string, prior array<long>, total long"), "trie-rows")
    # One row per partition: its first row is compared with the last one of the partition before.
    edges = rows.groupBy("pid").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.withColumn("prev", F.lag("high").over(Window.orderBy("pid")))

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, prev = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lcp = [-1 if p is None else _shared_turns(p, k) for k, p in zip(low, prev)]
            before = [-1 if p is None else len(p) // _DIGEST for p in prev]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lcp, pa.int32()), pa.array(before, pa.int32())], ["pid", "rows", "lcp", "before"])

    starts, size = [], 0
    for r in sorted(edges.select("pid", "rows", "low", "prev").mapInArrow(touch, "pid int, rows long, lcp int, before int").collect()):
        starts.append((r.pid, size, r.lcp, r.before))
        size += r.rows
    offsets = spark.createDataFrame(starts, "pid int, base long, first_lcp int, first_before int")
    rows = rows.drop("key").join(offsets, "pid").withColumn("lcp", F.coalesce("lcp", "first_lcp")).withColumn("before", F.coalesce("before", "first_before"))
    skipped = F.element_at("prior", F.col("lcp") + 2)
    return rows.select(
        (F.col("base") + F.col("at")).alias("i"), "lcp", (F.col("lcp") == F.col("before")).cast("long").alias("ended"), "depth", "n", "least", "ends", "prior",
        (F.col("n") * F.col("total")).alias("mass"), (F.col("total") - skipped).alias("fresh"), skipped.alias("skipped")), size


class RangeMin:
    """Sparse table: row l holds the minimum of every stretch of 2**l values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, low: np.ndarray, high: np.ndarray, default: int) -> np.ndarray:
        """Minimum of values[low:high], ``default`` where that is empty."""
        out = np.full(len(low), default, "int64")
        span = high - low
        level = np.frexp(np.maximum(span, 1).astype("float64"))[1] - 1
        for n in np.unique(level[span > 0]).tolist():
            own = (level == n) & (span > 0)
            out[own] = np.minimum(self.rows[n][low[own]], self.rows[n][high[own] - (1 << n)])
        return out

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place before ``at`` whose value is under ``bound``; -1 if there is none."""
        at = at.copy()
        for n in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[n], 1 << n
            can = at >= step
            can[can] = row[at[can] - step] >= bound[can]
            at[can] -= step
        return at - 1

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is under ``bound``; the number of values if there is none."""
        at, size = at.copy(), len(self.rows[0])
        for n in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[n], 1 << n
            can = at + step <= size
            can[can] = row[at[can]] >= bound[can]
            at[can] += step
        return at


_NONE = np.iinfo("int64").max
_SUMS = ("n", "mass", "fresh", "ended")
#: What is known at either end: its place, LCP, sums before it (of ``ended`` including the left end), and the candidate there.
_END = ("at", "lcp", *_SUMS, "ref", "block")
_COLUMNS = ["kind", "block", "k", "v", "splits", "least", *(f"l_{c}" for c in _END), *(f"r_{c}" for c in _END)]


def _block_intervals(table: pa.Table, size: int, block: int, tops: dict[str, np.ndarray]) -> pa.Table:
    """Intervals of the candidates and single rows of one block (kind 0), and its falling minima from the end (1) and the start (2)."""
    col = {c: table.column(c).to_numpy().astype("int64") for c in table.column_names}
    order = np.argsort(col["i"])
    col = {c: v[order] for c, v in col.items()}
    b, lcp, n = int(col["block"][0]), col["lcp"], len(order)
    base, n_blocks = b * block, len(tops["lcp"])
    sums = {c: tops[c][b] + np.concatenate([[0], np.cumsum(col[c])]) for c in _SUMS}
    mins, ids = RangeMin(lcp), RangeMin(col["least"])
    block_mins, block_ids = RangeMin(tops["lcp"]), RangeMin(tops["least"])
    first_lcp = np.append(tops["first_lcp"], -1)

    # Each candidate searches to the left and to the right on its own.
    k = np.flatnonzero(lcp >= 0)
    left, right = mins.left(k, lcp[k]), mins.right(k + 1, lcp[k])
    _, first, of = np.unique(np.stack([lcp[k], left, right]), axis=1, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    splits = np.bincount(of, minlength=len(first)).astype("int64")
    named = np.full(n + 1, -1, "int64")  # the first candidate of the block with the same interval
    named[k] = base + k[first][of]
    after = first_lcp[b + 1]
    named[n] = base + n if after >= 0 else -1
    lcp_after = np.append(lcp, after)

    def end(at: np.ndarray, place: np.ndarray, is_left: bool) -> dict[str, np.ndarray]:
        own = {"at": base + place, "lcp": lcp_after[place], "ref": named[place], "block": np.full(len(at), -1, "int64")}
        return own | {c: sums[c][place + (is_left and c == "ended")] for c in _SUMS}

    def rows(kind: int, k: np.ndarray, v: np.ndarray, splits: np.ndarray, least: np.ndarray, low: dict, high: dict) -> dict[str, np.ndarray]:
        full = lambda x: np.full(len(k), x, "int64")
        return {"kind": full(kind), "block": full(b), "k": k, "v": v, "splits": splits, "least": least,
                **{f"l_{c}": low.get(c, full(-1)) for c in _END}, **{f"r_{c}": high.get(c, full(-1)) for c in _END}}

    k, v, left, right = k[first], lcp[k[first]], left[first], right[first]
    low, high = end(k, np.maximum(left, 0), True), end(k, right, False)
    least = ids.least(np.maximum(left, 0), right, _NONE)
    out_left, out_right = np.flatnonzero(left < 0), np.flatnonzero(right == n)
    # Ends in other blocks: which block, and the smallest id of whole blocks on the way.
    to = block_mins.left(np.full(len(out_left), b, "int64"), v[out_left])
    low["block"][out_left] = to
    least[out_left] = np.minimum(least[out_left], block_ids.least(to + 1, np.full(len(to), b, "int64"), _NONE))
    to = block_mins.right(np.full(len(out_right), b + 1, "int64"), v[out_right])
    least[out_right] = np.minimum(least[out_right], block_ids.least(np.full(len(to), b + 1, "int64"), to, _NONE))
    head = first_lcp[to] < v[out_right]  # the end is the first row of that block, or the end of all
    here, at = out_right[head], to[head]
    high["at"][here], high["lcp"][here] = np.minimum(at * block, size), first_lcp[at]
    high["ref"][here] = np.where(first_lcp[at] >= 0, at * block, -1)
    for c in _SUMS:
        high[c][here] = tops[c][at]
    high["block"][out_right[~head]] = to[~head]
    found = [rows(0, base + k, v, splits, least, low, high)]

    # Rows that go on beyond what either neighbour shares; they refer to no block.
    single = np.flatnonzero(col["depth"] > np.maximum(lcp, lcp_after[1:]))
    none = np.full(len(single), -1, "int64")
    found.append(rows(0, none, col["depth"][single], np.zeros(len(single), "int64"), col["least"][single], end(single, single, True), end(single, single + 1, False)))

    if b + 1 < n_blocks:  # depths that may reach this block from the right
        v = np.arange(lcp.min() + 1, after + 1)
        at = mins.left(np.full(len(v), n, "int64"), v)
        found.append(rows(1, np.full(len(v), -1, "int64"), v, v * 0, ids.least(at, np.full(len(v), n, "int64"), _NONE), end(v, at, True), {}))
    if b:  # and from the left
        v = np.arange(lcp.min() + 1, lcp[0] + 1)
        at = mins.right(np.zeros(len(v), "int64"), v)
        found.append(rows(2, np.full(len(v), -1, "int64"), v, v * 0, ids.least(np.zeros(len(v), "int64"), at, _NONE), {}, end(v, at, False)))
    return pa.table({c: np.concatenate([f[c] for f in found]) for c in _COLUMNS})


def intervals(rows: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """One row per chain of nodes with the same members: rows [l_at, r_at), depths (u, v], and splits (rows where branches part at v)."""
    block = max(block, math.ceil(size / BLOCKS))
    rows = rows.select((F.col("i") / block).cast("long").alias("block"), "i", "lcp", "depth", "least", *_SUMS)
    totals = rows.groupBy("block").agg(
        F.min("lcp").alias("lcp"), F.min_by("lcp", "i").alias("first_lcp"), F.min("least").alias("least"), *(F.sum(c).alias(c) for c in _SUMS))
    top = sorted(totals.collect())  # at most BLOCKS rows
    tops = {c: np.array([r[c] for r in top], "int64") for c in ("lcp", "first_lcp", "least")}
    tops |= {c: np.concatenate([[0], np.cumsum([r[c] for r in top])]).astype("int64") for c in _SUMS}

    found = written(rows.groupBy("block").applyInArrow(
        lambda table: _block_intervals(table, size, block, tops), ", ".join(f"{c} long" for c in _COLUMNS)), "trie-intervals")
    whole = found.where("kind = 0").drop("kind", "block")
    inside = whole.where("l_block < 0 AND r_block < 0")
    # Few rows: at most the depth shared across each border of two blocks.
    part = whole.where("l_block >= 0 OR r_block >= 0")
    for kind, side in ((1, "l"), (2, "r")):
        ends = [f"{side}_{c}" for c in _END if c != "block"]
        stairs = found.where(f"kind = {kind}").select(F.col("block").alias(f"{side}_block"), "v", F.col("least").alias("_least"), *(F.col(c).alias(f"_{c}") for c in ends))
        part = part.join(stairs, [f"{side}_block", "v"], "left")
        part = part.select("k", "v", "splits", F.least("least", "_least").alias("least"), *(
            F.coalesce(f"_{c}", c).alias(c) if c in ends else F.col(c) for c in whole.columns if c not in ("k", "v", "splits", "least")))
    part = written(part, "trie-outside")
    chains = inside.unionByName(part)
    higher = F.col("l_lcp") >= F.col("r_lcp")
    parents = chains.where("splits > 0").select(F.col("k").alias("ref"), F.col("least").alias("parent"))
    chains = chains.select(
        "v", F.greatest("l_lcp", "r_lcp").alias("u"), F.col("l_at").alias("i"), "splits", "least", F.when(higher, F.col("l_ref")).otherwise(F.col("r_ref")).alias("ref"),
        (F.col("r_n") - F.col("l_n")).alias("n_convs"), (F.col("r_at") - F.col("l_at") - F.col("r_ended") + F.col("l_ended")).alias("n_leaves"),
        (F.col("r_mass") - F.col("l_mass") - F.col("r_fresh") + F.col("l_fresh")).alias("saved"), (F.expr(f"l_at div {block}") == F.expr(f"(r_at - 1) div {block}")).alias("_once"))
    chains = chains.join(parents, "ref", "left").drop("ref")
    # A chain that lies in several blocks was found by each of them.
    once, many = chains.where("_once").drop("_once"), chains.where("NOT _once").drop("_once")
    same = [c for c in many.columns if c != "splits"]
    return once.unionByName(many.groupBy(*same).agg(F.sum("splits").alias("splits")))


_EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turns): see the contract's columns below."""
    rows, size = sorted_rows(conversations)
    if not size:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    chains = intervals(rows, size, block).join(rows.select("i", "depth", "ends", "prior", "skipped"), "i")
    over = F.slice("prior", F.col("u") + 2, F.col("v") - F.col("u"))
    nodes = chains.select(*(c for c in chains.columns if c != "prior"), F.posexplode(over).alias("step", "before"))
    bottom = (F.col("u") + 1 + F.col("step") == F.col("v"))
    ends_here = F.col("depth") == F.col("v")
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("u") + 1 + F.col("step")).cast("long").alias("depth"),
        F.when(F.col("step") > 0, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("splits") + 1 - ends_here.cast("long")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("skipped") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(bottom & ends_here, F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"))


SQL = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, hex(encode(conv_id::VARCHAR)) AS x FROM own),
ids AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x)::BIGINT), lambda i:
    (strpos('0123456789ABCDEF', substr(x, (i // 2 * 2 + 2 - i % 2)::BIGINT, 1)) - 1)::BIGINT)), lambda s, v:
    xor(s >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
      3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[xor(s & 15, v) + 1])), 4294967295::BIGINT) % 6 AS h FROM named),
turns AS (SELECT i.conv_id, 0 AS part, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > h),
seqs AS (SELECT i.conv_id, coalesce(string_agg(md5(concat(length(role), ':', role, text)), '' ORDER BY part, pos), '') AS key,
    coalesce(list(length(text) ORDER BY part, pos) FILTER (text IS NOT NULL), []) AS sizes FROM ids i LEFT JOIN turns t ON t.conv_id = i.conv_id GROUP BY i.conv_id),
spread AS (SELECT conv_id, unnest(range(0, len(sizes) + 1)) AS depth, key, sizes FROM seqs),
nodes AS (SELECT substr(key, 1, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN any_value(sizes[depth]) ELSE 0 END AS last_size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(sizes) = depth), '')) AS ends_sha256
  FROM spread GROUP BY 1, 2),
children AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
above AS (SELECT substr(node, 1, 32 * a) AS node, n_children, (n_convs - 1) * last_size AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, 32 * (n.depth - 1))
"""
