"""Repeated byte strings over all documents, by column-wise construction of suffix order and common prefixes.

A byte goes if a string of ``SIZE`` bytes around it starts earlier too, in a document of smaller doc_id
or earlier in its own. The collection of texts is sorted by its suffixes as in multi-string
Burrows-Wheeler construction: each round puts one more symbol in front of every string's suffix;
the place of the longer suffix follows from the ranks of the symbols in the transform so
far, and its common prefix with its neighbours from the least common prefix between the places.

One round per symbol of the longest text, each over all symbols so far, is out of reach for whole documents,
so the construction runs on pieces. Every window of ``SIZE`` bytes has a seed, the ``SEED``-byte string
in it whose hash is least. Equal windows have equal seeds. Windows in a row with one seed form a
piece of at most ``SIZE + CUT - 1`` bytes; pieces with the same seed meet in one task, and each task
builds the transform of a bounded collection of whole seed groups after the other. The symbols of
a collection are read and written in order, as arrays in memory in the place of files. A symbol of
the construction is ``STEP`` bytes, and a window a whole number of symbols.

Seeds that occur once need no piece: a first pass counts seeds and marks those met twice in a
bitmap of fixed size (bits set by others only let more pieces through). Pieces equal to an earlier one of their batch are decided
there, so a group of copies sends one row per batch. A seed with more than ``GROUP`` different
pieces is resolved by grouping its windows themselves.

Absent texts count as empty. Documents without doc_id come last. Rows that share a doc_id are told
apart by the hash of their text; fully equal rows are one document and get the same answer. An empty table gives
no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.llm.common import bitmap, marked
from segmentlab.llm.shingles import _BYTE, _power_tables, mixed
from segmentlab.session import written

SIZE, SEED = 100, 32
#: Bytes that the construction puts in front at once; they divide ``SIZE``, so a window is a number of whole symbols.
STEP = 4
#: Windows of a piece, pieces of a collection, and different pieces of a seed that are sorted together.
CUT, COLLECTION, GROUP = 100, 1500, 5000
#: Bits of the bitmap of seeds (8 MiB), and bytes scanned at once.
BITS, STRETCH = 26, 1 << 20

PIECES = "v long, piece binary, doc_id long, h long, start long, r int"
REMOVED = "doc_id long, h long, start long, r int, window binary"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[:len(values) - (width - done)], values[width - done:]) if width > done else values


class Stretch:
    """Bytes of several texts one after the other, with the seed of each window that lies inside one text."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.parts = parts
        self.data = b"".join(p for *_, p in parts)
        n, width = len(self.data), SIZE - SEED + 1
        ends = np.cumsum([len(p) for *_, p in parts])
        self.begin = np.concatenate(([0], ends[:-1]))
        if n < SIZE:
            self.seeds, self.at, self.marks = np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "uint64")
            return
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, "uint64")
        np.cumsum(_BYTE[np.frombuffer(self.data, "uint8")] * up[:n], out=sums[1:])
        hashes = mixed((sums[SEED:] - sums[:-SEED]) * down[:n - SEED + 1])
        seeds = _sliding(hashes, width, np.minimum)
        owner_end = np.repeat(ends, [len(p) for *_, p in parts])[:len(seeds)]
        whole = np.arange(len(seeds)) + SIZE <= owner_end
        # A seed's places: those where it is the least of some whole window.
        most = np.where(whole, seeds, 0)
        most = _sliding(np.concatenate((np.zeros(width - 1, "uint64"), most, np.zeros(width - 1, "uint64"))), width, np.maximum)
        # Least hashes are small numbers; mixed again, they fill the bitmap and the partitions evenly.
        self.marks = mixed(hashes[(most == hashes) & (most > 0)] + np.uint64(1))
        self.at = np.flatnonzero(whole)
        self.seeds = mixed(seeds[self.at] + np.uint64(1))

    def pieces(self, wanted) -> Iterator[tuple[int, int, int, int, int]]:
        """(seed, text, offset in the text, place in the bytes, windows) of the pieces with a wanted seed."""
        if not len(self.at):
            return
        text = np.searchsorted(self.begin, self.at, "right") - 1
        new = (np.diff(self.at, prepend=-9) != 1) | (np.diff(self.seeds, prepend=~self.seeds[:1]) != 0) | (np.diff(text, prepend=-1) != 0)
        first = np.flatnonzero(new)
        place = np.arange(len(self.at)) - np.repeat(first, np.diff(np.append(first, len(self.at))))
        first = np.flatnonzero(place % CUT == 0)
        count = np.diff(np.append(first, len(self.at)))
        keep = wanted(self.seeds[first])
        first, count = first[keep], count[keep]
        owner = text[first]
        offset = self.at[first] - self.begin[owner]
        yield from zip(self.seeds[first].view("int64").tolist(), owner.tolist(), offset.tolist(), self.at[first].tolist(), count.tolist())


def stretches(rows: list[tuple[int, bytes]]) -> Iterator[Stretch]:
    """Stretches of bounded size; a longer text is cut with an overlap, so that each window is whole in one part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in rows:
        for at in range(0, max(len(text) - SIZE + 1, 0), STRETCH):
            part = text[at:at + STRETCH + SIZE - 1]
            if size and size + len(part) > STRETCH:
                yield Stretch(parts)
                parts, size = [], 0
            parts.append((i, at, part))
            size += len(part)
    if parts:
        yield Stretch(parts)


def _count_seeds(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, t in enumerate(batch.column(2).to_pylist()) if len(t) >= SIZE]
            for s in stretches(rows):
                h, n = np.unique(s.marks, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(n.astype("int32"))], ["h", "n"])

    return texts.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))


def _order(doc_id: int | None, h: int, start: int) -> tuple:
    return (doc_id is None, doc_id or 0, h, start)


def _pieces(texts: DataFrame, wanted) -> DataFrame:
    """Pieces with seeds met twice; those equal to an earlier one of their stretch only as the windows to remove."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, t) for i, t in enumerate(batch.column(2).to_pylist()) if len(t) >= SIZE]
            for s in stretches(rows):
                best: dict[bytes, tuple] = {}
                out: list[tuple] = []
                for v, part, offset, at, r in s.pieces(lambda seeds: marked(bits, seeds, BITS)):
                    i, shift, _ = s.parts[part]
                    row = (v, ids[i], hashes[i], shift + offset, r)
                    piece = s.data[at:at + r + SIZE - 1]
                    known = best.setdefault(piece, row)
                    if known[1:4] != row[1:4]:
                        if _order(*row[1:4]) < _order(*known[1:4]):
                            best[piece], row = row, known
                        # Decided rows may go to any task.
                        out.append((row[3] * 0x9E3779B97F4A7C1 + row[2] & 2**62 - 1, None, *row[1:]))
                out += [(row[0], piece, *row[1:]) for piece, row in best.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES)], _PIECE_NAMES)

    return texts.mapInArrow(emit, PIECES)


_PIECE_NAMES = ["v", "piece", "doc_id", "h", "start", "r"]
_PIECE_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_REMOVED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def suffix_order(strings: list[bytes], width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and common prefix with the one before, of all suffixes of a collection in their order.

    Round by round one symbol of every string is put in front of its last suffix. ``bwt`` holds the symbol before each suffix
    (0: the whole string is in), in suffix order; only the new suffixes and those after them change their common prefix.
    A symbol is ``width`` bytes (at most eight); more than one make as many fewer rounds. A string is then taken once for every length of what is
    left out at its end, 0 to ``width`` - 1 bytes, so each of its suffixes is in once, without these bytes, and common
    prefixes are in whole symbols. Every common prefix is exact. Which suffix belongs to which string is read off at the
    end, by going through the finished transform once.
    """
    size = np.array([len(s) for s in strings], "int64")
    data = _symbols(b"".join(strings), width)
    string, cut = np.nonzero(size[:, None] >= np.arange(width))
    stop, length = np.cumsum(size)[string] - cut, (size[string] - cut) // width
    m = len(stop)
    # The empty suffixes of all strings, in the order of the strings.
    bwt = np.where(length > 0, data[np.maximum(stop - width, 0)], 0).astype(data.dtype)
    lcp = np.zeros(m, "int16" if length.max(initial=0) < 2**15 else "int32")
    active = np.flatnonzero(length > 0)
    place = active.copy()  # of the last suffix of each active string
    step = 0
    while len(active):
        step += 1
        # The suffixes of the next list that are not empty are those of this one with their symbol in front.
        order = np.argsort(bwt, kind="stable").astype("int32")[np.count_nonzero(bwt == 0):]
        rank = np.empty(len(bwt), "int32")
        rank[order] = np.arange(len(order), dtype="int32")
        r = rank[place]
        turn = np.argsort(r, kind="stable")
        r, place, active = r[turn], place[turn], active[turn]
        before = np.where(r > 0, order[np.maximum(r - 1, 0)], -1)
        after = np.where(r + 1 < len(order), order[np.minimum(r + 1, len(order) - 1)], -1)
        own, following = np.split(_shared(bwt, lcp, np.concatenate((before, place)), np.concatenate((place, after))), 2)
        # Places in the next list, behind the m empty suffixes.
        spot = m + r
        total = len(bwt) + len(r)
        old = np.ones(total, bool)
        old[spot] = False
        grown_bwt, grown_lcp = np.empty(total, bwt.dtype), np.empty(total, lcp.dtype)
        grown_bwt[old], grown_lcp[old] = bwt, lcp
        grown_bwt[spot] = np.where(length[active] > step, data[np.maximum(stop[active] - (step + 1) * width, 0)], 0)
        grown_lcp[spot] = own
        bwt, lcp = grown_bwt, grown_lcp
        # The suffix after a new one has a new neighbour; where that is new too, it has its own value already.
        fix = spot + 1 < total
        fix[fix] = old[spot[fix] + 1]
        lcp[spot[fix] + 1] = following[fix]
        go_on = length[active] > step
        active, place = active[go_on], spot[go_on]
    who, count = np.empty(len(bwt), "int32"), np.empty(len(bwt), "int32")
    order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0):]
    rank = np.empty(len(bwt), "int64")
    rank[order] = np.arange(len(order))
    place, owner = np.arange(m), np.arange(m)
    for n in range(int(length.max(initial=0)) + 1):
        who[place], count[place] = owner, n
        more = length[owner] > n
        place, owner = m + rank[place[more]], owner[more]
    return string[who], size[string[who]] - cut[who] - count * width, lcp


def _symbols(data: bytes, width: int) -> np.ndarray:
    """At each place a number for the ``width`` bytes from there on, ordered as these are, none of them 0."""
    one = np.frombuffer(data, "uint8")
    if width == 1:
        # UTF-8 has no bytes over 0xF4.
        return np.append(one + np.uint8(1), np.uint8(0))
    padded = np.concatenate((one, np.zeros(width, "uint8"))).astype("uint64")
    value = np.zeros(len(one) + 1, "uint64")
    for i in range(width):
        value = value << np.uint64(8) | padded[i:i + len(value)]
    known, number = np.unique(value, return_inverse=True)
    return (number + 1).astype("uint16" if len(known) < 2**16 else "uint32")


def _shared(bwt: np.ndarray, lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One more than the least common prefix over (low, high] for pairs of places; 0 where their symbols differ."""
    out = np.zeros(len(low), lcp.dtype)
    same = np.flatnonzero((low >= 0) & (high >= 0) & (bwt[low] == bwt[high]))
    if len(same):
        a, b = low[same] + 1, high[same] + 1
        # Least values of each 1, 2, 4, ... places in a row; two overlapping stretches cover a range.
        level = np.frexp(b - a)[1] - 1
        least = np.empty((level.max() + 1, len(lcp)), lcp.dtype)
        least[0] = lcp
        for k in range(1, len(least)):
            half = 1 << k - 1
            end = len(lcp) - 2 * half + 1
            np.minimum(least[k - 1, :end], least[k - 1, half:half + end], out=least[k, :end])
        out[same] = np.minimum(least[level, a], least[level, b - (1 << level)]) + 1
    return out


def repeated_windows(rows: list[tuple]) -> list[tuple]:
    """Windows to remove, as (doc_id, h, start, r), among different pieces (piece, doc_id, h, start, r)."""
    rows = sorted(rows, key=lambda x: _order(*x[1:4]))
    who, offset, lcp = suffix_order([x[0] for x in rows], STEP)
    starts = np.array([x[3] for x in rows])
    documents = np.cumsum([0, *(a[1:3] != b[1:3] for a, b in zip(rows, rows[1:]))])
    group = np.cumsum(lcp < SIZE // STEP)
    size = np.bincount(group)
    in_group = size[group] > 1
    who, offset, group = who[in_group], offset[in_group], group[in_group]
    order = np.lexsort((starts[who] + offset, documents[who], group))
    who, offset, group = who[order], offset[order], group[order]
    again = np.diff(group, prepend=-1) == 0
    # The same place of a document may lie in two pieces only if rows repeat.
    spot = starts[who] + offset
    lead = np.flatnonzero(~again)
    head = lead[np.cumsum(~again) - 1]
    again &= (documents[who] != documents[who[head]]) | (spot != spot[head])
    who, offset = who[again], offset[again]
    order = np.lexsort((offset, who))
    who, offset = who[order], offset[order]
    first = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(offset, prepend=-9) != 1))
    count = np.diff(np.append(first, len(who)))
    return [(*rows[w][1:3], rows[w][3] + o, c) for w, o, c in zip(who[first].tolist(), offset[first].tolist(), count.tolist())]


def _sorted_out(pieces: DataFrame) -> DataFrame:
    """Windows to remove (doc_id, h, start, r); of seeds with too many pieces, all windows with their bytes."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REMOVED_TYPES)], ["doc_id", "h", "start", "r", "window"])

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        waiting: list[tuple] = []  # pieces of whole seed groups for the next collection
        group: list[tuple] = []  # different pieces of the seed at hand
        seed, many, last = None, False, None

        def windows(rows):
            return [(d, h, s + i, 1, p[i:i + SIZE]) for p, d, h, s, r in rows for i in range(r)]

        def close() -> None:
            nonlocal group
            if many:
                done.extend(windows(group))
            elif len(group) > 1 or group and len({group[0][0][i:i + SIZE] for i in range(group[0][4])}) < group[0][4]:
                waiting.extend(group)
            group = []

        for batch in batches:
            for v, piece, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if piece is None:
                    done.append((*row, None))
                    continue
                if v != seed:
                    close()
                    seed, many, last = v, False, None
                if last is not None and last[0] == piece:
                    # Equal pieces stand side by side: the earliest represents them.
                    if last[1:4] == (*row[:3],):
                        continue
                    if _order(*row[:3]) < _order(*last[1:4]):
                        last, row = (piece, *row), list(last[1:])
                        group[-1] = last
                    done.append((*row, None))
                    continue
                last = (piece, *row)
                group.append(last)
                if len(group) > GROUP:
                    many = True
                    done.extend(windows(group[:-1]))
                    group = group[-1:]
            while len(waiting) >= COLLECTION or len(done) > 20_000:
                if len(waiting) >= COLLECTION:
                    done.extend((*x, None) for x in repeated_windows(waiting))
                    waiting = []
                if done:
                    yield out(done)
                    done = []
        close()
        if waiting:
            done.extend((*x, None) for x in repeated_windows(waiting))
        if done:
            yield out(done)

    return pieces.repartition("v").sortWithinPartitions("v", "piece").mapInArrow(sort_out, REMOVED)


def removed_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, h, start, r): r windows in a row that also start earlier, from (doc_id, h, data)."""
    seeds = _count_seeds(texts).where("n > 1")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(seeds, BITS))
    found = written(_sorted_out(_pieces(texts, wanted)), "repeats")
    plain = found.where("window IS NULL").drop("window")
    crowded = found.where("window IS NOT NULL")
    if crowded.isEmpty():
        return plain
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "start")
    first = crowded.groupBy("window").agg(F.min(order).alias("first"))
    later = crowded.join(first, "window").where(~F.struct("doc_id", "h", "start").eqNullSafe(F.struct("first.doc_id", "first.h", "first.start")))
    return plain.unionByName(later.select("doc_id", "h", "start", "r"))


def _kept(data: bytes, spans: list[dict] | None) -> tuple[int, int, str, list[tuple[int, int]]]:
    merged: list[list[int]] = []
    for s, r in sorted((x["start"], x["r"]) for x in spans or ()):
        end = s + r + SIZE - 1
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([s, end])
    digest, at = hashlib.sha256(), 0
    for s, e in merged:
        digest.update(data[at:s])
        at = e
    digest.update(data[at:])
    return sum(e - s for s, e in merged), len(merged), digest.hexdigest(), [(s, e) for s, e in merged]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end in bytes)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    texts = texts.select("doc_id", F.xxhash64("data").alias("h"), "data")
    spans = removed_windows(texts).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "r")).alias("gone"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "gone")
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_doc"]) & (texts["h"] == spans["_h"]), "left").select("doc_id", "data", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = part.column(1).to_pylist()
                rows = [_kept(d, g) for d, g in zip(data, part.column(2).to_pylist())]
                removed, count, digest, where = zip(*rows)
                spans_ = pa.array([[{"start": s, "end": e} for s, e in w] for w in where], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), spans_],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i AS p, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
n AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM g),
r AS (SELECT doc_id, p, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM r GROUP BY doc_id, run),
b AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (SELECT d.doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(e) + 1) AS kept,
             sum(e - a) AS gone, count(*) AS spans FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
