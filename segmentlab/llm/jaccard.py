"""Jaccard join of documents on word shingles with vertical partitioning.

All shingles have one global order: those found too often first go to its end, the rest follow their
hash. Documents with equal shingle sets are one class. The order serves twice:

* Candidates. Two sets that are similar enough share a shingle among the first of each (the
  prefix). Classes meet at the shingles of their prefixes; lengths and positions rule pairs out.
* Counting. The order is cut into fragments. Every candidate pair's overlap is counted
  in each fragment separately, by a join on class and fragment, and the counts are summed per
  pair. No task ever holds a whole set, however long the document.

Hot shingles. A first pass counts all shingles of all documents; those of over ``HOT`` documents are marked in a
bitmap of fixed size and moved to the end of the order (a bit set by another shingle moves more of them, which
changes no result). So what is rare about a copy comes first, and copies that differ too much never meet. A
bucket that stays large is a group of near copies: there, each class is only paired with the few in which the shingle comes
first, the least changed ones. Once these links are known, classes of the bucket that are still in
different components are paired in a second round, so that no link between components is lost.

Absent texts and texts without words have empty sets and link with nothing. Rows that repeat are
of one class. Rows without doc_id take part, but are never the smallest of a component. An empty table gives no rows;
extra columns are not looked at. ``links`` gives all links between classes and counts them per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.llm.common import WORD, bitmap, keep_keys, marked, per_text, row_key, whole_text
from segmentlab.llm.components import components
from segmentlab.llm.shingles import mixed, shingles
from segmentlab.session import written

WORDS, PERCENT = 4, 85
#: Documents of a shingle beyond which it goes to the end of the order, and classes of a bucket that are all paired.
HOT, FREE = 16, 16
#: Classes of a larger bucket, those least changed, with which all its others are paired.
PIVOTS = 4
#: Bits of the bitmaps (8 MiB each), fragments of the order, and ranges in which shingles are counted.
BITS, FRAGMENTS, RANGES = 26, 4, 1024


def sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a few texts at a time, as hashing takes many times their bytes."""
    found: list[np.ndarray] = []
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        hashes, first, _ = shingles(part, size)
        hashes = hashes[np.lexsort((hashes, np.repeat(np.arange(len(part)), np.diff(first))))]
        found += [h[np.diff(h, prepend=~h[:1]) != 0] if len(h) else h for h in np.split(hashes, first[1:-1])]
    return found


def class_of(one: np.ndarray, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8, salt=salt.to_bytes(4, "big")).digest(), "big", signed=True)


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def _hot_shingles(docs: DataFrame, size: int) -> DataFrame:
    """(h): the shingles of over ``HOT`` documents, of all shingles of all documents, by their first 32 bits.

    A batch sends its hashes sorted, as differences in byte planes, of which the upper ones are nearly all zero: about
    two bytes a shingle after the shuffle's own compression.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [s for s in sets(batch.slice(at, 1000).column(0).to_pylist(), size) if len(s)]
                if not found:
                    continue
                values = np.sort((np.concatenate(found) >> np.uint64(32)).astype("uint32"))
                span = values // np.uint32(2**32 // RANGES)
                first = np.flatnonzero(np.diff(span.astype("int64"), prepend=-1))
                step = np.diff(values, prepend=np.uint32(0))
                step[first] = values[first] - span[first] * np.uint32(2**32 // RANGES)
                blobs = [part.view("uint8").reshape(-1, 4).T.tobytes() for part in np.split(step, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(span[first].astype("int32")), pa.array(blobs, pa.binary())], ["span", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                values, n = np.unique(np.concatenate(held), return_counts=True)
                hot = (values[n > HOT].astype("uint64") + np.uint64(span * (2**32 // RANGES))) << np.uint64(32)
                if len(hot):
                    yield pa.RecordBatch.from_arrays([pa.array(hot.view("int64"))], ["h"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != span:
                    yield from close()
                    span, held = s, []
                planes = np.frombuffer(blob.as_buffer(), "uint8").reshape(4, -1)
                held.append(np.cumsum(np.ascontiguousarray(planes.T).view("uint32").ravel(), dtype="uint32"))
        yield from close()

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(send, "span int, blob binary")
    return sent.repartition("span").sortWithinPartitions("span").mapInArrow(count, "h long")


def _prefixes(docs: DataFrame, hot, salt: int, size: int, percent: int) -> DataFrame:
    """(h, cid, n, at): every class's prefix in the global order, at most once per task."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                h, cid, n, place = [], [], [], []
                for one in sets(batch.slice(at, 1000).column(0).to_pylist(), size):
                    if not len(one) or (c := class_of(one, salt)) in seen:
                        continue
                    seen.add(c)
                    last = marked(bits, one, BITS)
                    first = np.concatenate((one[~last], one[last]))[:prefix_length(len(one), percent)] if last.any() else one[:prefix_length(len(one), percent)]
                    h.append(first)
                    cid.append(np.full(len(first), c))
                    n.append(np.full(len(first), len(one)))
                    place.append(np.arange(len(first)))
                if h:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(h).view("int64")), pa.array(np.concatenate(cid).astype("int64")),
                         pa.array(np.concatenate(n).astype("int32")), pa.array(np.concatenate(place).astype("int32"))], ["h", "cid", "n", "at"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "h long, cid long, n int, at int")


def long_enough(n, m, percent: int):
    """Whether sets of these sizes can be similar at all."""
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def early_enough(n, m, at_n, at_m, percent: int):
    """Whether they can be if their first common shingle is at these places; true of a similar pair at its first one."""
    return np.minimum(n - at_n, m - at_m) >= -(-(n + m) * percent // (100 + percent))


MET = "h long, x long, y long, n int, m int, at int, times int, large boolean"


def _meet(entries: DataFrame, percent: int) -> DataFrame:
    """From prefixes, per run of one shingle: pairs x < y of sizes n and m with their number of meetings, and the members
    (h, x, n, at; y null) of large buckets."""
    def rows(h, x, y, n, m, at, times, large) -> Iterator[pa.RecordBatch]:
        if len(x):
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.bool_()]
            columns = [pa.nulls(len(x), k) if v is None else pa.array(v).cast(k) for v, k in zip((h, x, y, n, m, at, times), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), large))], ["h", "x", "y", "n", "m", "at", "times", "large"])

    def paired(parts: list, large: bool) -> Iterator[pa.RecordBatch]:
        """One row per pair of places (cid, n, cid, n), with how often it was met."""
        if not parts:
            return
        x, n, y, m = (np.concatenate(v) for v in zip(*parts))
        turn = x > y
        x, n, y, m = np.where(turn, y, x), np.where(turn, m, n), np.where(turn, x, y), np.where(turn, n, m)
        order = np.lexsort((y, x))
        x, n, y, m = x[order], n[order], y[order], m[order]
        first = np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(y, prepend=~y[:1]) != 0))
        yield from rows(None, x[first], y[first], n[first], m[first], None, np.diff(np.append(first, len(x))), large)

    def handled(h, cid, n, at) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        size = np.diff(np.append(starts, len(h)))
        large = np.repeat(size > FREE, size)
        c, k, rank = cid[~large], n[~large], (np.arange(len(h)) - np.repeat(starts, size))[~large]
        parts = []
        for d in range(1, int(rank.max(initial=0)) + 1):
            i = np.flatnonzero(rank >= d)
            i = i[long_enough(k[i], k[i - d], percent)]
            parts.append((c[i - d], k[i - d], c[i], k[i]))
        yield from paired(parts, False)
        parts = []
        for a, z in zip(starts[size > FREE], size[size > FREE]):
            for p in range(a, a + PIVOTS):
                r = np.arange(p + 1, a + z)
                r = r[long_enough(n[r], n[p], percent) & early_enough(n[r], n[p], at[r], at[p], percent)]
                parts.append((np.full(len(r), cid[p]), np.full(len(r), n[p]), cid[r], n[r]))
        yield from paired(parts, True)
        yield from rows(h[large], cid[large], None, n[large], None, at[large], None, True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the run that may go on
        for batch in batches:
            h, cid, n, at = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in range(4))
            if held is not None:
                h, cid, n, at = (np.concatenate(v) for v in zip(held, (h, cid, n, at)))
            # A class that several tasks have seen counts once.
            once = (np.diff(h, prepend=~h[:1]) != 0) | (np.diff(cid, prepend=~cid[:1]) != 0)
            h, cid, n, at = (v[once] for v in (h, cid, n, at))
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut == 0 and len(h) > 50_000:
                # One run alone fills the batches: its first entries stay as partners for those to come.
                yield from handled(h, cid, n, at)
                held = tuple(v[:FREE + 1] for v in (h, cid, n, at))
                continue
            if cut:
                yield from handled(h[:cut], cid[:cut], n[:cut], at[:cut])
            held = tuple(v[cut:] for v in (h, cid, n, at))
        if held is not None and len(held[0]):
            yield from handled(*held)

    return entries.repartition("h").sortWithinPartitions("h", "at", "cid").mapInArrow(meet, MET)


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that their meetings leave possible.

    Beyond the shorter prefix, two sets share no more than what one of them has left; so too few
    meetings rule a pair out. Meetings in large buckets are not all known: as many as both have there count as met.
    Pairs from pivots are all taken.
    """
    in_large = met.where("y IS NULL").groupBy("x").agg(F.count("*").alias("hidden"))
    pairs = met.where("y IS NOT NULL").groupBy("x", "y", "n", "m").agg(
        F.sum(F.when(~F.col("large"), F.col("times")).otherwise(0)).alias("times"), F.max("large").alias("large"))
    known = pairs.join(in_large, "x", "left").join(in_large.select(F.col("x").alias("y"), F.col("hidden").alias("other")), "y", "left")
    met_ = F.col("times") + F.least(F.coalesce("hidden", F.lit(0)), F.coalesce("other", F.lit(0)))
    left = F.ceil(F.greatest("n", "m") * percent / 100) - 1
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    return known.where(F.col("large") | (met_ + left >= need)).select("x", "y")


def _sign(cid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """One number for a class and the document that stands for it."""
    return mixed(cid.view("uint64") ^ mixed(doc_id.view("uint64")))


def _signs(classes: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, doc_id = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_sign(cid, doc_id).view("int64"))], ["h"])

    return classes.select("cid", F.coalesce("least", F.lit(0)).alias("least")).mapInArrow(sign, "h long")


def _segments(docs: DataFrame, wanted, salt: int, size: int) -> DataFrame:
    """(cid, f, n, part): the sets of the wanted classes, cut into fragments of the order; seldom a class twice."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits, cuts = wanted.value, np.array([2**64 * k // FRAGMENTS for k in range(1, FRAGMENTS)], "uint64")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                found = sets(rows.column(1).to_pylist(), size)
                cids = np.array([class_of(s, salt) for s in found], "int64")
                ids = rows.column(0).to_numpy(zero_copy_only=False).astype("int64")
                cid, f, n, parts = [], [], [], []
                for i in np.flatnonzero(marked(bits, _sign(cids, ids), BITS)):
                    c, one = int(cids[i]), found[i]
                    if c in seen:
                        continue
                    seen.add(c)
                    for k, part in enumerate(np.split(one, np.searchsorted(one, cuts))):
                        if len(part):
                            cid.append(c)
                            f.append(k)
                            n.append(len(one))
                            parts.append(part.view("int64"))
                if cid:
                    ends = np.cumsum([0, *map(len, parts)]).astype("int32")
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(f, pa.int32()), pa.array(n, pa.int32()), lists], ["cid", "f", "n", "part"])

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(emit, "cid long, f int, n int, part array<long>")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(x, y, nx, ny, both): overlaps counted per fragment and summed per pair."""
    first = pairs.join(segments.select(F.col("cid").alias("y"), "f", F.col("n").alias("ny"), F.col("part").alias("b")), "y")
    each = first.join(segments.select(F.col("cid").alias("x"), "f", F.col("n").alias("nx"), F.col("part").alias("a")), ["x", "f"])
    # A class that two tasks have cut has equal segments, which count once.
    part = each.groupBy("x", "y", "nx", "ny", "f").agg(F.max(F.size(F.array_intersect("a", "b"))).cast("long").alias("both"))
    return part.groupBy("x", "y", "nx", "ny").agg(F.sum("both").alias("both"))


def links_among(docs: DataFrame, pairs: DataFrame, per_class: DataFrame, salt: int, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The candidate ``pairs`` (x, y) that are similar enough, and the segments of all classes of ``pairs``; both written."""
    ends = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(_signs(per_class.join(ends, "cid", "left_semi")), BITS))
    segments = written(_segments(docs, wanted, salt, size), "segments")
    found = overlaps(pairs, segments)
    union = F.col("nx") + F.col("ny") - F.col("both")
    return written(found.where(F.col("both") * 100 >= union * percent).select("x", "y"), "similar"), segments


def _left_over(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in one large bucket that are in different components."""
    placed = members.join(roots, members["x"] == roots["node"], "left").select("h", "x", "n", "at", F.coalesce("root", "x").alias("root"))
    mixed_ = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
    placed = written(placed.join(mixed_, "h"), "mixed")
    per_root = placed.groupBy("h", "root").agg(F.count("*").alias("size"))
    main = per_root.groupBy("h").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    tagged = placed.join(main, "h")
    minor = tagged.where("root <> main").select("h", F.col("x").alias("y"), F.col("n").alias("m"), F.col("at").alias("b"), F.col("root").alias("other"))
    both = tagged.join(minor, "h").where("root <> other AND (root = main OR x < y)")
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    both = both.where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("b")) >= need))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def ngram_join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest doc_id)."""
    return _joined(docs, size, percent).select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest doc_id, and all rows without words; all columns kept.

    A row is found again by its doc_id and text together, so absent and repeated doc_ids do not matter.
    """
    joined = _joined(docs, size, percent)
    best = joined.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")).alias("best"))
    keep = best.select(row_key(F.col("best.doc_id"), F.col("best.text_sha256")).alias("key"))
    text = whole_text()
    words = text.rlike(WORD)
    key = row_key(F.col("doc_id").cast("long"), F.sha2(text.cast("binary"), 256))
    return keep_keys(docs.where(words), key, keep).unionByName(docs.where(~words))


def roots_of(docs: DataFrame, per_class: DataFrame, salt: int, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (node, root) of the classes that link with any, and the segments (cid, f, n, part) of these classes and a few more."""
    hot = docs.sparkSession.sparkContext.broadcast(bitmap(_hot_shingles(docs, size), BITS))
    met = written(_meet(_prefixes(docs, hot, salt, size, percent), percent), "met")
    pairs = written(candidates(met, percent), "pairs")
    similar, segments = links_among(docs, pairs, per_class, salt, size, percent)
    roots = components(similar)
    large = met.where("y IS NULL").select("h", "x", "n", "at")
    if not large.isEmpty():
        more = written(_left_over(large, roots, percent).join(pairs, ["x", "y"], "left_anti"), "pairs")
        if not more.isEmpty():
            others, further = links_among(docs, more, per_class, salt, size, percent)
            roots, segments = components(similar.unionByName(others)), segments.unionByName(further)
    return roots, segments


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, text_sha256, root of its component, component_id."""
    salt = 0

    def classes(salt: int) -> DataFrame:
        return written(per_text(docs, "n_shingles long, cid long, full binary, text_sha256 string", lambda: lambda texts: list(zip(*(
            (len(s), class_of(s, salt), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
             hashlib.sha256((t or "").encode()).hexdigest()) for s, t in zip(sets(texts, size), texts))))), "classes")

    members = classes(salt)
    # Class numbers of 64 bits must tell all classes apart; another salt is taken otherwise.
    while not members.groupBy("cid").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").isEmpty():
        salt += 1
        members = classes(salt)
    per_class = written(members.groupBy("cid").agg(F.min("doc_id").alias("least")), "per-class")
    roots, _ = roots_of(docs, per_class, salt, size, percent)
    per_class = per_class.join(roots, per_class["cid"] == roots["node"], "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    per_root = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = per_class.join(per_root, "root").select("cid", "root", "component_id")
    return members.join(named, "cid").select("doc_id", "n_shingles", "text_sha256", "root", "component_id")


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
c AS (SELECT r, r AS o FROM d UNION SELECT e.y, c.o FROM c JOIN e ON e.x = c.r),
m AS (SELECT c.o AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN m ON m.r = s.r
"""
