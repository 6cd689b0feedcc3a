"""Spelling variant grouping: words one edit apart, found by moving states through a trie kept as an edge table.

The words of a vocabulary, each with an end mark, form a trie. A node is named by its path, so the table of edges
(path, first, second: the next two letters) is a relation, distributed like any other, and so are the states
(word, position, path, edits). A word's unedited states are its own prefixes. In every round all states are joined with the
edges: an unedited state becomes an edited one by taking another first letter than the word's own (a replacement) or by
leaving out the word's letter; an edited state must find the word's next two letters. A state whose path ends with the
mark has spelled a word one edit away.

* Every pair is found from one side where that is enough: a replacement only by the larger letter, an insertion as the other
  word's omission; of a run of one letter only the last is left out.
* One trie is of the words, the other of the reversed words. A word makes its edit in the second half of either, where nodes have few
  edges; the first letters, where every word branches to the whole alphabet, are never branched on. The second letter of an
  edge belongs to the join key, so only branches that go on are made at all.
* A node has at most as many edges as there are pairs of letters; a node that many states meet is split at run time.

A state carries its word and its path, which for long words would be quadratic. Words beyond ``LONG`` code points are paired by the
hash of what is left without one letter, one row a letter, and compared afterwards: the result is the same.

Each round is written to the shared folder; words of up to ``LONG`` letters take at most ``LONG / 4 + 1`` rounds.

Absent texts have no words, an absent doc_id is written as nothing before the colon. Repeated rows count each. An empty table, or one
without words, gives an empty result. Texts of any length are whole. Of equally frequent forms the first in code-point order is taken. Only
doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.session import written

#: Code points up to which a word moves through the trie; words counted by a task before their counts are handed on.
LONG, HELD = 48, 400_000
#: End of a word: no letter, and before all of them.
END = "\n"
#: Runs of letters, as UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: One run in so many loses a letter, by its checksum (part of the contract).
_SPOIL = 97


def _spoiled(run: bytes, checksum: int) -> bytes:
    letters = run.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def count_words(docs: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, one run in 97 without one letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            long_enough = [(w.decode(), n) for w, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long_enough], pa.string()), pa.array([n for _, n in long_enough], pa.int64())], ["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = crc(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                # bytes.lower changes A-Z only.
                counts.update([w if (h := crc(w, start)) % _SPOIL else _spoiled(w, h) for w in _RUN.findall(text.as_buffer().to_pybytes().lower())])
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.where(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letter(word: str, at: Column) -> Column:
    return F.substring(F.col(word), at + 1, F.lit(1))


def _marked(words: DataFrame) -> DataFrame:
    """Both spellings of every word with two end marks, and the first position that may be edited in each."""
    size = F.length("word")
    ways = F.array(
        F.struct(F.lit(False).alias("back"), F.concat("word", F.lit(END * 2)).alias("spelled"), F.floor(size / 2).cast("int").alias("half")),
        F.struct(F.lit(True).alias("back"), F.concat(F.reverse("word"), F.lit(END * 2)).alias("spelled"), F.ceil(size / 2).cast("int").alias("half")))
    return words.select(F.explode(ways).alias("w")).select("w.*")


def trie_edges(words: DataFrame) -> DataFrame:
    """back, path, first, second: the next two letters after every prefix, of the words and of the reversed words."""
    at = _marked(words).select("back", "spelled", F.explode(F.sequence(F.lit(0), F.length("spelled") - 2)).alias("at"))
    return at.select("back", F.substring("spelled", F.lit(1), F.col("at")).alias("path"), _letter("spelled", F.col("at")).alias("first"),
                     _letter("spelled", F.col("at") + 1).alias("second")).distinct()


def _unedited(words: DataFrame) -> DataFrame:
    """back, spelled, at, path: the states before an edit at letter ``at`` of the second half."""
    states = _marked(words).select("back", "spelled", F.explode(F.sequence(F.col("half"), F.length("spelled") - 3)).alias("at"))
    return states.withColumn("path", F.substring("spelled", F.lit(1), F.col("at")))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Edited states after the word's own next two letters."""
    at = states.withColumn("first", _letter("spelled", F.col("at"))).withColumn("second", _letter("spelled", F.col("at") + 1))
    return at.join(edges, ["back", "path", "first", "second"]).select(
        "back", "spelled", (F.col("at") + 2).alias("at"), F.concat("path", "first", "second").alias("path"))


def trie_neighbours(words: DataFrame) -> DataFrame:
    """word, other: every pair of the short words one edit apart, in one or both orders."""
    edges = written(trie_edges(words), "spelling-edges")
    start = _unedited(words)
    replaced = start.withColumn("second", _letter("spelled", F.col("at") + 1)).join(edges, ["back", "path", "second"]).where(
        F.col("first") > _letter("spelled", F.col("at"))).select(
        "back", "spelled", (F.col("at") + 2).alias("at"), F.concat("path", "first", "second").alias("path"))
    omitted = start.where(_letter("spelled", F.col("at")) != _letter("spelled", F.col("at") + 1)).withColumn("at", F.col("at") + 1)
    states = written(replaced.unionByName(_step(omitted, edges)), "spelling-states")
    over, done = F.col("path").endswith(END), None
    while True:
        ended = states.where(over)
        done = ended if done is None else done.unionByName(ended)
        live = states.where(~over)
        if live.isEmpty():
            break
        states = written(_step(live, edges), "spelling-states")

    def plain(spelled: str) -> Column:
        word = F.rtrim(spelled, F.lit(END))
        return F.when(F.col("back"), F.reverse(word)).otherwise(word)

    return done.select(plain("spelled").alias("word"), plain("path").alias("other"))


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, size, at, left: a hash of the word without its letter ``at``; at = -1: of the whole word."""
    for batch in batches:
        for word in batch.column(0).to_pylist():
            n = len(word)
            tail, power, back = 0, 1, [0] * (n + 1)
            powers = [1] * (n + 1)
            for i in range(n - 1, -1, -1):
                tail = (tail + ord(word[i]) * power) % _PRIME
                power = power * _BASE % _PRIME
                back[i], powers[n - i] = tail, power
            head, left = 0, [tail]
            for i in range(n):
                left.append((head * powers[n - i - 1] + back[i + 1]) % _PRIME)
                head = (head * _BASE + ord(word[i])) % _PRIME
            for low in range(0, n + 1, 1 << 16):
                part = left[low:low + (1 << 16)]
                at = np.arange(low - 1, low - 1 + len(part), dtype="int32")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.full(len(part), n, "int32")), pa.array(at), pa.array([word] * len(part)).dictionary_encode().cast(pa.string())],
                                                 ["left", "size", "at", "word"])


def long_neighbours(words: DataFrame) -> DataFrame:
    """word, other: every pair of the long words one edit apart. Words that agree without one letter, or without one of
    the same place, are compared; at most an alphabet of words agrees in the latter."""
    numbered = words.select("word", F.xxhash64("word").alias("id"))
    rows = words.select("word").mapInArrow(_without_one, "left long, size int, at int, word string").select(
        "left", "size", "at", F.xxhash64("word").alias("id"))
    # A run of one letter gives the same rest at each of its letters; one is enough for omissions.
    whole = rows.where("at < 0").select("left", F.col("size").alias("of"), F.col("id").alias("other"))
    omitted = rows.where("at >= 0").select("left", (F.col("size") - 1).alias("of"), "id").distinct().join(whole, ["left", "of"])
    a, b = rows.where("at >= 0"), rows.where("at >= 0").select("left", "size", "at", F.col("id").alias("other"))
    replaced = a.join(b, ["left", "size", "at"]).where("id < other")
    pairs = omitted.select("id", "other").unionByName(replaced.select("id", "other")).distinct()
    named = pairs.join(numbered, "id").join(numbered.select(F.col("id").alias("other"), F.col("word").alias("other_word")), "other")
    return named.where(F.levenshtein("word", "other_word", 1) == 1).select("word", F.col("other_word").alias("other"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, other: all ordered pairs of different words that one inserted, deleted or replaced code point tells apart."""
    short, long = words.where(F.length("word") <= LONG), words.where(F.length("word") > LONG)
    # A word just below the bound may have a neighbour just above it.
    found = trie_neighbours(short)
    beyond = words.where(F.length("word") >= LONG)
    if not long.isEmpty():
        found = found.unionByName(long_neighbours(beyond))
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of words and counts (word, n).

    ``form`` is the most frequent near word if it is at least ``ratio`` times as frequent; ``root`` follows forms to the last. A form is more
    frequent than its word, so there are no circles, and each round doubles the distance that is known.
    """
    words = written(words.select("word", "n"), "spelling-words")
    near = neighbours(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), "other")).alias("best"))
    formed = F.col("best.down") <= -ratio * F.col("n")
    table = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.down")).alias("form_n")), "spelling-forms")
    known = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(known.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if known.where("moved").isEmpty():
            break
        known = known.drop("moved")
    return table.join(known.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents WHERE text IS NOT NULL),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
named AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM lowered),
-- The checksum by half bytes, the low half of each byte first.
summed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x)::BIGINT), lambda i:
    (strpos('0123456789ABCDEF', substr(x, (i // 2 * 2 + 2 - i % 2)::BIGINT, 1)) - 1)::BIGINT)), lambda s, v:
    xor(s >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
      3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[xor(s & 15, v) + 1])), 4294967295::BIGINT) AS h FROM named),
counted AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run) + 2)::BIGINT)) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM summed GROUP BY 1),
words AS (SELECT * FROM counted WHERE length(word) >= 5 AND n >= 3),
left_out AS (SELECT word, spot, concat(substr(word, 1, spot - 1), substr(word, spot + 1)) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS spot FROM words)),
one_way AS (SELECT a.word, b.word AS other FROM left_out a JOIN left_out b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT l.word, w.word FROM left_out l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM left_out l JOIN words w ON w.word = l.rest),
near AS (SELECT o.word, count(*) AS n_near, first(o.other ORDER BY w.n DESC, o.other) AS best, max(w.n) AS best_n FROM one_way o JOIN words w ON w.word = o.other GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
roots AS (WITH RECURSIVE r AS (SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM forms f JOIN r ON f.form = r.word) SELECT * FROM r)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
