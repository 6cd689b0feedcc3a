"""Byte-level BPE encoding and decoding by merge replay over a collection of words.

The texts of a block are split by the pattern, and every word that is new to the task enters one
collection of symbols. An inverted index names, for each rank, the positions where a pair of that rank starts.
Ranks are applied in order over the whole collection, and a merge looks again only at its two neighbours. So a
word is encoded once a task, however often it occurs, and a run of a million letters costs its
length times a logarithm.

The collection is that of a block of texts (``BLOCK`` characters), not of the whole corpus: giving the ids of a corpus-wide
word table back to every occurrence would shuffle each occurrence of each word. Nothing is shuffled here.
The words of earlier blocks are remembered; beyond ``REMEMBER`` of them, those that the block at hand
uses again. That changes the work only.

A word that is a token itself becomes that token. Where a merge makes a pair of a lower rank, that one goes first, then
the rest of the higher rank, each from left to right; so ids are those of merging word by word.

An absent text counts as empty, and an empty one has no ids. Rows are independent: repeated rows give repeated rows, ties cannot arise,
texts of any length are whole, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block; words remembered by a task, and the longest of them.
BLOCK, REMEMBER, LONGEST = 1 << 21, 250_000, 64
#: Rows of a block at most.
ROWS = 1000
#: Between two words; a symbol that went into the one before it.
_GAP, _GONE = -1, -2


def load_ranks(path: str) -> bytes:
    """The rank file (token in base64, rank) as it is; it is read on the driver and sent along."""
    with open(path, "rb") as file:
        return file.read()


class Merges:
    """Tokens by rank, the rank of each pair of tokens whose bytes together are a token, and the ids of single bytes."""

    def __init__(self, ranks: bytes):
        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line.strip())}
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        #: By left token: right token to rank.
        self.pairs: list[dict[int, int]] = [{} for _ in self.token]
        for token, rank in self.rank.items():
            self.token[rank] = token
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left][right] = rank
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], "int64")
        #: Rank of each pair of single bytes, by both bytes; -1 for none.
        self.first = np.full(1 << 16, -1, "int64")
        for a in range(256):
            for b in range(256):
                self.first[a << 8 | b] = self.rank.get(bytes([a, b]), -1)


@lru_cache(maxsize=4)
def merges_of(ranks: bytes) -> Merges:
    return Merges(ranks)


def _start_index(symbols: np.ndarray, known: Merges) -> dict[int, list[int]]:
    """Positions of the pairs of single bytes by rank; ``symbols`` are bytes, and gaps."""
    left, right = symbols[:-1], symbols[1:]
    ranks = np.where((left >= 0) & (right >= 0), known.first[(left.clip(0) << 8) | right.clip(0)], -1)
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    found, starts = np.unique(ranks[at], return_index=True)
    return {int(r): part.tolist() for r, part in zip(found, np.split(at, starts[1:]))} if len(at) else {}


def replay(words: list[bytes], known: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each."""
    sizes = np.array([len(w) for w in words], "int64")
    ends = np.cumsum(sizes + 1)  # of each word with the gap before it
    symbols = np.full(int(ends[-1] if len(words) else 0) + 1, _GAP, "int64")
    inside = np.ones(len(symbols), bool)
    inside[np.concatenate([[0], ends])] = False
    symbols[inside] = np.frombuffer(b"".join(words), "uint8")
    index = _start_index(symbols, known)
    token = np.where(inside, known.byte[symbols.clip(0)], _GAP).tolist()
    after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
    pairs, ready, push = known.pairs, sorted(index), heapq.heappush
    while ready:
        rank = heapq.heappop(ready)
        spots = index.pop(rank)
        spots.sort()
        further = pairs[rank].get
        for n, i in enumerate(spots):
            left = token[i]
            if left < 0:
                continue
            j = after[i]
            if pairs[left].get(token[j]) != rank:
                continue
            k, h, lower = after[j], before[i], False
            token[i], token[j], after[i], before[k] = rank, _GONE, k, i
            left = token[h]
            if left >= 0:
                made = pairs[left].get(rank)
                if made is not None:
                    lower = made < rank
                    if made in index:
                        index[made].append(h)
                    else:
                        index[made] = [h]
                        push(ready, made)
            made = further(token[k])
            if made is not None:
                lower = lower or made < rank
                if made in index:
                    index[made].append(i)
                else:
                    index[made] = [i]
                    push(ready, made)
            if lower:
                index[rank] = spots[n + 1:]
                push(ready, rank)
                break
    token = np.array(token, "int64")
    starts = np.concatenate([[0], ends[:-1]]) if len(words) else np.zeros(0, "int64")
    counts = np.add.reduceat(token >= 0, starts) if len(words) else starts
    return token[token >= 0], counts


class Encoder:
    """Encodes lists of texts; remembers words between the calls."""

    def __init__(self, ranks: bytes, pattern: str):
        self.known, self.split, self.memory = merges_of(ranks), regex.compile(pattern).findall, {}

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        lists = [self.split(t) if t else [] for t in texts]
        used = set().union(*lists)
        if len(self.memory) > REMEMBER:
            # What this block uses again is likely to come back.
            self.memory = {w: self.memory[w] for w in used if w in self.memory}
        memory = self.memory
        fresh = list(used.difference(memory))
        del used
        self._learn(fresh)
        flat: list[int] = []
        offsets = [0]
        for words in lists:
            flat.extend(chain.from_iterable(map(memory.__getitem__, words)))
            offsets.append(len(flat))
        for word in fresh:
            if len(word) > LONGEST:
                del memory[word]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, "int32")))

    def _learn(self, words: list[str]) -> None:
        rank, whole = self.known.rank, [w.encode() for w in words]
        cut = []
        for word, raw in zip(words, whole):
            if raw in rank:
                self.memory[word] = (rank[raw],)
            else:
                cut.append((word, raw))
        ids, counts = replay([raw for _, raw in cut], self.known)
        ids, at = ids.tolist(), 0
        for (word, _), n in zip(cut, counts.tolist()):
            self.memory[word] = tuple(ids[at:at + n])
            at += n


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row: the tokens of its whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts = rows.column(1).to_pylist()
                for part in _blocks(texts):
                    keys = rows.column(0).slice(part.start, part.stop - part.start)
                    yield pa.RecordBatch.from_arrays([keys, encoder(texts[part])], [key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``: those of its ids, one token after another; an absent list gives no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merges_of(ranks).token.__getitem__
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            # The bytes of absent lists are none, as their offsets agree.
            found = [b"".join(map(token, flat[low:high].tolist())) for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], [key, "ids", "bytes"])

    return encoded.select(F.col(key).cast("long").alias(key), F.col(ids).alias("ids")).mapInArrow(
        run, f"{key} long, ids array<int>, bytes binary")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of tokens, and digests of the ids (decimal, joined by commas) and of the decoded bytes."""
    return decoded.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
