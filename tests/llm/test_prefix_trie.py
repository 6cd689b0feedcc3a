"""The conversation prefix trie against brute force, with blocks of a few rows so that intervals span many."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from segmentlab.llm import prefix_trie as t

FIELDS = "conv_id long, turn long, role string, text string"


def brute_rebuild(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        out[c] = tuple(base[:h] + turns[h:])
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, ids in members.items():
        under = [m for m in members if m[:len(node)] == node]
        childless = [m for m in under if not any(len(o) == len(m) + 1 and o[:-1] == m for o in members)]
        ends = sorted(c for c in ids if convs[c] == node)
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(o) == len(node) + 1 and o[:-1] == node for o in members), len(childless),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(convs):
    return [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def trie(spark, rows, block, rebuild=False):
    own = t.sequences(spark.createDataFrame(rows, FIELDS))
    found = t.prefix_trie(t.rebuilt(own) if rebuild else own, block)
    return sorted(map(tuple, found.collect()), key=str)


def some(rng, n, letters, longest):
    return {c: tuple((rng.choice("ab"), rng.choice(letters)) for _ in range(rng.randint(1, longest))) for c in rng.sample(range(-500, 5000), n)}


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
@pytest.mark.parametrize("letters,longest", [(["x"], 5), (["x", "yy", "zzz"], 4), (["w" * i for i in range(20)], 3)])
def test_random(spark, block, letters, longest):
    convs = some(random.Random(block * 31 + longest), 60, letters, longest)
    assert trie(spark, rows_of(convs), block) == brute_trie(convs)


def test_deep_shared_beginnings(spark):
    """Long common beginnings across many blocks, one conversation being the beginning of others, and copies."""
    base = tuple(("u", f"t{i}") for i in range(40))
    convs = {c: base[:c % 41] + (("a", "end"),) * (c % 3) for c in range(1, 90)} | {c: base for c in range(200, 230)}
    for block in (2, 5):
        assert trie(spark, rows_of({c: v for c, v in convs.items() if v}), block) == brute_trie({c: v for c, v in convs.items() if v})


def test_rebuilt_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "", "user"]), "same") for c in list(range(0, 40)) + [100, 101, 233, 250, -7, -100, -130] for _ in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "lost"), (55, 0, "user", "x" * 200_000), (56, 0, "user", "x" * 200_000)]
    rows = [r if r[1] is not None else (r[0], None, "user", None) for r in rows]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    for block in (3, 1024):
        assert trie(spark, rows, block, rebuild=True) == brute_trie(brute_rebuild(rows))


def test_turnless_conversations(spark):
    """Rebuilding may leave no turn: the conversation then ends at the root."""
    gone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(gone, 1, "u", "a"), (gone, 2, "u", "b"), (500, 1, "u", "a")]
    found = trie(spark, rows, 2, rebuild=True)
    assert found == brute_trie(brute_rebuild(rows))
    assert trie(spark, rows[:2], 2, rebuild=True) == brute_trie(brute_rebuild(rows[:2]))


def test_no_conversation_and_clashing_columns(spark):
    assert trie(spark, [], 4) == []
    assert trie(spark, [(None, 1, "u", "x")], 4) == []
    rows = [(1, 1, "u", "a"), (2, 1, "u", "b")]
    wide = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], FIELDS + ", n long, key string, least long")
    assert sorted(map(tuple, t.prefix_trie(t.sequences(wide)).collect()), key=str) == brute_trie(brute_rebuild(rows) and {1: (("u", "a"),), 2: (("u", "b"),)})


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 77)
    table = t.RangeMin(values)
    for _ in range(300):
        at, bound = int(rng.integers(0, 78)), int(rng.integers(0, 10))
        before = [i for i in range(at) if values[i] < bound]
        later = [i for i in range(at, 77) if values[i] < bound]
        assert table.left(np.array([at]), np.array([bound]))[0] == (before[-1] if before else -1)
        assert table.right(np.array([at]), np.array([bound]))[0] == (later[0] if later else 77)
        low = int(rng.integers(0, 78))
        assert table.least(np.array([min(low, at)]), np.array([max(low, at)]), 99)[0] == min(values[min(low, at):max(low, at)].tolist(), default=99)
