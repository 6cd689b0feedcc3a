import random
import re
from collections import defaultdict

from segmentlab.llm import mixing


def level(sizes, weights, most):
    """Targets by sharing the excess again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = left - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if target[s] >= most * sizes[s]]
        if not over:
            return {**target, **fixed}
        fixed |= {s: most * sizes[s] for s in over}


def check(docs, rows):
    got = mixing.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = level(size, mixing.WEIGHTS, mixing.MOST) if sum(size.values()) else dict.fromkeys(size, 0)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= mixing.MOST * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs(rows).repartition(7)).collect()))


def test_mix(docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "é", None, "Z"])) for i in range(400)]
    rows += [(1, None, "a"), (2, "", "b"), (3, " \n", None), (4, "x", "tiny"), (None, "a b c", "a"), (7, "q " * 50_000, "b")]
    check(docs, rows + rows[-4:] + [(500, "same row", "a")] * 30)


def test_few_words(docs):
    check(docs, [(1, "a", "s"), (2, None, "t"), (3, "", None)])
    check(docs, [(1, None, "s"), (2, "", "t")])
    assert mixing.mix_sources(docs([])).collect() == []


def test_one_source_takes_its_own_size(docs):
    check(docs, [(i, "a b c", "s") for i in range(10)])


def test_order_is_random_by_key(docs):
    rows = [(i, "a", "big") for i in range(300)] + [(1000 + i, "a", "x" + str(i)) for i in range(2)]
    part = [r.doc_id for r in mixing.mix_sources(docs(rows), weights=(1, 50, 50)).collect() if r.source == "big" and r.taken]
    assert part and part != list(range(len(part)))
