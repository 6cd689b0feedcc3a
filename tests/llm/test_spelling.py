"""Spelling variants against brute force over all pairs."""

import random


from segmentlab.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(counts, ratio=2):
    out = {}
    for word, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if one_edit(word, o))
        formed = bool(near) and -near[0][0] >= ratio * n
        out[word] = [near[0][1] if formed else None, n, len(near), -near[0][0] if formed else None]
    for word, found in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        found.insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def grouped(spark, counts):
    rows = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_random_words(spark):
    rng = random.Random(7)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice((3, 3, 6, 7, 12, 30, 100)) for _ in range(600)}
    assert grouped(spark, counts) == brute(counts)


def test_runs_ends_and_long_words(spark):
    """Runs of a letter, edits at both ends, ties, chains of forms, and words around and far beyond the bound of the trie."""
    words = ["aaaaa", "aaaaaa", "aaaabaa", "xaaaaa", "aaaaax", "hello", "hellos", "jello", "hallo", "helo", "mello", "ñello", "ÿello"]
    for size in (spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, 300, 20_000):
        base = "".join("abcdefghij"[i * i % 10] for i in range(size))
        words += [base, base + "z", "z" + base, base[:size // 2] + "zz" + base[size // 2 + 1:], base[:-1] + "q", "q" + base[1:], base[:7] + base[8:], "e" * size, "e" * (size + 1)]
    counts = {w: 3 * (1 + i % 5) ** 2 for i, w in enumerate(words)}
    assert grouped(spark, counts) == brute(counts)


def test_without_words(spark, docs):
    empty = spelling.group_variants(spelling.count_words(docs([(1, None), (2, ""), (3, "123 !"), (4, "abcd abcd abcd")])))
    assert empty.collect() == []
    assert spelling.count_words(docs([]).limit(0)).collect() == []


def test_counts(spark, docs):
    """Every occurrence counts, also of repeated rows and rows without doc_id; a run in 97 loses one letter."""
    import re
    import zlib
    from collections import Counter

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcABCÀéÿ×") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = [(i if i % 7 else None, " ".join(rng.choices(vocabulary, k=200)) + "1x") for i in range(60)]
    rows.append(rows[5])
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            want[word if h % 97 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    found = {r.word: r.n for r in spelling.count_words(docs(rows)).collect()}
    assert found == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_counts_handed_on_in_parts(spark, docs, monkeypatch):
    rows = [(i, "ninety nineteen ninety words " * 3) for i in range(50)]
    whole = sorted(map(tuple, spelling.count_words(docs(rows)).collect()))
    monkeypatch.setattr(spelling, "HELD", 2)
    assert sorted(map(tuple, spelling.count_words(docs(rows)).collect())) == whole
