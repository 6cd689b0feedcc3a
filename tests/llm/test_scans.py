"""Toxicity, licenses, secrets and personal data."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import pytest

from segmentlab.llm import licenses, pii, secret_scan, toxicity
from segmentlab.llm.common import table

TEXTS = [None, "", " ", "plain words only", "ÄÖÜ straße 中文 🙂"]
SF = "/root/testdata/sf0.01"


# toxicity

def test_folding():
    assert toxicity.folded("1d10t, Ｍoron! сlоwn") == " idiot moron clown "
    assert toxicity.folded("id​iot tr@sh") == " idiot trash "
    assert toxicity.folded(None) == toxicity.folded(" \n") == "  "


def test_longest_entry_and_exceptions():
    matcher = toxicity.automaton({" trash ": 2.0, " mor": 1.0, " moron ": 3.0})
    assert toxicity.hits(matcher, toxicity.folded("trash")) == [2.0]
    assert toxicity.hits(matcher, toxicity.folded("the trash can, a moron, a more")) == [3.0, 1.0]


def test_toxicity_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = toxicity.score_toxicity(docs, *toxicity.train(docs, labels)).join(labels, "doc_id")
    held = scored.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).select("score", "predicted", "toxic").collect()
    bad = [r for r in held if r.toxic == 1]
    good = [r for r in held if r.toxic == 0]
    assert len(bad) >= 10
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)  # a few junk texts carry the label without any such word
    assert sum(r.predicted for r in good) <= 0.02 * len(good)


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "you idiot"), (7, "idiot " * 30_000), (7, "idiot " * 30_000)]
    lexicon, curve = toxicity.train(docs(rows), none)
    got = toxicity.score_toxicity(docs(rows), lexicon, curve).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.predicted for r in got if r.doc_id == 7] == [1, 1]
    assert toxicity.score_toxicity(docs([]), lexicon, curve).collect() == []
    kept = toxicity.reject_toxic(docs(rows), lexicon, curve)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == set(range(len(TEXTS)))


# licenses

def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_license_base(docs):
    rng = random.Random(2)
    words = ["MIT", "License", "license", "apache", "general", "public", "gnu", "x", "é", "und", "2.0", "(mit)", "licenses"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "MIT\nLicense"), (90, "mit license " * 20_000)]
    rows += [(100 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += rows[-2:]
    got = licenses.scan_licenses(docs(rows)).collect()
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_words, r.n_base))), sorted(rows, key=lambda x: str((x[0], len(brute_words(x[1])), 0)))):
        w, places = brute_words(text), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
        assert (r.doc_id, r.n_words, r.n_base) == (doc_id, len(w), len(places))
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scan_licenses(docs([])).collect() == []


def test_rules_and_suppression():
    assert len(licenses.rules()) > 200

    def labels(text):
        return [rule.label for _, _, rule in licenses.detect(text.lower())]

    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache"]
    assert labels("under the GNU Lesser General Public License version 2.1 only") == ["lgpl"]
    assert labels("Licensed under the Apache License, Version 2.0 (the license)") == ["apache"]
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels("a license to kill") == []
    assert {"mit", "bsd"} <= set(labels("MIT License or BSD license"))


WORDINGS = ("Permission is hereby granted, free of charge, to any person obtaining a copy", "to deal in the Software without restriction",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
            "Redistribution and use in source and binary forms, with or without modification",
            "Neither the name of the holder nor the names of its contributors may be used to endorse or promote",
            "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
            "redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the Apache License, Version 2.0",
            "https://www.apache.org/licenses/LICENSE-2.0", "https://www.mozilla.org/en-US/MPL", "https://www.gnu.org/licenses/gpl-3.0", "https://www.gnu.org/licenses/lgpl",
            "https://www.gnu.org/licenses/agpl", "https://opensource.org/licenses/MIT", "https://opensource.org/licenses/BSD-3-Clause",
            "creativecommons.org/licenses/by-sa/4.0", "creativecommons.org/licenses/by-nc/4.0", "creativecommons.org/licenses/by/4.0",
            "creativecommons.org/publicdomain/zero/1.0", "boost.org/LICENSE_1_0", "free and unencumbered software released into the public domain",
            "placed in the public domain", "This software is provided 'as-is', without any express or implied warranty", "do what the fuck you want to",
            "All rights reserved", "proprietary and confidential", "Copyright (c) 2019")


def test_gates_hide_no_rule():
    samples = list(WORDINGS)
    for _, names, ids, versions in licenses.FAMILIES:
        samples += [f"SPDX-License-Identifier: {i}" for i in ids]
        for name in names:
            samples += [f"released under the {name} v{v}." for v in versions] + [f"the {name} license", f"licensed under the terms of the {name}", f"license: {name}"]
    texts = samples + [t.replace(" ", "\n") for t in samples] + [t.replace(" ", " \r\n\t") for t in samples]
    ungated = [",".join(f"{rule.label}:{s}:{e}" for s, e, rule in licenses.detect(t.lower(), gated=False)) for t in texts]
    assert licenses.scan(texts)[7] == ungated and all(ungated)
    met = {id(rule) for t in texts for rule in licenses.rules() if rule.pattern.search(t.lower())}
    assert len(met) == len(licenses.rules())
    for text, label in (("released under the GNU GPL v3.", "gpl"), ("CC BY-SA 4.0", "cc-by-sa"), ("Mozilla Public 2.0", "mpl"), ("Apache 2.0", "apache"),
                        ("permission is hereby\ngranted, free of charge, to any person obtaining a copy", "mit"), ("all rights\nreserved", "proprietary")):
        assert label in licenses.scan([text])[5][0].split(","), text


# secrets

def joined(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def brute_secrets(text):
    found = []
    pattern = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")).replace("[__]", "_")
    for m in re.finditer(pattern + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return found


def test_secret_base(docs):
    rng = random.Random(4)
    pieces = ["password", "Token", "API_KEY", "apikey", "secret", "=", ": ", '"', "abcdefgh1", "short", "AKIA", "ABCDEFGHIJKL9", "0123456789abcdef" * 2,
              "deadbeef", " ", "\n", "é", "paſſword", "toKen"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "token=abcdefgh"), (50, "a" * 200_000), (51, "token: " * 30_000)]
    rows += [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs(rows)).collect()}
    for doc_id, text in rows:
        base, r = brute_secrets(text or ""), got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, *_ in base) for kind in secret_scan.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base, secret_scan.KINDS).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
    assert secret_scan.scan_secrets(docs([])).collect() == []


SECRET = "token=abcdefgh12345678"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize("wrap", [
    lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    b64,
    lambda s: b64(zlib.compress(s.encode())),
    lambda s: b64(gzip.compress(s.encode(), mtime=0)),
    lambda s: b64(b64(b64(s))),
    lambda s: "".join(f"%{ord(c):02x}" for c in b64(gzip.compress(b64(s).encode(), mtime=0))),
    lambda s: b64("".join(f"\\u{ord(c):04x}" for c in "".join(f"%{ord(c):02x}" for c in s))),
])
def test_layers(wrap):
    text = f"é before {wrap(SECRET)} after"
    spans, _ = secret_scan.all_spans(text)
    assert any(k == "assign" and 9 <= s and e <= len(text) - 6 for s, e, k in spans), spans


def test_layer_positions_and_cycles():
    text = "x %74oken=abcdefgh%31%32 y"
    assert secret_scan.all_spans(text)[0] == {(2, len(text) - 2, "assign")}
    assert secret_scan.all_spans("%25" * 50 + "41")[0] == set()
    twice = f"{b64(SECRET)} {b64(SECRET)}"
    assert {k for *_, k in secret_scan.all_spans(twice)[0]} == {"assign"} and len(secret_scan.all_spans(twice)[0]) == 2


def test_bomb_is_reported(monkeypatch):
    monkeypatch.setattr(secret_scan, "LAYER", 1000)
    assert secret_scan.all_spans(b64(zlib.compress(b"a" * 5000)))[1] == 1


@pytest.mark.parametrize("glue", ["https://x.org/org/{}", "key-{}", "a_{}", "{}/tail", "ab/{}-name_x", "abc{}", "x/{}/y"])
@pytest.mark.parametrize("wrap", [b64, lambda s: b64(zlib.compress(s.encode())), lambda s: b64(gzip.compress(s.encode(), mtime=0)), lambda s: b64(b64(s))])
def test_glued_words(wrap, glue):
    text = "see " + glue.format(wrap(SECRET).rstrip("=")) + " there"
    assert any(k == "assign" and 4 <= s and e <= len(text) - 6 for s, e, k in secret_scan.all_spans(text)[0]), text


def test_all_members_and_large_layers(monkeypatch):
    two = gzip.compress(b"nothing here\n") + gzip.compress(SECRET.encode())
    assert {k for *_, k in secret_scan.all_spans(b64(two))[0]} == {"assign"}
    monkeypatch.setattr(secret_scan, "LAYER", 1000)
    lines = "".join(f"line {i}\n" for i in range(2000)) + SECRET + "\n" + "more\n" * 2000
    spans, oversize = secret_scan.all_spans(b64(gzip.compress(gzip.compress(lines.encode()))))
    assert {k for *_, k in spans} == {"assign"} and oversize == 0
    spans, oversize = secret_scan.all_spans(b64(zlib.compress((" " * 5000 + SECRET + " " * 5000).encode())))
    assert {k for *_, k in spans} == {"assign"} and oversize > 0


# personal data

def brute_pii(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(int(p) for p in m[0].split(".")) <= 255:
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 13 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def test_pii_base(docs):
    rng = random.Random(6)
    pieces = ["a.b", "@", "x.org", ".", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", "+49 30 ", "(0)", "1234567", " ", "-", "+", "é", "\n"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.c"), (50, "1" * 60_000), (51, "1." * 30_000), (52, "a@" * 30_000)]
    rows += [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    got = {r.doc_id: r for r in pii.scan_pii(docs(rows)).collect()}
    for doc_id, text in rows:
        if doc_id in (50, 51):
            continue
        base, r = brute_pii(text or ""), got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS], text
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
    assert pii.scan_pii(docs([])).collect() == []


def test_field_learns_its_table_and_generalises():
    import numpy as np

    field = pii.train()
    t, y, low, high = pii.labelled_tokens()
    labels, _ = field.decode(t, low, high)
    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    assert (labels == y[at]).mean() > 0.99
    text = "Call (040) 123-4567 today or wait."
    assert (5, 19, "phone") in pii.field_spans(field, ["é", text])[1]
    assert pii.field_spans(field, ["In 2019 there were 12 cases and 345 reports of 1,200.50 each."]) == [[]]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.RandomState(1)
    t, _, low, high = pii.labelled_tokens()
    field = pii.Field(np.unique(t.shape))
    field.weights, field.moves = rng.randn(*field.weights.shape), rng.randn(*field.moves.shape)
    low, high = low[:6], np.minimum(high[:6], low[:6] + 4)
    labels, begin = field.decode(t, low, high)
    active, _ = field.features(t, low, high)
    score = field.scores(active)
    for a, b in zip(begin[:-1], begin[1:]):
        def value(path):
            return sum(score[a + i, x] for i, x in enumerate(path)) + sum(field.moves[p, q] for p, q in itertools.pairwise(path))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=b - a), key=value)
        assert tuple(labels[a:b]) == best
