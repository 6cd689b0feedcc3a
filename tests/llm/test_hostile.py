"""Texts that would stop a task if an operator looked at a part more than a few times."""

import random
import re
import time

import numpy as np
import pytest

from segmentlab.llm import pii, radix, secret_scan, templates


def within(seconds, call):
    start = time.perf_counter()
    result = call()
    assert time.perf_counter() - start < seconds
    return result


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_addresses_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.@-_% ") for _ in range(rng.randint(0, 24)))
        want = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)] if "@" in text else []
        assert pii._emails(text) == want, text
        text = "".join(rng.choice("12.. a") for _ in range(rng.randint(0, 24)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 500_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a" * 1_000_000 + "@b.cd"])
def test_long_runs_of_personal_data(text):
    within(5, lambda: pii.base_spans(text))


@pytest.mark.parametrize("text", ["%" + "25" * 5000, "&" + "#38;" * 5000, "\\x5c" + "x5c" * 5000, "%" + "25" * 400_000 + "41"])
def test_nested_escapes(spark, docs, text):
    text += " password=abcdefgh1234"
    row = within(60, lambda: secret_scan.scan_secrets(docs([(1, text)])).collect()[0])
    assert row.n_assign == 1


def test_nested_layers_are_mapped_back():
    """Layers that lose one escape each: spans lie in the original text."""
    secret = "token=ABCDEFGH1234"
    text = secret
    for _ in range(6):
        text = text.replace("%", "%25").replace("=", "%3D")
    assert "%252525" in text
    layer = secret_scan.Layer(text, [(0, 0, len(text), True)], None)
    depth = 0
    while (below := secret_scan._resolved(layer, secret_scan._URL, secret_scan._url)) is not None:
        layer, depth = below, depth + 1
    assert layer.text == secret and depth == 6
    assert layer.back(0, len(secret)) == (0, len(text))
    for _ in range(3000):
        layer = secret_scan.Layer(layer.text, [(0, 0, len(layer.text), True)], layer)
    assert layer.back(0, len(secret)) == (0, len(text))


def test_smallest_doc_id(spark, docs):
    low = -2**63
    rows = {r.doc_id: r.keep_id for r in radix.exact_dedup(docs([(low, "same"), (5, "same"), (2**63 - 1, "same ")])).collect()}
    assert rows == {low: 2**63 - 1, 5: 2**63 - 1, 2**63 - 1: 2**63 - 1}
    rows = {r.doc_id: r.keep_id for r in radix.exact_dedup(docs([(low, "same"), (5, "same")])).collect()}
    assert rows == {low: low, 5: low}


@pytest.mark.parametrize("html", ["<a " * 350_000, "<div>" * 150_000 + "x", "<b>" * 200_000 + "x", "<div><p>" * 80_000, "<ul><li>" * 80_000, "<!" * 500_000, "<!--" * 250_000,
                                  "<div><b>" * 60_000 + "</p>" * 100_000, '<a ">" ' * 140_000 + "'", "<script>" * 120_000, "<a class='" * 100_000])
def test_pages_that_never_close(html):
    within(10, lambda: templates.main_text(html, np.zeros(0, "int64")))
