"""License scan: ordered signature rules over lower-cased text.

The rules are regular expressions in order of priority: identifiers, full grant texts, named
licenses with versions, and loose mentions. Each rule is gated by keywords that must all
occur in the text before its expression runs; they are single words that no match can lack, so the
gates change no result. Of overlapping detections, one that lies inside
a detection of a rule with higher priority (or of the same rule set, but longer) is suppressed.

Base: places where the words of a plain phrase stand consecutively, counted over words of
letters a-z, digits and characters beyond ASCII. Base labels are always kept; the rules add more.
Absent texts count as empty: no words, no labels, score 0. Rows that repeat are scanned each. An empty table gives no
rows; extra columns are not looked at; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from segmentlab.llm.common import per_text

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, names in running text, identifier stems, versions.
FAMILIES = (
    ("mit", ("mit", "expat", "x11"), ("mit", "mit-0", "x11"), ()),
    ("apache", ("apache", "apache software"), ("apache",), ("1.0", "1.1", "2.0")),
    ("gpl", ("gnu general public", "general public", "gnu gpl", "gpl"), ("gpl",), ("1.0", "2.0", "3.0", "2", "3")),
    ("lgpl", ("gnu lesser general public", "lesser general public", "library general public", "lgpl"), ("lgpl",), ("2.0", "2.1", "3.0", "2", "3")),
    ("agpl", ("gnu affero general public", "affero general public", "agpl"), ("agpl",), ("1.0", "3.0", "3")),
    ("bsd", ("bsd", "new bsd", "simplified bsd", "revised bsd", "berkeley software distribution"), ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"), ()),
    ("mpl", ("mozilla public", "mpl"), ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public", "epl"), ("epl",), ("1.0", "2.0")),
    ("cddl", ("common development and distribution", "cddl"), ("cddl",), ("1.0", "1.1")),
    ("eupl", ("european union public", "eupl"), ("eupl",), ("1.0", "1.1", "1.2")),
    ("cecill", ("cecill", "cecill free software"), ("cecill", "cecill-b", "cecill-c"), ("1.0", "2.0", "2.1")),
    ("artistic", ("artistic", "perl artistic"), ("artistic",), ("1.0", "2.0")),
    ("isc", ("isc",), ("isc",), ()),
    ("zlib", ("zlib", "zlib/libpng"), ("zlib",), ()),
    ("boost", ("boost software",), ("bsl",), ("1.0",)),
    ("unlicense", ("unlicense",), ("unlicense",), ()),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("wtfpl",), ("2",)),
    ("python", ("python software foundation", "psf"), ("psf", "python"), ("2.0",)),
    ("php", ("php",), ("php",), ("3.0", "3.01")),
    ("ruby", ("ruby",), ("ruby",), ()),
    ("openssl", ("openssl",), ("openssl",), ()),
    ("postgresql", ("postgresql",), ("postgresql",), ()),
    ("ofl", ("sil open font", "open font"), ("ofl",), ("1.0", "1.1")),
    ("ms-pl", ("microsoft public",), ("ms-pl",), ()),
    ("ms-rl", ("microsoft reciprocal",), ("ms-rl",), ()),
    ("osl", ("open software",), ("osl",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free",), ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("cpl", ("common public",), ("cpl",), ("1.0",)),
    ("ipl", ("ibm public",), ("ipl",), ("1.0",)),
    ("spl", ("sun public",), ("spl",), ("1.0",)),
    ("npl", ("netscape public",), ("npl",), ("1.0", "1.1")),
    ("odbl", ("open database", "odbl"), ("odbl",), ("1.0",)),
    ("pddl", ("public domain dedication",), ("pddl",), ("1.0",)),
    ("gfdl", ("gnu free documentation", "free documentation", "gfdl"), ("gfdl",), ("1.1", "1.2", "1.3")),
    ("cc0", ("creative commons zero", "cc0"), ("cc0",), ("1.0",)),
    ("cc-by", ("creative commons attribution", "cc by", "cc-by"), ("cc-by",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution share alike", "creative commons attribution-sharealike", "cc by-sa", "cc-by-sa"), ("cc-by-sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution non commercial", "creative commons attribution-noncommercial", "cc by-nc", "cc-by-nc"), ("cc-by-nc",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution-noderivatives", "cc by-nd", "cc-by-nd"), ("cc-by-nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("sspl", ("server side public", "sspl"), ("sspl",), ("1.0", "1")),
    ("busl", ("business source", "busl"), ("busl", "bsl-mariadb"), ("1.1",)),
    ("elastic", ("elastic",), ("elastic",), ("1.0", "2.0")),
    ("upl", ("universal permissive",), ("upl",), ("1.0",)),
    ("vim", ("vim",), ("vim",), ()),
    ("qpl", ("q public",), ("qpl",), ("1.0",)),
)

#: Wordings of grants and notices, with the label they show and the keywords that gate them:
#: single words (a blank in the wording is any white space) that every match holds.
GRANTS = (
    ("mit", ("permission", "hereby", "granted"), r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", ("deal", "restriction"), r"deal in the software without restriction"),
    ("isc", ("permission", "distribute"), r"permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee"),
    ("bsd", ("redistribution", "binary"), r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd", ("neither", "endorse"), r"neither the names? of .{1,80}? may be used to endorse or promote"),
    ("gpl", ("software", "redistribute", "gnu"), r"free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", ("redistribute", "lesser"), r"redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl", ("redistribute", "affero"), r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("apache", ("apache", "license"), r"licensed under the apache license,? version 2\.0"),
    ("apache", ("apache.org",), r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("mpl", ("mozilla.org",), r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl"),
    ("gpl", ("gnu.org",), r"https?://www\.gnu\.org/licenses/(?:gpl|old-licenses/gpl)[-0-9.a-z]*"),
    ("lgpl", ("gnu.org",), r"https?://www\.gnu\.org/licenses/lgpl[-0-9.a-z]*"),
    ("agpl", ("gnu.org",), r"https?://www\.gnu\.org/licenses/agpl[-0-9.a-z]*"),
    ("mit", ("opensource.org",), r"https?://(?:www\.)?opensource\.org/licenses/mit"),
    ("bsd", ("opensource.org",), r"https?://(?:www\.)?opensource\.org/licenses/bsd[-0-9a-z]*"),
    ("cc-by-sa", ("creativecommons.org",), r"creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("cc-by-nc", ("creativecommons.org",), r"creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("cc-by", ("creativecommons.org",), r"creativecommons\.org/licenses/by/[0-9.]+"),
    ("cc0", ("creativecommons.org",), r"creativecommons\.org/publicdomain/zero/[0-9.]+"),
    ("boost", ("boost.org",), r"boost\.org/license_1_0"),
    ("unlicense", ("unencumbered",), r"free and unencumbered software released into the public domain"),
    ("public-domain", ("public", "domain"), r"(?:released|placed|dedicated|put|is) (?:in|into|to) the public domain"),
    ("zlib", ("as-is", "implied"), r"this software is provided ['‘\"]as-is['’\"], without any express or implied warranty"),
    ("wtfpl", ("fuck",), r"do what the fuck you want to"),
    ("proprietary", ("rights", "reserved"), r"all rights reserved"),
    ("proprietary", ("confidential",), r"proprietary and confidential"),
    ("copyright", ("copyright",), r"copyright (?:\(c\)|©)? ?[12][0-9]{3}"),
)

class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    weight: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules by priority: identifiers, grants, versions, then names."""
    gap = r"[\s,;:(\"'-]+"
    found = [(1, label, keys, pattern.replace(" ", r"\s+"), 0.95) for label, keys, pattern in GRANTS]
    for label, names, ids, versions in FAMILIES:
        for stem in ids:
            found.append((0, label, ("spdx", stem), rf"spdx-license-identifier:\s*{re.escape(stem)}(?:-[0-9.]+)?(?:-only|-or-later|\+)?(?![\w-])", 0.99))
        for name in names:
            words = re.escape(name).replace(r"\ ", r"\s+")
            for version in versions:
                number = re.escape(version)
                found.append((2, label, (*name.split(), version), rf"(?<!\w){words}(?:{gap}licen[cs]e)?{gap}(?:version\s+|v\.?\s*)?{number}(?![\w]|\.[0-9])", 0.9))
            found.append((3, label, (*name.split(), "licen"), rf"(?<!\w){words}\s+licen[cs]e(?!\w)", 0.8))
            found.append((3, label, (*name.split(), "licen"), rf"licen[cs]ed?\s+(?:is\s+)?(?:under|by|with)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{words}(?!\w)", 0.8))
            found.append((4, label, (*name.split(), "licen"), rf"licen[cs]e\s*[:=]\s*[\"']?{words}(?!\w)", 0.7))
    order = sorted(found, key=lambda r: r[0])
    return tuple(Rule(p, label, keys, re.compile(pattern, re.S), weight) for p, label, keys, pattern, weight in order)


def detect(text: str, gated: bool = True) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) in lower-cased text that no stronger one contains; the same without the gates."""
    found: list[tuple[int, int, Rule]] = []
    known: dict[str, bool] = {}
    for rule in rules():
        for word in rule.keywords:
            if word not in known:
                known[word] = word in text
        if not gated or all(known[w] for w in rule.keywords):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    kept: list[tuple[int, int, Rule]] = []
    # Stronger rules and, among equals, longer detections first; then a sweep by start is enough for containment.
    by_start = sorted(found, key=lambda d: (d[0], -d[1], d[2].priority))
    open_: list[tuple[int, int, Rule]] = []
    for d in by_start:
        open_ = [o for o in open_ if o[1] > d[0]]
        if not any(o[1] >= d[1] and o[2].priority <= d[2].priority for o in open_):
            kept.append(d)
        open_.append(d)
    return kept


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = bytes(48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_PHRASES = [(tuple(w.encode() for w in phrase.split()), label) for phrase, label in BASE]


def base_places(data: bytes) -> list[tuple[int, str]]:
    """Word numbers at which a base phrase starts, with its label."""
    if b"license" not in data:
        return []
    words = _WORDS.findall(data)
    return [(i - len(phrase) + 1, label) for i, w in enumerate(words) if w == b"license"
            for phrase, label in _PHRASES if tuple(words[max(0, i - len(phrase) + 1):i + 1]) == phrase]


def scan(texts: list[str | None]) -> list[list]:
    rows = []
    for text in texts:
        data = (text or "").encode().translate(_LOWER)
        marks = np.frombuffer(b"\0" + data.translate(_IS_WORD), "int8")
        n_words = int(np.count_nonzero(np.diff(marks) == 1))
        places = base_places(data)
        detections = detect(data.decode())
        base = {label for _, label in places}
        labels = base | {rule.label for _, _, rule in detections}
        doubt = 0.2 ** len(places)
        for _, _, rule in detections:
            doubt *= 1 - rule.weight
        starts = [s for s, _ in places]
        rows.append((n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                     ",".join(sorted(labels)), 1 - doubt if labels else 0.0,
                     ",".join(f"{rule.label}:{s}:{e}" for s, e, rule in detections)))
    return [list(c) for c in zip(*rows)]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    return per_text(docs, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                          "score double, detections string", lambda: scan)
