"""Personal data by a linear-chain conditional random field over word shapes, beside plain patterns.

Tokens are runs without white space. A token's shape is its sequence of character runs (upper,
lower, digits with the length of the run, each sign by itself). The field scores each label from the shapes of the
token and its neighbours, from coarser features of the token (the set of its
character classes and its number of digits), and from label to label. It is trained on the small
labelled table below and decoded by Viterbi over numpy batches.

Sequences are the stretches around tokens that have a digit or an @: such tokens with three tokens on each side, joined
where they meet; tokens elsewhere are outside any entity. Entities are
trimmed of punctuation at their ends. The base spans of the plain patterns always stay; an
entity of the field is added where it overlaps no base span and has the parts its kind must have.

Absent texts count as empty and have no spans; rows that repeat are scanned each. All positions
are code points of the whole text, however long. An empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from segmentlab.llm.common import per_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens on each side of one with a digit or an @ that belong to its sequence.
AROUND = 3

#: The labelled table: entities in brackets, with their kind.
LABELLED = (
    "Write to [email:anna.berg@example.org] before Friday.",
    "Contact: [email:j.smith42@mail.example.com], office hours 9 to 5.",
    "Her address is [email:info@firma-nord.de] and his is [email:max_m@web.example.net].",
    "<[email:sales+eu@shop.example.co.uk]> wrote on Monday:",
    "Send it to [email:PETER@EXAMPLE.COM] or call [phone:+49 30 901820].",
    "Mail ([email:k.lee@uni.example.edu]) works best.",
    "The host [ip:192.168.0.12] did not answer.",
    "Login from [ip:10.0.0.1] at 12:45 and from [ip:172.16.254.3] at 13:10.",
    "Address [ip:8.8.8.8], port 53.",
    "Blocked [ip:203.0.113.77] after 5 attempts on 2021-03-04.",
    "Card [card:4111 1111 1111 1111] expires 12/27.",
    "Paid with [card:5500-0000-0000-0004] on 3 May 2020.",
    "Number: [card:378282246310005].",
    "His card [card:6011 0009 9013 9424] was declined for 120.50 euro.",
    "Charge [card:4012888888881881] now.",
    "Call [phone:+1 (555) 010-9999] today.",
    "Tel. [phone:+44 20 7946 0958] or fax [phone:+44 20 7946 0959].",
    "Phone: [phone:+33-1-23-45-67-89], ask for Marie.",
    "My number is [phone:+4915112345678].",
    "Ring [phone:+34 911 23 45 67] after 18:00.",
    "Call [phone:(030) 901-8200] today.",
    "Phone [phone:030 9018 2000] in the morning.",
    "Tel. [phone:(555) 010-4477] is free.",
    "In 2019 there were 12 cases and 345 reports.",
    "The price rose from 1,299.00 to 1,450.50 in 3 years.",
    "Version 2.0.1 replaced 1.9 on 2024-05-01.",
    "Chapter 12, section 3.4, page 118.",
    "It took 10:35:12 hours for 42 km.",
    "Order 100045 of 17.03.2011 has 3 items.",
    "About 1 500 000 people and 20 000 houses were counted.",
    "See [1] and [2], pp. 44-51.",
    "Item a1 or b2 of list x9 costs 5$ or 6%.",
    "The id 8f14e45f and the hash 0cc175b9c0f1b6a8 differ.",
    "Room 101, floor 3, building 7b.",
    "At @home we follow @work and #42.",
    "Between 1914 and 1918, 1939-1945 and 1989/90.",
    "Score 3:2 after 90 minutes and 7 corners.",
    "Model X-200, serial 77-1234-A.",
    "It is 3.14159 and not 2.71828.",
    "Width 1920 x 1080 at 60 Hz, 16 GB, 512 MB.",
    "ISBN 978-3-16-148410-0 was sold 1000 times.",
    "Zip 10115 Berlin, 75001 Paris and 90210 next.",
)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# Begins where a run of digits does, and takes runs whole: a long run is looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each @ to both sides, so a long run is looked at once."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        # No address reaches back over another @.
        before = text[free:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((at - size, free, "email"))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the plain patterns, in the order of the kinds."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# Character classes: 0 space, 1 lower or beyond ASCII, 2 upper, 3 digit, then signs.
_SIGNS = "@.+-()/:,_%"
_CLASS = np.full(256, 15, "uint8")
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 4 + _i
_MIX = np.random.RandomState(8).randint(1, 2**62, size=(256,), dtype="int64").astype("uint64") | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Tokens(NamedTuple):
    """Per token: first and end byte, shape number, set of classes, number of digits."""
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    classes: np.ndarray
    digits: np.ndarray


def tokens(data: np.ndarray) -> Tokens:
    """Tokens of UTF-8 bytes; all steps run over the whole array at once."""
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(kind, prepend=255) != 0)
    run_class, run_len = kind[change], np.diff(np.append(change, len(data)))
    inside = run_class != 0
    first = inside & ~np.concatenate(([False], inside[:-1]))
    change, run_class, run_len, first = change[inside], run_class[inside], run_len[inside], first[inside]
    heads = np.flatnonzero(first)
    if not len(heads):
        none = np.zeros(0, "int64")
        return Tokens(none, none, none.astype("uint64"), none, none)
    token = np.cumsum(first) - 1
    place = np.arange(len(first)) - heads[token]
    symbol = run_class.astype("int64") * 8 + np.where(run_class == 3, np.minimum(run_len, 7), 0)
    with np.errstate(over="ignore"):
        mixed = _MIX[symbol] * (_FACTOR * (place.astype("uint64") * np.uint64(2) + np.uint64(1)))
        mixed ^= mixed >> np.uint64(29)
        shape = np.add.reduceat(mixed, heads)
    classes = np.bitwise_or.reduceat(np.left_shift(1, run_class.astype("int64")), heads)
    digits = np.add.reduceat(np.where(run_class == 3, run_len, 0), heads)
    last = np.append(heads[1:], len(first)) - 1
    return Tokens(change[heads], change[last] + run_len[last], shape, classes, digits)


def sequences(t: Tokens, owner: np.ndarray) -> list[np.ndarray]:
    """First and end token of each stretch around tokens with digits or @, inside one owner (document)."""
    core = np.flatnonzero((t.digits > 0) | (t.classes & (1 << 4) > 0))
    if not len(core):
        return [np.zeros(0, "int64"), np.zeros(0, "int64")]
    n = len(t.start)
    low, high = np.maximum(core - AROUND, 0), np.minimum(core + AROUND + 1, n)
    own_first = np.searchsorted(owner, owner[core], "left")
    own_end = np.searchsorted(owner, owner[core], "right")
    low, high = np.maximum(low, own_first), np.minimum(high, own_end)
    new = np.concatenate(([True], (low[1:] > high[:-1]) | (owner[core][1:] != owner[core][:-1])))
    at = np.flatnonzero(new)
    return [low[at], np.maximum.reduceat(high, at)]


class Field:
    """Weights of the random field: label by feature and label by label."""

    def __init__(self, shapes: np.ndarray, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.shapes = shapes
        k = len(LABELS)
        # Features: bias, three positions of known shapes (0: unknown), classes (2 x 16), digits (20).
        self.offsets = np.cumsum([1, *[len(shapes) + 1] * 3, 16, 16])
        self.size = self.offsets[-1] + 20
        self.weights = np.zeros((self.size, k)) if weights is None else weights
        self.moves = np.zeros((k, k)) if moves is None else moves

    def features(self, t: Tokens, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the active features per token of all stretches (-1: none), and where each stretch starts."""
        length = high - low
        begin = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(begin[-1])
        stretch = np.repeat(np.arange(len(low)), length)
        at = low[stretch] + place - begin[stretch]
        known = np.searchsorted(self.shapes, t.shape[at])
        known = np.where((known < len(self.shapes)) & (self.shapes[np.minimum(known, len(self.shapes) - 1)] == t.shape[at]), known + 1, 0)
        before = np.where(place == begin[stretch], 0, np.roll(known, 1))
        after = np.where(place == begin[stretch + 1] - 1, 0, np.roll(known, -1))
        o, cols = self.offsets, [np.zeros(len(at), "int64")]
        cols += [o[0] + known, o[1] + before, o[2] + after]
        has = (t.classes[at][:, None] >> np.arange(16)) & 1
        cols += [np.where(has[:, i], o[3] + i, -1) for i in range(16)]
        only = has.sum(1) == 1
        cols += [np.where(only & (has[:, i] > 0), o[4] + i, -1) for i in (1, 2, 3)]
        cols.append(o[5] + np.minimum(t.digits[at], 19))
        return np.stack(cols, 1), begin

    def scores(self, active: np.ndarray) -> np.ndarray:
        padded = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]))])
        return padded[active].sum(1)

    def decode(self, t: Tokens, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels of all stretches, by Viterbi over all of them at once; and where each starts."""
        active, begin = self.features(t, low, high)
        score = self.scores(active)
        length = high - low
        order = np.argsort(-length, kind="stable")
        count = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), "right")
        best = np.full(score.shape, -1, "int8")
        state = np.zeros((len(low), len(LABELS)))
        for step, n in enumerate(count):
            rows = begin[order[:n]] + step
            if step:
                total = state[:n, :, None] + self.moves[None]
                best[rows] = total.argmax(1)
                state[:n] = total.max(1) + score[rows]
            else:
                state[:n] = score[rows]
        labels = np.zeros(len(score), "int8")
        current = state.argmax(1)
        for step in range(len(count) - 1, -1, -1):
            n = count[step]
            rows = begin[order[:n]] + step
            labels[rows] = current[:n]
            if step:
                current[:n] = best[rows, current[:n]]
        return labels, begin


def labelled_tokens() -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the labelled table, their labels, and the stretches to train on."""
    texts, marks = [], []
    for line in LABELLED:
        plain, at = "", 0
        for m in re.finditer(r"\[(email|ip|card|phone):([^\]]*)\]", line):
            plain += line[at:m.start()]
            marks.append((sum(len(x) + 1 for x in texts) + len(plain), len(m[2]), m[1]))
            plain += m[2]
            at = m.end()
        texts.append(plain + line[at:])
    data = np.frombuffer("\n".join(texts).encode(), "uint8")
    t = tokens(data)
    y = np.zeros(len(t.start), "int64")
    for start, length, kind in marks:
        first = np.searchsorted(t.end, start, "right")
        last = np.searchsorted(t.start, start + length, "left")
        y[first:last] = LABELS.index(f"I-{kind}")
        y[first] = LABELS.index(f"B-{kind}")
    owner = np.searchsorted(np.flatnonzero(data == 10), t.start)
    return t, y, *sequences(t, owner)


def train(rounds: int = 150, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Maximum likelihood by forward-backward and adaptive gradient steps; about a second."""
    t, y_all, low, high = labelled_tokens()
    field = Field(np.unique(t.shape))
    active, begin = field.features(t, low, high)
    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    y, k = y_all[at], len(LABELS)
    once = active >= 0
    rows = np.repeat(np.arange(len(at)), once.sum(1))
    square = np.full(field.weights.shape, 1e-8), np.full(field.moves.shape, 1e-8)
    for _ in range(rounds):
        score, marginal, moves = field.scores(active), np.zeros((len(at), k)), np.zeros((k, k))
        for a, b in zip(begin[:-1], begin[1:]):
            forward, backward = np.zeros((b - a, k)), np.zeros((b - a, k))
            forward[0] = score[a]
            for i in range(1, b - a):
                forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + field.moves, 0) + score[a + i]
            for i in range(b - a - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(field.moves + score[a + i + 1] + backward[i + 1], 1)
            z = np.logaddexp.reduce(forward[-1])
            marginal[a:b] = np.exp(forward + backward - z)
            for i in range(1, b - a):
                moves += np.exp(forward[i - 1][:, None] + field.moves + score[a + i] + backward[i] - z)
                moves[y[a + i - 1], y[a + i]] -= 1
        marginal[np.arange(len(at)), y] -= 1
        slope = np.zeros(field.weights.shape)
        np.add.at(slope, active[once], marginal[rows])
        for w, g, s in ((field.weights, slope, square[0]), (field.moves, moves, square[1])):
            g = g + decay * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    return field


def _holds(kind: str, piece: str) -> bool:
    """Whether an entity has the parts that its kind cannot lack."""
    digits = len(_DIGIT.findall(piece))
    if kind == "email":
        name, _, host = piece.rpartition("@")
        return bool(name) and "." in host.strip(".")
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(_DIGIT.findall(piece)))
    return 9 <= digits <= 15 and piece[0] in "+(0" and set(piece) <= set("0123456789 +().-/")


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Entities that the field finds in each text, in code points."""
    found: list[list[Span]] = [[] for _ in texts]
    parts = [x.encode() for x in texts]
    data = np.frombuffer(b"\n".join(parts), "uint8")
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    t = tokens(data)
    owner = np.searchsorted(starts, t.start, "right") - 1
    low, high = sequences(t, owner)
    if not len(low):
        return found
    labels, begin = field.decode(t, low, high)
    for s in np.unique(np.searchsorted(begin, np.flatnonzero(labels), "right") - 1):
        line = labels[begin[s]:begin[s + 1]]
        i = 0
        while i < len(line):
            if line[i] == 0:
                i += 1
                continue
            kind, j = LABELS[line[i]][2:], i + 1
            while j < len(line) and LABELS[line[j]] == f"I-{kind}":
                j += 1
            doc = owner[low[s] + i]
            raw = parts[doc]
            a, b = t.start[low[s] + i] - starts[doc], t.end[low[s] + j - 1] - starts[doc]
            piece = raw[a:b].decode()
            kept = piece.strip(" \t\r\n,;:!?<>[]{}\"'|*#&$%").rstrip(".").rstrip(",;:!?")
            if kept.startswith("(") and kind != "phone":
                kept = kept.lstrip("(")
            if kept.endswith(")") and kept.count("(") < kept.count(")"):
                kept = kept.rstrip(").")
            if kept and _holds(kind, kept):
                start = len(raw[:a].decode()) + piece.index(kept)
                found[doc].append((start, start + len(kept), kind))
            i = j
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], x[1])))


def scan_with(field: Field, texts: list[str | None]) -> list[list]:
    whole = [x or "" for x in texts]
    rows = []
    for text, extra in zip(whole, field_spans(field, whole)):
        base = base_spans(text)
        more = [x for x in extra if not any(x[0] < e and s < x[1] for s, e, _ in base)]
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])))
    return [list(c) for c in zip(*rows)]


def scan_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = field or train()
    return per_text(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                    lambda: lambda texts: scan_with(field, texts), rows=500)
