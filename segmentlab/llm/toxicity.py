"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: case, look-alike letters of other scripts, and digits or signs put in
place of letters. The lexicon is learned from labelled rows: whole words and word stems (a stem
stands for any word that begins with it), weighed by their log odds. At each place the
longest entry counts, unless an exception phrase covers it. The weights found are
normalised by the length of the text, and a logistic curve fitted on the same rows turns them
into a score from 0 to 1.

Labels are learned from a bounded sample: of the rows with a label whose crc32(doc_id as text)
mod 3 is not 1, the ``sample`` first by md5 of the doc_id. Everything else covers all rows.
Scores read the text alone. Absent and empty texts have no hits and get the
score of a text without hits; repeated rows are scored each. Without usable labels the built-in
lexicon stands, with fixed coefficients. An empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.llm.common import per_text

#: Bound of the labelled rows that are learned from, and of the lexicon.
SAMPLE, ENTRIES = 20_000, 4_000
THRESHOLD = 0.7
STEM = (4, 8)

#: Look-alike letters and the Latin letters they stand for.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n", "ս": "u", "α": "a", "ο": "o", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs used in place of letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which such a word is harmless.
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "trash collection", "take out the trash", "clown fish", "circus clown",
    "pond scum", "soap scum", "sore loser", "disgusting taste", "pathetic fallacy", "stupid mistake of mine")
#: Used only where nothing can be learned.
PLAIN = ("idiot", "moron", "clown", "scum", "trash", "pathetic", "worthless", "disgusting", "loser", "stupid")

_SIGN = re.compile(r"(?<=\w)[@$!|](?=\w)")
_FOLD = {i: " " for i in range(128) if not chr(i).isalnum()}
_FOLD |= {ord(k): v for k, v in (LOOK_ALIKES | DIGITS).items()}
_FOLD |= {i: chr(i - 0xFEE0) for i in range(0xFF41, 0xFF5B)}  # full-width letters
_FOLD |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF))  # unseen characters vanish
_FOLD |= dict.fromkeys((0xA0, 0xA1, 0xAB, 0xBB, 0xBF, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2026), " ")


def folded(text: str | None) -> str:
    """Words of the text, folded, each between single spaces."""
    if not text:
        return "  "
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    """Entries begin with a space, and end with one if they are whole words; exception phrases are added."""
    found = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        found.add_word(entry, (len(entry), weight))
    for phrase in EXCEPTIONS:
        entry = folded(phrase)
        found.add_word(entry, (len(entry), None))
    found.make_automaton()
    return found


def hits(matcher: ahocorasick.Automaton, text: str) -> list[float]:
    """Weights of the longest entries at each place outside exception phrases."""
    best: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight) in matcher.iter(text):
        start = end - length + 1
        if weight is None:
            covered.append((start, end))
        elif length > best.get(start, (0, 0))[0]:
            best[start] = (length, weight)
    return [w for s, (_, w) in best.items() if not any(a <= s < b for a, b in covered)]


def features(matcher: ahocorasick.Automaton, text: str | None) -> tuple[float, ...]:
    words = folded(text)
    found = hits(matcher, words)
    total, length = sum(found), words.count(" ") - 1
    return 1.0, math.log1p(total), total / math.sqrt(max(length, 1)), min(4.0, 20 * total / max(length, 1))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic coefficients by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's distinct words, with the words around the first place of each."""
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"]):
            line = folded(text).split()
            first = {w: i for i, w in reversed([*enumerate(line)])}
            around = [" ".join(line[max(i - 1, 0):i + 2]) for i in first.values()]
            yield pd.DataFrame({"word": list(first), "around": around, "toxic": np.full(len(first), toxic, "int32")}, columns=["word", "around", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the labelled rows to learn from, at most ``sample``."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    # At most ``sample`` rows of 12 bytes.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, least: int = 4, odds: float = 3.0) -> dict[str, float]:
    """Words and stems with their log odds; a longer entry only where it says more than the stem it begins with."""
    # A word counts once per surroundings, so that copies of one text do not make all its words suspect.
    places = rows.mapInPandas(_distinct_words, "word string, around string, toxic int").groupBy("word", "around").agg(F.max("toxic").alias("toxic"))
    words = places.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    stems = words.select(F.explode(F.expr(
        f"transform(sequence({STEM[0]}, {STEM[1]}), n -> CASE WHEN length(word) >= n THEN concat(' ', left(word, n)) END)")).alias("entry"), "bad", "good")
    both = stems.unionByName(words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "bad", "good"))
    seen = both.where("entry IS NOT NULL").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    seen = seen.where((F.col("bad") >= least) & (F.col("good") * 4 < F.col("bad")))
    found = seen.orderBy(F.desc("bad"), "entry").limit(entries * 4).collect()
    rate = rows.agg(F.avg("toxic")).first()[0] or 0.5
    rate = min(max(rate, 0.01), 0.99)
    lexicon: dict[str, float] = {}
    for row in sorted(found, key=lambda r: (len(r["entry"].strip()), r["entry"].endswith(" "), r["entry"])):
        entry, weight = row["entry"], math.log((row["bad"] + 0.5) / rate) - math.log((row["good"] + 0.5) / (1 - rate))
        known = max((lexicon.get(entry[:n], 0) for n in range(STEM[0] + 1, len(entry))), default=0)
        if weight >= odds and weight > known + (1.0 if known else 0):
            lexicon[entry] = weight
    return dict(sorted(lexicon.items(), key=lambda x: -x[1])[:entries])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> tuple[dict[str, float], list[float]]:
    """Lexicon and coefficients; both are bounded, so they travel with the tasks."""
    rows = training_rows(docs, labels, sample).cache()
    try:
        lexicon = learn_lexicon(rows, entries)
        if not lexicon:
            return {f" {w} ": 5.0 for w in PLAIN}, [-4.0, 1.0, 2.0, 2.0]

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = automaton(lexicon)
            for batch in batches:
                yield pd.DataFrame([(*features(matcher, t), float(y)) for y, t in zip(batch["toxic"], batch["text"])], columns=list("abcde"))

        table = rows.mapInPandas(measured, "a double, b double, c double, d double, e double").toPandas().sort_values(list("abcde")).to_numpy()
    finally:
        rows.unpersist()
    return lexicon, [float(v) for v in _fit(table[:, :4], table[:, 4])]


def _scorer(lexicon: dict[str, float], curve: list[float]):
    def maker():
        matcher = automaton(lexicon)

        def scores(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            x = np.array([features(matcher, t) for t in texts]).reshape(-1, 4)
            return 1 / (1 + np.exp(-np.clip(x @ np.array(curve), -30, 30))), np.expm1(x[:, 1])
        return scores
    return maker


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], curve: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, weight (sum over the hits), predicted."""
    return per_text(docs, "score double, weight double", _scorer(lexicon, curve)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, lexicon: dict[str, float], curve: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; one pass, all columns kept."""
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = _scorer(lexicon, curve)()
        for batch in texts:
            yield pd.Series(scores(list(batch))[0] < threshold)

    return docs.where(clean(F.col("text").cast("string")))
