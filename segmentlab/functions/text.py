"""Column functions on text. All of them stay in the JVM except NFC."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from segmentlab.functions import fixed

# Character classes with the meaning Python gives \w, \s, \d on str. Java's own
# Unicode \w differs (marks, other numbers), so letters and numbers are spelled out;
# its Unicode \s lacks only the four separators 1C to 1F.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"(?U:[\s\x{1c}-\x{1f}])"
NOT_SPACE = r"(?U:[^\s\x{1c}-\x{1f}])"
DIGIT = r"\p{Nd}"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
LETTER = "A-Za-zÀ-ỹ"
WRONG_SCRIPT = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in fixed.WRONG_SCRIPT_RANGES) + "]"
# One wide range that holds all of them: a text without it needs no closer look.
_MAYBE_WRONG_SCRIPT = (
    rf"[\x{{{min(a for a, _ in fixed.WRONG_SCRIPT_RANGES):x}}}-\x{{{max(b for _, b in fixed.WRONG_SCRIPT_RANGES):x}}}]")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}++|{SPACE}++$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return strip(F.regexp_replace(text, rf"{SPACE}{{2,}}+", " "))


def is_blank(text: Column) -> Column:
    """NULL or empty, without trimming."""
    return F.coalesce(text, F.lit("")) == ""


def half_even(value: Column) -> Column:
    """Round to whole numbers, ties to the even neighbour."""
    return F.bround(value, 0)


def has_wrong_script(text: Column) -> Column:
    """Give it a plain column: it is read twice."""
    return F.coalesce(text.rlike(_MAYBE_WRONG_SCRIPT) & text.rlike(WRONG_SCRIPT), F.lit(False))


def without_wrong_script(text: Column) -> Column:
    """Give it a plain column: it is read several times."""
    kept = F.when(text.rlike(_MAYBE_WRONG_SCRIPT), F.regexp_replace(text, WRONG_SCRIPT, "")).otherwise(text)
    return squeeze(F.regexp_replace(kept, rf"{SPACE}++([,.;:!?])", "$1"))


def map_tokens(df: DataFrame, col: str, pattern: str, spoken: Callable[[Column], Column],
               where: Column | None = None, hits: str | None = None) -> DataFrame:
    """Replace every match of ``pattern`` in ``col`` by its entry in ``spoken(matches)``.

    The text is cut into literals and matches and put together again inside
    the row, so no row leaves its partition. Rows outside ``where`` keep their
    text. The matches get a column of their own so that they are found once. A column
    ``hits``, if named, tells how many matches were replaced by something else.
    """
    found = F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0))
    nothing = F.array().cast("array<string>")
    tokens = df.withColumn("_tokens", found if where is None else F.when(where, found).otherwise(nothing))
    said = tokens.withColumn("_said", spoken(F.col("_tokens")))
    if hits is not None:
        changes = F.zip_with("_tokens", "_said", lambda token, new: ~token.eqNullSafe(new))
        said = said.withColumn(hits, F.coalesce(F.size(F.filter(changes, lambda c: c)), F.lit(0)).cast("bigint"))
    pieces = F.zip_with(
        F.split(F.col(col), pattern), F.col("_said"),
        lambda literal, token: F.concat(literal, F.coalesce(token, F.lit(""))),
    )
    changed = F.when(F.size("_tokens") > 0, F.array_join(pieces, "")).otherwise(F.col(col))
    return said.withColumn(col, changed).drop("_tokens", "_said")


def _char_class(ranges: list[tuple[int, int]], negated: bool = False) -> str:
    return "[" + "^" * negated + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@functools.cache
def _unstable_classes() -> tuple[str, str]:
    """Regex classes ``(rough, exact)`` of the code points NFC may change or reorder.

    A text without any of them is already NFC. ``exact`` is derived from the
    Unicode data: points that normalise to something else, combining marks, and
    the second half of every canonical pair. It has hundreds of ranges and is slow
    to test, so ``rough`` leaves out only the widest stretches of safe points.
    """
    points: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            points.add(cp)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            points.add(int(parts[1], 16))
    ranges: list[list[int]] = []
    for cp in sorted(points):
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    gaps = [(0, ranges[0][0] - 1)] + [(a[1] + 1, b[0] - 1) for a, b in zip(ranges, ranges[1:])]
    widest = sorted(gaps, key=lambda g: g[0] - g[1])[:6]
    # Latin and Vietnamese letters come first, they are what most texts consist of.
    safe = [gaps[0], *[g for g in gaps if g[0] <= 0x1EA0 <= g[1]], *widest]
    return _char_class(list(dict.fromkeys(safe)), negated=True), _char_class([tuple(r) for r in ranges])


@F.pandas_udf(StringType())
def _nfc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC of a plain column. Spark has no normaliser, so the few rows that
    may change go through one vectorised function; all others send NULL and keep
    their text."""
    # One pass: the wide class is tried before the one of hundreds of ranges at every character.
    rough, exact = _unstable_classes()
    return F.coalesce(_nfc_batch(F.when(text.rlike(rf"(?=[^\x{{0}}-\x{{2ff}}])(?={rough}){exact}"), text)), text)


_WEB = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
_MAIL = rf"{EDGE}[\p{{L}}\p{{N}}_.+-]++@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+{EDGE}"
ADDRESS = f"(?iu){_WEB}|{_MAIL}"


def without_addresses(text: Column) -> Column:
    """Web and mail addresses become one blank. Give it a plain column; the slow
    pattern for mail is tried only where there is an @."""
    return F.when(text.contains("@"), F.regexp_replace(text, ADDRESS, " ")).otherwise(
        F.regexp_replace(text, f"(?iu){_WEB}", " "))


def split_letters_digits(text: Column) -> Column:
    """``12B`` -> ``12 B`` and ``page2`` -> ``page 2``. Both patterns look for the digit first."""
    before = F.regexp_replace(text, rf"(?={DIGIT})(?<=[{LETTER}])", " ")
    return F.regexp_replace(before, rf"({DIGIT})(?=[{LETTER}])", "$1 ")


def ranges_to_words(text: Column, joiner: str) -> Column:
    return F.regexp_replace(text, rf"({DIGIT}){SPACE}*-{SPACE}*(?={DIGIT})", f"$1 {joiner} ")


_AMOUNT = rf"({DIGIT}[{DIGIT}.,]*)"
# What follows an amount is none of its characters: it gives none back, and a start inside of it could only fail like the first one.
_AMOUNT_BEFORE = rf"(?={DIGIT})(?<!{DIGIT})(?<!{DIGIT}[.,])({DIGIT}[{DIGIT}.,]*+)"
# White space is tried from its start only, and most characters are passed by at a glance.
_AND = rf"(?=[^!-%'-~])(?:(?<!{SPACE}){SPACE}++&|&){SPACE}*+"


def _fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


VI_EARLY = [
    (rf"{_AMOUNT_BEFORE}{SPACE}*+[đ₫](?![\p{{L}}\p{{N}}_À-ỹ])", f"$1 {fixed.VI_DONG}"),
    (rf"(?i){_AMOUNT_BEFORE}{SPACE}*+VND{EDGE}", f"$1 {fixed.VI_DONG}"),
    (rf"({DIGIT}){SPACE}*\+{SPACE}*(?={DIGIT})", f"$1 {fixed.VI_PLUS} "),
    (rf"({DIGIT}){SPACE}*={SPACE}*(?={DIGIT})", f"$1 {fixed.VI_EQUALS} "),
]
VI_LATE = [
    (rf"({DIGIT}){SPACE}*%", f"$1 {fixed.VI_PERCENT}"),
    (rf"\${SPACE}*{_AMOUNT}", f"$1 {fixed.VI_DOLLARS}"),
    (rf"{_AMOUNT_BEFORE}{SPACE}*+\$", f"$1 {fixed.VI_DOLLARS}"),
    (rf"({DIGIT}){SPACE}*[₫đ](?={EDGE})", f"$1 {fixed.VI_DONG}"),
    (rf"{_AMOUNT_BEFORE}{SPACE}*+VND{EDGE}", f"$1 {fixed.VI_DONG}"),
    (_AND, f" {fixed.VI_AND} "),
]
EN_RULES = [
    (rf"({DIGIT}){SPACE}*%", f"$1 {fixed.EN_PERCENT}"),
    (rf"\${SPACE}*{_AMOUNT}", f"$1 {fixed.EN_DOLLARS}"),
    (rf"{_AMOUNT_BEFORE}{SPACE}*+\$", f"$1 {fixed.EN_DOLLARS}"),
    (_AND, f" {fixed.EN_AND} "),
]


def vi_symbols_early(text: Column) -> Column:
    return _fold(text, VI_EARLY)


def vi_symbols_late(text: Column) -> Column:
    return _fold(text, VI_LATE)


def en_symbols(text: Column) -> Column:
    return _fold(text, EN_RULES)


def dedupe_time_words(text: Column) -> Column:
    """``ngày ngày`` -> ``ngày`` and the same for month, year and hour words."""
    pattern = rf"(?iu){EDGE}({"|".join(fixed.VI_TIME_WORDS)}){SPACE}+\1{EDGE}"
    return squeeze(F.regexp_replace(text, pattern, "$1"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOT_WORD, "_")


def words(text: Column) -> Column:
    """White-space separated words of a text, none for a blank one."""
    return F.filter(F.split(strip(text), rf"{SPACE}+"), lambda w: w != "")
