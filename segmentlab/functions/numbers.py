"""Reading numbers aloud as column expressions.

A number of up to 18 (Vietnamese) or 36 (English) digits is cut into groups of
three; each group is looked up in a table of 1000 readings made from a rule.
The tables are single folded literals, so nothing is joined or shuffled. The
functions work on arrays of tokens: each step binds its result once.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.functions.text import DIGIT, WORD

NUMBER = rf"{DIGIT}[{DIGIT}.,]*{DIGIT}|{DIGIT}"
ACRONYM = rf"(?=[A-Z])(?<!{WORD})[A-Z]{{2,4}}(?!{WORD})"
PHONE = rf"(?=[+{DIGIT}])(?<!{DIGIT})\+?{DIGIT}[{DIGIT} \-]{{7,12}}{DIGIT}(?!{DIGIT})"


def vi_triplet(n: int, padded: bool) -> str:
    """Reading of 0..999; ``padded`` when a higher group was read before it."""
    hundreds, tens, unit = n // 100, n // 10 % 10, n % 10
    said = []
    if n and (hundreds or padded):
        said += [fixed.VI_DIGITS[hundreds], fixed.VI_HUNDRED]
    if tens:
        said += [fixed.VI_TEN] if tens == 1 else [fixed.VI_DIGITS[tens], fixed.VI_TENS]
    elif unit and said:
        said.append(fixed.VI_GAP)
    if unit:
        special = {0: {}, 1: fixed.VI_UNIT_AFTER_TEN}.get(tens, fixed.VI_UNIT_AFTER_TENS)
        said.append(special.get(unit, fixed.VI_DIGITS[unit]))
    return " ".join(said)


def en_triplet(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    said = [f"{fixed.EN_DIGITS[hundreds]} hundred"] if hundreds else []
    if 10 <= rest < 20:
        said.append(fixed.EN_TEENS[rest - 10])
    elif rest:
        said.append("-".join(w for w in (fixed.EN_TENS[rest // 10],
                                         fixed.EN_DIGITS[rest % 10] if rest % 10 else "") if w))
    return " ".join(said)


def _table(entries: list[str]) -> Column:
    return F.split(F.lit("|".join(entries)), r"\|")


@functools.cache
def _digit_forms() -> tuple[str, str]:
    """All decimal digits of other scripts and their ASCII forms, from Unicode data."""
    other = [chr(cp) for cp in range(0x80, 0x20000) if unicodedata.category(chr(cp)) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


def _ascii_digits(token: Column) -> Column:
    return F.when(token.rlike(r"[^\x00-\x7f]"), F.translate(token, *_digit_forms())).otherwise(token)


def _spell(digits: Column, names: list[str]) -> Column:
    table = _table(names)
    each = F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))
    return F.array_join(F.transform(each, lambda d: F.element_at(table, d.cast("int") + 1)), " ")


def _read_groups(digits: Column, first: list[str], later: list[str], scales: list[str]) -> Column:
    """Read a digit string without leading zeros, three digits per scale."""
    n = len(scales)
    first_table, later_table, scale_table = _table(first), _table(later), _table(scales[::-1])
    leading = n - F.ceil(F.length(digits) / 3).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
        k.alias("k"),
        F.substring(F.lpad(digits, 3 * n, "0"), k * 3 + 1, F.lit(3)).cast("int").alias("n"),
        (k == leading).alias("leads"),
    ))
    spoken = F.transform(F.filter(groups, lambda g: g["n"] > 0), lambda g: F.concat(
        F.when(g["leads"], F.element_at(first_table, g["n"] + 1))
        .otherwise(F.element_at(later_table, g["n"] + 1)),
        F.element_at(scale_table, g["k"] + 1),
    ))
    return F.array_join(spoken, " ")


def _vi_parts(token: Column) -> Column:
    """Whole and decimal digits: a comma is the decimal sign, dots group
    thousands unless the only one is followed by other than three digits."""
    decimal_dot = token.rlike(r"^[^.,]*\.(?:[^.]{0,2}|[^.]{4,})$")
    cut = F.when(token.contains(","), F.instr(token, ",")).when(decimal_dot, F.instr(token, ".")).otherwise(
        F.length(token) + 1)
    return F.struct(
        F.regexp_replace(F.substring(token, F.lit(1), cut - 1), "[^0-9]", "").alias("whole"),
        F.regexp_replace(F.substring(token, cut + 1, F.length(token)), "[^0-9]", "").alias("frac"),
    )


def _vi_words(number: Column) -> Column:
    whole, frac = number["whole"], number["frac"]
    said = (
        F.when(whole.isin("", "0"), fixed.VI_DIGITS[0])
        .when(whole.startswith("0") | (F.length(whole) > fixed.VI_MAX_DIGITS), _spell(whole, fixed.VI_DIGITS))
        .otherwise(_read_groups(
            whole,
            [vi_triplet(n, False) for n in range(1000)],
            [vi_triplet(n, True) for n in range(1000)],
            fixed.VI_SCALES,
        ))
    )
    tail = F.concat(F.lit(f" {fixed.VI_POINT} "), _spell(frac, fixed.VI_DIGITS))
    return F.concat(said, F.when(frac != "", tail).otherwise(""))


def _en_parts(token: Column) -> Column:
    dots = F.length(token) - F.length(F.translate(token, ".", ""))
    return F.struct(
        F.regexp_replace(F.substring_index(token, ".", 1), "^0+", "").alias("whole"),
        F.when(dots == 1, F.substring_index(token, ".", -1)).otherwise("").alias("frac"),
        dots.alias("dots"),
    )


def _en_words(number: Column) -> Column:
    whole, frac = number["whole"], number["frac"]
    table = [en_triplet(n) for n in range(1000)]
    said = F.when(whole == "", fixed.EN_DIGITS[0]).otherwise(_read_groups(whole, table, table, fixed.EN_SCALES))
    tail = F.concat(F.lit(" point "), _spell(frac, fixed.EN_DIGITS))
    fits = (number["dots"] <= 1) & (F.length(whole) <= 3 * len(fixed.EN_SCALES))
    return F.when(fits, F.concat(said, F.when(frac != "", tail).otherwise("")))


def number_words(tokens: Column, lang: str) -> Column:
    """Array of number tokens -> array of their words. English entries are NULL
    where the token is left as it is (several dots, or no scale name is left)."""
    plain = F.transform(tokens, _ascii_digits)
    if lang == "vi":
        return F.transform(F.transform(plain, _vi_parts), _vi_words)
    if lang == "en":
        bare = F.transform(plain, lambda t: F.translate(t, ",", ""))
        return F.transform(F.transform(bare, _en_parts), _en_words)
    raise ValueError(f"no number reader for {lang!r}")


def spoken_numbers(tokens: Column, lang: str) -> Column:
    return F.zip_with(tokens, number_words(tokens, lang), lambda token, said: F.coalesce(
        F.concat(F.lit(" "), said, F.lit(" ")), token))


def spoken_acronyms(tokens: Column) -> Column:
    names = _table([fixed.VI_LETTERS[c] for c in sorted(fixed.VI_LETTERS)])

    def letters(token: Column) -> Column:
        each = F.regexp_extract_all(token, F.lit("[A-Z]"), F.lit(0))
        return F.array_join(F.transform(each, lambda c: F.element_at(names, F.ascii(c) - 64)), " ")

    return F.transform(tokens, letters)


def spoken_phones(tokens: Column) -> Column:
    """Phone numbers digit by digit; other long digit runs stay as they are."""
    def spoken(raw: Column, digits: Column) -> Column:
        n = F.length(digits)
        phone = (n >= 10) | ((n == 9) & (digits.startswith("0") | raw.startswith("+")))
        said = F.concat(F.lit(" "), _spell(digits, fixed.VI_DIGITS), F.lit(" "))
        return F.when(phone, said).otherwise(raw)

    digits = F.transform(tokens, lambda t: F.regexp_replace(_ascii_digits(t), "[^0-9]", ""))
    return F.zip_with(tokens, digits, spoken)
