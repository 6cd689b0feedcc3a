"""Text normalisation over a whole table of texts.

Each step is its own projection: a step that needs its input more than once
then reads a column instead of repeating the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.functions import fixed, numbers, text


def strip_cjk(df: DataFrame, col: str) -> DataFrame:
    """Remove wrong-script characters and tidy the blanks they leave."""
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit("")))
    return filled.withColumn(col, text.without_wrong_script(F.col(col)))


def pre_clean(df: DataFrame, col: str) -> DataFrame:
    """NFC, addresses to blanks, letters and digits apart."""
    composed = df.withColumn(col, text.nfc(F.col(col)))
    return composed.withColumn(col, text.split_letters_digits(text.without_addresses(F.col(col))))


def ranges_to_words(df: DataFrame, col: str, joiner: str) -> DataFrame:
    return df.withColumn(col, text.ranges_to_words(F.col(col), joiner))


def vi_symbols(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.vi_symbols_late(text.vi_symbols_early(F.col(col))))


def en_symbols(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.en_symbols(F.col(col)))


def number_vocabulary(df: DataFrame, col: str, lang: str) -> DataFrame:
    """Distinct number tokens of the corpus, how often each occurs, its words.

    Counting combines before the shuffle, so a token found in every row is no
    hot key; the words are read once per distinct token.
    """
    found = F.regexp_extract_all(F.col(col), F.lit(numbers.NUMBER), F.lit(0))
    # An outer explode: a plain one makes Spark test the size first and search every text twice.
    tokens = df.select(F.explode_outer(found).alias("token")).filter("token IS NOT NULL")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    said = F.element_at(numbers.number_words(F.array("token"), lang), 1)
    return counts.withColumn("words", F.coalesce(said, F.col("token")))


def expand_numbers(df: DataFrame, col: str, lang: str, where: Column | None = None, hits: str | None = None) -> DataFrame:
    return text.map_tokens(df, col, numbers.NUMBER, lambda t: numbers.spoken_numbers(t, lang), where, hits)


def spell_acronyms(df: DataFrame, col: str, where: Column | None = None, hits: str | None = None) -> DataFrame:
    return text.map_tokens(df, col, numbers.ACRONYM, numbers.spoken_acronyms, where, hits)


def spell_phones(df: DataFrame, col: str, where: Column | None = None, hits: str | None = None) -> DataFrame:
    return text.map_tokens(df, col, numbers.PHONE, numbers.spoken_phones, where, hits)


def lang_code(df: DataFrame, col: str) -> DataFrame:
    """Adds ``lang_code``; a name that is not listed gives an empty code and is flagged."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGE_CODES.items() for x in pair])
    code = F.element_at(table, F.lower(F.coalesce(F.col(col), F.lit(""))))
    return df.withColumn("lang_code", F.coalesce(code, F.lit(""))).withColumn(
        "is_unmapped", F.col("lang_code") == "")


def ref_text_cap(segments: DataFrame, cap: float = fixed.REFERENCE_CAP, col: str = "text",
                 start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Adds ``ref_text``: the leading share of the words that fits ``cap`` seconds."""
    return segments.withColumn("ref_text", capped_text(F.col(col), F.col(end) - F.col(start), cap))


def capped_text(col: Column, duration: Column, cap: float) -> Column:
    trimmed = text.strip(F.coalesce(col, F.lit("")))
    said = text.words(trimmed)
    keep = F.greatest(F.lit(1), text.half_even(F.size(said) * F.lit(cap) / duration).cast("int"))
    too_long = (duration > cap) & (trimmed != "") & F.lit(cap > 0)
    return F.when(too_long, F.array_join(F.slice(said, F.lit(1), keep), " ")).otherwise(trimmed)
