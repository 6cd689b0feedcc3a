"""Normalising a corpus of lines in several languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from segmentlab.functions import text
from segmentlab.operators import normalize

RULES = ["addresses", "script", "phones", "percent", "numbers", "acronyms"]


def normalize_corpus(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Make every text speakable in its language; Vietnamese and English are spelled out.

    Rows stay where they are: there is no shuffle. Only rows with characters that
    Unicode composition may change pass through Python. Each step that replaces something
    adds its ``hit_<rule>`` column, the replacements it makes in the row; counters that
    nobody reads are not computed.
    """
    t, lang = F.col(text_col), F.col(lang_col)
    vi, en = lang == "vi", lang == "en"

    def when(where: Column, changed: Column) -> Column:
        return F.when(where, changed).otherwise(t)

    def counted(rows: DataFrame, rule: str, pattern: str, where: Column | None = None) -> DataFrame:
        n = F.regexp_count(t, F.lit(pattern)).cast("bigint")
        return rows.withColumn(f"hit_{rule}", F.coalesce(n if where is None else F.when(where, n), F.lit(0).cast("bigint")))

    out = counted(df.withColumn(text_col, text.nfc(t)), "addresses", text.ADDRESS)
    out = out.withColumn(text_col, text.split_letters_digits(text.without_addresses(t)))
    out = counted(out, "script", text.WRONG_SCRIPT, vi)
    out = out.withColumn(text_col, when(vi & text.has_wrong_script(t), text.without_wrong_script(t)))
    out = normalize.spell_phones(out, text_col, vi, "hit_phones")
    out = counted(out, "percent", rf"{text.DIGIT}{text.SPACE}*%", vi | en)
    out = out.withColumn(text_col, F.when(vi, text.vi_symbols_late(text.ranges_to_words(text.vi_symbols_early(t), "đến")))
                         .when(en, text.en_symbols(text.ranges_to_words(t, "to"))).otherwise(t))
    out = normalize.expand_numbers(out, text_col, "vi", vi, "_hit_vi")
    out = normalize.expand_numbers(out, text_col, "en", en, "_hit_en")
    out = out.withColumn("hit_numbers", F.col("_hit_vi") + F.col("_hit_en")).drop("_hit_vi", "_hit_en")
    out = normalize.spell_acronyms(out, text_col, vi, "hit_acronyms")
    return out.withColumn(text_col, F.when(vi, text.dedupe_time_words(text.squeeze(t))).when(en, text.squeeze(t)).otherwise(t))


def observe_hits(normalized: DataFrame, name: str = "hits") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the hits per rule once they have been written or read."""
    hits = Observation(name)
    return normalized.observe(hits, F.count("*").alias("texts"), *[F.sum(f"hit_{r}").alias(f"hit_{r}") for r in RULES]), hits


def hit_report(normalized: DataFrame, lang_col: str) -> DataFrame:
    """Texts and replacements made per rule and language."""
    return normalized.groupBy(lang_col).agg(
        F.count("*").alias("texts"), *[F.sum(f"hit_{r}").alias(f"hit_{r}") for r in RULES])
