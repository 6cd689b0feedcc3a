"""The corpus pipeline: five stages from ``documents`` to a weighted mix.

Toxic documents go, then exact copies, then all but one document of each group of near copies, then documents
that leak benchmark items; the last stage tells how many words of each document the mix
takes. Every stage is written to the shared folder and read again by the next.

Stages decide by row: rows without doc_id or with a repeated one are judged each. Absent and empty texts are clean; of
several, equal as texts, the exact-copy stage keeps one. Of rows that repeat one stays. An empty table gives no
rows and the same columns; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segmentlab.llm import decontam, jaccard, mixing, radix, toxicity
from segmentlab.llm.common import table
from segmentlab.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix.drop_copies(docs)


#: Words of a shingle and least similarity in percent: near copies of the corpus, not op10's own contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mix_sources", mix),
]

#: The learned scores of the first stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
