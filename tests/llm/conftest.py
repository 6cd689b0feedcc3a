import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; as extra columns they must not matter.
CLASHING = ("g", "p", "head", "rest", "ended", "rid", "n", "h", "cid", "key", "range", "size", "rows", "token", "host", "page",
            "hits", "score", "x", "y", "at", "component_id", "kept", "_keep_key", "item", "words", "start")


def documents(spark, rows, clashing=True):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, FIELDS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, clashing=True: documents(spark, rows, clashing)
