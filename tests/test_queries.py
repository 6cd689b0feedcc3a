"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        problem = compare(df, con, SQL[name])
        assert problem is None, problem
    else:
        assert not df.isEmpty()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "total", "untranslated", "gate"]
    assert df.count() > 0


# The ordered operators again with blocks of three, so that every group is cut many times.
@pytest.mark.parametrize("name", [
    "merge_segments", "chunk_segments", "build_requests", "ffill_boxes", "time_windows", "segment_stream"])
def test_small_blocks(spark, con, monkeypatch, name):
    from segmentlab.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 3)
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None
