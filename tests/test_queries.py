"""Every registered query against its SQL on DuckDB, on the smallest test data."""

import pytest

import __spark_entry__ as entry
from acceptance import queries
from acceptance.oracle import all_oracles
from acceptance.queries import all_queries
from gridtide.streaming import segments
from tests.conftest import TESTDATA
from tools.compare import connect, difference, duckdb_rows, spark_rows

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def db():
    return connect(TESTDATA)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 30


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = spark_rows(QUERIES[name](spark, TESTDATA))
    assert found[1]
    assert difference(found, duckdb_rows(db, ORACLES[name])) is None


def test_more_rows_arrive_as_more_files(spark, db, monkeypatch):
    """No task writes a fixed share of the table, and there are as many batches as before."""
    monkeypatch.setattr(queries, "FILE_ROWS", 300)
    folders = []
    arrived = queries._arrived
    monkeypatch.setattr(queries, "_arrived", lambda *a, **only: folders.append(arrived(*a, **only)) or folders[-1])
    found = spark_rows(QUERIES["stream_delta_overview"](spark, TESTDATA))
    assert difference(found, duckdb_rows(db, ORACLES["stream_delta_overview"])) is None
    lines = spark.read.parquet(f"{folders[0].removesuffix('/state')}/lines")
    sizes = [r["count"] for r in lines.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) > 5000 and max(sizes) <= 2 * queries.FILE_ROWS
    left = segments.visible(segments.finished(spark, folders[0]))
    assert (left[0].first, left[-1].last) == (0, queries.ARRIVALS - 1)
