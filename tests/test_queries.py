"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lingoscope.plans import catalogue, picture_queries, report_queries, rule_queries, sentence_queries, shop_queries, sweep_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


THREADS = os.environ.get("TEST_DUCK_THREADS")


@pytest.fixture
def duck():
    """A connection for each test: an error in one query leaves the others alone."""
    with duckdb.connect(config={"threads": int(THREADS)} if THREADS else {}) as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[k] for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, want.fetchall())
