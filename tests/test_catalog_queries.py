"""Queries of the reference's operators against DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from skyloom.operators.graph import components, hops
from skyloom.operators.series import islands, midpoint_windows, on_grid, revisit_gaps
from skyloom.plans import catalog
from skyloom.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(rows):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in rows)


def test_entry_is_the_flagship(spark):
    assert driver.entry(spark).columns == ["user_id", "avg_revisit", "max_revisit", "min_revisit"]


def test_every_query_has_an_oracle():
    assert catalog.QUERIES and catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys() and catalog.QUERIES.keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES) or ["none"])
def test_oracle(spark, tables, name):
    found = catalog.QUERIES[name](spark, DATA)
    wanted = tables.sql(catalog.ORACLE_SQL[name])
    assert found.columns == wanted.columns
    assert _rows(found.collect()) == _rows(wanted.fetchall())


def test_revisit_gaps_of_overlaps_single_events_and_missing_times(spark):
    events = spark.createDataFrame(
        [("a", 1, 0, 7_200_000_000), ("a", 2, 3_600_000_000, 7_200_000_000), ("a", 3, 10_800_000_000, 10_800_000_000), ("b", 4, 5, 6), ("c", 5, None, 1)],
        "g string, id long, s long, e long",
    )
    found = {r[0]: tuple(r[1:]) for r in revisit_gaps(events, "g", "s", "e", "id").collect()}
    assert found == {"a": (0.0, 1.0, -1.0), "b": (99999.0,) * 3, "c": (99999.0,) * 3}


def test_midpoints_islands_and_grid(spark):
    events = spark.createDataFrame([("a", 1, 0), ("a", 2, 10_000_000), ("b", 3, 5_500_000)], "g string, id long, at long")
    assert sorted(tuple(r) for r in midpoint_windows(events, "g", "id", "at").collect()) == [("a", 1, -5, 5), ("a", 2, 5, 15), ("b", 3, 5, 5)]
    assert sorted(tuple(r) for r in islands(events, "g", "id", "at", 9_999_999).collect()) == [
        ("a", 0, 0, 1), ("a", 10_000_000, 10_000_000, 1), ("b", 5_500_000, 5_500_000, 1),
    ]
    spans = spark.createDataFrame([(1, 10, 20), (2, 11, 19)], "id long, s long, e long")
    assert sorted(tuple(r) for r in on_grid(spans, spans.s, spans.e, 10).select("id", "t").collect()) == [(1, 10), (1, 20)]


def test_hops_and_components(spark):
    edges = spark.createDataFrame([(2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (8, 9), (9, 9)], "a long, b long")
    assert {tuple(r) for r in hops(edges, "a", "b", 1, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    found = {tuple(r) for r in components(spark.range(1, 11), "id", edges, "a", "b").collect()}
    assert found == {(n, 1) for n in range(1, 7)} | {(7, 7), (8, 8), (9, 8), (10, 10)}
