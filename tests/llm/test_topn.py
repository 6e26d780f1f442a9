"""The N best items of every group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyloom.llm.topn import band_floors, top_n_per_group
from skyloom.session import local_session

SCHEMA = "g string, s double, id long, rank_no string"


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


def _best(rows, n):
    groups = {}
    for g, s, i, _ in set(rows):
        if g is not None and s is not None:
            groups.setdefault(g, []).append((-s, i))
    return {(g, k + 1, i) for g, items in groups.items() for k, (_, i) in enumerate(sorted(items)[:n])}


@pytest.mark.parametrize("floors", [None, [], [0.5], [0.9, 0.5, 0.5, 0.1]])
def test_hot_group_ties_copies_and_nulls(spark, floors):
    draw = random.Random(3)
    rows = [("hot", round(draw.random(), 1), i, "x") for i in range(600)] + [(f"g{i % 90}", round(draw.random(), 1), 1000 + i, "x") for i in range(300)]
    rows += rows[::7] + [("tied", 0.5, 5000 + i, "x") for i in range(20)] + [(None, 0.5, 1, "x"), ("none", None, 2, "x"), ("one", 0.0, 3, "x")]
    found = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "s", [F.col("id").asc()], 5, floors=floors)
    assert {(r["g"], r["rank_no"], r["id"]) for r in found.collect()} == _best(rows, 5)


def test_enriched_tie_rule(spark):
    rows = [("a", 1.0, 1, ""), ("a", 1.0, 2, ""), ("a", 0.5, 3, "")]
    extra = spark.createDataFrame([(2, 9)], "id long, p long")
    found = top_n_per_group(
        spark.createDataFrame(rows, SCHEMA), "g", "s", [F.col("p").desc_nulls_last(), F.col("id").asc()], 2, enrich=lambda r: r.join(extra, "id", "left")
    )
    assert sorted((r["rank_no"], r["id"]) for r in found.collect()) == [(1, 2), (2, 1)]


def test_empty_table_and_band_count(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "g", "s", [F.col("id").asc()], 5).collect() == []
    few = spark.range(4096).select(F.lit("a").alias("g"), (F.col("id") / 4096).alias("s"))
    many = spark.range(4096).select((F.col("id") / 2).cast("long").alias("g"), (F.col("id") / 4096).alias("s"))
    assert len(band_floors(few, "g", "s", 5)) > len(band_floors(many, "g", "s", 5))
