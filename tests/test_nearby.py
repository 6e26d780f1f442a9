"""Near pairs and containment against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators.nearby import SphereTree, contained, near_pairs, region_edges, valid_place
from skyloom.session import local_session

SCHEMA = "side int, id long, lon double, lat double"


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


def _km(a, b):
    (lo1, la1), (lo2, la2) = ((math.radians(p[2]), math.radians(p[3])) for p in (a, b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def _brute(rows, radius):
    points = sorted(set(rows))
    return {(a[0], a[1], b[0], b[1]) for i, a in enumerate(points) for b in points[i + 1 :] if (a[0] == 0 or b[0] == 0) and a[:2] < b[:2] and _km(a, b) <= radius}


@pytest.mark.parametrize(("radius", "chunk"), [(2.0, 256), (0.05, 4), (500.0, 8)])
def test_crowds_seams_poles_and_copies(spark, radius, chunk):
    draw = random.Random(5)
    rows = [(draw.randrange(2), i, draw.uniform(-180, 360), draw.uniform(-90, 90)) for i in range(40)]
    rows += [(draw.randrange(2), 100 + i, 179.999 + draw.uniform(-1, 1) * radius / 60, 10 + draw.uniform(-1, 1) * radius / 60) for i in range(40)]
    rows += [(draw.randrange(2), 200 + i, draw.uniform(-180, 180), 90 - draw.random() * radius / 60) for i in range(20)]
    rows += [(0, 300 + i, 50.0, 20.0) for i in range(30)] + rows[:10]  # one place, and repeated rows
    tree = SphereTree(spark.createDataFrame(rows, SCHEMA), radius, leaf_size=3, chunk_size=chunk)
    found = [tuple(r) for r in near_pairs(tree, radius).collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(rows, radius)


def test_empty_and_single(spark):
    assert near_pairs(SphereTree(spark.createDataFrame([], SCHEMA)), 2.0).collect() == []
    assert near_pairs(SphereTree(spark.createDataFrame([(0, 1, 5.0, 5.0)], SCHEMA)), 2.0).collect() == []


def test_regions_over_the_date_line_overlapping_and_unsound(spark):
    rings = [(1, [170.0, 190.0, 190.0, 170.0], [0.0, 0.0, 10.0, 10.0]), (2, [175.0, 185.0, 180.0], [1.0, 1.0, 9.0]), (3, [0.0, 1.0], [0.0, 1.0]), (4, None, [1.0]), (5, [0.0, None, 1.0], [0.0, 1.0, 2.0])]
    regions = region_edges(spark.createDataFrame(rings, "no long, lon array<double>, lat array<double>"), "no", "lon", "lat")
    rows = [(0, 1, -179.0, 5.0), (0, 2, 181.0, 1.5), (0, 3, 172.0, 5.0), (0, 4, 20.0, 5.0), (1, 5, 180.0, 5.0)]
    tree = SphereTree(spark.createDataFrame(rows, SCHEMA), leaf_size=1)
    assert sorted(tuple(r) for r in contained(tree, regions).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert contained(SphereTree(spark.createDataFrame([], SCHEMA)), regions).collect() == []
    assert contained(tree, regions.limit(0)).collect() == []


def test_valid_places(spark):
    rows = [(0.0, 0.0, False), (0.0, 1.0, True), (-180.0, 90.0, True), (360.0, -90.0, True), (360.5, 0.0, False), (0.0, 91.0, False), (None, 1.0, None), (float("nan"), 1.0, False)]
    frame = spark.createDataFrame(rows, "lon double, lat double, ok boolean")
    assert all(bool(r["ok"]) == bool(r["v"]) for r in frame.withColumn("v", valid_place(F.col("lon"), F.col("lat"))).collect())
