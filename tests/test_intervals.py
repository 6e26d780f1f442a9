"""Periods and gaps of intervals."""

from __future__ import annotations

import random

import pytest

from skyloom.operators.intervals import merge_intervals
from skyloom.session import local_session

SCHEMA = "e string, s long, t long, kind string"
DAY = 86_400_000


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


def _expected(rows):
    out = set()
    for name in {e for e, *_ in rows if e is not None}:
        spans = sorted((s, t) for e, s, t, _ in rows if e == name and s is not None and t is not None and t > s)
        periods = []
        for s, t in spans:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], t)
            else:
                periods.append([s, t])
        out |= {(name, "period", s, t) for s, t in periods} | {(name, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


def _found(spark, rows, **options):
    found = [tuple(r) for r in merge_intervals(spark.createDataFrame(rows, SCHEMA), "e", "s", "t", **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_nulls_touching_nested_repeated_and_reversed(spark):
    rows = [("a", 0, 10, "x"), ("a", 10, 20, "x"), ("a", 2, 5, None), ("a", 2, 5, None), ("a", 30, 30, "x"), ("a", 40, 35, "x"), ("a", 50, 60, ""), ("b", -5, DAY, "x"),
            (None, 0, 1, "x"), ("c", None, 1, "x"), ("c", 1, None, "x"), ("d", -2 * DAY, -DAY, "x"), ("d", -DAY, 0, "x")]
    assert _found(spark, rows) == _expected(rows)
    assert _found(spark, []) == set()


@pytest.mark.parametrize("seed", range(4))
def test_random_spans_of_all_lengths(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), (s := draw.randrange(-5000, 60_000)), s + draw.choice([1, 3, 40, 150, 700, 9000, 30_000]) * draw.randrange(1, 3), "") for _ in range(40)]
    assert _found(spark, rows, chunk_ms=10) == _expected(rows)


def test_a_window_of_millennia_and_short_ones_inside_and_outside(spark):
    far = 253_000_000_000_000
    rows = [("a", 1000, far, ""), ("a", 3 * DAY, 3 * DAY + 5, ""), ("a", -9 * DAY, -8 * DAY, ""), ("a", far + 5, far + 9, ""), ("b", 0, 5 * DAY, ""), ("b", 9 * DAY, 9 * DAY + 1, "")]
    assert _found(spark, rows) == _expected(rows)
