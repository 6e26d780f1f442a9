"""Mixing sources to target weights."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyloom.llm.mixing import mix_sources, mixture_plan, training_time
from skyloom.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


def _sizes(spark, counts, each=10):
    rows = [(n * 1000 + i, name, each) for n, (name, count) in enumerate(counts.items()) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def _weights(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_allowances_and_a_source_without_documents(spark):
    sizes = _sizes(spark, {"big": 400, "small": 20, "unweighted": 5})
    weights = _weights(spark, [("big", 0.4, 2), ("small", 0.4, 5), ("none", 0.2, 3)])
    mixture, report = mix_sources(sizes, weights)
    found = {r["source"]: r.asDict() for r in report.collect()}
    assert found["big"]["wanted_share"] == found["small"]["wanted_share"] == 0.5 and found["none"]["wanted_share"] == 0
    assert abs(found["big"]["actual_share"] - 0.5) < 0.01 and found["small"]["repeats"] == 5 and found["big"]["repeats"] == 1
    assert found["none"]["mix_tokens"] == found["unweighted"]["mix_tokens"] == 0
    rows = mixture.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(0 <= r["position"] < 1 for r in rows)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows) == sum(r["n_rows"] for r in found.values())


def test_a_given_size_and_an_allowance_that_is_too_small(spark):
    report = mix_sources(_sizes(spark, {"a": 100, "b": 1}), _weights(spark, [("a", 0.5, 1), ("b", 0.5, 2)]), total_tokens=400)[1]
    assert {r["source"]: r["mix_tokens"] for r in report.collect()} == {"a": 200, "b": 20}


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1.0, 3.0)], [(0.0, 0.0), (0.5, 4.0), (1.0, 0.0)], [(0.3, 2.0)], [(0.0, 0.0), (0.4, 0.0), (0.4001, 5.0)], [(0.2, 0.0)], []])
def test_training_time_inverts_the_integral(spark, knots):
    schedule = spark.createDataFrame([("a", t, w) for t, w in knots] + [("a", 2.0, 1.0), ("a", 0.5, -1.0), (None, 0.5, 1.0)], "source string, time double, weight double")
    plan = mixture_plan(_sizes(spark, {"a": 10}), _weights(spark, [("a", 1.0, 1)]), schedule=schedule)
    times = spark.range(101).select((F.col("id") / 100).alias("done")).crossJoin(plan.select("steps")).select("done", training_time(F.col("done"), F.col("steps")).alias("t"))

    def weight(t):
        if not knots:
            return 1.0
        if t <= knots[0][0]:
            return knots[0][1]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
        return knots[-1][1]

    steps = 20_000
    values = [weight((i + 0.5) / steps) for i in range(steps)]
    whole = sum(values)
    if whole == 0:
        values, whole = [1.0] * steps, steps
    sums = [0.0]
    for v in values:
        sums.append(sums[-1] + v / whole)
    found = times.collect()
    assert [r["t"] for r in found] == sorted(r["t"] for r in found)
    for r in found:
        assert abs(sums[min(round(r["t"] * steps), steps)] - r["done"]) < 2e-3


def test_nulls_ties_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    mixture, report = mix_sources(empty, _weights(spark, []))
    assert mixture.collect() == [] and report.collect() == []
    odd = spark.createDataFrame([(1, None, 5), (2, "a", 0), (3, "a", None), (4, "a", 5)], "doc_id long, source string, n_tokens long")
    mixture, _ = mix_sources(odd, _weights(spark, [("a", 0.1, 1), ("a", 0.1, 3), (None, 0.5, 1)]))
    assert [r["doc_id"] for r in mixture.collect()] == [4]
