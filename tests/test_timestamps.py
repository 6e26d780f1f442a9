"""The dictionary of timestamp texts."""

from __future__ import annotations

import pytest

from skyloom.operators.timestamps import InstantDictionary, normalize_timestamps
from skyloom.session import local_session

SCHEMA = "id long, t string, z string, o string, utc_us string"
FIRST = [(1, "2025-07-20 10:00", "UTC", None, "x"), (1, "2025-07-20 10:00", "UTC", None, "x"), (2, "07/08/2025 00:00", "UTC", "MDY", None), (3, None, "UTC", None, None),
         (4, " ", None, None, None), (5, "soon 1", "UTC", "DMY", None), (6, "2025-07-20 10:00", None, None, None)]


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


def _run(spark, rows, dictionary=None):
    found = normalize_timestamps(spark.createDataFrame(rows, SCHEMA), "t", "z", "o", dictionary=dictionary)
    return sorted((r["id"], r["utc_us"]) for r in found.collect())


def test_nulls_repeated_rows_and_a_column_of_the_same_name(spark):
    noon = 1_753_005_600_000_000
    assert _run(spark, FIRST) == [(1, noon), (1, noon), (2, 1_751_932_800_000_000), (3, None), (4, None), (5, None), (6, None)]
    assert _run(spark, []) == []


def test_digits_of_other_scripts(spark):
    rows = [(1, "二〇二五年七月二十日十时零分", "UTC", None, None), (2, "٢٠٢٥-٠٧-٢٠ ١٠:٠٠", "UTC", None, None), (3, "２０２５-０７-２０ １０：００", "UTC", None, None)]
    assert _run(spark, rows) == [(n, 1_753_005_600_000_000) for n in (1, 2, 3)]


def test_a_second_load_parses_only_new_texts_and_repeated_keys_dont_double_rows(spark, tmp_path):
    path = f"file://{tmp_path}/instants"
    dictionary = InstantDictionary(spark, path)
    before = _run(spark, FIRST, dictionary)
    stored = spark.read.parquet(path)
    assert stored.count() == 4
    assert _run(spark, FIRST + [(7, "2025-07-21 00:00Z", None, None, None)], InstantDictionary(spark, path)) == sorted(before + [(7, 1_753_056_000_000_000)])
    assert spark.read.parquet(path).count() == 5
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)  # a second writer
    assert _run(spark, FIRST, InstantDictionary(spark, path)) == before
