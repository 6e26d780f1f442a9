"""Summaries of numbers: distributions, histograms, shares, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(rows: DataFrame, value: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """``by``, n, total, mean, std (of the whole), least, p25, median, p75, most.

    Quartiles are interpolated linearly. Nulls aren't counted. A group without values, and an empty
    table without ``by``, has zeros.
    """
    v = F.col(f"`{value}`").cast("double")
    zero = lambda c: F.coalesce(F.round(c, digits), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), zero(F.sum(v)).alias("total"), zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), zero(F.min(v)).alias("least"),
        zero(F.percentile(v, 0.25)).alias("p25"), zero(F.percentile(v, 0.5)).alias("median"), zero(F.percentile(v, 0.75)).alias("p75"), zero(F.max(v)).alias("most"),
    )


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (from 0), low, high and n of every bin, empty ones too; bins have equal widths and the last is closed.

    Where all values are equal there is one bin. Nulls aren't counted; without values there are no rows.
    """
    v = rows.select(F.col(f"`{value}`").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo is not null")
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.withColumn("bin", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def bucket_shares(rows: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """bucket, n and percent of all rows, in the order given; a row counts in every bucket whose condition it meets."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(condition).alias(f"n{i}") for i, condition in enumerate(buckets.values())))
    listed = F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"n{i}").alias("n")) for i, name in enumerate(buckets)))
    spread = counts.select("total", F.explode(listed).alias("b"))
    return spread.select("b.bucket", "b.n", F.coalesce(F.round(F.col("b.n") * 100 / F.nullif("total", F.lit(0)), 4), F.lit(0.0)).alias("percent"))


def share_buckets(share: str) -> dict[str, Column]:
    """The buckets of a coverage rate: above 1, 1, and three bands below."""
    c = F.col(share)
    return {">1": c > 1, "=1": c == 1, "0.9-1": (c >= 0.9) & (c < 1), "0.8-0.9": (c >= 0.8) & (c < 0.9), "<0.8": c < 0.8}


def series_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``by``, least, most and mean of values rounded to two places first, half to even."""
    v = F.bround(F.col(f"`{value}`").cast("double"), 2)
    return rows.groupBy(*(by or [])).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.bround(F.avg(v), 2).alias("mean"))


def tally(rows: DataFrame, succeeded: Column) -> DataFrame:
    """One row: total, success, failed and success_percent (0 for an empty table); null counts as failed."""
    good = F.coalesce(succeeded, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success")).select(
        "total", "success", (F.col("total") - F.col("success")).alias("failed"),
        F.coalesce(F.round(F.col("success") * 100 / F.nullif("total", F.lit(0)), 2), F.lit(0.0)).alias("success_percent"),
    )


def resolution_bands(rows: DataFrame, by: str, value: str, edges: tuple[float, float, float]) -> DataFrame:
    """``by``, total and the counts below the first edge, in the two bands between edges (lower edge in) and from the last on."""
    v = F.col(f"`{value}`")
    x, y, z = edges
    return rows.groupBy(by).agg(
        F.count(v).alias("total"), F.count_if(v < x).alias("better"), F.count_if((v >= x) & (v < y)).alias("fine"),
        F.count_if((v >= y) & (v < z)).alias("coarse"), F.count_if(v >= z).alias("worse"),
    )


def duration_summary(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """``by``, least, most, mean and total of durations, to six places."""
    v = F.col(f"`{seconds}`").cast("double")
    return rows.groupBy(by).agg(*(F.round(f(v), 6).alias(n) for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg), ("total", F.sum))))


def duration_matrix(rows: DataFrame, a: str, b: str, seconds: str, columns: list, symmetric: bool = False) -> DataFrame:
    """A row for every ``a`` with the minutes to each of ``columns``; 0 where there are none.

    ``symmetric`` mirrors every pair first; a pair that is given both ways then has the sum of both.
    The columns are named by the caller, so that no job has to look for them.
    """
    long = rows.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"), F.col(f"`{seconds}`").alias("s"))
    if symmetric:
        long = long.unionByName(long.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    wide = long.filter("a is not null").groupBy("a").pivot("b", columns).agg(F.sum("s") / 60)
    return wide.select(F.col("a").alias(a), *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(str(c)) for c in columns))
