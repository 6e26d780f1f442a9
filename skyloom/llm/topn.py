"""The N best items of every group by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialize

#: Parts of all rows, from the top, at which a band may end; which of them do follows from the data.
_SHARES = tuple(0.5 / 4**k for k in range(6))


def band_floors(items: DataFrame, group: str, score: str, n: int) -> list[float]:
    """The least score of every band but the last, best band first.

    Floors are quantiles of the whole score column, copies included. Filling all groups takes at
    least ``n`` rows of each, so no band ends above a quarter of that part of all rows: many
    small groups make few bands, few large groups make many. Equal scores fall into one band.
    """
    points = [1.0 - share for share in _SHARES]
    found = items.agg(
        F.percentile_approx(F.col(f"`{score}`"), points, 1000).alias("q"), F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.col(f"`{group}`")).alias("groups")
    ).head()
    if not found["rows"]:
        return []
    least = n * found["groups"] / found["rows"] / 4
    return sorted({q for q, share in zip(found["q"], _SHARES, strict=True) if share >= least}, reverse=True)


def top_n_per_group(
    items: DataFrame, group: str, score: str, tie_order: list[Column], n: int, enrich=None, floors: list[float] | None = None, rank: str = "rank_no"
) -> DataFrame:
    """The first ``n`` rows of every non-null ``group`` by ``score`` descending, then ``tie_order``.

    Rows equal in all columns are copies and count once. The others are written once, partitioned
    by score band. The bands are worked from the top: of each band only rows of groups that the
    bands above left unfilled are read (anti-join), ranked within their group with the exact tie
    rule and cut to ``n``. A group is filled as soon as the bands so far gave it ``n`` rows, so
    that a large group is done after the first, small band and its other rows are never shuffled
    again. Each band keeps at most ``n`` rows a group; the last step ranks those across bands,
    which decides the boundary bands exactly.

    Ranking is ``row_number() <= n``, which Spark cuts to ``n`` rows a group in every task before
    the shuffle: no task ever gets the whole of a large group, however many of its rows are tied.
    For the same reason ``enrich`` comes before the ranking: rows that are tied at the cut are
    without bound, and only the tie rule can tell them apart.

    ``enrich`` may add columns that ``tie_order`` needs (a join) to the rows of one band; it runs
    after the anti-join. ``tie_order`` must make the order total; of rows equal in all of it
    either may come first. Rows with a null group or score aren't ranked. A group with fewer than
    ``n`` rows gives all of them. A column named like ``rank`` is replaced. An empty table gives
    an empty one. ``floors`` sets the bands by hand.
    """
    items = items.drop(rank) if rank not in (group, score) else items
    items = items.filter(F.col(f"`{group}`").isNotNull() & F.col(f"`{score}`").isNotNull())
    floors = band_floors(items, group, score, n) if floors is None else sorted(set(floors), reverse=True)
    number: Column = F.lit(len(floors))
    for i, floor in reversed(list(enumerate(floors))):
        number = F.when(F.col(f"`{score}`") >= floor, F.lit(i)).otherwise(number)
    banded = materialize(items.distinct().withColumn("sk_band", number), "bands", ["sk_band"])

    within = Window.partitionBy(F.col(f"`{group}`")).orderBy(F.col(f"`{score}`").desc(), *tie_order)
    kept: list[DataFrame] = []
    for band in range(len(floors) + 1):
        rows = banded.filter(F.col("sk_band") == band).drop("sk_band")
        if kept:
            counts = reduce(DataFrame.unionByName, [k.select(group) for k in kept]).groupBy(group).count()
            filled = counts.filter(F.col("count") >= n).select(group)
            rows = rows.join(filled, group, "left_anti")
        if enrich is not None:
            rows = enrich(rows)
        best = rows.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n).drop(rank)
        kept.append(materialize(best, f"band{band}"))
    merged = reduce(DataFrame.unionByName, kept)
    return merged.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n)
