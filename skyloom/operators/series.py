"""Gaps, midpoints and islands in series of events, and sampling of intervals onto a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a revisit figure is where there is no gap.
NO_GAP = 99999.0


def micros(instant: Column) -> Column:
    """Microseconds since 1970-01-01 of a time that holds UTC; the session's zone is UTC."""
    return F.unix_micros(instant.cast("timestamp"))


def revisit_gaps(events: DataFrame, group: str, start_us: str, end_us: str, tiebreak: str) -> DataFrame:
    """``group``, avg_revisit, max_revisit and min_revisit in hours to six places.

    A gap is the start of an event less the end of the one before it; it is below 0 where they
    overlap. Events without a start or an end make no gap. A group without a gap has 99999 in all
    three figures. Null is a group.
    """
    order = Window.partitionBy(group).orderBy(F.col(start_us), F.col(tiebreak))
    sound = F.col(start_us).isNotNull() & F.col(end_us).isNotNull()
    gaps = events.filter(sound).select(group, (F.col(start_us) - F.lag(end_us).over(order)).alias("gap"))
    every = gaps.unionByName(events.filter(~sound).select(group, F.lit(None).cast("long").alias("gap")))

    def hours(value: Column) -> Column:
        return F.coalesce(F.round(value / 3_600_000_000, 6), F.lit(NO_GAP))

    return every.groupBy(group).agg(
        hours(F.avg("gap")).alias("avg_revisit"), hours(F.max("gap")).alias("max_revisit"), hours(F.min("gap")).alias("min_revisit")
    )


def midpoint_windows(events: DataFrame, group: str, key: str, at_us: str) -> DataFrame:
    """``group``, ``key``, start_s, end_s: whole seconds half the way to the next event before and after each event.

    The last event takes half the way from the one before it, a single event none.
    """
    order = Window.partitionBy(group).orderBy(F.col(at_us), F.col(key))
    half = F.coalesce(F.lead(at_us).over(order) - F.col(at_us), F.col(at_us) - F.lag(at_us).over(order), F.lit(0))
    rows = events.select(group, key, F.col(at_us).alias("at"), half.alias("width"))
    return rows.select(
        group, key, F.expr("(2 * at - width - pmod(2 * at - width, 2000000)) div 2000000").alias("start_s"),
        F.expr("(2 * at + width - pmod(2 * at + width, 2000000)) div 2000000").alias("end_s"),
    )


def islands(events: DataFrame, group: str, key: str, at_us: str, gap_us: int) -> DataFrame:
    """``group``, start_us, end_us, n: stretches of events with no gap over ``gap_us`` between neighbours."""
    order = Window.partitionBy(group).orderBy(F.col(at_us), F.col(key))
    far = F.col(at_us) - F.lag(at_us).over(order) > gap_us
    opened = events.select(group, key, F.col(at_us).alias("at"), F.when(far, 1).otherwise(0).alias("opens"))
    numbered = opened.withColumn("no", F.sum("opens").over(Window.partitionBy(group).orderBy("at", key)))
    return numbered.groupBy(group, "no").agg(F.min("at").alias("start_us"), F.max("at").alias("end_us"), F.count("*").alias("n")).drop("no")


def on_grid(rows: DataFrame, start: Column, end: Column, step: int) -> DataFrame:
    """The rows once for each multiple ``t`` of ``step`` from start to end, both included; an interval without one has no row."""
    first, last = F.ceil(start / step) * step, F.floor(end / step) * step
    return rows.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))))
