"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialize

_BUCKET_BITS = 12


def _knots(schedule: DataFrame | None) -> DataFrame | None:
    """``source`` and knots: the schedule's times and weights, in order, as an array a source."""
    if schedule is None:
        return None
    sound = schedule.filter(F.col("source").isNotNull() & F.col("time").between(0, 1) & (F.col("weight") >= 0))
    once = sound.groupBy("source", F.col("time").cast("double").alias("t")).agg(F.avg(F.col("weight").cast("double")).alias("w"))
    return once.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("knots"))


def _steps(knots: Column) -> Column:
    """Stretches of the piecewise linear weight over [0, 1], each with its start t0, width, weights w0 and w1 and
    the area before it, all scaled so that the whole area is 1; one even stretch where there is no weight at all."""
    first, last = F.get(knots, F.lit(0)), F.element_at(knots, -1)
    ends = F.concat(
        F.array(F.struct(F.lit(0.0).alias("t"), first["w"].alias("w"))), knots, F.array(F.struct(F.lit(1.0).alias("t"), last["w"].alias("w")))
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(ends) - 2),
        lambda i: F.struct(
            F.get(ends, i)["t"].alias("t0"), (F.get(ends, i + 1)["t"] - F.get(ends, i)["t"]).alias("width"), F.get(ends, i)["w"].alias("w0"), F.get(ends, i + 1)["w"].alias("w1")
        ),
    )
    wide = F.filter(pairs, lambda p: p["width"] > 0)
    area = lambda p: (p["w0"] + p["w1"]) / 2 * p["width"]
    whole = F.aggregate(wide, F.lit(0.0), lambda total, p: total + area(p))
    even = F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("width"), F.lit(1.0).alias("w0"), F.lit(1.0).alias("w1"), F.lit(0.0).alias("before")))
    scaled = F.transform(
        wide,
        lambda p, i: F.struct(
            p["t0"].alias("t0"), p["width"].alias("width"), (p["w0"] / whole).alias("w0"), (p["w1"] / whole).alias("w1"),
            (F.aggregate(F.slice(wide, 1, i), F.lit(0.0), lambda total, q: total + area(q)) / whole).alias("before"),
        ),
    )
    return F.when(knots.isNotNull() & (whole > 0), scaled).otherwise(even)


def mixture_plan(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None, schedule: DataFrame | None = None) -> DataFrame:
    """One row a source of ``sizes`` or ``weights``: what the mixture takes of it.

    ``sizes``: source, n_tokens. ``weights``: source, target_share, max_repeats. Columns: source,
    target_share, max_repeats, available (tokens), share (the target among sources that have
    tokens), demand (tokens the mixture takes), steps.

    Without ``total_tokens`` the mixture is as large as it can be with every share met and no
    source repeated more often than allowed. With it, a source whose allowance is too small gives
    all of its allowance, and the other sources don't fill the gap. A source without tokens, weight or
    allowance has demand 0. A source named twice in ``weights`` gets the sum of its shares and the
    least of its allowances.

    ``schedule``: source, time (0 to 1 over the training), weight: the source's weight relative to
    itself, linear between the times given and level before the first and after the last. It says
    when a source's tokens come, its share of the whole stays ``share``. A source without one
    comes evenly. steps holds the schedule as stretches whose areas add up to 1. Times outside
    0…1, negative and null weights are ignored, weights of one time averaged.
    """
    have = sizes.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available"))
    want = weights.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    joined = want.join(have, "source", "full").na.fill({"available": 0, "target_share": 0.0, "max_repeats": 0})
    knots = _knots(schedule)
    empty = F.lit(None).cast("array<struct<t: double, w: double>>")
    joined = joined.withColumn("knots", empty) if knots is None else joined.join(knots, "source", "left")
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = joined.withColumn("live", live)
    # Sources may be as many as web hosts, so totals over them are aggregates of one row.
    shares = F.broadcast(rows.agg(F.sum(F.when(F.col("live"), F.col("target_share"))).alias("all_shares")))
    rows = rows.crossJoin(shares).withColumn("share", F.when(F.col("live"), F.col("target_share") / F.col("all_shares")).otherwise(0.0))
    allowed = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(F.when(F.col("live"), allowed / F.col("share"))).alias("size"))))
    else:
        rows = rows.withColumn("size", F.lit(float(total_tokens)))
    demand = F.when(F.col("live"), F.least(F.col("share") * F.col("size"), allowed.cast("double"))).otherwise(0.0)
    return rows.select("source", "target_share", "max_repeats", "available", "share", demand.alias("demand"), _steps(F.col("knots")).alias("steps"))


def training_time(done: Column, steps: Column) -> Column:
    """The time in [0, 1] at which a part ``done`` of a source's demand is reached: the inverse of the integral of its schedule.

    Within a stretch the weight is w0 + (w1 - w0) x, x from 0 to 1, and its area up to x is width * (w0 x + (w1 - w0) x² / 2).
    """
    here = F.aggregate(steps, F.get(steps, F.lit(0)), lambda found, p: F.when((p["before"] <= done) & (p["w0"] + p["w1"] > 0), p).otherwise(found))
    rest = F.greatest((done - here["before"]) / here["width"], F.lit(0.0))
    root = F.sqrt(F.greatest(here["w0"] * here["w0"] + 2 * (here["w1"] - here["w0"]) * rest, F.lit(0.0)))
    x = F.when(rest == 0, 0.0).otherwise(2 * rest / (here["w0"] + root))
    return here["t0"] + here["width"] * F.least(x, F.lit(1.0))


def mix_sources(
    sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 7, schedule: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``sizes``: doc_id, source, n_tokens, doc_id unique. ``weights``, ``schedule`` and
    ``total_tokens`` are those of ``mixture_plan``. The mixture has doc_id, source, copy_no
    (from 0), n_tokens and position (in [0, 1)), sorted by position: range-partitioned and sorted
    within. Each source's documents are lined up in an order drawn by ``seed``, pass after pass,
    until its demand is met; a document's place in that line is turned into a position by the
    inverse of the source's cumulative demand. The last document of a source may reach over its
    demand by part of its own size; a pass over the allowance is never begun.

    The running token counts are taken in two steps, over 4096 hash buckets a source and then
    within a bucket, so that no task gets a whole source.

    The report has one row a source: target_share, wanted_share (the target among sources that have
    tokens, against which actual_share is to be judged), max_repeats, available, n_rows (rows in
    the mixture), repeats (passes over the source, begun ones too), mix_tokens and actual_share. Documents with
    no tokens (null and empty texts) and of sources without weight are in no mixture. Empty tables
    give an empty mixture.
    """
    plan = materialize(mixture_plan(sizes, weights, total_tokens, schedule), "mixplan")
    docs = sizes.select("doc_id", "source", "n_tokens").filter("n_tokens > 0")
    drawn = docs.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    drawn = drawn.withColumn("bucket", F.shiftrightunsigned("draw", 64 - _BUCKET_BITS).cast("int"))
    per_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        drawn.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(per_source), F.lit(0)))
        .drop("in_bucket")
    )
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lined = drawn.join(before, ["source", "bucket"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    )
    wanted = lined.join(plan.filter("demand > 0").select("source", "available", "max_repeats", "demand", "steps"), "source").filter("start < demand")
    passes = F.least(F.ceil((F.col("demand") - F.col("start")) / F.col("available")), F.col("max_repeats")).cast("int")
    copies = wanted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), passes - 1)))
    done = (F.col("copy_no") * F.col("available") + F.col("start")) / F.col("demand")
    placed = copies.select("doc_id", "source", "copy_no", "n_tokens", training_time(done, F.col("steps")).alias("position"))
    placed = materialize(placed, "mixture")
    taken = placed.groupBy("source").agg(
        F.sum("n_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("copy_no") + 1).cast("long").alias("repeats")
    )
    report = (
        plan.select("source", "target_share", F.col("share").alias("wanted_share"), F.col("max_repeats").cast("long").alias("max_repeats"), "available")
        .join(taken, "source", "left")
        .na.fill({"mix_tokens": 0, "n_rows": 0, "repeats": 0})
        .crossJoin(F.broadcast(taken.agg(F.sum("mix_tokens").alias("all_tokens"))))
        .withColumn("actual_share", F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)))
        .drop("all_tokens")
    )
    order = ["position", "source", "doc_id", "copy_no"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order), report
