"""From access intervals to what each satellite sees at every step of a time grid, and on to graph snapshots.

Intervals are rows: src, dst, t0, t1 (seconds since the scenario's start), seq (their order of
arrival). A hot satellite is no group of its own anywhere: rows are keyed by (src, dst, t) or (src, t).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.geodesy import connection_quality, distance3
from skyloom.session import materialize


def scenario_intervals(rows: DataFrame) -> DataFrame:
    """Intervals that begin before the scenario, or end before it, are left out, as are those with a null."""
    return rows.filter((F.col("t0") >= 0) & (F.col("t1") >= 0) & F.col("src").isNotNull() & F.col("dst").isNotNull())


def both_directions(rows: DataFrame) -> DataFrame:
    """Every interval from src to dst also from dst to src."""
    return rows.unionByName(rows.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def time_grid(intervals: DataFrame, step: int) -> DataFrame:
    """t: the multiples of ``step`` from that at or before the first start to that after the last end, both included."""
    ends = intervals.agg(F.min("t0").alias("lo"), F.max("t1").alias("hi")).filter("lo is not null and hi is not null")
    first, last = F.floor(F.col("lo") / step) * step, (F.floor(F.col("hi") / step) + 1) * step
    return ends.select(F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("t"))


def sample_intervals(intervals: DataFrame, step: int, until: int | None = None) -> DataFrame:
    """src, dst, t and t0, t1, seq of the first interval (by seq) that holds t, both ends included, for every t of the grid.

    ``until`` ends the grid, so that an interval that lasts for ever makes no more points than the others could.

    Each interval is unrolled to its own grid points, so the join of intervals and grid is no
    theta join; the first is taken by an aggregation with partial results in every task.
    """
    end = F.col("t1") if until is None else F.least(F.col("t1"), F.lit(float(until)))
    first, last = F.ceil(F.col("t0") / step) * step, F.floor(end / step) * step
    points = intervals.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))))
    taken = points.groupBy("src", "dst", "t").agg(F.min(F.struct("seq", "t0", "t1")).alias("i"))
    return taken.select("src", "dst", "t", "i.t0", "i.t1", "i.seq")


def window_until(t: Column, t1: Column, step: int) -> tuple[Column, Column]:
    """The end of a visibility window that begins at ``t``, twice: t + min(t1, step) as the data were first made, which
    takes an absolute time for a duration, and t + min(t1 - t, step)."""
    return t + F.least(t1, F.lit(step)), t + F.least(t1 - t, F.lit(step))


def positions_at(points: DataFrame, ephemeris: DataFrame, object_id: str, t: str, step: int, order: int = 1) -> DataFrame:
    """``points`` with x, y, z of their object at their time; null where the ephemeris doesn't reach.

    ``ephemeris``: object_id, t (a regular grid of ``step`` seconds), x, y, z. ``order`` 1 takes
    the straight line between the points around t, higher odd orders Lagrange's polynomial through
    the order + 1 points around it. The points come by equi-joins on the grid, one for each.
    """
    keys = [-(order // 2) + k for k in range(order + 1)]
    base = F.floor(F.col(t) / step)
    rows = points.withColumn("sk_at", F.col(t) / step - base).withColumn("sk_base", base.cast("long"))
    grid = ephemeris.select(F.col("object_id").alias("sk_id"), (F.col("t") / step).cast("long").alias("sk_k"), F.struct("x", "y", "z").alias("sk_p"))
    spread = rows
    for k in keys:
        near = grid.select(F.col("sk_id").alias(f"sk_id{k}"), (F.col("sk_k") - k).alias(f"sk_k{k}"), F.col("sk_p").alias(f"sk_p{k}"))
        spread = spread.join(near, (F.col(object_id) == F.col(f"sk_id{k}")) & (F.col("sk_base") == F.col(f"sk_k{k}")), "left").drop(f"sk_id{k}", f"sk_k{k}")

    def axis(name: str) -> Column:
        total = F.lit(0.0)
        for k in keys:
            weight = F.lit(1.0)
            for j in keys:
                if j != k:
                    weight = weight * (F.col("sk_at") - j) / (k - j)
            total = total + weight * F.col(f"sk_p{k}")[name]
        exact = F.col("sk_p0")[name]
        return F.round(F.when(F.col("sk_at") == 0, exact).otherwise(total), 3)

    return spread.withColumns({a: axis(a) for a in "xyz"}).drop("sk_at", "sk_base", *(f"sk_p{k}" for k in keys))


def visibility_ticks(targets: DataFrame, peers: DataFrame, step: int) -> DataFrame:
    """src, t, targets and peers (arrays of dst and until, by dst): what each satellite sees at every step.

    A satellite has a tick where it sees a target; peers are attached where it has some, else the
    array is empty. ``peers`` are taken in both directions.
    """
    def nested(rows: DataFrame, name: str) -> DataFrame:
        seen = sample_intervals(scenario_intervals(rows), step)
        until = window_until(F.col("t"), F.col("t1"), step)[1]
        return seen.groupBy("src", "t").agg(F.array_sort(F.collect_list(F.struct("dst", until.alias("until")))).alias(name))

    left, right = nested(targets, "targets"), nested(both_directions(peers), "peers")
    joined = left.join(right, ["src", "t"], "left")
    return joined.select("src", "t", "targets", F.coalesce("peers", F.filter("targets", lambda e: F.lit(False))).alias("peers"))


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key by ``order``; nulls come last, ties go by the other columns."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    taken = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).isNull().alias("sk_late"), F.col(order), *others)).alias("sk_row"))
    return taken.select(*keys, f"sk_row.{order}", *(f"sk_row.{c}" for c in others)).select(*rows.columns)


def relative_weights(edges: DataFrame, group: str, distance: str, digits: int = 2) -> DataFrame:
    """``edges`` with w: the group's least distance over the edge's own.

    A distance of 0 or null has a null weight. The least comes by an aggregation and a join, so
    that a large group isn't one task's.
    """
    d = F.nullif(F.col(f"`{distance}`"), F.lit(0.0))
    least = edges.groupBy(F.col(group).alias("sk_group")).agg(F.min(d).alias("sk_least"))
    joined = edges.join(least, F.col(group).eqNullSafe(F.col("sk_group")))
    return joined.withColumn("w", F.round(F.col("sk_least") / d, digits)).drop("sk_group", "sk_least")


def argmax_per_key(rows: DataFrame, key: str, value: str, item: str) -> DataFrame:
    """``key``, ``item`` and ``value`` of the row with the highest value; ties go to the least item, nulls come last."""
    best = F.max_by(F.struct(item, value), F.struct(F.coalesce(F.col(value), F.lit(float("-inf"))).alias("v"), (-F.col(item)).alias("k")))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("sk_best")).select(key, f"sk_best.{item}", f"sk_best.{value}")


def graph_snapshots(nodes: DataFrame, sat_edges: DataFrame, target_edges: DataFrame, strategy: str = "balanced", seed: int = 7) -> DataFrame:
    """One nested snapshot a t: t, strategy, sat_attrs, sat_edges and target_edges, elements in order of their ids.

    ``nodes``: t, id, x, y, z, seq. ``sat_edges`` and ``target_edges``: t, from_id, to_id,
    distance, seq. Of repeated nodes and edges of a t the first by seq counts. Weights are the
    least distance at t over the edge's own, apart for the two kinds of edges; health is drawn
    around 0.8, the same for the same seed. A t without edges of a kind has an empty array.
    """
    drawn = nodes.withColumn("health", random_health(F.xxhash64("t", "id", F.lit(seed))))
    attrs = first_per_key(drawn, ["t", "id"], "seq").groupBy("t").agg(
        F.array_sort(F.collect_list(F.struct("id", "health", F.array("x", "y", "z").alias("pos")))).alias("sat_attrs")
    )

    def listed(edges: DataFrame, name: str, weight: str) -> DataFrame:
        once = relative_weights(first_per_key(edges, ["t", "from_id", "to_id"], "seq"), "t", "distance")
        return once.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id", F.col("w").alias(weight)))).alias(name))

    joined = attrs.join(listed(sat_edges, "sat_edges", "w"), "t", "left").join(listed(target_edges, "target_edges", "q"), "t", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)).alias(name)
    return joined.select("t", F.lit(strategy).alias("strategy"), "sat_attrs", empty("sat_edges"), empty("target_edges"))


def random_health(key: Column, mean: float = 0.8, spread: float = 0.2) -> Column:
    """A normal draw around ``mean`` kept in 0…1, two places; it follows from the key alone, so that a retried task draws the same."""
    uniform = lambda salt: (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * 3.141592653589793 * uniform(2))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + spread * normal)), 2)


def random_choice(key: Column, options: list[str]) -> Column:
    """One of ``options``, following from the key alone."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(len(options))).cast("int"))


def edges_with_quality(rows: DataFrame) -> DataFrame:
    """``rows`` (x1 … z2) with distance and the connection quality 0–100 that belongs to it."""
    distance = distance3(*(F.col(f"{a}{n}") for n in (1, 2) for a in "xyz"))
    return rows.withColumn("distance", distance).withColumn("quality", connection_quality(F.col("distance")))


def unordered_pairs(objects: DataFrame, position: str, block: str) -> DataFrame:
    """a and b of every two objects of a block, by ascending position; a block is what bounds the number of pairs."""
    left = objects.select(F.col(block), F.col(position).alias("a"))
    return left.join(left.withColumnRenamed("a", "b"), block).filter("a < b").select(block, "a", "b")


def numeric_stretch(values: Column) -> Column:
    """An array of texts as numbers without the leading ones that are none and without its last element."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    first = F.array_position(F.transform(numbers, lambda v: v.isNotNull()), True)
    return F.when(first > 0, F.slice(numbers, first.cast("int"), F.greatest(F.size(numbers) - first.cast("int"), F.lit(0))))


def numbered(rows: DataFrame, order: list[str], name: str = "no", first: int = 1) -> DataFrame:
    """``rows`` with their number in the whole order, without a single task for all: counts of range partitions are
    added up first. ``order`` must be total."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn("sk_part", F.spark_partition_id()), "numbered")
    counts = kept.groupBy("sk_part").agg(F.count(F.lit(1)).alias("sk_n"))
    before = counts.select("sk_part", F.coalesce(F.sum("sk_n").over(Window.orderBy("sk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sk_before"))
    within = Window.partitionBy("sk_part").orderBy(*order)
    return kept.join(F.broadcast(before), "sk_part").withColumn(name, F.row_number().over(within) + F.col("sk_before") + (first - 1)).drop("sk_part", "sk_before")
