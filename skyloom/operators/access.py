"""Access of sensors to targets and of satellites to each other, from sampled positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.geodesy import ground_sample_distance
from skyloom.functions.orbits import azimuth_elevation_range, inertial_to_fixed, line_of_sight, off_axis_angle, propagate_j2


def propagate(elements: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """object_id, t, and inertial x, y, z (km) of every object at every t (seconds since 1970) from ``start`` to ``end``.

    ``elements``: object_id, epoch (seconds since 1970), a, e, inclination, node, perigee, mean.
    Each object makes its own times, so nothing is joined.
    """
    rows = elements.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))).withColumn("t", F.col("t").cast("double"))
    x, y, z = propagate_j2(*(F.col(c) for c in ("a", "e", "inclination", "node", "perigee", "mean")), F.col("t") - F.col("epoch"))
    return rows.select("object_id", "t", x.alias("x"), y.alias("y"), z.alias("z"))


def to_fixed(ephemeris: DataFrame) -> DataFrame:
    """The ephemeris in the Earth-fixed frame."""
    x, y, z = inertial_to_fixed(F.col("x"), F.col("y"), F.col("z"), F.col("t"))
    return ephemeris.withColumns({"x": x, "y": y, "z": z})


def samples_to_intervals(samples: DataFrame, keys: list[str], t: str, inside, step: int) -> DataFrame:
    """``keys``, t0 and t1: stretches of consecutive samples, ``step`` apart, at which ``inside`` holds.

    Gaps and islands: within a stretch t - step * row number is constant. The ends are known to a step.
    """
    hit = samples.filter(inside).select(*keys, F.col(t).alias("t")).distinct()
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    return hit.withColumn("sk_run", F.col("t") - row * step).groupBy(*keys, "sk_run").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).drop("sk_run")


def target_samples(satellites: DataFrame, targets: DataFrame, most_km: float = 4500.0) -> DataFrame:
    """sat, target, t, azimuth, elevation, range_km and off_nadir of every satellite and target at most ``most_km`` apart at t.

    ``satellites``: object_id, t and Earth-fixed x, y, z in km. ``targets``: target, lat, lon, x, y, z (km).
    Space is cut into cubes of ``most_km``; a target is looked for in its own and the 26 around it,
    so that only places near each other meet, by an equi-join on the cube.
    """
    cube = lambda axis: F.floor(F.col(axis) / most_km).cast("long")
    moving = satellites.select(F.col("object_id").alias("sat"), "t", *(F.col(a).alias(f"s{a}") for a in "xyz"), *(cube(a).alias(f"c{a}") for a in "xyz"))
    around = targets.select("target", "lat", "lon", *(F.col(a).alias(f"g{a}") for a in "xyz"), *(cube(a).alias(f"c{a}") for a in "xyz"))
    for a in "xyz":
        around = around.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"c{a}") - 1, F.col(f"c{a}") + 1)))
    pairs = moving.join(around, [f"c{a}" for a in "xyz"])
    sat, site = (tuple(F.col(f"{p}{a}") for a in "xyz") for p in "sg")
    azimuth, elevation, reach = azimuth_elevation_range(F.col("lat"), F.col("lon"), site, sat)
    down, view = tuple(-c for c in sat), tuple(g - s for g, s in zip(site, sat, strict=True))
    rows = pairs.select(
        "sat", "target", "t", azimuth.alias("azimuth"), elevation.alias("elevation"), reach.alias("range_km"), off_axis_angle(down, view).alias("off_nadir")
    )
    return rows.filter(F.col("range_km") <= most_km)


def sensor_access(samples: DataFrame, step: int, most_km: float = 4500.0, cone: tuple[float, float] = (0.0, 90.0), least_elevation: float = 0.0) -> DataFrame:
    """sat, target, t0, t1: when a target is in range, above the horizon and between the cone's inner and outer half angle."""
    inside = (F.col("range_km") <= most_km) & F.col("off_nadir").between(*cone) & (F.col("elevation") >= least_elevation)
    return samples_to_intervals(samples, ["sat", "target"], "t", inside, step)


def access_details(intervals: DataFrame, samples: DataFrame, factor: float) -> DataFrame:
    """sat, target, t0, t1, max_elevation, min_range and gsd of every interval, from the samples inside it.

    Samples are matched to intervals by satellite and target, and a sample lies in one interval at most.
    """
    inside = intervals.join(samples, ["sat", "target"]).filter(F.col("t").between(F.col("t0"), F.col("t1")))
    found = inside.groupBy("sat", "target", "t0", "t1").agg(F.max("elevation").alias("max_elevation"), F.min("range_km").alias("min_range"))
    return found.withColumn("gsd", ground_sample_distance(factor, F.col("min_range"), F.col("max_elevation")))


def mutual_access(ephemeris: DataFrame, step: int) -> DataFrame:
    """a, b, t0, t1 with a < b: when two satellites see each other past the Earth.

    All pairs of a moment are asked for; their number follows from the constellation, not from the length of the time.
    """
    one = ephemeris.select("t", F.col("object_id").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    two = ephemeris.select("t", F.col("object_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    seen = line_of_sight(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz"))
    return samples_to_intervals(one.join(two, "t").filter("a < b"), ["a", "b"], "t", seen, step)


def equator_crossings(ephemeris: DataFrame, descending: bool = True) -> DataFrame:
    """object_id, t and lon of the crossings of the equator, by the straight line between the two samples around each.

    ``ephemeris`` is Earth-fixed.
    """
    order = Window.partitionBy("object_id").orderBy("t")
    rows = ephemeris.withColumns({f"p{c}": F.lag(c).over(order) for c in ("t", "x", "y", "z")})
    down = (F.col("pz") > 0) & (F.col("z") <= 0)
    crossed = rows.filter(down if descending else (F.col("pz") < 0) & (F.col("z") >= 0)).withColumn("k", F.col("pz") / (F.col("pz") - F.col("z")))
    at = lambda c: F.col(f"p{c}") + F.col("k") * (F.col(c) - F.col(f"p{c}"))
    return crossed.select("object_id", at("t").alias("t"), F.degrees(F.atan2(at("y"), at("x"))).alias("lon"))


def latitude_extremes(ephemeris: DataFrame) -> DataFrame:
    """object_id, least and most geocentric latitude."""
    lat = F.degrees(F.asin(F.col("z") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))))
    return ephemeris.groupBy("object_id").agg(F.min(lat).alias("least_lat"), F.max(lat).alias("most_lat"))
