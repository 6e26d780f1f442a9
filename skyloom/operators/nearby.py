"""Near pairs and containment by a dual-tree join on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geodesy import chord, unit_vector, wrapped_longitude
from skyloom.session import materialize

_AXES = ("x", "y", "z")
_BITS = 20
_MASK = (1 << _BITS) - 1


def _above(code: Column, by: Column) -> Column:
    """The code of the cell ``by`` levels up; a code packs the cell's three numbers."""
    up = lambda v: F.call_function("shiftright", v, by)
    x, y, z = F.shiftright(code, 2 * _BITS), F.shiftright(code, _BITS).bitwiseAND(_MASK), code.bitwiseAND(_MASK)
    return F.shiftleft(up(x), 2 * _BITS).bitwiseOR(F.shiftleft(up(y), _BITS)).bitwiseOR(up(z))


class SphereTree:
    """An octree over points on the unit sphere whose nodes keep the bounding box of their points.

    ``points`` needs side (int), id (bigint), lon and lat (degrees, valid). A node is split while
    it holds more than ``leaf_size`` points, down to the last level, whose cells are about as
    large as ``radius_km``: below that, all points of a cell are near each other or to be measured
    anyway. A leaf there may hold any number of points; it is worked in chunks of ``chunk_size``,
    so that a crowded place is many small joins.

    Only narrow rows are spread over the levels: counts of cells, to find the nodes to split. The
    points get their leaf by one join on their cell, and the boxes of inner nodes come from those
    of the leaves.
    """

    def __init__(self, points: DataFrame, radius_km: float = 2.0, leaf_size: int = 24, first_level: int = 3, chunk_size: int = 256) -> None:
        deepest = max(first_level + 1, min(_BITS, math.floor(math.log2(2 / max(chord(radius_km), 1e-9)))))
        # every second level: half the rounds of the descent, for nodes of up to sixteen children on a surface
        self.levels = [0, *sorted(range(deepest, first_level - 1, -2))]
        lon = wrapped_longitude(F.col("lon"))
        x, y, z = unit_vector(F.col("lon"), F.col("lat"))
        cell = lambda v: F.greatest(F.least(F.floor((v + 1) / 2 * (1 << deepest)), F.lit((1 << deepest) - 1)), F.lit(0)).cast("long")
        code = F.shiftleft(cell(F.col("x")), 2 * _BITS).bitwiseOR(F.shiftleft(cell(F.col("y")), _BITS)).bitwiseOR(cell(F.col("z")))
        placed = materialize(
            points.select("side", "id", lon.alias("lon"), "lat", x.alias("x"), y.alias("y"), z.alias("z")).distinct().withColumn("cell", code), "placed"
        )
        cells = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
        inner = F.array(*(F.struct(F.lit(k).alias("level"), _above(F.col("cell"), F.lit(deepest - k)).alias("code")) for k in self.levels[:-1]))
        spread = cells.select("cell", "n", F.explode(inner).alias("c")).select("cell", "n", "c.level", "c.code")
        split = materialize(spread.groupBy("level", "code").agg(F.sum("n").alias("n")).filter(F.col("n") > leaf_size).select("level", "code"), "split")
        # split nodes have split parents, so a cell's leaf is one step below its deepest split node
        below = spread.join(split, ["level", "code"], "left_semi").groupBy("cell").agg(F.max("level").alias("parent"))
        step = dict(zip(self.levels, self.levels[1:], strict=False))
        next_level = F.element_at(F.create_map(*(F.lit(v) for pair in step.items() for v in pair)), F.col("parent"))
        following = F.when(F.col("parent").isNull(), 0).otherwise(next_level)
        leaf_of = cells.join(below, "cell", "left").select("cell", "n", following.cast("int").alias("level"))
        leaf_of = leaf_of.withColumn("code", F.when(F.col("level") == 0, 0).otherwise(_above(F.col("cell"), deepest - F.col("level"))).cast("long"))
        # only leaves of the last level, which are single cells, are crowded
        chunks = F.when(F.col("level") == deepest, F.ceil(F.col("n") / chunk_size)).otherwise(1).cast("int")
        located = placed.join(leaf_of.withColumn("chunks", chunks).drop("n"), "cell").drop("cell")
        self.points = materialize(located.withColumn("chunk", F.pmod(F.xxhash64("side", "id", "x", "y", "z"), F.col("chunks")).cast("int")), "points")

        ends = [(n, f, c) for c in (*_AXES, "lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))]
        leaves = self.points.groupBy("level", "code").agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.max("chunks").alias("chunks"), *(f(c).alias(f"{n}_{c}") for n, f, c in ends)
        )
        leaves = materialize(leaves, "leaves")
        over = F.filter(F.array(*map(F.lit, self.levels)), lambda k: k < F.col("level"))
        boxes = leaves.withColumn("up", F.explode(over)).withColumn("code", F.when(F.col("up") == 0, 0).otherwise(_above(F.col("code"), F.col("level") - F.col("up"))).cast("long"))
        inner_nodes = boxes.groupBy(F.col("up").alias("level"), "code").agg(
            F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.lit(1).alias("chunks"), *(f(f"{n}_{c}").alias(f"{n}_{c}") for n, f, c in ends)
        )
        nodes = leaves.withColumn("leaf", F.lit(True)).unionByName(inner_nodes.withColumn("leaf", F.lit(False)))
        top = F.col("level") == self.levels[1]
        parent = F.when(top, 0).otherwise(F.col("level") - 2)
        up_code = F.when(top, 0).otherwise(_above(F.col("code"), F.lit(2))).cast("long")
        self.nodes = materialize(nodes.withColumns({"up_level": F.when(F.col("level") > 0, parent), "up_code": F.when(F.col("level") > 0, up_code)}), "nodes")

    def children(self, prefix: str) -> DataFrame:
        """Every node under its parent; a leaf also under itself, so that it stays while others are split."""
        down = self.nodes.filter("level > 0").withColumns({"p_level": F.col("up_level"), "p_code": F.col("up_code")})
        stay = self.nodes.filter("leaf").withColumns({"p_level": F.col("level"), "p_code": F.col("code")})
        both = down.unionByName(stay).drop("up_level", "up_code")
        return both.select(*(F.col(c).alias(f"{prefix}_{c}") for c in both.columns))


def _gap2() -> Column:
    """The least squared distance of two boxes."""
    apart = [F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")) for c in _AXES]
    return sum((d * d for d in apart[1:]), apart[0] * apart[0])


def _reach2() -> Column:
    """The greatest squared distance of two boxes."""
    far = [F.greatest(F.abs(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}")), F.abs(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))) for c in _AXES]
    return sum((d * d for d in far[1:]), far[0] * far[0])


def _descend(frontier: DataFrame, step, label: str) -> list[DataFrame]:
    """Apply ``step`` to undecided rows until none is left; the finished rows of all rounds."""
    done = []
    while True:
        table = materialize(step(frontier), label)
        done.append(table.filter("done"))
        frontier = table.filter("not done").drop("done")
        if frontier.isEmpty():
            return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_pairs(tree: SphereTree, radius_km: float) -> DataFrame:
    """Pairs of points at most ``radius_km`` apart: a_side, a_id, b_side, b_id.

    At least one of the two has side 0. Pairs have (a_side, a_id) < (b_side, b_id) and come once;
    a point isn't paired with others of its own side and id.

    Pairs of nodes are worked level by level, from (root, root). Both are replaced by their
    children; a pair whose boxes are farther apart than the radius is discarded, one whose boxes
    lie wholly within it is accepted and goes down unmeasured, any other is refined. Pairs of
    leaves are joined with their points, and only the points of unsure pairs are measured. Every
    step is an equi-join on node keys, so the work spreads over all tasks.

    An empty tree gives no pairs. The result grows with the number of near pairs: n points in one
    place are n(n-1)/2 rows.
    """
    limit = chord(radius_km) ** 2
    spark = tree.nodes.sparkSession
    a_kids, b_kids = tree.children("a"), tree.children("b")
    if tree.nodes.isEmpty():
        return spark.createDataFrame([], "a_side int, a_id bigint, b_side int, b_id bigint")

    def step(pairs: DataFrame) -> DataFrame:
        same = (F.col("al") == F.col("bl")) & (F.col("ac") == F.col("bc"))
        wide = (
            pairs.join(a_kids, (F.col("al") == F.col("a_p_level")) & (F.col("ac") == F.col("a_p_code")))
            .join(b_kids, (F.col("bl") == F.col("b_p_level")) & (F.col("bc") == F.col("b_p_code")))
            .filter(~same | (F.col("a_code") <= F.col("b_code")))
            .filter(F.col("a_n0") + F.col("b_n0") > 0)
        )
        return wide.filter(F.col("sure") | (_gap2() <= limit)).select(
            F.col("a_level").alias("al"),
            F.col("a_code").alias("ac"),
            F.col("b_level").alias("bl"),
            F.col("b_code").alias("bc"),
            (F.col("sure") | (_reach2() <= limit)).alias("sure"),
            (F.col("a_leaf") & F.col("b_leaf")).alias("done"),
            F.col("a_chunks").alias("ak"),
            F.col("b_chunks").alias("bk"),
        )

    root = spark.createDataFrame([(0, 0, 0, 0, False)], "al int, ac bigint, bl int, bc bigint, sure boolean")
    leaves = _union(_descend(root, step, "pairs"))
    same_leaf = (F.col("al") == F.col("bl")) & (F.col("ac") == F.col("bc"))
    # of a leaf's pairs of chunks with itself, each is taken once
    leaves = leaves.withColumn("ah", F.explode(F.sequence(F.lit(0), F.col("ak") - 1))).withColumn("bh", F.explode(F.sequence(F.lit(0), F.col("bk") - 1)))
    leaves = leaves.filter(~same_leaf | (F.col("ah") <= F.col("bh")))
    a, b = (
        tree.points.select(*(F.col(c).alias(f"{p}_{c}") for c in ("side", "id", "level", "code", "chunk", *_AXES))) for p in "ab"
    )
    apart = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in _AXES]
    measured = sum((d * d for d in apart[1:]), apart[0] * apart[0])
    first = (F.col("a_side") < F.col("b_side")) | ((F.col("a_side") == F.col("b_side")) & (F.col("a_id") < F.col("b_id")))
    other = (F.col("a_side") != F.col("b_side")) | (F.col("a_id") != F.col("b_id"))
    same_chunk = same_leaf & (F.col("ah") == F.col("bh"))
    found = (
        leaves.join(a, (F.col("al") == F.col("a_level")) & (F.col("ac") == F.col("a_code")) & (F.col("ah") == F.col("a_chunk")))
        .join(b, (F.col("bl") == F.col("b_level")) & (F.col("bc") == F.col("b_code")) & (F.col("bh") == F.col("b_chunk")))
        .filter((F.col("a_side") == 0) | (F.col("b_side") == 0))
        .filter(other & (~same_chunk | first))
        .filter(F.col("sure") | (measured <= limit))
    )
    low, high = (F.when(first if up else ~first, F.struct(*(F.col(f"a_{c}").alias(c) for c in ("side", "id")))).otherwise(
        F.struct(*(F.col(f"b_{c}").alias(c) for c in ("side", "id")))) for up in (True, False))
    return (
        found.select(low.alias("low"), high.alias("high"))
        .select(
            F.col("low.side").alias("a_side"), F.col("low.id").alias("a_id"),
            F.col("high.side").alias("b_side"), F.col("high.id").alias("b_id"),
        )
        .distinct()
    )


def _in_polygon(lon: Column, lat: Column) -> Column:
    """Whether the place lies inside the polygon of the column ``edges`` (crossing number)."""

    def crossing(inside: Column, e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        left = lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when(spans & left, ~inside).otherwise(inside)

    return F.aggregate(F.col("edges"), F.lit(False), crossing)


def region_edges(regions: DataFrame, key: str, lons: str, lats: str) -> DataFrame:
    """Columns region, turn and edges (straight in degrees); a ring is taken at every full turn at which
    it reaches -180...180. Rings that are null, unequal in length, hold nulls or have fewer than three
    corners are no regions."""
    lon, lat = F.col(f"`{lons}`"), F.col(f"`{lats}`")
    sound = (F.size(lon) == F.size(lat)) & (F.size(lon) >= 3) & ~F.exists(lon, F.isnull) & ~F.exists(lat, F.isnull)
    turned = regions.filter(sound).select(
        F.col(f"`{key}`").alias("region"), lon.alias("lons"), lat.alias("lats"), F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).alias("turn")
    )
    at = lambda c, i: F.element_at(c, i + 1)
    n = F.size("lons")
    edge = lambda i: F.struct(
        (at("lons", i) + F.col("turn")).alias("x1"), at("lats", i).alias("y1"),
        (at("lons", (i + 1) % n) + F.col("turn")).alias("x2"), at("lats", (i + 1) % n).alias("y2"),
    )
    return (
        turned.filter((F.array_max("lons") + F.col("turn") >= -180) & (F.array_min("lons") + F.col("turn") <= 180))
        .withColumn("edges", F.transform(F.sequence(F.lit(0), n - 1), edge))
        .select("region", "turn", "edges")
    )


def contained(tree: SphereTree, edges: DataFrame) -> DataFrame:
    """Columns region, id: every point of side 0 inside a region of ``region_edges``.

    The tree's nodes are worked from the root against each region: a node whose box no edge's box
    meets lies wholly inside (accepted unmeasured) or outside (discarded); any other node is
    split, and the points of unsure leaves are tested by crossing number. A place in several
    regions comes once for each. No regions or no points give no rows.
    """
    kids = tree.children("n")

    def step(pairs: DataFrame) -> DataFrame:
        wide = (
            pairs.join(kids, (F.col("level") == F.col("n_p_level")) & (F.col("code") == F.col("n_p_code")))
            .filter(F.col("n_n0") > 0)
            .join(edges, ["region", "turn"])
        )
        meets = F.exists(
            "edges",
            lambda e: (F.greatest(e["x1"], e["x2"]) >= F.col("n_lo_lon"))
            & (F.least(e["x1"], e["x2"]) <= F.col("n_hi_lon"))
            & (F.greatest(e["y1"], e["y2"]) >= F.col("n_lo_lat"))
            & (F.least(e["y1"], e["y2"]) <= F.col("n_hi_lat")),
        )
        judged = wide.withColumn("meets", ~F.col("sure") & meets)
        return judged.filter(F.col("sure") | F.col("meets") | _in_polygon(F.col("n_lo_lon"), F.col("n_lo_lat"))).select(
            "region", "turn", F.col("n_level").alias("level"), F.col("n_code").alias("code"),
            (F.col("sure") | ~F.col("meets")).alias("sure"), F.col("n_leaf").alias("done"),
        )

    start = edges.select("region", "turn", F.lit(0).alias("level"), F.lit(0).cast("long").alias("code"), F.lit(False).alias("sure"))
    leaves = _union(_descend(start, step, "regions"))
    found = leaves.join(tree.points.filter("side = 0"), ["level", "code"])
    sure = found.filter("sure").select("region", "id")
    tested = found.filter("not sure").join(edges, ["region", "turn"]).filter(_in_polygon(F.col("lon"), F.col("lat")))
    return sure.unionByName(tested.select("region", "id")).distinct()


def valid_place(lon: Column, lat: Column) -> Column:
    """Both coordinates are there, on the globe (longitude -180...360) and not both exactly 0."""
    return lon.between(-180, 360) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
