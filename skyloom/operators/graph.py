"""Reach and components of undirected graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.session import materialize


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns a and b: every edge in both directions, once; edges without an end are dropped."""
    there = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hops(edges: DataFrame, a: str, b: str, start: int, most: int) -> DataFrame:
    """Columns node and hop: the nodes at most ``most`` edges from ``start`` and their distance; the start has 0."""
    links = both_ways(edges, a, b)
    reached = links.sparkSession.range(1).select(F.lit(start).cast(links.schema["a"].dataType).alias("node"), F.lit(0).cast("long").alias("hop"))
    for hop in range(1, most + 1):
        ring = links.join(reached.filter(F.col("hop") == hop - 1).select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        fresh = ring.distinct().join(reached, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        reached = reached.unionByName(fresh)
    return reached


def components(nodes: DataFrame, key: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``key`` and component, the least key of those it is joined with; a node without edges is its own.

    Every round takes the least label around a node, and then the label of that label; rounds
    go on until none changes.
    """
    links = materialize(both_ways(edges, a, b), "links")
    labels = materialize(nodes.select(F.col(key).alias("node"), F.col(key).alias("label")).dropna().distinct(), "labels")
    while True:
        around = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        following = materialize(least.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = following.filter("label <> old").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels.select(F.col("node").alias(key), F.col("label").alias("component"))


def undirected(edges: DataFrame, a: str, b: str, weight: str, order: str) -> DataFrame:
    """a < b and weight: parallel and reversed edges become one, the last by ``order`` (ties: the greatest weight); loops and null ends are dropped."""
    rows = edges.filter(F.col(a) != F.col(b))
    taken = rows.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(F.struct(order, weight))[weight].alias("weight"))
    return taken.select("a", "b", "weight")


def known_ends(edges: DataFrame, a: str, b: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends are among ``nodes``: the subgraph they induce."""
    for end in (a, b):
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return edges


def incident(edges: DataFrame, a: str, b: str, node) -> DataFrame:
    """The edges at a node."""
    return edges.filter((F.col(a) == node) | (F.col(b) == node))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and degree; a loop counts twice."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, source: str, item: str) -> DataFrame:
    """``source`` and items: the distinct ends of its edges in order. For graphs whose degrees are bounded, as an array is one value."""
    return edges.groupBy(source).agg(F.array_sort(F.collect_set(item)).alias("items"))


def inverse_weight(weight: Column) -> Column:
    """1 / (w + 0.000001), a length for layouts."""
    return 1 / (weight + 1e-6)


def spread(points: DataFrame, by: str) -> DataFrame:
    """``by``, the mean x, y, z of its points, and reach, the greatest distance from there.

    The means come first and are joined back, so that both steps are aggregations with partial results.
    """
    centre = points.groupBy(F.col(by).alias("sk_by")).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    joined = points.join(centre, F.col(by).eqNullSafe(F.col("sk_by")))
    far = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))
    return joined.groupBy(by).agg(*(F.first(f"m{c}").alias(f"m{c}") for c in "xyz"), F.max(F.sqrt(far)).alias("reach"))


def principal_plane(points: DataFrame, key: str) -> DataFrame:
    """``key``, u, v: points in the plane of their two largest principal components; the signs of u and v are free."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    sound = points.dropna(subset=["x", "y", "z"])
    mean = sound.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    centred = sound.crossJoin(F.broadcast(mean)).select(key, *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))  # mean is one row
    vectors = VectorAssembler(inputCols=["x", "y", "z"], outputCol="sk_v").transform(centred)
    plane = vector_to_array(F.col("sk_p"))
    return PCA(k=2, inputCol="sk_v", outputCol="sk_p").fit(vectors).transform(vectors).select(key, plane[0].alias("u"), plane[1].alias("v"))


def hops_to_master(edges: DataFrame, a: str, b: str, members: DataFrame, most: int) -> DataFrame:
    """group, node and hop: the distance of each member to its group's master along edges inside the group, null beyond ``most``.

    ``members``: group, node, master. Rounds are few and fixed; each is one equi-join.
    """
    links = both_ways(edges, a, b)
    inner = links.join(members.select("group", F.col("node").alias("a")), "a").join(members.select("group", F.col("node").alias("b")), ["group", "b"])
    inner = materialize(inner.select("group", "a", "b"), "inner")
    reached = members.filter("node = master").select("group", "node", F.lit(0).cast("long").alias("hop")).distinct()
    for hop in range(1, most + 1):
        ring = inner.join(reached.filter(F.col("hop") == hop - 1).select("group", F.col("node").alias("a")), ["group", "a"]).select("group", F.col("b").alias("node")).distinct()
        fresh = ring.join(reached, ["group", "node"], "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        reached = reached.unionByName(fresh)
    return members.select("group", "node").distinct().join(reached, ["group", "node"], "left")


def merge_groups(members: DataFrame, edges: DataFrame, a: str, b: str, weight: str, least: float = 0.7) -> DataFrame:
    """node and group: groups joined as long as an edge of at least ``least`` runs between them; a group is named by its least member group.

    Merging while any such edge is left is the same as taking connected components of the groups.
    ``members``: group, node.
    """
    strong = edges.filter(F.col(weight) >= least)
    x, y = members.select(F.col("node").alias(a), F.col("group").alias("x")), members.select(F.col("node").alias(b), F.col("group").alias("y"))
    crossing = strong.join(x, a).join(y, b).filter("x <> y").select("x", "y").distinct()
    names = components(members.select("group").distinct(), "group", crossing, "x", "y")
    return members.join(names, "group").select("node", F.col("component").alias("group")).distinct()


def choose_masters(members: DataFrame, nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """group and master: the healthiest member, then the one with most edges, then the least number. ``nodes``: node, health."""
    ranked = members.join(nodes.select("node", "health"), "node", "left").join(degrees(edges, a, b), "node", "left")
    order = F.struct(F.coalesce("health", F.lit(-1.0)).alias("h"), F.coalesce("degree", F.lit(0)).cast("long").alias("d"), (-F.col("node")).alias("k"))
    return ranked.groupBy("group").agg(F.max_by("node", order).alias("master"))


#: Parts of the score of a grouping (fixed values).
SCORE_WEIGHTS = {"link": 0.4, "quality": 0.3, "groups": 0.2, "health": 0.1}


def grouping_scores(members: DataFrame, masters: DataFrame, nodes: DataFrame, sat_edges: DataFrame, target_edges: DataFrame, most_per_target: int = 1) -> DataFrame:
    """One row: link (mean weight of edges inside groups), quality (mean best q of the targets), groups (groups a satellite,
    to be low), health (mean of the masters), oversized (groups with more satellites than ``most_per_target`` times their
    targets), and score, their weighted sum with groups negative.

    ``members``: group, node; ``masters``: group, master; ``nodes``: node, health; ``sat_edges``:
    a, b, w; ``target_edges``: node, target, q. The weights are given, how parts are scaled to 0…1 is this library's choice.
    """
    inside = sat_edges.join(members.select(F.col("node").alias("a"), F.col("group").alias("x")), "a").join(members.select(F.col("node").alias("b"), F.col("group").alias("y")), "b").filter("x = y")
    link = inside.agg(F.coalesce(F.avg("w"), F.lit(0.0)).alias("link"))
    best = target_edges.groupBy("target").agg(F.max_by(F.struct("node", "q"), F.struct("q", (-F.col("node")).alias("k"))).alias("e")).select("target", "e.node", "e.q")
    quality = best.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("quality"))
    groups = members.agg(F.coalesce(F.count_distinct("group") / F.nullif(F.count_distinct("node"), F.lit(0)), F.lit(0.0)).alias("groups"))
    health = masters.join(nodes, F.col("master") == F.col("node"), "left").agg(F.coalesce(F.avg("health"), F.lit(0.0)).alias("health"))
    served = best.join(members, "node").groupBy("group").agg(F.count_distinct("target").alias("targets"))
    sizes = members.groupBy("group").agg(F.count_distinct("node").alias("sats")).join(served, "group", "left")
    over = sizes.agg(F.count_if(F.col("sats") > most_per_target * F.coalesce("targets", F.lit(0))).alias("oversized"))
    row = link.crossJoin(quality).crossJoin(groups).crossJoin(health).crossJoin(over)  # one row each
    w = SCORE_WEIGHTS
    score = w["link"] * F.col("link") + w["quality"] * F.col("quality") - w["groups"] * F.col("groups") + w["health"] * F.col("health")
    return row.withColumn("score", score)


def radial_places(nodes: DataFrame, order: str, radius: float = 1.0) -> DataFrame:
    """``nodes`` with x and y on a circle, evenly, in order."""
    from skyloom.operators.visibility import numbered

    placed = numbered(nodes, [order], "sk_no", 0).crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("sk_n"))))
    angle = 2 * 3.141592653589793 * F.col("sk_no") / F.col("sk_n")
    return placed.withColumns({"x": radius * F.cos(angle), "y": radius * F.sin(angle)}).drop("sk_no", "sk_n")
