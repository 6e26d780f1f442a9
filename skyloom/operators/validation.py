"""Checks of groupings of satellites against the snapshots they were made for.

A grouping belongs to one record and its size to the snapshot's, so every check is an expression
over the record's own arrays: nothing is shuffled, and a broken record costs no other its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.texts import CLUSTERS

SNAPSHOT = (
    "struct<timestamp: string, strategy: string, sat_attrs: array<struct<id: int, health: double, pos: array<double>>>, "
    "sat_edges: array<struct<`from`: int, `to`: int, w: double>>, target_edges: array<struct<`from`: int, `to`: int, q: double>>>"
)


def _list(column: Column) -> Column:
    """The elements that aren't null; an empty array for null."""
    return F.coalesce(F.filter(column, lambda e: e.isNotNull()), F.filter(column, lambda e: F.lit(False)), F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_pairs(rows: DataFrame, key: str, given: str, result: str) -> DataFrame:
    """key, sats, targets, edges and clusters of JSON snapshots and JSON results, paired by record and not by place.

    clusters is null where the result isn't a JSON array of objects with a list of satellites each.
    """
    snapshot = F.from_json(F.col(given), SNAPSHOT)
    value = F.from_json(F.col(result), CLUSTERS)
    sound = F.try_parse_json(F.col(result)).isNotNull() & F.trim(F.col(result)).startswith("[") & F.forall(value, lambda c: c["sats"].isNotNull() & c["targets"].isNotNull())
    return rows.select(F.col(key), snapshot.alias("s"), F.when(sound, value).alias("clusters")).select(
        key, F.col("s.sat_attrs.id").alias("sats"), F.col("s.target_edges.to").alias("targets"), F.col("s.sat_edges").alias("edges"), "clusters"
    )


def set_checks(rows: DataFrame, given: Column, used: Column, prefix: str, digits: int | None) -> DataFrame:
    """``rows`` with missing, extra and rate of the used elements, under ``prefix``.

    The rate's numerator counts extra elements too, so that it may exceed 1; without given elements it is 0.
    """
    before, after = F.array_distinct(_list(given)), F.array_distinct(_list(used))
    rate = F.when(F.size(before) == 0, 0.0).otherwise(F.size(after) / F.size(before))
    return rows.withColumns(
        {
            f"{prefix}_missing": F.array_sort(F.array_except(before, after)),
            f"{prefix}_extra": F.array_sort(F.array_except(after, before)),
            f"{prefix}_rate": rate if digits is None else F.round(rate, digits),
        }
    )


def duplicate_members(clusters: Column) -> Column:
    """An array of node and groups: nodes that stand in more than one group or more than once in one, with the numbers
    (from 0) of those groups in order, one for each time."""
    placed = F.flatten(F.transform(clusters, lambda c, i: F.transform(_list(c["sats"]), lambda s: F.struct(s.alias("node"), i.alias("place")))))

    def listed(rows: Column) -> Column:
        nodes = F.array_sort(F.array_distinct(F.transform(rows, lambda p: p["node"])))
        each = F.transform(nodes, lambda n: F.struct(n.alias("node"), F.transform(F.filter(rows, lambda p: p["node"] == n), lambda p: p["place"]).alias("groups")))
        return F.filter(each, lambda d: F.size(d["groups"]) > 1)

    return _let(placed, listed)


def group_links(clusters: Column, edges: Column) -> Column:
    """An array of a, b and strength: the summed weights of the edges between every two groups that have any.

    A node in several groups belongs to the last. Sums are decimal, so that the order of edges doesn't matter.
    """
    placed = F.flatten(F.transform(clusters, lambda c, i: F.transform(_list(c["sats"]), lambda s: F.struct(s.alias("node"), i.alias("place")))))

    def last_places(rows: Column) -> Column:
        nodes = F.array_distinct(F.transform(rows, lambda p: p["node"]))
        return F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.array_max(F.transform(F.filter(rows, lambda p: p["node"] == n), lambda p: p["place"]))))

    def crossing(places: Column) -> Column:
        at = lambda node: F.try_element_at(places, F.coalesce(node, F.lit(-1)))
        ends = F.transform(edges, lambda e: F.struct(at(e["from"]).alias("x"), at(e["to"]).alias("y"), e["w"].cast("decimal(10,4)").alias("w")))
        kept = F.filter(ends, lambda e: (e["x"] != e["y"]) & e["w"].isNotNull())
        return F.transform(kept, lambda e: F.struct(F.least(e["x"], e["y"]).alias("a"), F.greatest(e["x"], e["y"]).alias("b"), e["w"].alias("w")))

    def summed(across: Column) -> Column:
        pairs = F.array_sort(F.array_distinct(F.transform(across, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))))
        total = lambda p: F.aggregate(
            F.filter(across, lambda e: (e["a"] == p["a"]) & (e["b"] == p["b"])), F.lit(0).cast("decimal(20,4)"), lambda t, e: (t + e["w"]).cast("decimal(20,4)")
        )
        return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), total(p).alias("strength")))

    return _let(placed, lambda rows: _let(last_places(rows), lambda places: _let(crossing(places), summed)))


def validation_report(pairs: DataFrame, key: str, least_link: float = 0.7) -> DataFrame:
    """One report a record of ``read_pairs``: key, is_valid, target_missing, target_extra, target_rate (two places),
    duplicates, sat_missing, sat_extra, sat_rate, merge (pairs of groups with links above ``least_link``), errors and warnings.

    A record is invalid where targets are missing or extra, satellites are unknown or used twice,
    or its result couldn't be read; groups that could be merged and unused satellites are
    warnings. A bogus master isn't looked at. Null arrays count as empty.
    """
    flat = lambda field: F.flatten(F.transform(F.coalesce("clusters", F.array().cast(CLUSTERS)), lambda c: _list(c[field])))
    rows = set_checks(pairs, F.col("targets"), flat("targets"), "target", 2)
    rows = set_checks(rows, F.col("sats"), flat("sats"), "sat", None)
    rows = rows.withColumns(
        {
            "duplicates": duplicate_members(F.coalesce("clusters", F.array().cast(CLUSTERS))),
            "links": group_links(F.coalesce("clusters", F.array().cast(CLUSTERS)), F.coalesce("edges", F.array().cast("array<struct<`from`: int, `to`: int, w: double>>"))),
        }
    )
    merge = F.filter("links", lambda p: p["strength"] > F.lit(least_link).cast("decimal(10,4)"))
    told = lambda names: F.filter(F.array(*(F.when(c, n) for n, c in names)), lambda n: n.isNotNull())
    errors = told(
        [
            ("unreadable", F.col("clusters").isNull()), ("missing targets", F.size("target_missing") > 0), ("extra targets", F.size("target_extra") > 0),
            ("unknown satellites", F.size("sat_extra") > 0),
        ]
    )
    warnings = told([("repeated satellites", F.size("duplicates") > 0), ("unused satellites", F.size("sat_missing") > 0), ("groups to merge", F.size("merge") > 0)])
    out = rows.withColumn("merge", merge).withColumns({"errors": errors, "warnings": warnings})
    valid = (F.size("errors") == 0) & (F.size("duplicates") == 0)
    return out.select(
        key, valid.alias("is_valid"), "target_missing", "target_extra", "target_rate", "duplicates", "sat_missing", "sat_extra", "sat_rate", "merge", "errors", "warnings"
    )


def constraint_rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the others with broken, the names of the rules they break; null breaks a rule."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda n: n.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
