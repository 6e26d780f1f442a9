"""Queries of the pipelines against DuckDB, and their operators on small cases."""

from __future__ import annotations

import json
import math
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geodesy, orbits, texts, times
from skyloom.operators import access, calls, catalog, graph, scenario, stats, validation, visibility
from skyloom.plans import pipelines
from skyloom.session import local_session
from skyloom.sources import readers, sinks
from skyloom.streaming import pipelines as streams

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 4)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(rows):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in rows)


def test_only_one_query_has_no_oracle():
    assert set(pipelines.QUERIES) - set(pipelines.ORACLE_SQL) == {"q_principal_plane"}


@pytest.mark.parametrize("name", sorted(pipelines.ORACLE_SQL))
def test_oracle(spark, tables, name):
    found = pipelines.QUERIES[name](spark, DATA)
    wanted = tables.sql(pipelines.ORACLE_SQL[name])
    order = [wanted.columns.index(c) for c in found.columns]
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows(found.collect()) == _rows([row[i] for i in order] for row in wanted.fetchall())


# ---- validation: a grouping with every fault, worked out by hand ---------------------------------
GIVEN = {
    "sat_attrs": [{"id": i} for i in (1, 2, 3, 4, 5)],
    "sat_edges": [{"from": 1, "to": 3, "w": 0.5}, {"from": 3, "to": 1, "w": 0.2}, {"from": 2, "to": 3, "w": 0.1}, {"from": 1, "to": 2, "w": 0.9}, {"from": 4, "to": 9, "w": 1.0}, {"from": 5, "to": 4, "w": None}],
    "target_edges": [{"from": 1, "to": t, "q": 0.5} for t in (10, 11, 12, 12)],
}
GROUPS = [{"cluster_id": 1, "master": 99, "sats": [1, 2, 2], "targets": [10, 77]}, {"cluster_id": 2, "master": 3, "sats": [3, 4, 8], "targets": [11]}, {"cluster_id": 3, "master": 4, "sats": [4], "targets": []}]


def _report(spark, given, result, **options):
    rows = spark.createDataFrame([(1, json.dumps(given) if given is not None else None, result)], "id long, u string, o string")
    return validation.validation_report(validation.read_pairs(rows, "id", "u", "o"), "id", **options).head()


def test_report_of_a_faulty_grouping(spark):
    r = _report(spark, GIVEN, json.dumps(GROUPS))
    assert not r["is_valid"] and r["target_missing"] == [12] and r["target_extra"] == [77] and r["target_rate"] == 1.0
    assert [(d["node"], d["groups"]) for d in r["duplicates"]] == [(2, [0, 0]), (4, [1, 2])]
    assert r["sat_missing"] == [5] and r["sat_extra"] == [8] and r["sat_rate"] == 1.0
    assert [(m["a"], m["b"], float(m["strength"])) for m in r["merge"]] == [(0, 1, 0.8)]
    assert r["errors"] == ["missing targets", "extra targets", "unknown satellites"] and r["warnings"] == ["repeated satellites", "unused satellites", "groups to merge"]


def test_a_strength_of_exactly_the_threshold_is_no_merge_and_order_doesnt_matter(spark):
    given = GIVEN | {"sat_edges": GIVEN["sat_edges"][:2]}
    assert _report(spark, given, json.dumps(GROUPS))["merge"] == [] and len(_report(spark, given, json.dumps(GROUPS), least_link=0.6999)["merge"]) == 1
    turned = GIVEN | {"sat_edges": GIVEN["sat_edges"][::-1]}
    assert _report(spark, turned, json.dumps(GROUPS))["merge"] == _report(spark, GIVEN, json.dumps(GROUPS))["merge"]


@pytest.mark.parametrize("result", [None, "", "not_a_list", '"not_a_list"', '{"clusters": "not_a_list"}', '[{"cluster_id": 1}]', '[{"cluster_id": 1, "sats": [1'])
def test_malformed_results_are_reports_too(spark, result):
    r = _report(spark, GIVEN, result)
    assert not r["is_valid"] and "unreadable" in r["errors"] and r["target_missing"] == [10, 11, 12]


def test_no_snapshot_and_an_empty_grouping(spark):
    assert _report(spark, None, "[]")["is_valid"] and _report(spark, {}, "[]")["target_rate"] == 0
    assert _report(spark, GIVEN, "[]")["errors"] == ["missing targets"]


# ---- outputs of a model -------------------------------------------------------------------------
OUTPUT = json.dumps({"chain_of_thought": "步骤一", "clusters": [{"cluster_id": 1, "master": 161, "sats": [161], "targets": [21]}]}, ensure_ascii=False)


@pytest.mark.parametrize(
    ("text", "read"),
    [
        (OUTPUT, True), (f"Here it is:\n```json\n{OUTPUT}\n```", True), (f"```json\n{OUTPUT}\n```\nDone.", True), (f"  {OUTPUT} ", True), (f"So: {OUTPUT}", True), ("", False), (None, False),
        (OUTPUT[:-5], False), ('{"chain_of_thought": "x"}', False), (OUTPUT[:-1] + ', "more": 1}', False), ("no json", False),
    ],
)
def test_parsed_outputs(spark, text, read):
    got = spark.createDataFrame([(text,)], "t string").select(texts.parsed_output(F.col("t")).alias("p")).head()["p"]
    assert (got is not None) == read and (not read or (got["chain_of_thought"], got["clusters"][0]["sats"]) == ("步骤一", [161]))


def test_text_expressions(spark):
    row = spark.createDataFrame([("a　 b\n\tc ", "<think>why\nso</think>\n[{\\\"cluster_id\\\":1}]", "A-B", "A-B-C", "卫星a")], "s string, a string, p string, q string, w string")
    got = row.select(
        texts.one_line(F.col("s")).alias("line"), texts.answer_parts(F.col("a"))[0].alias("why"), texts.answer_clusters(F.col("a")).alias("c"), texts.split_pair(F.col("p")).alias("p"), texts.split_pair(F.col("q")).alias("q"),
        texts.display_width(F.col("w")).alias("w"), texts.tagged(F.lit("x<t>1</t>y<t>2</t>"), "t").alias("t"), texts.with_summary(F.lit(""), F.lit("s")).alias("sum"), texts.think_json(F.lit("r"), F.array(F.lit(1))).alias("j"),
        texts.content_of(texts.chat_record(F.lit("s"), F.lit("u"), F.lit("a")), "user").alias("u"), texts.id_number(F.lit("Satellite12x"), "Satellite").alias("n"),
    ).head()
    assert (got["line"], got["why"], got["c"][0]["cluster_id"], tuple(got["p"]), got["q"], got["w"], got["t"], got["sum"], got["j"], got["u"], got["n"]) == (
        "a b c", "why\nso", 1, ("A", "B"), None, 5, "1\n2", "s", "<think>r</think>[1]", "u", None,
    )
    with pytest.raises(KeyError):
        texts.fill_template("{x}", {"y": F.lit(1)})
    with pytest.raises(ValueError):
        texts.TemplateRegistry().get("v9")


# ---- files --------------------------------------------------------------------------------------
def test_json_files_and_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "é"}, {"id": 2, "t": null}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"id": 3, "t": "x"}')
    (tmp_path / "c.jsonl").write_text('{"id": 4, "t": "y"}\n\n{"id": \n')
    schema = "id long, t string"
    assert readers.read_json_array(spark, f"{tmp_path}/a.json", schema).count() == 2 and readers.read_json_array(spark, f"{tmp_path}/b.json", schema).count() == 1
    rows = readers.read_records(spark, f"{tmp_path}/c.jsonl", schema).collect()
    assert sorted((r["id"] or 0, r["sk_corrupt"] is None) for r in rows) == [(0, False), (4, True)]
    with pytest.raises(ValueError):
        readers.read_records(spark, f"{tmp_path}/d.txt", schema)
    assert [r["line_no"] for r in readers.malformed_lines(spark, f"{tmp_path}/c.jsonl").collect()] == [3]
    out = sinks.json_to_lines(spark, f"{tmp_path}/a.json", schema)
    assert out.endswith("a.jsonl") and "é" in "".join(p.read_text(encoding="utf-8") for p in Path(out).glob("*.json"))
    good, bad = sinks.error_lines(spark.createDataFrame([('{"a": 1}',), ('ERROR: {"b": 2}',), (None,)], "value string"))
    assert good.count() == 2 and bad.head()["value"] == '{"b": 2}'
    assert sinks.json_array(spark.createDataFrame([(2, None), (1, "x")], schema), ["id"]).head()["value"] == '[{"id":1,"t":"x"},{"id":2,"t":null}]'


def test_sibling_prompts_and_interval_maps(spark, tmp_path):
    (tmp_path / "to_targets.csv").write_text("对,开始,结束,秒\nA-m1,6 Jul 2025 04:00:00.000,06 Jul 2025 04:00:10.500,10.5\n,x,y,1\nA-B-C,x,y,1\n", encoding="utf-8")
    rows = readers.read_intervals(spark, f"{tmp_path}/to_targets.csv").collect()
    assert [(r["src"], r["dst"], r["seconds"], (r["end_time"] - r["start_time"]).total_seconds()) for r in rows] == [("A", "m1", 10.5, 10.5)]
    missing = readers.read_sibling(spark, f"file://{tmp_path}/to_targets.csv", "to_targets", "mutual", readers.read_intervals, "src string, dst string")
    assert missing.collect() == []
    (tmp_path / "mutual.csv").write_text("h,h,h,h\nA-B,6 Jul 2025 04:00:00.000,6 Jul 2025 04:00:01.000,1\n")
    assert readers.read_sibling(spark, f"file://{tmp_path}/to_targets.csv", "to_targets", "mutual", readers.read_intervals, "src string").count() == 1
    (tmp_path / "p.md").write_text("== PROMPT 1 ==\n one \n== PROMPT 2 ==\ntwo\n==== PROMPT 3 ====\n  \n")
    assert [r["prompt"].strip() for r in readers.read_prompts(spark, f"{tmp_path}/p.md").orderBy("no").collect()] == ["one", "two", ""]
    interval = "struct<start_time: string, end_time: string, seconds: double>"
    maps = spark.createDataFrame([({"A-B": [("s", "e", 1.0), ("s2", "e2", 2.0)], "A-C": []},)], f"m map<string, array<{interval}>>")
    assert sorted(r["seconds"] for r in sinks.flatten_interval_map(maps, "m").collect()) == [1.0, 2.0]
    numbered = sinks.numbered_prompts(spark.createDataFrame([("b",), ("a",)], "t string"), ["t"], "t").orderBy("no").collect()
    assert [r["no"] for r in numbered] == [1, 2] and "PROMPT 1 =" in numbered[0]["value"] and numbered[0]["value"].endswith("a\n\n")


def test_resume_adds_each_record_once(spark, tmp_path):
    rows, path = spark.range(5).withColumnRenamed("id", "k"), f"file://{tmp_path}/out"
    made = lambda r: r.withColumn("v", F.col("k") * 2)
    sinks.resume(rows.filter("k < 3"), "k", path, made, "k long, v long")
    found = sinks.resume(rows, "k", path, made, "k long, v long")
    assert sorted(tuple(r) for r in found.collect()) == [(k, 2 * k) for k in range(5)]


def test_scenario_files(spark, tmp_path):
    (tmp_path / "Sat1.sa").write_text("version 11\nBEGIN Ephemeris\n NumberOfEphemerisPoints 2\n ScenarioEpoch 6 Jul 2025 04:00:00.0\n CoordinateSystem ICRF\n EphemerisTimePosVel\n\n0.0 1.0e+06 2 3 4 5 6\n60 7 8 9 1 2 3\n\nEND Ephemeris\n")
    rows = readers.read_ephemeris(spark, f"{tmp_path}/Sat1.sa").orderBy("t").collect()
    assert [(r["object_id"], r["frame"], r["t"], r["x"], r["vz"]) for r in rows] == [("Sat1", "ICRF", 0.0, 1e6, 6.0), ("Sat1", "ICRF", 60.0, 7.0, 3.0)]
    (tmp_path / "S1.sn").write_text("  InnerConeHalfAngle  5.7e+01\n OuterConeHalfAngle 75\n MaxRange 4500000.0\n")
    assert tuple(readers.read_sensors(spark, f"{tmp_path}/S1.sn").head()) == ("S1", 57.0, 75.0, 4_500_000.0)
    (tmp_path / "all.cn").write_text("BEGIN Members\n Object Satellite/A\n Object Satellite/B\nEND\n")
    assert [(r["no"], r["member"]) for r in readers.read_members(spark, f"{tmp_path}/all.cn", "Object").orderBy("no").collect()] == [(1, "Satellite/A"), (2, "Satellite/B")]


def test_synthetic_sources_follow_the_seed(spark):
    one, two = (readers.synthetic_snapshots(spark, 20, seed=s).orderBy("t").collect() for s in (7, 7))
    assert one == two and [r["t"] for r in one] == list(range(0, 200, 10))
    for r in one:
        ids = {s["id"] for s in r["sat_attrs"]}
        assert 10 <= len(r["sat_edges"]) <= 30 and 10 <= len(r["target_edges"]) <= 40 and {e["from_id"] for e in r["target_edges"]} <= ids
        assert all(0.2 <= e["w"] <= 1 and e["from_id"] != e["to_id"] for e in r["sat_edges"])
    targets = readers.synthetic_targets(spark, 50, [(30.0, 120.0)], [(10.0, 20.0), (40.0, 50.0)]).collect()
    assert len({r["name"] for r in targets}) == 50 and all(abs(r["lat"] - 30) <= 0.0501 and 0 <= r["epoch_second"] <= 300 for r in targets)


def test_objects_of_a_scenario(spark):
    sats = scenario.new_objects(spark, "Satellite", {"Sat1": {"h": 1}, "Sat11": {}})
    both = scenario.attach_to_all(sats, "Satellite", "Sensor", "S_", {"inner": 1})
    gone = scenario.delete_objects(both, spark.createDataFrame([("/Satellite/Sat1",), ("None",), (None,)], "path string"))
    assert sorted(r["path"] for r in gone.collect()) == ["/Satellite/Sat11", "/Satellite/Sat11/Sensor/S_Sat11"]
    assert scenario.add_objects(both, sats).count() == 4 and scenario.replace_kind(both, sats.limit(1), "Satellite").count() == 1
    changed = scenario.set_attributes(sats, "/Satellite/Sat1", {"h": 2}, ["h"]).filter("name = 'Sat1'").head()
    assert json.loads(changed["attributes"]) == {"h": "2"}
    with pytest.raises(ValueError):
        scenario.set_attributes(sats, "/Satellite/Sat1", {"x": 2}, ["h"])
    with pytest.raises(ValueError):
        scenario.TimeRange(datetime(2025, 1, 2), datetime(2025, 1, 1))
    paths = spark.createDataFrame([("/Scenario/a/Satellite/Sat1/Sensor/x",), ("/Scenario/a/Satellite/Sat1",)], "path string")
    assert [tuple(r)[:2] for r in readers.sensors_of(paths).collect()] == [("x", "Sat1")]


# ---- numbers ------------------------------------------------------------------------------------
def test_summaries_of_nothing_and_of_equal_values(spark):
    none = spark.createDataFrame([], "v double")
    assert tuple(stats.distribution(none, "v").head()) == (0, *[0.0] * 8)
    assert stats.histogram(none, "v").collect() == [] and stats.tally(none, F.col("v") > 0)["success_percent"] is not None
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in stats.histogram(same, "v", 5).collect()] == [(0, 2.0, 2.0, 2)]
    some = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "v double")
    assert {r["bin"]: r["n"] for r in stats.histogram(some, "v", 10).collect()} == {0: 1, 1: 1, 9: 1, **{b: 0 for b in range(2, 9)}}


def test_insert_or_ignore_puts_null_orders_last_and_stamps_are_optional(spark):
    table = spark.createDataFrame([(1, "a")], "id long, name string")
    batch = spark.createDataFrame([(2, "b", None), (2, "c", 5), (3, "d", None), (1, "z", 1), (None, "n", 1)], "id long, name string, seq long")
    assert sorted(tuple(r) for r in catalog.insert_or_ignore(table, batch, "id", "seq").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert catalog.update_where(table, F.col("id") == 1, {"name": "x"}, stamp=5).head()["name"] == "x"
    with pytest.raises(Exception, match="no entry for 3"):
        catalog.required_lookup(batch.filter("id = 3"), table, "id").collect()


def test_weights_first_rows_and_arg_max(spark):
    edges = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 4.0, 2), (1, "b", 9.0, 3), (1, "c", 0.0, 4), (2, "d", None, 5), (None, "e", 3.0, 6)], "t long, e string, d double, seq long")
    once = visibility.first_per_key(edges, ["t", "e"], "seq")
    found = {(r["t"], r["e"]): r["w"] for r in visibility.relative_weights(once, "t", "d").collect()}
    assert found == {(1, "a"): 1.0, (1, "b"): 0.5, (1, "c"): None, (2, "d"): None, (None, "e"): 1.0}
    best = visibility.argmax_per_key(spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 6, None), (2, 7, None)], "k long, i long, v double"), "k", "v", "i")
    assert sorted(tuple(r) for r in best.collect()) == [(1, 4, 0.5), (2, 7, None)]
    got = spark.createDataFrame([(["n/a", "x", "1", "2.5", "9"],), (["x"],), ([],), (None,)], "v array<string>").select(visibility.numeric_stretch(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in got] == [[1.0, 2.5], None, None, None]


def test_sampling_touches_both_ends_and_agrees_with_a_theta_join(spark):
    rows = [("a", "x", 1, 0.0, 10.0), ("a", "x", 2, 5.0, 20.0), ("a", "y", 3, 11.0, 19.0), ("b", "x", 4, 10.0, 10.0)]
    frame = spark.createDataFrame(rows, "src string, dst string, seq long, t0 double, t1 double")
    found = {(r["src"], r["dst"], r["t"], r["seq"]) for r in visibility.sample_intervals(frame, 10).collect()}
    wanted = {}
    for src, dst, seq, t0, t1 in rows:
        for t in range(0, 30, 10):
            if t0 <= t <= t1:
                wanted.setdefault((src, dst, t), seq)
    assert found == {(*k, v) for k, v in wanted.items()}
    ticks = visibility.visibility_ticks(frame.filter("dst = 'x'"), frame.filter("src = 'b'"), 10).orderBy("src", "t").collect()
    assert [(r["src"], r["t"], len(r["targets"]), len(r["peers"])) for r in ticks] == [("a", 0, 1, 0), ("a", 10, 1, 0), ("a", 20, 1, 0), ("b", 10, 1, 1)]
    assert visibility.time_grid(frame.limit(0), 10).collect() == [] and [r["t"] for r in visibility.time_grid(frame, 10).orderBy("t").collect()] == [0, 10, 20, 30]


def test_lagrange_positions(spark):
    ephemeris = spark.range(11).select(F.lit("a").alias("object_id"), (F.col("id") * 60).cast("double").alias("t"), *(F.pow(F.col("id").cast("double"), F.lit(p)).alias(c) for c, p in zip("xyz", (1, 2, 3), strict=True)))
    points = spark.createDataFrame([("a", 150.0), ("a", 240.0), ("a", 900.0), ("b", 1.0)], "o string, at double")
    found = {(r["o"], r["at"]): (r["x"], r["y"], r["z"]) for r in visibility.positions_at(points, ephemeris, "o", "at", 60, order=3).collect()}
    assert found == {("a", 150.0): (2.5, 6.25, 15.625), ("a", 240.0): (4.0, 16.0, 64.0), ("a", 900.0): (None,) * 3, ("b", 1.0): (None,) * 3}


def test_nested_snapshots(spark):
    nodes = spark.createDataFrame([(0, 2, 1.0, 2.0, 3.0, 1), (0, 1, 1.0, 1.0, 1.0, 2), (0, 1, 9.0, 9.0, 9.0, 3), (10, 1, 0.0, 0.0, 0.0, 4)], "t long, id long, x double, y double, z double, seq long")
    edges = spark.createDataFrame([(0, 1, 2, 4.0, 1), (0, 2, 1, 8.0, 2)], "t long, from_id long, to_id long, distance double, seq long")
    made = visibility.graph_snapshots(nodes, edges, edges.limit(0)).orderBy("t").collect()
    assert [s["id"] for s in made[0]["sat_attrs"]] == [1, 2] and made[0]["sat_attrs"][0]["pos"] == [1.0, 1.0, 1.0] and all(0 <= s["health"] <= 1 for s in made[0]["sat_attrs"])
    assert [(e["from_id"], e["w"]) for e in made[0]["sat_edges"]] == [(1, 1.0), (2, 0.5)] and made[0]["target_edges"] == [] and made[1]["sat_edges"] == []


# ---- geometry -----------------------------------------------------------------------------------
def test_rounding_and_the_horizon(spark):
    row = spark.range(1).select(
        geodesy.ground_sample_distance(0.001, F.lit(1000.0), F.lit(30.0)).alias("g"), geodesy.ground_sample_distance(0.001, F.lit(1000.0), F.lit(0.0)).alias("h"), geodesy.swath_width(F.lit(7000.0), F.lit(0.0), F.lit(0.0), F.lit(30.0)).alias("s"),
        geodesy.ecef_m(F.lit(0.0), F.lit(0.0), F.lit(0.0))[0].alias("x"), geodesy.connection_quality(F.lit(5.0)).alias("q"),
    ).head()
    assert (row["g"], row["h"], row["s"], row["x"], row["q"]) == (1.414, None, round((7000 - 6371) * math.tan(math.radians(30)), 2), 6378137.0, 100)


def test_orbits_against_known_facts(spark):
    elements = spark.createDataFrame([("geo", 0.0, 42164.17, 0.0, 0.0, 0.0, 0.0, 10.0), ("ell", 0.0, 12000.0, 0.4, 63.4349, 20.0, 90.0, 0.0)], "object_id string, epoch double, a double, e double, inclination double, node double, perigee double, mean double")
    moving = access.propagate(elements, 0, 86_400, 600)
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    ends = {row["object_id"]: row for row in moving.groupBy("object_id").agg(F.min(r).alias("lo"), F.max(r).alias("hi"), F.count("*").alias("n")).collect()}
    assert ends["geo"]["n"] == 145 and abs(ends["geo"]["lo"] - 42164.17) < 1e-6 and 7200 - 1 <= ends["ell"]["lo"] < 7300 and 16700 < ends["ell"]["hi"] <= 16800 + 1
    fixed = access.to_fixed(moving.filter("object_id = 'geo'"))
    lon = F.degrees(F.atan2("y", "x"))
    drift = fixed.agg((F.max(lon) - F.min(lon)).alias("d")).head()["d"]
    assert drift < 0.2  # a geostationary satellite stands still over the Earth
    high = access.latitude_extremes(moving.filter("object_id = 'ell'")).head()
    assert 60 < high["most_lat"] < 63.5 and -63.5 < high["least_lat"] < -55
    nodes = access.equator_crossings(access.to_fixed(moving.filter("object_id = 'ell'"))).count()
    assert nodes == 6 or nodes == 7  # a period of 3.63 hours
    solstice, equinox = (spark.range(1).select(F.degrees(F.asin(orbits.sun_direction(F.lit(float(t)))[2])).alias("d")).head()["d"] for t in (1_750_473_600, 1_742_461_200))
    assert abs(solstice - 23.44) < 0.02 and abs(equinox) < 0.02
    seen = spark.range(1).select(
        orbits.line_of_sight((F.lit(7000.0), F.lit(0.0), F.lit(0.0)), (F.lit(-7000.0), F.lit(0.0), F.lit(0.0))).alias("no"),
        orbits.line_of_sight((F.lit(7000.0), F.lit(0.0), F.lit(0.0)), (F.lit(7000.0), F.lit(3000.0), F.lit(0.0))).alias("yes"),
        orbits.azimuth_elevation_range(F.lit(0.0), F.lit(0.0), (F.lit(6378.0), F.lit(0.0), F.lit(0.0)), (F.lit(6378.0), F.lit(0.0), F.lit(10.0)))[0].alias("north"),
    ).head()
    assert (seen["no"], seen["yes"]) == (False, True) and min(seen["north"], 360 - seen["north"]) < 1e-9


def test_access_of_a_passing_satellite(spark):
    places = spark.createDataFrame([("s", float(t), 7378.0 * math.cos((t - 300) / 1000), 7378.0 * math.sin((t - 300) / 1000), 0.0) for t in range(0, 601, 10)], "object_id string, t double, x double, y double, z double")
    target = spark.createDataFrame([("m1", 0.0, 0.0, 6378.0, 0.0, 0.0)], "target string, lat double, lon double, x double, y double, z double")
    samples = access.target_samples(places, target)
    spans = access.sensor_access(samples, 10, most_km=2000)
    found = access.access_details(spans, samples, 0.001).collect()
    assert len(found) == 1 and found[0]["t0"] == 600 - found[0]["t1"] and abs(found[0]["max_elevation"] - 90) < 1e-6 and abs(found[0]["min_range"] - 1000) < 1e-6 and found[0]["gsd"] == 1.0
    two = places.unionByName(places.withColumns({"object_id": F.lit("u"), "x": -F.col("x"), "y": -F.col("y")}))
    assert access.mutual_access(two, 10).collect() == []
    near = {tuple(r) for r in access.target_samples(places, target, 1100.0).select("t", F.round("range_km", 6)).collect()}
    far = {tuple(r) for r in samples.filter("range_km <= 1100").select("t", F.round("range_km", 6)).collect()}
    assert near == far and near


# ---- graphs -------------------------------------------------------------------------------------
def test_groups_masters_hops_and_score(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, 1), (2, 1, 0.4, 2), (2, 3, 0.7, 3), (3, 4, 0.69, 4), (5, 5, 1.0, 5), (4, None, 1.0, 6)], "a long, b long, w double, o long")
    assert sorted(tuple(r) for r in graph.undirected(edges, "a", "b", "w", "o").collect()) == [(1, 2, 0.4), (2, 3, 0.7), (3, 4, 0.69)]
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "node long, group long")
    merged = graph.merge_groups(members, edges.filter("o <> 2"), "a", "b", "w")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    nodes = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.4), (4, None)], "node long, health double")
    masters = graph.choose_masters(merged, nodes, edges, "a", "b")
    assert sorted(tuple(r) for r in masters.collect()) == [(1, 2), (4, 4)]
    hops = graph.hops_to_master(edges, "a", "b", merged.join(masters, "group"), 2)
    assert sorted((r["node"], r["hop"]) for r in hops.collect()) == [(1, 1), (2, 0), (3, 1), (4, 0)]
    seen = spark.createDataFrame([(1, 10, 0.8), (2, 10, 0.6), (4, 11, 1.0)], "node long, target long, q double")
    score = graph.grouping_scores(merged, masters, nodes, edges.dropna().filter("a <> b"), seen).head()
    assert (round(score["link"], 4), score["quality"], score["groups"], score["health"], score["oversized"]) == (round(2.0 / 3, 4), 0.9, 0.5, 0.5, 1)
    ring = graph.radial_places(members.select("node"), "node").orderBy("node").collect()
    assert [(round(r["x"], 6), round(r["y"], 6)) for r in ring] == [(1, 0), (0, 1), (-1, 0), (0, -1)]


def test_principal_plane_against_numpy(spark):
    import numpy as np

    points = np.random.default_rng(3).normal(size=(40, 3)) * [5, 2, 0.1] + [7, 8, 9]
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    found = {r["id"]: (abs(r["u"]), abs(r["v"])) for r in graph.principal_plane(frame, "id").collect()}
    centred = points - points.mean(0)
    wanted = np.abs(centred @ np.linalg.svd(centred)[2][:2].T)
    assert all(np.allclose(found[i], wanted[i], atol=1e-6) for i in range(40))


# ---- calls and streams --------------------------------------------------------------------------
def test_calls_keep_faults_to_their_record(spark):
    def make_client():
        def answer(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return ["<thou", "ght>a</thought>x<thought>b</thought>", "y", None]

        return answer

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id long, p string")
    found = {r["id"]: r for r in calls.map_records(rows, "id", "p", make_client, per_minute=1e9, tries=2).collect()}
    assert (found[1]["reasoning"], found[1]["content"], found[1]["error"], found[1]["attempts"]) == ("a\nb", "xy", None, 1)
    assert json.loads(found[2]["error"])["type"] == "RuntimeError" and found[2]["attempts"] == 2 and found[3]["error"] == "no prompt"
    assert calls.map_records(rows.limit(0), "id", "p", make_client).collect() == []


def test_rate_limit_with_a_clock_of_its_own():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    limit = calls.RateLimit(60, lambda: now[0], sleep)
    for _ in range(3):
        limit.wait()
    now[0] += 10
    limit.wait()
    assert waits == [1.0, 1.0]
    open_block = calls.TagStream()
    open_block.feed("x<thought>never closed")
    assert open_block.close() == ("", "x<thought>never closed")


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "at timestamp, k string"
    spark.createDataFrame([(datetime(2025, 1, 1, 0, 0, s), "a") for s in (1, 2, 40)], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    source = lambda: streams.event_stream(spark, f"{tmp_path}/in", schema)
    run = lambda: streams.append_files(source(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    spark.createDataFrame([(datetime(2025, 1, 1, 0, 2), "b")], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    counted: list = []
    query = streams.tumbling(source(), "at", ["k"], "10 seconds", "1 hour").writeStream.outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True)
    query.foreachBatch(lambda batch, n: counted.append(sorted((r["k"], r["n"]) for r in batch.collect()))).start().awaitTermination()
    assert counted[-1] == [("a", 1), ("a", 2), ("b", 1)]
    batch = streams.sessions(spark.read.parquet(f"{tmp_path}/in"), "at", "k", "5 seconds", "1 hour")
    assert sorted((r["k"], r["n"]) for r in batch.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_progress_of_a_stream(spark, tmp_path):
    progress = streams.Progress()
    spark.streams.addListener(progress)
    try:
        spark.createDataFrame([(datetime(2025, 1, 1), "a")] * 3, "at timestamp, k string").write.parquet(f"{tmp_path}/in")
        seen: list = []
        streams.for_each_batch(streams.event_stream(spark, f"{tmp_path}/in", "at timestamp, k string"), lambda batch, n: seen.append(batch.count()), f"{tmp_path}/c").awaitTermination()
        for _ in range(100):  # listeners are told a little later
            if progress.rows >= 3:
                break
            time.sleep(0.1)
        assert (sum(seen), progress.rows, progress.failed) == (3, 3, 0) and progress.batches >= 1
    finally:
        spark.streams.removeListener(progress)


def test_times(spark):
    row = spark.createDataFrame([("6 Jul 2025 04:00:00.123",), ("06 Jul 2025 04:00:00.123",)], "s string").select(times.instant(F.col("s")).alias("t")).select(
        times.iso_text(F.col("t")).alias("iso"), times.epoch_with_millis(F.col("t")).alias("ms"), times.offset_seconds(F.col("t"), datetime(2025, 7, 6, 4)).alias("o")
    ).collect()
    assert [tuple(r) for r in row] == [("2025-07-06T04:00:00Z", 1_751_774_400.123, 0.123)] * 2 and times.file_stamp(datetime.fromisoformat("2025-07-20T02:00:00+00:00")) == "20250720_020000"
