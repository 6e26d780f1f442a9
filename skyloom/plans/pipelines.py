"""Queries for files, the visibility pipeline, validation, texts, times, tables, graphs, orbits, calls and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geodesy, orbits, texts, times
from skyloom.operators import calls, catalog, graph, scenario, stats, validation, visibility
from skyloom.operators.series import micros
from skyloom.session import materialize, table, work_path
from skyloom.sources import readers, sinks
from skyloom.streaming import pipelines as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows where there is one."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


# ---- access windows as intervals in seconds since the scenario's start ------------------------
_START_S = 1_704_067_200  # 2024-01-01 UTC
_STEP = 600
_WINDOWS_SQL = f"""
WITH w AS (SELECT DISTINCT satellite_name AS src, sensor AS dst, window_id AS seq, gsd, epoch_us(try_strptime(trim(start_time), '%d %b %Y %H:%M:%S.%f')) / 1e6 - {_START_S} AS t0,
                  epoch_us(try_strptime(trim(end_time), '%d %b %Y %H:%M:%S.%f')) / 1e6 - {_START_S} AS t1 FROM access_windows),
     v AS (SELECT * FROM w WHERE t0 >= 0 AND t1 > t0 AND src IS NOT NULL AND dst IS NOT NULL)
"""
_SAMPLED = """
     p AS (SELECT src, dst, seq, t0, t1, unnest(range(CAST(ceil(t0 / 600) AS BIGINT) * 600, CAST(floor(t1 / 600) AS BIGINT) * 600 + 1, 600)) AS t FROM v),
     s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY src, dst, t ORDER BY seq, t0, t1) = 1)
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: (F.unix_micros(times.instant(F.col(c))) / 1e6) - _START_S
    rows = table(spark, sf_dir, "access_windows").select(
        F.col("satellite_name").alias("src"), F.col("sensor").alias("dst"), F.col("window_id").alias("seq"), "gsd", at("start_time").alias("t0"), at("end_time").alias("t1")
    )
    return visibility.scenario_intervals(rows.distinct()).filter("t1 > t0")


@_query(_WINDOWS_SQL + "SELECT CAST(unnest(range(CAST(floor(lo / 86400) AS BIGINT) * 86400, CAST(floor(hi / 86400) + 1 AS BIGINT) * 86400 + 1, 86400)) AS BIGINT) AS t FROM (SELECT min(t0) AS lo, max(t1) AS hi FROM v)")
def q_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' grid over all windows."""
    return visibility.time_grid(_windows(spark, sf_dir), 86_400)


@_query(_WINDOWS_SQL + "," + _SAMPLED + "SELECT src, dst, t, seq, round(t + least(t1, 600), 3) AS until_as_made, round(t + least(t1 - t, 600), 3) AS until FROM s")
def q_first_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window that holds each grid point, and the ends of its stretch."""
    seen = visibility.sample_intervals(_windows(spark, sf_dir), _STEP)
    made, right = visibility.window_until(F.col("t"), F.col("t1"), _STEP)
    return seen.select("src", "dst", "t", "seq", F.round(made, 3).alias("until_as_made"), F.round(right, 3).alias("until"))


@_query(
    _WINDOWS_SQL.replace("v AS (", "a AS (")
    + ", v AS (SELECT src, dst, seq, t0, t1, 't' AS kind FROM a WHERE gsd < 2 UNION ALL SELECT src, dst, seq, t0, t1, 'p' FROM a WHERE gsd >= 2 UNION ALL SELECT dst, src, seq, t0, t1, 'p' FROM a WHERE gsd >= 2),"
    + _SAMPLED.replace("SELECT src, dst, seq", "SELECT kind, src, dst, seq").replace("PARTITION BY src", "PARTITION BY kind, src")
    + "SELECT src, t, count(*) FILTER (WHERE kind = 't') AS targets, count(*) FILTER (WHERE kind = 'p') AS peers, min(dst) FILTER (WHERE kind = 't') AS first_target FROM s GROUP BY src, t HAVING count(*) FILTER (WHERE kind = 't') > 0"
)
def q_visibility_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of satellites that see a target (here fine windows), with their peers (coarse ones)."""
    rows = _windows(spark, sf_dir)
    ticks = visibility.visibility_ticks(rows.filter("gsd < 2"), rows.filter("gsd >= 2"), _STEP)
    return ticks.select(
        "src", "t", F.size("targets").cast("long").alias("targets"), F.size("peers").cast("long").alias("peers"), F.col("targets")[0]["dst"].alias("first_target")
    )


@_query(_WINDOWS_SQL + "SELECT src, dst, round(CAST(sum(CAST(t1 - t0 AS DECIMAL(18, 3))) AS DOUBLE) / 60, 6) AS minutes FROM v GROUP BY src, dst")
def q_pair_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    total = F.sum((F.col("t1") - F.col("t0")).cast("decimal(18,3)")).cast("double")
    return _windows(spark, sf_dir).groupBy("src", "dst").agg(F.round(total / 60, 6).alias("minutes"))


_SENSORS = [f"Sensor{n}" for n in (1, 9, 14, 34, 41, 55)]


@_query(
    _WINDOWS_SQL + "SELECT src, " + ", ".join(f"round(coalesce(sum(t1 - t0) FILTER (WHERE dst = '{s}') / 60, 0), 4) AS {s}" for s in _SENSORS) + " FROM v GROUP BY src"
)
def q_sensor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    rows = _windows(spark, sf_dir).select("src", "dst", (F.col("t1") - F.col("t0")).alias("s"))
    wide = stats.duration_matrix(rows, "src", "dst", "s", _SENSORS)
    return wide.select("src", *(F.round(s, 4).alias(s) for s in _SENSORS))


@_query(
    "WITH n AS (SELECT s_nationkey AS a, s_suppkey % 7 AS b, s_acctbal AS s FROM supplier), m AS (SELECT a, b, s FROM n UNION ALL SELECT b, a, s FROM n WHERE a <> b) "
    "SELECT CAST(a AS BIGINT) AS a, " + ", ".join(f"round(coalesce(sum(s) FILTER (WHERE b = {k}) / 60, 0), 4) AS \"{k}\"" for k in range(7)) + " FROM m GROUP BY a"
)
def q_symmetric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers instead of durations between nations and classes of suppliers, mirrored."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") % 7).alias("b"), F.col("s_acctbal").alias("s"))
    wide = stats.duration_matrix(rows, "a", "b", "s", list(range(7)), symmetric=True)
    return wide.select("a", *(F.round(f"`{k}`", 4).alias(str(k)) for k in range(7)))


@_query(_WINDOWS_SQL + "SELECT src, round(min(t1 - t0), 6) AS least, round(max(t1 - t0), 6) AS most, round(avg(t1 - t0), 4) AS mean, round(sum(t1 - t0), 3) AS total FROM v GROUP BY src")
def q_duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    found = stats.duration_summary(_windows(spark, sf_dir).withColumn("s", F.col("t1") - F.col("t0")), "src", "s")
    return found.select("src", "least", "most", F.round("mean", 4).alias("mean"), F.round("total", 3).alias("total"))


@_query(
    "SELECT satellite_name, count(gsd) AS total, count_if(gsd < 1) AS better, count_if(gsd >= 1 AND gsd < 2) AS fine, count_if(gsd >= 2 AND gsd < 5) AS coarse, count_if(gsd >= 5) AS worse FROM access_events GROUP BY satellite_name"
)
def q_resolution_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return stats.resolution_bands(table(spark, sf_dir, "access_events"), "satellite_name", "gsd", (1, 2, 5))


@_query("SELECT satellite_name, sensor, max(max_elevation) AS max_elevation, min(min_range) AS min_range FROM access_events GROUP BY satellite_name, sensor")
def q_access_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, A19."""
    return table(spark, sf_dir, "access_events").groupBy("satellite_name", "sensor").agg(F.max("max_elevation").alias("max_elevation"), F.min("min_range").alias("min_range"))


# ---- files ------------------------------------------------------------------------------------
@_query("SELECT rec_id, id, name, description, longitude, latitude, priority, target_value, last_access_date FROM target_list")
def q_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as JSON lines, read back."""
    columns = ["rec_id", "id", "name", "description", "longitude", "latitude", "priority", "target_value", "last_access_date"]
    rows, path = table(spark, sf_dir, "target_list").select(*columns), f"{work_path(spark, 'lines')}.jsonl"
    sinks.write_json_lines(rows, path)
    return readers.read_records(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)).drop("sk_corrupt")


@_query(_WINDOWS_SQL + "SELECT src, dst, CAST(round((t0 + " + str(_START_S) + ") * 1000) AS BIGINT) AS start_ms, round(t1 - t0, 3) AS seconds FROM v WHERE src NOT LIKE '%-%' AND dst NOT LIKE '%-%'")
def q_interval_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as an interval file, read back."""
    rows = _windows(spark, sf_dir)
    at = lambda c: times.from_epoch(F.col(c) + _START_S)
    path = work_path(spark, "intervals")
    sinks.write_intervals(rows.select("src", "dst", at("t0").alias("start_time"), at("t1").alias("end_time"), F.round(F.col("t1") - F.col("t0"), 3).alias("seconds")), path)
    return readers.read_intervals(spark, path).select("src", "dst", F.unix_millis("start_time").alias("start_ms"), "seconds")


@_query(
    """
SELECT record_id, len(from_json(output_result_data, '[{"cluster_id":"JSON"}]')) AS clusters, output_resoning_data AS reasoning
FROM (SELECT DISTINCT record_id, output_resoning_data, output_result_data FROM sft_records)
WHERE json_valid(output_result_data) AND output_result_data LIKE '[{"cluster_id"%]' AND output_resoning_data IS NOT NULL AND output_resoning_data NOT LIKE '%think>%' AND output_result_data NOT LIKE '%\\%'
"""
)
def q_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as conversations, read back, their answers taken apart."""
    rows = table(spark, sf_dir, "sft_records").select("record_id", "instruction", "input_user_data", "output_resoning_data", "output_result_data").distinct()
    sound = F.try_parse_json("output_result_data").isNotNull() & F.col("output_result_data").rlike(r'(?s)^\[\{"cluster_id".*\]$')
    sound = sound & ~F.col("output_resoning_data").contains("think>") & ~F.col("output_result_data").contains("\\")
    answer = F.concat(F.lit("<think>"), F.col("output_resoning_data"), F.lit("</think>"), F.col("output_result_data"))
    chats = rows.filter(sound).select(texts.chat_record(F.col("record_id").cast("string"), F.col("input_user_data"), answer).alias("messages"))
    path = f"{work_path(spark, 'chats')}.jsonl"
    sinks.write_json_lines(chats, path)
    read = readers.read_conversations(spark, path)
    clusters = texts.answer_clusters(F.col("assistant"))
    return read.select(F.col("system").cast("long").alias("record_id"), F.size(clusters).cast("long").alias("clusters"), F.regexp_extract("assistant", r"(?s)<think>(.*?)</think>", 1).alias("reasoning"))


@_query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no FROM documents")
def q_record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, W11."""
    return visibility.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).select("doc_id", F.col("no").cast("long").alias("no"))


@_query(
    "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, '。'), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: len(x) > 0) AS parts FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, unnest(range(1, len(parts) + 1)) AS no, unnest(parts) AS prompt FROM p"
)
def q_prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(readers.split_records(F.col("text"), "。")).alias("at", "prompt"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("no"), "prompt")


@_query("SELECT DISTINCT sensor, satellite_name AS satellite FROM access_windows WHERE satellite_name <> '' AND sensor <> '' AND satellite_name NOT LIKE '%/%'")
def q_sensor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors parsed from object paths, joined with their satellites."""
    rows = table(spark, sf_dir, "access_windows").filter("satellite_name <> '' and sensor <> '' and satellite_name not like '%/%'").select("satellite_name", "sensor").distinct()
    paths = rows.select(F.concat(F.lit("/Scenario/main/Satellite/"), "satellite_name", F.lit("/Sensor/"), "sensor").alias("path"))
    listing = paths.agg(F.lit("None").alias("l")).select(F.explode(readers.objects_of(F.col("l"))).alias("path"))  # a kind without objects
    satellites = rows.select(F.col("satellite_name").alias("satellite")).distinct()
    return readers.children_of(satellites, paths.unionByName(listing)).select("sensor", "satellite")


@_query(
    "WITH e AS (SELECT user_id AS object_id, event_id AS t, value AS x FROM events WHERE event_id BETWEEN 100 AND 5100 AND (event_id - 100) % 10 = 0 AND user_id IN (8, 46, 47, 50)) "
    "SELECT object_id, min(t) AS t, round(arg_min(x, t), 3) AS x FROM e GROUP BY object_id"
)
def q_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first position of named objects on a grid; events stand in for an ephemeris."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("t"), *(F.col("value").alias(c) for c in "xyz"))
    return readers.positions(rows, 100, 5000, 10, [8, 46, 47, 50], first_only=True).select("object_id", "t", "x")


@_query(
    """
WITH o AS (SELECT DISTINCT satellite_name AS n FROM access_windows WHERE satellite_name <> '' AND satellite_name NOT LIKE '%/%')
SELECT '/Satellite/' || n AS path, 'Satellite' AS kind FROM o WHERE n <> 'Satellite111'
UNION ALL SELECT '/Satellite/' || n || '/Sensor/S_' || n, 'Sensor' FROM o WHERE n <> 'Satellite111'
"""
)
def q_scenario_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellites with a sensor each, one of them deleted with what hangs below it."""
    named = table(spark, sf_dir, "access_windows").filter("satellite_name <> '' and satellite_name not like '%/%'").select(F.col("satellite_name").alias("name")).distinct()
    objects = named.select(F.concat(F.lit("/Satellite/"), "name").alias("path"), F.lit("Satellite").alias("kind"), "name", F.lit("").alias("parent"), F.lit("{}").alias("attributes"))
    with_sensors = scenario.attach_to_all(objects, "Satellite", "Sensor", "S_", {"inner": 57})
    return scenario.delete_objects(with_sensors, objects.filter("name = 'Satellite111'")).select("path", "kind")


# ---- the catalog ------------------------------------------------------------------------------
_NOW = 1_735_700_000


@_query(
    f"SELECT rec_id, id, target_value FROM target_list WHERE freeze_timestamp <= {_NOW} AND target_status = 0 ORDER BY target_value DESC NULLS LAST, rec_id LIMIT 50"
)
def q_open_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P28, O1, W2."""
    return catalog.top_k(catalog.open_targets(table(spark, sf_dir, "target_list").distinct(), _NOW), "target_value", 50, "rec_id").select("rec_id", "id", "target_value")


ORACLE_SQL["q_open_targets"] = ORACLE_SQL["q_open_targets"].replace("FROM target_list", "FROM (SELECT DISTINCT * FROM target_list)")


@_query(
    "SELECT rec_id FROM (SELECT * FROM (SELECT DISTINCT * FROM target_list) ORDER BY priority DESC NULLS LAST, rec_id LIMIT 2000) WHERE target_status <> 1"
)
def q_unvisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, O3, O4."""
    return catalog.limit_then_filter(table(spark, sf_dir, "target_list").distinct(), "priority", 2000, "rec_id", F.col("target_status") != 1).select("rec_id")


@_query("SELECT id, rec_id, priority FROM target_list WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_id, priority NULLS FIRST) = 1")
def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every target."""
    return visibility.first_per_key(table(spark, sf_dir, "target_list").filter("id is not null").select("id", "rec_id", "priority"), ["id"], "rec_id")


@_query("SELECT rec_id, 0::BIGINT AS freeze_timestamp, 0 AS target_status, '' AS last_access_date FROM target_list")
def q_refresh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    return catalog.reset_targets(table(spark, sf_dir, "target_list")).select("rec_id", "freeze_timestamp", "target_status", "last_access_date")


_STAMP = "2026-01-01 00:00:00"


@_query(
    f"SELECT rec_id, CASE WHEN id = 1111 THEN 9 ELSE priority END AS priority, CASE WHEN id = 1111 THEN CAST(target_value * 2 AS DOUBLE) ELSE target_value END AS target_value, epoch_us(CASE WHEN id = 1111 THEN TIMESTAMP '{_STAMP}' ELSE update_at END) AS stamp_us FROM target_list"
)
def q_update_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, D12."""
    changed = catalog.update_where(
        table(spark, sf_dir, "target_list"), F.col("id") == 1111, {"priority": 9, "target_value": F.col("target_value") * 2}, stamp=F.lit(_STAMP).cast("timestamp_ntz")
    )
    return changed.select("rec_id", "priority", "target_value", micros(F.col("update_at")).alias("stamp_us"))


@_query("SELECT rec_id, '[]' AS access_json FROM target_list")
def q_reset_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, P61."""
    return catalog.reset_column(table(spark, sf_dir, "target_list"), "access_json", "[]").select("rec_id", "access_json")


@_query("SELECT rec_id, NULL::BIGINT AS access_orbit, TRY_CAST(last_access_date AS BIGINT) AS last_access_date, CAST(priority AS VARCHAR) AS priority FROM target_list WHERE last_access_date IS NULL OR regexp_matches(last_access_date, '^[0-9A-Za-z/-]+$')")
def q_alter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, D9."""
    rows = catalog.add_column(catalog.add_column(table(spark, sf_dir, "target_list"), "access_orbit", "bigint"), "rec_id", "string")
    rows = rows.filter(F.col("last_access_date").isNull() | F.col("last_access_date").rlike(r"^[0-9A-Za-z/-]+\z"))
    return catalog.alter_column(catalog.alter_column(rows, "last_access_date", "bigint"), "priority", "string").select("rec_id", "access_orbit", "last_access_date", "priority")


@_query("SELECT target_status, count(*) AS n FROM target_list WHERE priority >= 5 GROUP BY target_status")
def q_raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10, S13."""
    return catalog.run_sql(spark, "SELECT target_status, count(*) AS n FROM {t} WHERE priority >= :least GROUP BY target_status", {"t": table(spark, sf_dir, "target_list")}, least=5)


@_query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' END AS type FROM (DESCRIBE SELECT feed_id, feed_name, tz_name, date_order FROM feeds)")
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return catalog.describe(table(spark, sf_dir, "feeds").select("feed_id", "feed_name", "tz_name", "date_order")).select("name", "type")


@_query("SELECT rec_id, priority FROM target_list")
def q_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows range-partitioned downwards by priority, for files with disjoint ranges."""
    return catalog.order_by_priority(table(spark, sf_dir, "target_list").select("rec_id", "priority"))


@_query(
    "WITH t AS (SELECT DISTINCT * FROM target_list), base AS (SELECT id, min(name) AS name, min(rec_id) AS rec_id FROM t WHERE id % 3 = 0 GROUP BY id), "
    "fresh AS (SELECT id, name, rec_id FROM t WHERE id % 2 = 0 AND name IS NOT NULL AND priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_id, name) = 1) "
    "SELECT id, name, rec_id FROM base UNION ALL SELECT id, name, rec_id FROM fresh WHERE id NOT IN (SELECT id FROM base WHERE id IS NOT NULL)"
)
def q_insert_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivered row of each new target is added, rows without name or priority aren't."""
    rows = table(spark, sf_dir, "target_list").distinct()
    base = rows.filter("id % 3 = 0").groupBy("id").agg(F.min("name").alias("name"), F.min("rec_id").alias("rec_id"))
    batch = rows.filter("id % 2 = 0").select("id", "name", "rec_id", "priority")
    return catalog.insert_or_ignore(base, batch, "id", "rec_id", ["name", "priority"])


@_query("SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 10 = 0)")
def q_delete_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.delete_named(rows, "c_name", rows.filter("c_custkey % 10 = 0"))


@_query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey")
def q_required_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").alias("p_partkey"))
    return catalog.required_lookup(lines, table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey").drop("p_partkey")


@_query(
    "SELECT rec_id, list_filter([CASE WHEN coalesce(latitude BETWEEN -90 AND 90, false) THEN NULL ELSE 'latitude' END, CASE WHEN coalesce(longitude BETWEEN -180 AND 180, false) THEN NULL ELSE 'longitude' END, "
    "CASE WHEN coalesce(priority BETWEEN 1 AND 10, false) THEN NULL ELSE 'priority' END, CASE WHEN coalesce(target_status IN (0, 1), false) THEN NULL ELSE 'status' END], lambda x: x IS NOT NULL) AS broken "
    "FROM target_list WHERE NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND priority BETWEEN 1 AND 10 AND target_status IN (0, 1), false)"
)
def q_field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, apart from the others, with the rules they break."""
    rules = {
        "latitude": F.col("latitude").between(-90, 90), "longitude": F.col("longitude").between(-180, 180), "priority": F.col("priority").between(1, 10), "status": F.col("target_status").isin(0, 1),
    }
    return validation.constraint_rejects(table(spark, sf_dir, "target_list"), rules)[1].select("rec_id", "broken")


# ---- groupings against their snapshots --------------------------------------------------------
_PAIRS_SQL = r"""
WITH r AS (SELECT DISTINCT record_id, input_user_data AS u, CASE WHEN json_valid(output_result_data) THEN CASE WHEN json_type(output_result_data) = 'ARRAY' AND len(json_extract(output_result_data, '$[*].sats')) = json_array_length(output_result_data)
                  AND len(json_extract(output_result_data, '$[*].targets')) = json_array_length(output_result_data) THEN output_result_data END END AS o FROM sft_records),
     nodes AS (SELECT record_id, CAST(unnest(json_extract(u, '$.sat_attrs[*].id')) AS INT) AS sat FROM r),
     wanted AS (SELECT DISTINCT record_id, CAST(unnest(json_extract(u, '$.target_edges[*].to')) AS INT) AS target FROM r),
     g AS (SELECT record_id, c.j AS c, c.i - 1 AS place FROM (SELECT record_id, unnest(list_zip(json_extract(o, '$[*]'), range(1, len(json_extract(o, '$[*]')) + 1))) AS z FROM r WHERE o IS NOT NULL), LATERAL (SELECT z[1] AS j, z[2] AS i) c),
     used AS (SELECT record_id, place, CAST(unnest(json_extract(c, '$.sats[*]')) AS INT) AS sat FROM g),
     served AS (SELECT DISTINCT record_id, CAST(unnest(json_extract(c, '$.targets[*]')) AS INT) AS target FROM g)
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sft_records").select("record_id", "input_user_data", "output_result_data").distinct()
    return validation.validation_report(validation.read_pairs(rows, "record_id", "input_user_data", "output_result_data"), "record_id")


@_query(
    _PAIRS_SQL
    + """, d AS (SELECT r.record_id, coalesce(list_sort((SELECT list(target) FROM wanted w WHERE w.record_id = r.record_id)), []) AS a, coalesce(list_sort((SELECT list(target) FROM served s WHERE s.record_id = r.record_id)), []) AS b FROM r)
SELECT record_id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS extra,
       CASE WHEN len(a) = 0 THEN 0 ELSE round(len(b) / len(a), 2) END AS rate FROM d"""
)
def q_report_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, A10, A11, A14, O6, P12, P14, U1, U2."""
    return _checked(spark, sf_dir).select("record_id", F.col("target_missing").alias("missing"), F.col("target_extra").alias("extra"), F.col("target_rate").alias("rate"))


@_query(_PAIRS_SQL + "SELECT record_id, sat, list(place ORDER BY place) AS places FROM used GROUP BY record_id, sat HAVING count(*) > 1")
def q_report_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, F5."""
    rows = _checked(spark, sf_dir).select("record_id", F.explode("duplicates").alias("d"))
    return rows.select("record_id", F.col("d.node").alias("sat"), F.col("d.groups").cast("array<bigint>").alias("places"))


@_query(
    _PAIRS_SQL
    + """, n AS (SELECT DISTINCT record_id, sat FROM nodes), k AS (SELECT DISTINCT record_id, sat FROM used),
     a AS (SELECT record_id, count(*) AS n FROM n GROUP BY ALL), b AS (SELECT record_id, count(*) AS n FROM k GROUP BY ALL),
     m AS (SELECT record_id, count(*) AS n FROM (SELECT * FROM n EXCEPT SELECT * FROM k) GROUP BY ALL)
SELECT r.record_id, coalesce(m.n, 0) AS unused, CASE WHEN coalesce(a.n, 0) = 0 THEN 0 ELSE round(coalesce(b.n, 0) / a.n, 6) END AS rate
FROM r LEFT JOIN a USING (record_id) LEFT JOIN b USING (record_id) LEFT JOIN m USING (record_id)"""
)
def q_report_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return _checked(spark, sf_dir).select("record_id", F.size("sat_missing").cast("long").alias("unused"), F.round("sat_rate", 6).alias("rate"))


@_query(
    _PAIRS_SQL
    + """, last AS (SELECT record_id, sat, max(place) AS place FROM used GROUP BY ALL),
     e AS (SELECT record_id, unnest(json_extract(u, '$.sat_edges[*]')) AS e FROM r),
     w AS (SELECT record_id, CAST(e ->> '$.from' AS INT) AS x, CAST(e ->> '$.to' AS INT) AS y, CAST(e ->> '$.w' AS DECIMAL(10, 4)) AS w FROM e)
SELECT w.record_id, least(p.place, q.place) AS a, greatest(p.place, q.place) AS b, CAST(sum(w) AS DECIMAL(20, 4)) AS strength
FROM w JOIN last p ON p.record_id = w.record_id AND p.sat = x JOIN last q ON q.record_id = w.record_id AND q.sat = y WHERE p.place <> q.place GROUP BY 1, 2, 3 HAVING sum(w) > 0.7"""
)
def q_report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    rows = _checked(spark, sf_dir).select("record_id", F.explode("merge").alias("m"))
    return rows.select("record_id", F.col("m.a").cast("long").alias("a"), F.col("m.b").cast("long").alias("b"), "m.strength")


_RATES_SQL = ORACLE_SQL["q_report_targets"].replace("SELECT record_id, list_sort(list_filter(a", ", c AS (SELECT record_id, list_sort(list_filter(a") + ")"


@_query(
    _RATES_SQL
    + """, k AS (SELECT unnest(['>1', '=1', '0.9-1', '0.8-0.9', '<0.8']) AS bucket, unnest([count_if(rate > 1), count_if(rate = 1), count_if(rate >= 0.9 AND rate < 1), count_if(rate >= 0.8 AND rate < 0.9), count_if(rate < 0.8)]) AS n, count(*) AS total FROM c)
SELECT bucket, CAST(n AS BIGINT) AS n, round(n * 100 / total, 4) AS percent FROM k"""
)
def q_report_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return stats.bucket_shares(_checked(spark, sf_dir), stats.share_buckets("target_rate"))


@_query(_RATES_SQL + " SELECT rate, CAST(len(missing) AS BIGINT) AS missing, count(*) AS n FROM c GROUP BY ALL")
def q_report_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return _checked(spark, sf_dir).groupBy(F.col("target_rate").alias("rate"), F.size("target_missing").cast("long").alias("missing")).agg(F.count("*").alias("n"))


# ---- numbers ----------------------------------------------------------------------------------
@_query(
    "SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity), 6) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS least, "
    "round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS p75, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag"
)
def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, F6, S12."""
    return stats.distribution(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@_query(
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1) "
    "SELECT b.bin, round(lo + b.bin * (hi - lo) / 30, 4) AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN c USING (bin), e"
)
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice").select("bin", F.round("low", 4).alias("low"), "n")


@_query("SELECT event_type, min(value) AS least, max(value) AS most, round_even(avg(value), 2) AS mean FROM events GROUP BY event_type")
def q_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, P41."""
    return stats.series_summary(table(spark, sf_dir, "events"), "value", ["event_type"])


@_query("SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS success, count(*) - count_if(o_orderstatus = 'F') AS failed, round(count_if(o_orderstatus = 'F') * 100 / count(*), 2) AS success_percent FROM orders")
def q_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return stats.tally(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@_query("SELECT edge_id, greatest(0, least(1, q)) AS q FROM target_edges WHERE q IS NOT NULL AND NOT isnan(q)")
def q_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    rows = table(spark, sf_dir, "target_edges").filter("q is not null and not isnan(q)")
    return rows.select("edge_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "q")).alias("q"))


@_query(
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, [l_quantity, l_extendedprice] AS numbers FROM lineitem"
)
def q_numeric_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a list of texts without its heading and its last element."""
    values = F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_tax").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), visibility.numeric_stretch(values).alias("numbers"))


@_query(
    "WITH f AS (SELECT l_orderkey AS t, l_suppkey AS from_id, l_partkey AS to_id, l_extendedprice AS d FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey ORDER BY l_linenumber, l_extendedprice) = 1) "
    "SELECT t, from_id, to_id, round(min(d) OVER (PARTITION BY t) / nullif(d, 0), 6) AS w FROM f"
)
def q_snapshot_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for moments, their lines for edges with a distance."""
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("t"), F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_extendedprice").alias("distance"), F.col("l_linenumber").alias("seq")
    )
    return visibility.relative_weights(visibility.first_per_key(edges, ["t", "from_id", "to_id"], "seq"), "t", "distance", 6).select("t", "from_id", "to_id", "w")


@_query(
    "WITH f AS (SELECT l_orderkey AS t, l_suppkey AS id FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS a, l_partkey AS b FROM lineitem) "
    "SELECT t, 'balanced' AS strategy, nodes, coalesce(edges, 0) AS sat_edges, coalesce(edges, 0) AS target_edges FROM (SELECT t, count(*) AS nodes FROM f GROUP BY t) LEFT JOIN (SELECT t, count(*) AS edges FROM e GROUP BY t) USING (t)"
)
def q_graph_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested snapshots built from flat nodes and edges, counted."""
    lines = table(spark, sf_dir, "lineitem")
    nodes = lines.select(F.col("l_orderkey").alias("t"), F.col("l_suppkey").alias("id"), *(F.col("l_quantity").alias(c) for c in "xyz"), F.col("l_linenumber").alias("seq"))
    edges = lines.select(
        F.col("l_orderkey").alias("t"), F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_extendedprice").alias("distance"), F.col("l_linenumber").alias("seq")
    )
    made = visibility.graph_snapshots(nodes, edges, edges)
    sizes = (F.size(c).cast("long").alias(n) for c, n in (("sat_attrs", "nodes"), ("sat_edges", "sat_edges"), ("target_edges", "target_edges")))
    return made.select("t", "strategy", *sizes)


@_query(
    "SELECT to_id, from_id, q FROM (SELECT DISTINCT to_id, from_id, q FROM target_edges WHERE q >= 0 AND q <= 1 AND to_id IS NOT NULL AND from_id IS NOT NULL) "
    "QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY q DESC, from_id) = 1"
)
def q_core_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    rows = table(spark, sf_dir, "target_edges").filter(F.col("q").between(0, 1) & F.col("from_id").isNotNull())
    return visibility.argmax_per_key(rows, "to_id", "q", "from_id")


@_query(
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_suppkey * t, 3) AS x, round(k * k + (t / 100 - k / 100) * ((k + 100) * (k + 100) - k * k), 3) AS y, round(-t, 3) AS z "
    "FROM (SELECT *, l_quantity * 17.5 AS t, floor(l_quantity * 17.5 / 100) * 100 AS k FROM lineitem)"
)
def q_positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions between the points of an ephemeris; it is made up, one straight and one curved axis a supplier."""
    objects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"))
    t = F.col("t").cast("double")
    ephemeris = objects.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(1000), F.lit(100)))).select("object_id", t.alias("t"), (F.col("object_id") * t).alias("x"), (t * t).alias("y"), (-t).alias("z"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", (F.col("l_quantity") * 17.5).alias("t"))
    return visibility.positions_at(points, ephemeris, "l_suppkey", "t", 100).select("l_orderkey", "l_linenumber", "x", "y", "z")


# ---- times ------------------------------------------------------------------------------------
@_query(
    "SELECT o_orderkey, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(a, '%d %b %Y %H:%M:%S.%g') AS simulator, CAST(epoch_us(a) // 1000000 AS BIGINT) AS seconds, round((epoch_us(a) // 1000) / 1000, 3) AS with_millis, "
    "epoch_us(a) + 131400000000 AS shifted_us, round((epoch_us(a) - 852076800000000) / 1e6, 6) AS since, epoch_us(a) AS back_us FROM (SELECT o_orderkey, o_orderdate + o_orderkey * INTERVAL 1234567 MICROSECOND AS a FROM orders)"
)
def q_time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P21, P22, P23, P24, P25."""
    at = F.timestamp_micros(micros(F.col("o_orderdate")) + F.col("o_orderkey") * 1_234_567)
    origin = F.lit("1997-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", times.iso_text(at).alias("iso"), times.simulator_text(at).alias("simulator"), times.epoch_seconds(at).alias("seconds"), F.round(times.epoch_with_millis(at), 3).alias("with_millis"),
        F.unix_micros(times.shifted(at, days=1.5, seconds=1800)).alias("shifted_us"), F.round(times.seconds_between(origin, at), 6).alias("since"),
        F.unix_micros(times.from_epoch(F.unix_micros(at) / 1e6)).alias("back_us"),
    )


# ---- texts ------------------------------------------------------------------------------------
@_query(
    "SELECT DISTINCT satellite_name || '-' || sensor AS pair, satellite_name AS a, sensor AS b, TRY_CAST(regexp_replace(satellite_name, '^Satellite', '') AS INT) AS number FROM access_windows WHERE satellite_name NOT LIKE '%-%' AND sensor NOT LIKE '%-%'"
)
def q_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50, P51, P52."""
    rows = table(spark, sf_dir, "access_windows").select(texts.pair_key(F.col("satellite_name"), F.col("sensor")).alias("pair")).distinct()
    parts = texts.split_pair(F.col("pair"))
    return rows.filter(parts.isNotNull()).select("pair", parts["a"].alias("a"), parts["b"].alias("b"), texts.id_number(parts["a"], "Satellite").alias("number"))


@_query(
    "WITH t AS (SELECT doc_id, '<thought>' || lang || '</thought>' || text || '<thought>' || source || '</thought>' AS t FROM documents WHERE text NOT LIKE '%thought>%') "
    "SELECT doc_id, array_to_string(regexp_extract_all(t, '<thought>(.*?)</thought>', 1, 's'), chr(10)) AS reasoning, regexp_replace(t, '<thought>.*?</thought>', '', 'gs') AS content FROM t WHERE t IS NOT NULL"
)
def q_tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P54, T1."""
    rows = table(spark, sf_dir, "documents").filter("text not like '%thought>%'")
    t = F.concat(F.lit("<thought>"), "lang", F.lit("</thought>"), "text", F.lit("<thought>"), "source", F.lit("</thought>"))
    return rows.withColumn("t", t).filter("t is not null").select("doc_id", texts.tagged(F.col("t"), "thought").alias("reasoning"), texts.untagged(F.col("t"), "thought").alias("content"))


@_query(
    "SELECT record_id, instruction, left(input_user_data, 40) AS given, CASE WHEN length(output_resoning_data) > 0 THEN output_resoning_data || chr(10) || chr(10) || model_tag ELSE model_tag END AS output "
    "FROM sft_records WHERE trim(instruction) = instruction AND length(instruction) > 0 AND model_tag IS NOT NULL"
)
def q_delimited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields put between delimiters, taken out again, records that lack one dropped."""
    rows = table(spark, sf_dir, "sft_records").filter("trim(instruction) = instruction and length(instruction) > 0 and model_tag is not null")
    text = F.concat(F.lit("## Instruction:"), "instruction", F.lit("## Input: "), F.left("input_user_data", F.lit(40)), F.lit(" ## Tag:"), "model_tag")
    fields = texts.delimited(text, {"instruction": ("## Instruction:", "## Input:"), "given": ("## Input:", "## Tag:"), "tag": ("## Tag:", "")})
    taken = rows.select("record_id", "output_resoning_data", *(c.alias(n) for n, c in fields.items())).filter("instruction <> '' and given <> '' and tag <> ''")
    return taken.select("record_id", "instruction", "given", texts.with_summary(F.col("output_resoning_data"), F.col("tag")).alias("output"))


@_query(
    "WITH m AS (SELECT record_id, unnest([{'no': 0, 'role': 'system', 'content': instruction}, {'no': 1, 'role': 'user', 'content': coalesce(input_user_data, '')}, {'no': 2, 'role': 'assistant', 'content': output_resoning_data}]) AS m FROM sft_records) "
    "SELECT record_id, CAST(m.no AS BIGINT) AS no, m.role AS role, m.content AS content FROM m"
)
def q_alpaca_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P66, P67."""
    chat = texts.alpaca_to_chat(F.col("instruction"), F.col("input_user_data"), F.col("output_resoning_data"))
    rows = table(spark, sf_dir, "sft_records").select("record_id", F.posexplode(chat).alias("no", "m"))
    return rows.select("record_id", F.col("no").cast("long").alias("no"), "m.role", "m.content")


@_query(
    """
SELECT record_id, CAST(json_array_length(output_result_data) AS BIGINT) AS clusters, model_tag AS reasoning FROM sft_records
WHERE json_valid(output_result_data) AND output_result_data LIKE '[{"cluster_id"%' AND model_tag IS NOT NULL
"""
)
def q_parsed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in a fence with a text before it; those that don't parse, or hold other members, are dropped."""
    body = F.concat(F.lit('{"chain_of_thought":"'), "model_tag", F.lit('","clusters":'), "output_result_data", F.lit("}"))
    text = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("The result is:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = table(spark, sf_dir, "sft_records").filter("output_result_data like '[{\"cluster_id\"%'").select("record_id", texts.parsed_output(text).alias("p"))
    return rows.filter("p is not null").select("record_id", F.size("p.clusters").cast("long").alias("clusters"), F.col("p.chain_of_thought").alias("reasoning"))


@_query("SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS BIGINT) AS width FROM documents")
def q_display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P63."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.display_width(F.col("text")).alias("width"))


@_query("SELECT n_nationkey, 'Nation ' || n_name || ' lies in region ' || n_regionkey || '.' AS prompt, substring(n_name, length(n_name) - 3, 2) AS tag FROM nation WHERE length(n_name) >= 4")
def q_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P64, P65, F11."""
    registry = texts.TemplateRegistry()
    registry.add("v1", "Nation {name}.")
    registry.add("v2", "Nation {name} lies in region {region}.")
    prompt = texts.fill_template(registry.get("v2"), {"name": F.col("n_name"), "region": F.col("n_regionkey")})
    return table(spark, sf_dir, "nation").filter("length(n_name) >= 4").select("n_nationkey", prompt.alias("prompt"), texts.file_tag(F.col("n_name"), -4, -2).alias("tag"))


@_query("SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' AS compact FROM nation")
def q_compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P58."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).alias("compact"))


@_query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id")
def q_json_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of JSON texts, decoded element by element."""
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list("props")).alias("list"))
    decoded = packed.select("user_id", catalog.decode_json_list(F.col("list"), "struct<k: bigint>").alias("d"))
    return decoded.select("user_id", F.aggregate("d", F.lit(0).cast("long"), lambda t, x: t + x["k"]).alias("total"), F.size("d").cast("long").alias("n"))


@_query("SELECT record_id, CAST(CASE WHEN t IS NULL OR t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS n FROM (SELECT record_id, trim(regexp_replace(instruction, '[ \t\n\r]+', ' ', 'g')) AS t FROM sft_records)")
def q_record_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blank-separated tokens, counted natively."""
    clean = F.trim(F.regexp_replace("instruction", r"[ \t\n\r]+", " "))
    n = F.when(clean.isNull() | (clean == ""), 0).otherwise(F.size(F.split(clean, " ")))
    return table(spark, sf_dir, "sft_records").select("record_id", n.cast("long").alias("n"))


# ---- geometry ---------------------------------------------------------------------------------
@_query(
    "WITH p AS (SELECT c_custkey, c_custkey * 13 % 20000 AS x, c_custkey * 7 % 9000 AS y, c_custkey * 3 % 7000 AS z FROM customer), d AS (SELECT *, sqrt(pow(x - 1000.0, 2) + pow(y - 2000.0, 2) + pow(z - 3000.0, 2)) AS d FROM p) "
    "SELECT c_custkey, round(d, 6) AS distance, CAST(greatest(0, least(100, trunc(100 * (1 - (d - 100) / 9900)))) AS INT) AS quality, round(x * pi() / 180, 6) AS angle, round(0.001::DOUBLE * (x - 6371), 6) AS nadir FROM d"
)
def q_link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P30, P32, P34 (straight down), P36."""
    key = F.col("c_custkey")
    x, y, z = (key * 13 % 20_000).cast("double"), (key * 7 % 9000).cast("double"), (key * 3 % 7000).cast("double")
    d = geodesy.distance3(x, y, z, F.lit(1000.0), F.lit(2000.0), F.lit(3000.0))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(d, 6).alias("distance"), geodesy.connection_quality(d, 100, 10_000).alias("quality"), F.round(F.radians(x), 6).alias("angle"), F.round(geodesy.nadir_sample_distance(0.001, x, None), 6).alias("nadir")
    )


_CIRCLE_SQL = """
WITH k AS (SELECT s_suppkey, radians(s_suppkey % 90 + 10) AS i, radians(s_suppkey * 17 % 360) AS o, radians(s_suppkey * 29 % 360) AS m, s_suppkey * 60.0::DOUBLE AS t FROM supplier),
     r AS (SELECT *, sqrt(398600.4418 / (7878.137::DOUBLE * 7878.137 * 7878.137)) AS n, 1.5::DOUBLE * 1.08262668e-3 * sqrt(398600.4418 / (7878.137::DOUBLE * 7878.137 * 7878.137)) * (6378.137 / 7878.137::DOUBLE) * (6378.137 / 7878.137::DOUBLE) AS d FROM k),
     u AS (SELECT s_suppkey, i, t, o - d * cos(i) * t AS o, d * (2 - 2.5 * sin(i) * sin(i)) * t + m + (n + d * (1 - 1.5 * sin(i) * sin(i))) * t AS u FROM r),
     p AS (SELECT s_suppkey, t, 7878.137 * (cos(o) * cos(u) - sin(o) * sin(u) * cos(i)) AS x, 7878.137 * (sin(o) * cos(u) + cos(o) * sin(u) * cos(i)) AS y, 7878.137 * sin(u) * sin(i) AS z FROM u)
"""
_FIXED_SQL = _CIRCLE_SQL + """,
     g AS (SELECT *, radians(280.46061837 + 360.98564736629 * ((1735689600 + t - 946728000) / 86400.0)) AS w FROM p),
     f AS (SELECT s_suppkey, cos(w) * x + sin(w) * y AS x, cos(w) * y - sin(w) * x AS y, z FROM g)
"""


def _orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    place = orbits.propagate_j2(
        F.lit(7878.137), F.lit(0.0), (key % 90 + 10).cast("double"), (key * 17 % 360).cast("double"), F.lit(0.0), (key * 29 % 360).cast("double"), key * 60.0
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", (1_735_689_600 + key * 60.0).alias("at"), *(c.alias(n) for n, c in zip("xyz", place, strict=True)))


@_query(_CIRCLE_SQL + "SELECT s_suppkey, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p")
def q_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular orbits, one a supplier; tests have elliptic ones."""
    return _orbits(spark, sf_dir).select("s_suppkey", *(F.round(c, 4).alias(c) for c in "xyz"))


@_query(_FIXED_SQL + "SELECT s_suppkey, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM f")
def q_fixed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8."""
    fixed = orbits.inertial_to_fixed(F.col("x"), F.col("y"), F.col("z"), F.col("at"))
    return _orbits(spark, sf_dir).select("s_suppkey", *(F.round(c, 3).alias(n) for n, c in zip("xyz", fixed, strict=True)))


@_query(
    _FIXED_SQL
    + """, d AS (SELECT s_suppkey, x - 4510.731 AS x, y - 4510.731 AS y, z AS z FROM f), v AS (SELECT s_suppkey, -sin(radians(45)) * x + cos(radians(45)) * y AS e, z AS n, cos(radians(45)) * x + sin(radians(45)) * y AS u, sqrt(x * x + y * y + z * z) AS r FROM d)
SELECT s_suppkey, round((degrees(atan2(e, n)) + 360) % 360, 4) AS azimuth, round(degrees(asin(u / r)), 4) AS elevation, round(r, 3) AS range_km FROM v"""
)
def q_look_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a site on the equator."""
    fixed = orbits.inertial_to_fixed(F.col("x"), F.col("y"), F.col("z"), F.col("at"))
    site = (F.lit(4510.731), F.lit(4510.731), F.lit(0.0))
    found = orbits.azimuth_elevation_range(F.lit(0.0), F.lit(45.0), site, fixed)
    return _orbits(spark, sf_dir).select("s_suppkey", *(F.round(c, d).alias(n) for n, c, d in zip(("azimuth", "elevation", "range_km"), found, (4, 4, 3), strict=True)))


@_query(
    """
WITH k AS (SELECT s_suppkey, radians(s_suppkey % 90 + 10) AS i, radians(s_suppkey * 17 % 360) AS o, (1735689600 + s_suppkey * 600.0 - 946728000) / 86400.0 AS d FROM supplier),
     m AS (SELECT *, radians(357.528 + 0.9856003 * d) AS g, radians(23.439 - 0.0000004 * d) AS t FROM k),
     l AS (SELECT *, radians(280.460 + 0.9856474 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM m)
SELECT s_suppkey, round(degrees(asin(sin(o) * sin(i) * cos(l) - cos(o) * sin(i) * cos(t) * sin(l) + cos(i) * sin(t) * sin(l))), 4) AS beta FROM l
"""
)
def q_sun_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    key = F.col("s_suppkey")
    beta = orbits.beta_angle((key % 90 + 10).cast("double"), (key * 17 % 360).cast("double"), 1_735_689_600 + key * 600.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(beta, 4).alias("beta"))


@_query(
    _CIRCLE_SQL
    + """, q AS (SELECT *, 9000.0 - x AS dx, 0 - y AS dy, 0 - z AS dz FROM p), c AS (SELECT *, greatest(0, least(1, -(x * dx + y * dy + z * dz) / (dx * dx + dy * dy + dz * dz))) AS k FROM q)
SELECT s_suppkey, NOT (pow(x + k * dx, 2) + pow(y + k * dy, 2) + pow(z + k * dz, 2) < 6378.137 * 6378.137 AND k > 0 AND k < 1) AS seen FROM c"""
)
def q_line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    seen = orbits.line_of_sight(tuple(F.col(c) for c in "xyz"), (F.lit(9000.0), F.lit(0.0), F.lit(0.0)))
    return _orbits(spark, sf_dir).select("s_suppkey", seen.alias("seen"))


# ---- graphs -----------------------------------------------------------------------------------
_EDGES_SQL = "WITH s AS (SELECT DISTINCT snapshot_id, sat_attrs, sat_edges, target_edges FROM snapshots), e AS (SELECT snapshot_id, unnest(sat_edges) AS e FROM s), w AS (SELECT snapshot_id, e.from_id AS a, e.to_id AS b, e.w AS w FROM e WHERE e IS NOT NULL)\n"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snapshots").select("snapshot_id", "sat_attrs", "sat_edges", "target_edges").distinct()


def _sat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snapshots(spark, sf_dir).select("snapshot_id", F.explode("sat_edges").alias("e")).filter("e is not null")
    return rows.select("snapshot_id", F.col("e.from_id").alias("a"), F.col("e.to_id").alias("b"), F.col("e.w").alias("w"))


@_query(_EDGES_SQL + "SELECT least(a, b) AS a, greatest(a, b) AS b, round(1 / (arg_max(w, (snapshot_id, w)) + 1e-6), 6) AS length FROM w WHERE a <> b AND w IS NOT NULL GROUP BY 1, 2")
def q_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel and reversed edges become one, the last snapshot's."""
    edges = graph.undirected(_sat_edges(spark, sf_dir).filter("w is not null"), "a", "b", "w", "snapshot_id")
    return edges.select("a", "b", F.round(graph.inverse_weight(F.col("weight")), 6).alias("length"))


@_query(
    _EDGES_SQL
    + ", n AS (SELECT DISTINCT snapshot_id, unnest(sat_attrs).id AS id FROM s) SELECT snapshot_id, a, b, count(*) AS n FROM w WHERE EXISTS (SELECT 1 FROM n WHERE n.snapshot_id = w.snapshot_id AND id = a) AND EXISTS (SELECT 1 FROM n WHERE n.snapshot_id = w.snapshot_id AND id = b) GROUP BY ALL"
)
def q_known_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are satellites of the same snapshot."""
    both = F.struct
    edges = _sat_edges(spark, sf_dir).select("snapshot_id", "a", "b", both("snapshot_id", F.col("a").alias("id")).alias("x"), both("snapshot_id", F.col("b").alias("id")).alias("y"))
    nodes = _snapshots(spark, sf_dir).select("snapshot_id", F.explode("sat_attrs").alias("s")).select(both("snapshot_id", F.col("s.id").alias("id")).alias("k"))
    return graph.known_ends(edges, "x", "y", nodes, "k").groupBy("snapshot_id", "a", "b").agg(F.count("*").alias("n"))


@_query(_EDGES_SQL + "SELECT snapshot_id, a, b, w FROM w WHERE a = 111 OR b = 111")
def q_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, G3."""
    return graph.incident(_sat_edges(spark, sf_dir), "a", "b", 111)


@_query(_EDGES_SQL + "SELECT a, list_sort(list(DISTINCT b)) AS items FROM w WHERE a IS NOT NULL GROUP BY a")
def q_edges_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, A10."""
    return graph.neighbours(_sat_edges(spark, sf_dir).filter("a is not null"), "a", "b")


@_query(
    _EDGES_SQL
    + "SELECT 'sat_attrs' AS kind, count(*) AS n FROM (SELECT unnest(sat_attrs) AS e FROM s) WHERE e IS NOT NULL UNION ALL SELECT 'sat_edges', count(*) FROM w UNION ALL SELECT 'target_edges', count(*) FROM (SELECT unnest(target_edges) AS e FROM s) WHERE e IS NOT NULL"
)
def q_element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    from skyloom.operators.nested import flatten_arrays

    return flatten_arrays(table(spark, sf_dir, "snapshots")).groupBy(F.col("child").alias("kind")).agg(F.count("*").alias("n"))


@_query(
    "WITH p AS (SELECT snapshot_id, unnest(sat_attrs) AS e FROM (SELECT DISTINCT snapshot_id, sat_attrs, sat_edges, target_edges FROM snapshots)), q AS (SELECT snapshot_id, e.pos[1] AS x, e.pos[2] AS y, e.pos[3] AS z FROM p WHERE len(e.pos) = 3 AND e.pos[1] IS NOT NULL AND e.pos[2] IS NOT NULL AND e.pos[3] IS NOT NULL), "
    "m AS (SELECT snapshot_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM q GROUP BY snapshot_id) SELECT snapshot_id, round(any_value(mx), 3) AS mx, round(max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))), 3) AS reach FROM q JOIN m USING (snapshot_id) GROUP BY snapshot_id"
)
def q_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    rows = _snapshots(spark, sf_dir).select("snapshot_id", F.explode("sat_attrs").alias("s")).filter(F.size("s.pos") == 3)
    points = rows.select("snapshot_id", *(F.col("s.pos")[i].alias(c) for i, c in enumerate("xyz"))).dropna()
    return graph.spread(points, "snapshot_id").select("snapshot_id", F.round("mx", 3).alias("mx"), F.round("reach", 3).alias("reach"))


_MEMBERS_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
     e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM l x JOIN l y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= 2),
     both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     m AS (SELECT s_suppkey AS node, s_nationkey AS grp, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS master FROM supplier)
"""


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as nodes, nations as their groups, and how many orders two of them share, from two on."""
    from skyloom.plans.catalog import _co_supply

    supplier = table(spark, sf_dir, "supplier")
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("master"))
    members = supplier.join(first, "s_nationkey").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("group"), "master")
    return members, materialize(_co_supply(spark, sf_dir), "cosupply")


@_query(
    _MEMBERS_SQL
    + """, r AS (SELECT node, grp, 0::BIGINT AS hop FROM m WHERE node = master UNION SELECT y.node, r.grp, r.hop + 1 FROM r JOIN both_ways b ON b.a = r.node JOIN m y ON y.node = b.b AND y.grp = r.grp WHERE r.hop < 2),
     h AS (SELECT node, grp, min(hop) AS hop FROM r GROUP BY ALL)
SELECT m.node, CAST(m.grp AS INT) AS "group", h.hop FROM m LEFT JOIN h USING (node, grp)"""
)
def q_hops_to_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    members, edges = _groups(spark, sf_dir)
    return graph.hops_to_master(edges, "a", "b", members, 2).select("node", "group", "hop")


@_query(
    _MEMBERS_SQL
    + """, x AS (SELECT DISTINCT p.grp AS a, q.grp AS b FROM e JOIN m p ON p.node = e.a JOIN m q ON q.node = e.b WHERE e.n >= 4 AND p.grp <> q.grp), xx AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
     c AS (SELECT DISTINCT grp, grp AS other FROM m UNION SELECT c.grp, xx.b FROM c JOIN xx ON xx.a = c.other), f AS (SELECT grp, min(other) AS least FROM c GROUP BY grp)
SELECT m.node, CAST(least AS INT) AS "group" FROM m JOIN f USING (grp)"""
)
def q_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    members, edges = _groups(spark, sf_dir)
    return graph.merge_groups(members.select("node", "group"), edges, "a", "b", "n", 4)


@_query(
    _MEMBERS_SQL
    + """, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT CAST(m.grp AS INT) AS "group", m.node AS master FROM m JOIN supplier ON s_suppkey = m.node LEFT JOIN d ON d.node = m.node QUALIFY row_number() OVER (PARTITION BY m.grp ORDER BY floor(s_acctbal / 5000) DESC, coalesce(degree, 0) DESC, m.node) = 1"""
)
def q_choose_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    members, edges = _groups(spark, sf_dir)
    health = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_acctbal") / 5000).cast("double").alias("health"))
    return graph.choose_masters(members.select("group", "node"), health, edges, "a", "b").select("group", "master")


@_query(
    _MEMBERS_SQL
    + """, i AS (SELECT coalesce(avg(n / 100), 0) AS link FROM e JOIN m p ON p.node = e.a JOIN m q ON q.node = e.b WHERE p.grp = q.grp),
     t AS (SELECT l_partkey AS target, l_suppkey AS node, l_discount AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_suppkey) = 1),
     z AS (SELECT grp, count(DISTINCT node) AS sats FROM m GROUP BY grp), v AS (SELECT grp, count(DISTINCT target) AS targets FROM t JOIN m USING (node) GROUP BY grp),
     o AS (SELECT count_if(sats > coalesce(targets, 0)) AS oversized FROM z LEFT JOIN v USING (grp)),
     h AS (SELECT avg(s_acctbal / 10000) AS health FROM (SELECT DISTINCT master FROM m) JOIN supplier ON s_suppkey = master),
     k AS (SELECT link, (SELECT avg(q) FROM t) AS quality, (SELECT count(DISTINCT grp) / count(DISTINCT node) FROM m) AS groups, health, oversized FROM i, h, o)
SELECT round(link, 6) AS link, round(quality, 6) AS quality, round(groups, 6) AS groups, round(health, 6) AS health, oversized, round(0.4 * link + 0.3 * quality - 0.2 * groups + 0.1 * health, 6) AS score FROM k"""
)
def q_grouping_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, G11."""
    members, edges = _groups(spark, sf_dir)
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 10_000).alias("health"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("q"))
    masters = members.select("group", "master").distinct()
    found = graph.grouping_scores(members.select("group", "node"), masters, nodes, edges.select("a", "b", (F.col("n") / 100).alias("w")), seen)
    return found.select(*(F.round(c, 6).alias(c) for c in ("link", "quality", "groups", "health")), "oversized", F.round("score", 6).alias("score"))


@_query()
def q_principal_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the coordinates, as their signs are free; no SQL has eigenvectors, tests compare with numpy."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") * 3).cast("double").alias("y"), F.length("o_orderpriority").cast("double").alias("z"))
    return graph.principal_plane(rows, "id").select("id", F.round(F.col("u") * F.col("u"), 2).alias("u2"), F.round(F.col("v") * F.col("v"), 2).alias("v2"))


# ---- calls and streams ------------------------------------------------------------------------
@_query("SELECT doc_id, 'lang ' || lang AS reasoning, upper(source) AS content FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def q_record_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call a record, answered by a stand-in that streams its answer in pieces."""

    def make_client():
        def answer(prompt: str):
            lang, source = prompt.split("|", 1)
            text = f"<thought>lang {lang}</thought>{source.upper()}"
            return [text[i : i + 7] for i in range(0, len(text), 7)]

        return answer

    rows = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").select("doc_id", F.concat_ws("|", "lang", "source").alias("p"))
    return calls.map_records(rows, "doc_id", "p", make_client, per_minute=1e9).select("doc_id", "reasoning", "content")


@_query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, counted in windows of a day; every micro-batch replaces the result."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counted = streams.tumbling(stream, "ts", ["event_type"], "1 day", "1 hour")
    out = work_path(spark, "stream")
    writer = counted.writeStream.outputMode("complete").option("checkpointLocation", work_path(spark, "checkpoint")).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(out).select("event_type", F.unix_micros("start").alias("start_us"), "n")
