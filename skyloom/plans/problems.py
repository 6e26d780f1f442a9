"""The pN_ queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.intervals import merge_intervals
from skyloom.operators.nearby import SphereTree, contained, near_pairs, region_edges, valid_place
from skyloom.operators.nested import flatten_arrays, flatten_json
from skyloom.operators.timestamps import InstantDictionary, normalize_timestamps
from skyloom.session import table


def timestamp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timestamp texts with their feed's zone and date order: src, row_id, pos, text, tz_name, date_order."""
    feeds = table(spark, sf_dir, "feeds").select("feed_id", "tz_name", "date_order")

    def plain(name: str, key: str, text: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("src"), F.col(key).alias("row_id"), F.lit(0).cast("long").alias("pos"), F.col(text).alias("text"), "feed_id"
        )

    listed = table(spark, sf_dir, "target_access").select(
        "access_id", "feed_id", F.posexplode("access_times").alias("pos", "text")
    )
    rows = (
        plain("access_events", "event_id", "start_time")
        .unionByName(plain("snapshots", "snapshot_id", "snap_timestamp"))
        .unionByName(plain("target_list", "rec_id", "last_access_date"))
        .unionByName(
            listed.select(
                F.lit("target_access").alias("src"), F.col("access_id").alias("row_id"), F.col("pos").cast("long").alias("pos"), "text", "feed_id"
            )
        )
    )
    return rows.join(feeds, "feed_id", "left").drop("feed_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``spark.skyloom.instants`` set to a path, the dictionary of all loads so far is kept there."""
    path = spark.conf.get("spark.skyloom.instants", None)
    dictionary = InstantDictionary(spark, path) if path else None
    normalised = normalize_timestamps(timestamp_rows(spark, sf_dir), "text", "tz_name", "date_order", dictionary=dictionary)
    return normalised.filter(F.col("utc_us").isNotNull()).select("src", "row_id", "pos", "utc_us").distinct()


_ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"


def p1_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p1 that SQL can express: texts in ISO form with their own zone, through the same operator."""
    rows = timestamp_rows(spark, sf_dir).filter(F.col("text").rlike(_ISO.removesuffix("$") + r"\z"))
    normalised = normalize_timestamps(rows, "text", "tz_name", "date_order")
    return normalised.filter(F.col("utc_us").isNotNull()).select("src", "row_id", "pos", "utc_us").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.lit("d MMM yyyy HH:mm:ss.SSS")
    windows = table(spark, sf_dir, "access_windows").select(
        "satellite_name",
        F.unix_millis(F.try_to_timestamp(F.trim("start_time"), form)).alias("start_ms"),
        F.unix_millis(F.try_to_timestamp(F.trim("end_time"), form)).alias("end_ms"),
    )
    return merge_intervals(windows.filter(F.trim("satellite_name") != ""), "satellite_name", "start_ms", "end_ms")


NEAR_KM = 2.0


def target_tree(spark: SparkSession, sf_dir: str) -> SphereTree:
    """Valid places of target_list (side 0) and observation_targets (side 1), for pairs within ``NEAR_KM``."""
    targets = table(spark, sf_dir, "target_list").select(
        F.lit(0).alias("side"), F.col("id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    places = table(spark, sf_dir, "observation_targets").select(
        F.lit(1).alias("side"), F.col("obs_id").alias("id"), F.get("target_coords", F.lit(0)).alias("lon"), F.get("target_coords", F.lit(1)).alias("lat")
    )
    both = targets.unionByName(places)
    return SphereTree(both.filter(F.col("id").isNotNull() & valid_place(F.col("lon"), F.col("lat"))), NEAR_KM)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = target_tree(spark, sf_dir)
    pairs = near_pairs(tree, NEAR_KM)
    regions = region_edges(table(spark, sf_dir, "watch_regions"), "region_no", "ring_lon", "ring_lat")
    inside = contained(tree, regions)
    near = pairs.select(F.when(F.col("b_side") == 0, "tt").otherwise("ot").alias("kind"), "a_id", "b_id")
    return near.unionByName(inside.select(F.lit("tr").alias("kind"), F.col("region").alias("a_id"), F.col("id").alias("b_id")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = flatten_arrays(table(spark, sf_dir, "snapshots"))
    texts = flatten_json(table(spark, sf_dir, "raw_records"), "snapshot_id", "body")
    return typed.unionByName(texts).select("snapshot_id", "child", "ord", "a_id", "b_id")


def p6_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p6 that SQL can express: the typed snapshots."""
    return flatten_arrays(table(spark, sf_dir, "snapshots")).select("snapshot_id", "child", "ord", "a_id", "b_id")


QUERIES = {"p1_found": p1_found, "p1_iso": p1_iso, "p6_typed": p6_typed, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found}

ORACLE_SQL = {
    "p1_iso": f"""
WITH t AS (SELECT 'access_events' AS src, event_id AS row_id, 0::BIGINT AS pos, start_time AS t FROM access_events
           UNION ALL SELECT 'snapshots', snapshot_id, 0, snap_timestamp FROM snapshots UNION ALL SELECT 'target_list', rec_id, 0, last_access_date FROM target_list
           UNION ALL SELECT 'target_access', access_id, unnest(range(len(access_times))), unnest(access_times) FROM target_access)
SELECT DISTINCT src, row_id, pos, epoch_us(TRY_CAST(t AS TIMESTAMPTZ)) AS utc_us FROM t WHERE regexp_matches(t, '{_ISO}') AND TRY_CAST(t AS TIMESTAMPTZ) IS NOT NULL
""",
    "p6_typed": """
WITH s AS (SELECT DISTINCT snapshot_id, sat_attrs, sat_edges, target_edges FROM snapshots),
     e AS (
       SELECT snapshot_id, 'sat_attrs' AS child, list_transform(list_filter(sat_attrs, lambda x: x IS NOT NULL), lambda x: {'a': x.id, 'b': 0}) AS l FROM s
       UNION ALL SELECT snapshot_id, 'sat_edges', list_transform(list_filter(sat_edges, lambda x: x IS NOT NULL), lambda x: {'a': x.from_id, 'b': x.to_id}) FROM s
       UNION ALL SELECT snapshot_id, 'target_edges', list_transform(list_filter(target_edges, lambda x: x IS NOT NULL), lambda x: {'a': x.from_id, 'b': x.to_id}) FROM s),
     u AS (SELECT snapshot_id, child, unnest(range(1, len(l) + 1)) AS ord, unnest(l) AS r FROM e)
SELECT snapshot_id, child, ord, CAST(r.a AS BIGINT) AS a_id, CAST(r.b AS BIGINT) AS b_id FROM u
""",
    "p3_found": """
WITH w AS (
       SELECT satellite_name, epoch_ms(try_strptime(trim(start_time), '%d %b %Y %H:%M:%S.%f')) AS s,
              epoch_ms(try_strptime(trim(end_time), '%d %b %Y %H:%M:%S.%f')) AS e
       FROM access_windows WHERE trim(satellite_name) <> ''),
     v AS (SELECT * FROM w WHERE e > s),
     m AS (SELECT *, max(e) OVER (PARTITION BY satellite_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY satellite_name ORDER BY s, e) AS no FROM m),
     p AS (SELECT satellite_name, no, min(s) AS s, max(e) AS e FROM g GROUP BY satellite_name, no),
     n AS (SELECT *, lead(s) OVER (PARTITION BY satellite_name ORDER BY s) AS following FROM p)
SELECT satellite_name, 'period' AS kind, s AS start_ms, e AS end_ms FROM n
UNION ALL
SELECT satellite_name, 'gap', e, following FROM n WHERE following IS NOT NULL
""",
    "p5_found": """
WITH t AS (
       SELECT DISTINCT id, lon, lat FROM (
         SELECT id, longitude - 360 * floor((longitude + 180) / 360) AS lon, latitude AS lat FROM target_list
         WHERE id IS NOT NULL AND longitude BETWEEN -180 AND 360 AND latitude BETWEEN -90 AND 90 AND NOT (longitude = 0 AND latitude = 0))),
     o AS (
       SELECT DISTINCT id, lon, lat FROM (
         SELECT obs_id AS id, target_coords[1] - 360 * floor((target_coords[1] + 180) / 360) AS lon, target_coords[2] AS lat
         FROM observation_targets
         WHERE obs_id IS NOT NULL AND target_coords[1] BETWEEN -180 AND 360 AND target_coords[2] BETWEEN -90 AND 90
           AND NOT (target_coords[1] = 0 AND target_coords[2] = 0))),
     every AS (SELECT 0 AS side, * FROM t UNION ALL SELECT 1, * FROM o),
     xyz AS (
       SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM every),
     cells AS (SELECT *, CAST(floor(x * 3000) AS BIGINT) AS cx, CAST(floor(y * 3000) AS BIGINT) AS cy, CAST(floor(z * 3000) AS BIGINT) AS cz FROM xyz),
     around AS (
       SELECT c.*, cx + dx AS nx, cy + dy AS ny, cz + dz AS nz
       FROM cells c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) d(dz)),
     pairs AS (
       SELECT a.side AS a_side, a.id AS a_id, b.side AS b_side, b.id AS b_id
       FROM around a JOIN cells b ON a.nx = b.cx AND a.ny = b.cy AND a.nz = b.cz
       WHERE (a.side < b.side OR (a.side = b.side AND a.id < b.id)) AND a.side = 0
         AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= pow(2 * sin(1.0 / 6371), 2)),
     rings AS (
       SELECT region_no, unnest(ring_lon) AS x1, unnest(ring_lat) AS y1,
              unnest(list_concat(ring_lon[2:], ring_lon[1:1])) AS x2, unnest(list_concat(ring_lat[2:], ring_lat[1:1])) AS y2
       FROM watch_regions),
     turned AS (
       SELECT region_no, turn, x1 + turn AS x1, y1, x2 + turn AS x2, y2 FROM rings, (VALUES (-360), (0), (360)) k(turn)),
     boxes AS (
       SELECT region_no, turn, min(least(x1, x2)) AS x_lo, max(greatest(x1, x2)) AS x_hi, min(y1) AS y_lo, max(y1) AS y_hi
       FROM turned GROUP BY region_no, turn),
     inside AS (
       SELECT r.region_no, r.turn, t.id
       FROM t JOIN boxes b ON t.lon BETWEEN b.x_lo AND b.x_hi AND t.lat BETWEEN b.y_lo AND b.y_hi
       JOIN turned r ON r.region_no = b.region_no AND r.turn = b.turn
       WHERE (r.y1 > t.lat) <> (r.y2 > t.lat) AND t.lon < (r.x2 - r.x1) * (t.lat - r.y1) / (r.y2 - r.y1) + r.x1
       GROUP BY r.region_no, r.turn, t.id, t.lon, t.lat HAVING count(*) % 2 = 1)
SELECT DISTINCT CASE WHEN b_side = 0 THEN 'tt' ELSE 'ot' END AS kind, a_id, b_id FROM pairs
UNION
SELECT 'tr', region_no, id FROM inside
""",
}
