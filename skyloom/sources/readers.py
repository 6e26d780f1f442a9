"""Readers of records, intervals, prompts and scenario files. Schemas are given, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.times import instant

CONVERSATION = "messages array<struct<role: string, content: string>>"
INTERVAL_COLUMNS = ("pair", "start_time", "end_time", "seconds")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row an element of a JSON array, or one row for a single object; a broken file gives one row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A .json file (array or object), or .jsonl with one object a line; blank lines are skipped.

    sk_corrupt holds the text of a line that didn't parse, else null. Another suffix is an error.
    """
    wide = f"{schema}, sk_corrupt string"
    reader = spark.read.schema(wide).option("columnNameOfCorruptRecord", "sk_corrupt")
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """record (the line's number order is not kept; a hash of the text names it), system, user and assistant of chat records."""
    from skyloom.functions.texts import content_of

    rows = read_records(spark, path, CONVERSATION)
    m = F.col("messages")
    return rows.select(F.xxhash64(F.to_json(m)).alias("record"), *(content_of(m, role).alias(role) for role in ("system", "user", "assistant")), "sk_corrupt")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, start_time, end_time (instants) and seconds of an interval file with a header; its columns go by place.

    Rows whose pair is empty or isn't of two parts are left out.
    """
    from skyloom.functions.texts import split_pair

    schema = T.StructType([T.StructField(c, T.StringType()) for c in INTERVAL_COLUMNS])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    pair = split_pair(F.col("pair"))
    return rows.filter(pair.isNotNull()).select(
        pair["a"].alias("src"), pair["b"].alias("dst"), instant(F.col("start_time")).alias("start_time"), instant(F.col("end_time")).alias("end_time"),
        F.col("seconds").try_cast("double").alias("seconds"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_sibling(spark: SparkSession, path: str, part: str, sibling: str, read, empty_schema: str) -> DataFrame:
    """What ``read`` makes of the file beside ``path`` with ``part`` of its name replaced; an empty table where there is none."""
    folder, name = os.path.split(path)
    beside = f"{folder}/{name.replace(part, sibling)}"
    if part not in name or not path_exists(spark, beside):
        return spark.createDataFrame([], empty_schema)
    return read(spark, beside)


def split_records(text: Column, mark: str) -> Column:
    """The parts of a text between marks (a pattern), trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, mark), lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def read_prompts(spark: SparkSession, path: str, mark: str = r"=+ PROMPT \d+ =+") -> DataFrame:
    """path, no (from 1) and prompt: the parts of each text file between its marks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(split_records(F.col("value"), mark)).alias("at", "prompt"))
    return files.select("path", (F.col("at") + 1).cast("long").alias("no"), "prompt")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and line_no (from 1) of the lines that are no JSON; blank lines are skipped.

    A file is read whole, as a line's number depends on all lines before it.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return files.filter((F.trim("line") != "") & F.try_parse_json("line").isNull()).select("path", (F.col("at") + 1).cast("long").alias("line_no"))


def _block(text: Column, name: str) -> Column:
    """The lines between BEGIN name and END name."""
    return F.regexp_extract(text, rf"(?s)BEGIN {name}\b(.*?)END {name}\b", 1)


def _field(text: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?m)^[ \t]*{name}[ \t]+(.+?)[ \t]*$", 1))


def read_ephemeris(spark: SparkSession, path: str) -> DataFrame:
    """object_id, frame, epoch, t, x, y, z, vx, vy, vz (metres, as the file has them) of scenario objects' ephemeris blocks.

    An object's file is read whole; its points are rows of seven numbers after the block's header.
    """
    files = spark.read.text(path, wholetext=True)
    block = _block(F.col("value"), "Ephemeris")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    head = files.select(name.alias("object_id"), _field(block, "CoordinateSystem").alias("frame"), _field(block, "ScenarioEpoch").alias("epoch"), block.alias("b"))
    lines = head.select("object_id", "frame", "epoch", F.explode(F.split("b", "\r?\n")).alias("line"))
    numbers = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(F.size(numbers) == 7).select("object_id", "frame", "epoch", F.transform(numbers, lambda n: n.try_cast("double")).alias("n"))
    sound = rows.filter(~F.exists("n", F.isnull))
    return sound.select("object_id", "frame", "epoch", *(F.col("n")[i].alias(c) for i, c in enumerate(("t", "x", "y", "z", "vx", "vy", "vz"))))


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """sensor, inner and outer half angle (degrees) and most_m of conical sensors; null where a file lacks one."""
    files = spark.read.text(path, wholetext=True)
    number = lambda field: F.regexp_extract(_field(F.col("value"), field), r"([-+0-9.eE]+)\s*$", 1).try_cast("double")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return files.select(name.alias("sensor"), number("InnerConeHalfAngle").alias("inner"), number("OuterConeHalfAngle").alias("outer"), number("MaxRange").alias("most_m"))


def read_members(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """group, no and member: the lines of a file that begin with a keyword and name an object's path, in order."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    found = F.regexp_extract_all(F.col("value"), F.lit(rf"(?m)^[ \t]*{keyword}[ \t]+(\S+)"), F.lit(1))
    return files.select(name.alias("group"), F.posexplode(found).alias("at", "member")).select("group", (F.col("at") + 1).cast("long").alias("no"), "member")


def objects_of(listing: Column) -> Column:
    """The object paths of a listing separated by blanks; an empty array where it is null, blank or None."""
    return F.filter(F.split(F.coalesce(F.trim(listing), F.lit("")), r"\s+"), lambda p: (p != "") & (p != "None"))


def path_part(path: Column, kind: str) -> Column:
    """The name that follows a kind in a path such as /Scenario/s/Satellite/a/Sensor/b; null without it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, kind)
    return F.when(at > 0, F.get(parts, at.cast("int")))


def sensors_of(paths: DataFrame, column: str = "path") -> DataFrame:
    """sensor, satellite and full_path of the paths that name both."""
    p = F.col(column)
    return paths.select(path_part(p, "Sensor").alias("sensor"), path_part(p, "Satellite").alias("satellite"), p.alias("full_path")).dropna(subset=["sensor", "satellite"])


def children_of(objects: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensors with their satellite's row: joined on the name parsed from the path, so that Satellite1 isn't taken for a part of Satellite111."""
    return sensors_of(sensors).join(objects, "satellite")


def positions(ephemeris: DataFrame, start: float, period: float, step: int, names: list[str] | None = None, first_only: bool = False) -> DataFrame:
    """The ephemeris rows on a grid from ``start`` over ``period`` seconds, of the named objects or all; the first a time
    each with ``first_only``. Values are rounded to three places."""
    rows = ephemeris.filter(F.col("t").between(start, start + period) & (F.pmod(F.col("t") - start, F.lit(step)) == 0))
    if names is not None:
        rows = rows.filter(F.col("object_id").isin(names))
    rows = rows.select("object_id", "t", *(F.round(c, 3).alias(c) for c in "xyz"))
    if first_only:
        rows = rows.groupBy("object_id").agg(F.min_by(F.struct("t", "x", "y", "z"), "t").alias("p")).select("object_id", "p.*")
    return rows


def synthetic_snapshots(spark: SparkSession, n: int, start: int = 0, step: int = 10, seed: int = 7, sats: int = 36, targets: int = 50) -> DataFrame:
    """``n`` graph snapshots ``step`` seconds apart: t, strategy, sat_attrs, sat_edges and target_edges.

    Each has 10 to 30 satellite edges with weights from 0.2 to 1 and 10 to 40 target edges from
    satellites that have an edge. All follows from the seed and t, so a retried task makes the same.
    """
    rows = spark.range(n).select((F.col("id") * step + start).alias("t"))
    draw = lambda *salt: (F.pmod(F.xxhash64("t", F.lit(seed), *(s if isinstance(s, Column) else F.lit(s) for s in salt)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    whole = lambda low, high, *salt: (low + F.floor(draw(*salt) * (high - low + 1))).cast("int")
    edge = lambda i: F.struct(whole(0, sats - 1, "a", i).alias("x"), whole(1, sats - 1, "b", i).alias("y"), F.round(0.2 + 0.8 * draw("w", i), 2).alias("w"))
    rows = rows.withColumn("e", F.transform(F.sequence(F.lit(1), whole(10, 30, "n")), edge))
    rows = rows.withColumn("sat_edges", F.transform("e", lambda e: F.struct((111 + e["x"]).alias("from_id"), (111 + (e["x"] + e["y"]) % sats).alias("to_id"), e["w"].alias("w"))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("sat_edges", lambda e: F.array(e["from_id"], e["to_id"])))))
    rows = rows.withColumn("ids", ids)
    rows = rows.withColumn("sat_attrs", F.transform("ids", lambda i: F.struct(i.alias("id"), F.round(draw("h", i), 2).alias("health"), F.transform(F.array(*map(F.lit, "xyz")), lambda a: F.round(7000 * (2 * draw(a, i) - 1), 3)).alias("pos"))))
    seen = lambda i: F.struct(F.get("ids", F.floor(draw("s", i) * F.size("ids")).cast("int")).alias("from_id"), whole(1, targets, "t", i).alias("to_id"), F.round(draw("q", i), 2).alias("q"))
    rows = rows.withColumn("target_edges", F.transform(F.sequence(F.lit(1), whole(10, 40, "m")), seen))
    strategy = F.when(draw("z") < 0.5, "balanced").otherwise("quality")
    return rows.select("t", strategy.alias("strategy"), "sat_attrs", "sat_edges", "target_edges")


def synthetic_targets(spark: SparkSession, n: int, bases: list[tuple[float, float]], cities: list[tuple[float, float]], seed: int = 7, jitter: float = 0.05) -> DataFrame:
    """``n`` ballistic targets: name, epoch_second (0–300), speed (3–10), altitude (100–1500), start lat and lon near a base and
    impact lat and lon near a city."""
    draw = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    near = lambda places, axis, salt: F.round(F.get(F.array(*(F.lit(p[axis]) for p in places)), F.floor(draw(salt) * len(places)).cast("int")) + jitter * (2 * draw(f"{salt}{axis}") - 1), 4)
    return spark.range(1, n + 1).select(
        F.concat(F.lit("m"), F.col("id")).alias("name"), F.floor(draw("e") * 301).alias("epoch_second"), F.round(3 + 7 * draw("v"), 2).alias("speed"), F.round(100 + 1400 * draw("h"), 1).alias("altitude"),
        near(bases, 0, "b").alias("lat"), near(bases, 1, "b").alias("lon"), near(cities, 0, "c").alias("impact_lat"), near(cities, 1, "c").alias("impact_lon"),
    )
