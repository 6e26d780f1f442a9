"""Writers of records. Each task commits its own files, so no lock is needed and a retried task leaves no second copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.texts import pair_key
from skyloom.functions.times import simulator_text
from skyloom.session import materialize


def write_intervals(intervals: DataFrame, path: str) -> None:
    """src, dst, start_time, end_time and seconds as an interval file with a header."""
    rows = intervals.select(
        pair_key(F.col("src"), F.col("dst")).alias("pair"), simulator_text(F.col("start_time")).alias("start_time"), simulator_text(F.col("end_time")).alias("end_time"), "seconds"
    )
    rows.write.mode("overwrite").option("header", True).csv(path)


def flatten_interval_map(rows: DataFrame, column: str) -> DataFrame:
    """pair, start_time, end_time and seconds of a map from pairs to arrays of such intervals; a pair without one has no row."""
    listed = rows.select(F.explode(column).alias("pair", "list"))
    return listed.select("pair", F.explode("list").alias("i")).select("pair", "i.*")


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def json_array(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row with one JSON array of all rows, in order: for documents that are small by nature, since an array is one value."""
    value = F.struct(*rows.columns)
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("v"))))
    return rows.agg(F.to_json(F.transform(listed, lambda e: e["v"]), {"ignoreNullFields": "false"}).alias("value"))


def json_to_lines(spark: SparkSession, path: str, schema: str, out: str | None = None) -> str:
    """A JSON array file as lines; the target's name is the source's with .jsonl where none is given. Text is kept as it is."""
    target = out or f"{path.removesuffix('.json')}.jsonl"
    write_json_lines(spark.read.schema(schema).option("multiLine", True).json(path), target)
    return target


def split_rejects(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """Sound rows and the others, apart; null counts as not sound."""
    good = F.coalesce(sound, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def error_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines of an output in which failures were mixed as ``ERROR: {json}``: the sound lines, and the JSON of the others."""
    failed = F.col(column).startswith("ERROR:")
    return lines.filter(~F.coalesce(failed, F.lit(False))), lines.filter(failed).select(F.trim(F.expr(f"substring(`{column}`, 7)")).alias(column))


def resume(rows: DataFrame, key: str, path: str, make, schema: str) -> DataFrame:
    """Add to the table at ``path`` what ``make`` gives for rows whose key isn't there yet, and read all.

    A run that was cut off goes on where it stopped, and one that is repeated adds nothing.
    """
    from skyloom.sources.readers import path_exists

    spark = rows.sparkSession
    done = spark.read.schema(schema).parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else spark.createDataFrame([], schema)
    fresh = materialize(make(rows.join(done.select(key), key, "left_anti")), "resume")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered_prompts(rows: DataFrame, order: list[str], text: str, mark: str = "=" * 20) -> DataFrame:
    """no and value: each text under a numbered separator, in order."""
    from skyloom.operators.visibility import numbered

    head = F.concat(F.lit(f"{mark} PROMPT "), F.col("no"), F.lit(f" {mark}\n\n"))
    return numbered(rows, order).select("no", F.concat(head, F.col(text), F.lit("\n\n")).alias("value"))
