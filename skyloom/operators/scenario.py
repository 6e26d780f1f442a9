"""The objects of a scenario as a table, changed by copies: path, kind, name, parent and attributes as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "path string, kind string, name string, parent string, attributes string"


@dataclass(frozen=True)
class TimeRange:
    """When a scenario begins and ends; a parameter where it is needed, no state."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("the end lies before the start")

    def moved(self, **changes: datetime) -> TimeRange:
        return replace(self, **changes)

    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()


def new_objects(spark: SparkSession, kind: str, attributes: dict[str, dict[str, Any]], parent: str = "") -> DataFrame:
    """Rows of the table for objects given by name."""
    rows = [(f"{parent}/{kind}/{name}", kind, name, parent, json.dumps(about, ensure_ascii=False)) for name, about in attributes.items()]
    return spark.createDataFrame(rows, OBJECTS)


def add_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """``objects`` and the new ones; a path that is there already keeps its row."""
    return objects.unionByName(new.dropDuplicates(["path"]).join(objects.select("path"), "path", "left_anti").select(*objects.columns))


def replace_kind(objects: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """All objects of a kind, and what hangs below them, give way to the new ones."""
    return delete_objects(objects, objects.filter(F.col("kind") == kind)).unionByName(new.select(*objects.columns))


def attach_to_all(objects: DataFrame, kind: str, child_kind: str, prefix: str, attributes: dict[str, Any]) -> DataFrame:
    """``objects`` with a child for every object of a kind, named after its parent."""
    parents = objects.filter(F.col("kind") == kind)
    name = F.concat(F.lit(prefix), F.col("name"))
    return add_objects(
        objects, parents.select(F.concat_ws("/", "path", F.lit(child_kind), name).alias("path"), F.lit(child_kind).alias("kind"), name.alias("name"), F.col("path").alias("parent"), F.lit(json.dumps(attributes)).alias("attributes"))
    )


def delete_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """``objects`` without those whose path is in ``gone``, nor what hangs below them; the paths None and null name nothing."""
    named = gone.filter("path is not null and path <> 'None'").select(F.col("path").alias("sk_gone")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = objects.withColumn("sk_gone", F.explode(above)).join(named, "sk_gone", "left_semi").select("path").distinct()
    return objects.join(hit, "path", "left_anti").select(*objects.columns)


def set_attributes(objects: DataFrame, path: str, changes: dict[str, Any], known: list[str]) -> DataFrame:
    """The object's attributes with ``changes``; an attribute that isn't ``known`` is an error."""
    unknown = sorted(set(changes) - set(known))
    if unknown:
        raise ValueError(f"unknown attributes: {', '.join(unknown)}")
    texts = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in changes.items()}
    old = F.from_json("attributes", "map<string, string>")
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string, string>")), lambda k, v: ~k.isin(list(texts)))
    new = F.to_json(F.map_concat(kept, F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))))
    return objects.withColumn("attributes", F.when(F.col("path") == path, new).otherwise(F.col("attributes")))
