"""Reads and writes of the target catalog: top-k, upserts, JSON columns, schema changes.

Writes are copy-on-write: each takes a DataFrame and gives the changed one. Times are parameters.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_LIST = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("priority", T.LongType()),
        T.StructField("access_period", T.StringType()),
        T.StructField("access", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("last_access_date", T.StringType()),
        T.StructField("freeze_timestamp", T.LongType()),
        T.StructField("target_status", T.LongType()),
        T.StructField("update_at", T.TimestampType()),
    ]
)


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def records(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, in order; an unknown name is an error."""
    return df.select(*(_column(df, c) for c in columns))


def top_k(df: DataFrame, by: str, k: int, tiebreak: str, ascending: bool = False) -> DataFrame:
    """The first ``k`` rows by a column given by name; nulls come last downwards and first upwards."""
    column = _column(df, by)
    order = column.asc_nulls_first() if ascending else column.desc_nulls_last()
    return df.orderBy(order, _column(df, tiebreak)).limit(k)


def open_targets(df: DataFrame, now: int) -> DataFrame:
    """Targets that are free at ``now`` and not yet observed; null in either column is out."""
    return df.filter((F.col("freeze_timestamp") <= now) & (F.col("target_status") == 0))


def top_k_with_ties(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` highest rows and all rows equal to the last of them.

    The k-th value comes from a partial top-k in every task; the rows are then a filter on one
    value, so no task sorts the whole table. Nulls come last and are equal to each other.
    """
    column = _column(df, by)
    cut = (
        df.select(column.alias("v")).orderBy(F.col("v").desc_nulls_last()).limit(k)
        .agg(F.min("v").alias("sk_least"), (F.count("*") > F.count("v")).alias("sk_open"))
    )
    return df.crossJoin(F.broadcast(cut)).filter(F.col("sk_open") | (column >= F.col("sk_least"))).drop("sk_least", "sk_open")  # cut is one row


def limit_then_filter(df: DataFrame, by: str, k: int, tiebreak: str, condition: Column) -> DataFrame:
    """The rows among the first ``k`` that meet ``condition``; the filter never crosses the limit."""
    return top_k(df, by, k, tiebreak).filter(condition)


def insert_or_ignore(table: DataFrame, batch: DataFrame, key: str, order: str, required: list[str] | None = None) -> DataFrame:
    """``table`` and the rows of ``batch`` whose key is new; of equal keys the first by ``order``.

    Rows that lack a required column are ignored. ``order`` may be a column of the batch only; a row
    with a null there comes after the others, and rows equal in it go by their other columns.
    """
    sound = batch.filter(F.col(key).isNotNull())
    for column in required or []:
        sound = sound.filter(F.col(column).isNotNull())
    others = [c for c in sound.columns if c != key]
    rank = F.struct(F.col(order).isNull().alias("sk_late"), F.col(order).alias("sk_order"), F.struct(*others).alias("sk_row"))
    first = sound.groupBy(key).agg(F.min(rank)["sk_row"].alias("r")).select(key, "r.*")
    fresh = first.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def update_where(df: DataFrame, condition: Column, changes: dict[str, Any], stamp: Any = None) -> DataFrame:
    """Rows that meet ``condition`` get ``changes``, and ``update_at`` = ``stamp`` where the table has it; unknown columns are an error."""
    for name in changes:
        _column(df, name)
    every = {**changes, **({"update_at": stamp} if stamp is not None and "update_at" in df.columns else {})}
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns(
        {
            name: F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)).cast(df.schema[name].dataType)
            for name, value in every.items()
        }
    )


def update_in(df: DataFrame, key: str, keys: DataFrame, changes: dict[str, Any], stamp: Any = None) -> DataFrame:
    """``update_where`` for the rows whose key is in the column ``key`` of ``keys``."""
    marked = df.join(keys.select(key).distinct().withColumn("sk_hit", F.lit(True)), key, "left")
    return update_where(marked, F.col("sk_hit"), changes, stamp).drop("sk_hit").select(*df.columns)


def reset_targets(df: DataFrame) -> DataFrame:
    """Every target free, unobserved and without a last date."""
    return update_where(df, F.lit(True), {"freeze_timestamp": 0, "target_status": 0, "last_access_date": ""})


def append_in(df: DataFrame, key: str, keys: DataFrame, column: str, value: Any) -> DataFrame:
    """Append ``value`` to the array of the rows in ``keys``; a null array counts as empty."""
    empty = F.array().cast(df.schema[column].dataType)
    grown = F.array_append(F.coalesce(F.col(column), empty), F.lit(value))
    return update_in(df, key, keys, {column: grown})


def reset_column(df: DataFrame, column: str, value: Any) -> DataFrame:
    return update_where(df, F.lit(True), {column: value})


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A null column of a type, unless there is one of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def alter_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """The column in another type; values that don't fit become null."""
    return df.withColumn(name, F.expr(f"try_cast(`{name}` as {kind})"))


def delete_named(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    return df.join(names.select(key).distinct(), key, "left_anti")


def required_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``lookup`` for its key; a key that isn't there fails the query. ``lookup`` has each key once."""
    found = df.join(lookup.withColumn("sk_there", F.lit(True)), key, "left")
    checked = F.when(F.col("sk_there").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(df.schema[key].dataType)).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("sk_there")


def decode_json_list(column: Column, schema: str) -> Column:
    """A JSON array of JSON texts as an array of structs; broken elements are null."""
    return F.transform(F.from_json(column, "array<string>"), lambda x: F.from_json(x, schema))


def match_in_json_list(df: DataFrame, column: str, value: int) -> DataFrame:
    """One row for each element of a JSON array of numbers equal to ``value``; duplicates are kept."""
    listed = df.withColumn("sk_element", F.explode(F.from_json(_column(df, column), "array<bigint>")))
    return listed.filter(F.col("sk_element") == value).drop("sk_element")


def run_sql(spark, sql: str, tables: dict[str, DataFrame], **parameters: Any) -> DataFrame:
    """SQL over the given tables, with named parameters instead of spliced text."""
    return spark.sql(sql, args=parameters, **{}) if not tables else spark.sql(
        sql.format(**{name: f"{{{name}}}" for name in tables}), args=parameters or None, **tables
    )


def describe(df: DataFrame) -> DataFrame:
    """One row a column: name, type and whether it may be null."""
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(fields, "name string, type string, nullable boolean")


def order_by_priority(df: DataFrame, column: str = "priority", files: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted downwards, so that files written have disjoint min-max ranges."""
    order = F.col(column).desc_nulls_last()
    ranged = df.repartitionByRange(files, order) if files else df.repartitionByRange(order)
    return ranged.sortWithinPartitions(order)
