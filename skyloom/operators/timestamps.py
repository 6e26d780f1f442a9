"""Timestamps of mixed formats and zones, normalised through a dictionary of distinct texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.instants import parse_instant
from skyloom.session import work_path

_KEY = ["sk_text", "sk_zone", "sk_order"]
_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _KEY] + [T.StructField("sk_utc_us", T.LongType())]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, zones, orders = (batch.column(i).to_pylist() for i in range(3))
        instants = [parse_instant(t, z or None, o or None) for t, z, o in zip(texts, zones, orders, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(instants, pa.int64())],
            names=[*_KEY, "sk_utc_us"],
        )


class InstantDictionary:
    """A persisted table of every distinct (text, zone, date order) and its instant.

    Each entry is parsed once in its life: ``extend`` parses only keys that the stored table
    doesn't hold and appends them. Texts that determine no instant are kept too, with null, so
    that they aren't tried again. ``path`` is kept; it has to lie in storage that all executors
    reach. Two writers, or a run that is retried, may append a key twice; readers get it once.
    After a change of the parser's rules a new path is due.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return bool(files.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")))

    def read(self) -> DataFrame:
        """The stored entries, each key once; none before the first ``extend``.

        The aggregation leaves the rows partitioned by the key, as the joins on it need them.
        """
        if not self._exists():
            return self.spark.createDataFrame([], _SCHEMA)
        stored = self.spark.read.schema(_SCHEMA).parquet(self.path)
        return stored.groupBy(*_KEY).agg(F.max("sk_utc_us").alias("sk_utc_us"))

    def extend(self, keys: DataFrame) -> DataFrame:
        """Add the distinct keys of ``keys`` (columns sk_text, sk_zone, sk_order), then read all."""
        fresh = keys.select(*_KEY).distinct()  # partial aggregation: a hot text leaves each task once
        if self._exists():
            fresh = fresh.join(self.read().select(*_KEY), _KEY, "left_anti")
        fresh.mapInArrow(_parse, _SCHEMA).write.mode("append").parquet(self.path)
        return self.read()


def timestamp_keys(rows: DataFrame, text: str, zone: str, order: str) -> DataFrame:
    """``rows`` with the dictionary key in sk_text, sk_zone and sk_order.

    sk_text is null where the text is null or has no digit of any script; such rows need no entry
    and join none.
    """
    source = F.col(f"`{text}`")
    return rows.withColumns(
        {
            "sk_text": F.when(source.rlike("[\\p{N}〇零一二三四五六七八九十]"), source),
            "sk_zone": F.coalesce(F.col(f"`{zone}`"), F.lit("")),
            "sk_order": F.coalesce(F.col(f"`{order}`"), F.lit("")),
        }
    )


def normalize_timestamps(
    rows: DataFrame,
    text: str,
    zone: str,
    order: str,
    out: str = "utc_us",
    dictionary: InstantDictionary | None = None,
) -> DataFrame:
    """``rows`` with ``out``: microseconds since 1970-01-01 UTC, or null.

    The distinct (text, zone, order) go into a dictionary, each is parsed once, the dictionary is
    persisted, and its instants are joined back to all rows. A caller's own ``dictionary`` grows
    over its calls and runs: a load parses only the texts that no load before it held. Without
    one, the dictionary lives as long as the session. The join is an equi-join on the key with
    one dictionary row a key; a text that holds a large part of all rows is split by adaptive skew
    handling, which only copies that one dictionary row. Rows without a text to look up take no
    part in the join.

    Nulls: a null, blank or undetermined text gives null; a null zone means that a clock time
    without its own zone gives null; a null order that a date with slashes and the year last
    does. Repeated rows stay repeated. An empty table gives an empty one. A column ``out`` that
    ``rows`` already has is replaced; other extra columns pass through. Texts of any length are
    read whole and parsed.
    """
    dictionary = dictionary or InstantDictionary(rows.sparkSession, work_path(rows.sparkSession, "instants"))
    keyed = timestamp_keys(rows.drop(out) if out in rows.columns and out not in (text, zone, order) else rows, text, zone, order)
    told, blank = keyed.filter(F.col("sk_text").isNotNull()), keyed.filter(F.col("sk_text").isNull())
    determined = dictionary.extend(told).filter(F.col("sk_utc_us").isNotNull())
    joined = told.join(determined, _KEY, "left").withColumn(out, F.col("sk_utc_us")).drop(*_KEY, "sk_utc_us")
    return joined.unionByName(blank.withColumn(out, F.lit(None).cast("long")).drop(*_KEY))
