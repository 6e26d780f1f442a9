"""The library's aggregations over streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet files as a stream; the number of files a trigger bounds what a batch takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """``by``, start, end and n: events counted in windows of a fixed width.

    An event later than ``late`` behind the newest is dropped, by Spark's watermark; so is one
    without a time.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """``by``, start, end and n: stretches of events with less than ``gap`` between neighbours."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_files(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished rows to parquet files; a run that was cut off goes on from its checkpoint and repeats nothing."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give each micro-batch and its number to ``work``; a number may come again after a failure, so work should be idempotent by it."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """Batches and rows of the queries of a session so far."""

    def __init__(self) -> None:
        self.batches = self.rows = self.failed = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None
