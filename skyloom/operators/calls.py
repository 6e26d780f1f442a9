"""Calls of an outside service for every record, with a rate limit and faults kept to their record."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULT = T.StructType(
    [T.StructField("reasoning", T.StringType()), T.StructField("content", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.LongType())]
)


class RateLimit:
    """At least 60 / ``per_minute`` seconds between two calls; the wait is outside of any lock, as each task has its own limit."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = 60.0 / per_minute, clock, sleep
        self.following = clock()

    def wait(self) -> None:
        now = self.clock()
        if now < self.following:
            self.sleep(self.following - now)
        self.following = max(now, self.following) + self.gap


class TagStream:
    """Chunks of a stream put together; blocks in a tag go to the reasoning as soon as they close."""

    def __init__(self, tag: str = "thought") -> None:
        self._block = re.compile(rf"<{tag}>(.*?)</{tag}>", re.S)
        self.reasoning: list[str] = []
        self._rest = ""

    def feed(self, chunk: str | None) -> None:
        self._rest += chunk or ""
        if ">" in (chunk or ""):
            self.reasoning += self._block.findall(self._rest)
            self._rest = self._block.sub("", self._rest)

    def close(self) -> tuple[str, str]:
        """Reasoning and content; a block that never closes stays in the content."""
        return "\n".join(self.reasoning), self._rest.strip()


def map_records(
    rows: DataFrame, key: str, prompt: str, make_client: Callable[[], Callable[[str], Iterable[str]]], per_minute: float = 60, workers: int = 4, tries: int = 1, tag: str = "thought"
) -> DataFrame:
    """``key``, reasoning, content, error and attempts of the call for every row.

    ``make_client`` is run once a task and gives a function from a prompt to the chunks of its
    answer. ``workers`` tasks share the rate: each keeps to ``per_minute`` / ``workers``. A call
    that fails, after ``tries``, gives an error on its own row and stops no other. A task that is
    run again calls again, so calls should be idempotent by key; use ``sinks.resume`` to keep
    what is done. A null prompt isn't sent and gives an error.
    """
    schema = T.StructType([rows.schema[key], *_RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, limit = make_client(), RateLimit(per_minute / workers)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                reasoning = content = None
                error, attempt = ("no prompt", 0) if text is None else (None, 0)
                while text is not None and attempt < tries:
                    attempt += 1
                    limit.wait()
                    stream = TagStream(tag)
                    try:
                        for chunk in client(text):
                            stream.feed(chunk)
                        (reasoning, content), error = stream.close(), None
                        break
                    except Exception as fault:  # whatever a service does concerns this record only
                        error = json.dumps({"type": type(fault).__name__, "message": str(fault)}, ensure_ascii=False)
                out.append((reasoning, content, error, attempt))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=schema.names)

    return rows.select(key, F.col(prompt)).repartition(workers, key).mapInArrow(run, schema)
