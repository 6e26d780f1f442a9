"""Continuous periods and gaps of overlapping intervals, per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialize

_DAY_MS = 86_400_000


_LONG_CHUNKS = 4
_STEP = 64


def merge_intervals(windows: DataFrame, entity: str, start_ms: str, end_ms: str, chunk_ms: int = _DAY_MS) -> DataFrame:
    """Columns ``entity``, kind (period or gap), start_ms, end_ms.

    ``session_window`` with a gap that is each row's own duration makes the sessions: an interval
    [s, e) is an event at s that stays open for e - s, and events whose spans overlap fall into
    one session. Touching sessions are joined afterwards, and gaps come from ``lead``.

    An entity may hold a third of all rows, so nothing is grouped by the entity alone. Intervals
    are cut at the edges of chunks of ``chunk_ms`` and sessions are built per (entity, chunk),
    which spreads a large entity over as many tasks as it has chunks. Only periods that reach a
    chunk's edge, at most two a chunk, and the first start and last end of a chunk are looked at
    per entity.

    An interval longer than four chunks isn't cut into all of them, since a single wrong end date
    could make millions of pieces: long intervals are first merged among themselves in chunks 64
    times as long, and so on upwards. What comes of them, the covers, is cut only for the chunks
    in which short intervals lie or a cover begins or ends.

    Rows without entity, start or end, and rows that end at or before their start, are left out.
    Nested, equal and repeated intervals merge. Extra columns are dropped. An empty table gives
    an empty one.
    """
    name = F.col(f"`{entity}`")
    valid = windows.select(
        name.alias(entity), F.col(f"`{start_ms}`").cast("long").alias("sk_s"), F.col(f"`{end_ms}`").cast("long").alias("sk_e")
    ).filter(F.col(entity).isNotNull() & (F.col("sk_e") > F.col("sk_s")))
    return _merge(valid, entity, chunk_ms).withColumnsRenamed({"sk_s": "start_ms", "sk_e": "end_ms"})


def _chunk(at, chunk_ms: int):
    return F.floor(at / F.lit(chunk_ms)).cast("long")


def _pieces(rows: DataFrame, entity: str, chunk_ms: int) -> DataFrame:
    """The parts of rows with sk_chunk that lie in that chunk."""
    low = F.col("sk_chunk") * chunk_ms
    return rows.select(entity, "sk_chunk", F.greatest("sk_s", low).alias("sk_s"), F.least("sk_e", low + chunk_ms).alias("sk_e"))


def _cut(rows: DataFrame, entity: str, chunk_ms: int) -> DataFrame:
    every = F.explode(F.sequence(_chunk(F.col("sk_s"), chunk_ms), _chunk(F.col("sk_e") - 1, chunk_ms)))
    return _pieces(rows.withColumn("sk_chunk", every), entity, chunk_ms)


def _cover_pieces(covers: DataFrame, short: DataFrame, entity: str, chunk_ms: int) -> DataFrame:
    """The covers' parts in chunks that hold short intervals or an end of a cover."""
    first, last = _chunk(F.col("sk_s"), chunk_ms), _chunk(F.col("sk_e") - 1, chunk_ms)
    ends = covers.withColumn("sk_chunk", F.explode(F.array_distinct(F.array(first, last))))
    # covers and chunks meet in blocks of 64 * 64 chunks, which even a cover of millennia has few of
    block = chunk_ms * _STEP * _STEP
    blocks = covers.withColumn("sk_block", F.explode(F.sequence(_chunk(F.col("sk_s"), block), _chunk(F.col("sk_e") - 1, block))))
    chunks = short.select(entity, "sk_chunk").distinct().withColumn("sk_block", F.floor(F.col("sk_chunk") / F.lit(_STEP * _STEP)).cast("long"))
    inside = blocks.join(chunks, [entity, "sk_block"]).filter((F.col("sk_chunk") > first) & (F.col("sk_chunk") < last))
    return _pieces(ends.unionByName(inside.drop("sk_block")), entity, chunk_ms)


def _merge(valid: DataFrame, entity: str, chunk_ms: int) -> DataFrame:
    kept = materialize(valid.withColumn("sk_long", F.col("sk_e") - F.col("sk_s") > _LONG_CHUNKS * chunk_ms), "windows", ["sk_long"])
    pieces = _cut(kept.filter("not sk_long").drop("sk_long"), entity, chunk_ms)
    long, covers = kept.filter("sk_long").drop("sk_long"), None
    if not long.isEmpty():
        covers = materialize(_merge(long, entity, chunk_ms * _STEP).filter("kind = 'period'").drop("kind"), "covers")
        pieces = pieces.unionByName(_cover_pieces(covers, pieces, entity, chunk_ms))

    spans = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((sk_e - sk_s) / 1000.0 as decimal(18, 6)))")
    sessions = (
        pieces.withColumn("sk_t", F.timestamp_millis("sk_s"))
        .groupBy(entity, "sk_chunk", F.session_window("sk_t", spans))
        .agg(F.count(F.lit(1)).alias("sk_n"))
        .select(
            entity,
            "sk_chunk",
            F.unix_millis("session_window.start").alias("sk_s"),
            F.unix_millis("session_window.end").alias("sk_e"),
        )
    )
    in_chunk = Window.partitionBy(entity, "sk_chunk").orderBy("sk_s")
    joined = (
        sessions.withColumn("sk_new", F.coalesce((F.col("sk_s") > F.lag("sk_e").over(in_chunk)).cast("int"), F.lit(1)))
        .withColumn("sk_no", F.sum("sk_new").over(in_chunk))
        .groupBy(entity, "sk_chunk", "sk_no")
        .agg(F.min("sk_s").alias("sk_s"), F.max("sk_e").alias("sk_e"))
        .withColumns(
            {
                "sk_next": F.lead("sk_s").over(in_chunk),
                "sk_first": F.lag("sk_s").over(in_chunk).isNull(),
                "sk_edge": (F.col("sk_s") == F.col("sk_chunk") * chunk_ms) | (F.col("sk_e") == (F.col("sk_chunk") + 1) * chunk_ms),
            }
        )
        .select(entity, "sk_chunk", "sk_s", "sk_e", "sk_next", "sk_first", "sk_edge")
    )
    periods = materialize(joined, "periods")

    per_entity = Window.partitionBy(entity).orderBy("sk_s", "sk_e")
    reach = F.max("sk_e").over(per_entity.rowsBetween(Window.unboundedPreceding, -1))
    inner = periods.filter(~F.col("sk_edge")).select(entity, F.lit("period").alias("kind"), "sk_s", "sk_e")
    open_ended = periods.filter("sk_edge").select(entity, "sk_s", "sk_e")
    blocks = periods.filter("sk_first or sk_next is null").groupBy(entity, "sk_chunk").agg(F.min("sk_s").alias("sk_s"), F.max("sk_e").alias("sk_e")).drop("sk_chunk")
    if covers is not None:
        open_ended, blocks = open_ended.unionByName(covers), blocks.unionByName(covers)
    across = (
        open_ended.withColumn("sk_new", F.coalesce((F.col("sk_s") > reach).cast("int"), F.lit(1)))
        .withColumn("sk_no", F.sum("sk_new").over(per_entity))
        .groupBy(entity, "sk_no")
        .agg(F.min("sk_s").alias("sk_s"), F.max("sk_e").alias("sk_e"))
        .select(entity, F.lit("period").alias("kind"), "sk_s", "sk_e")
    )
    inner_gaps = periods.filter("sk_next is not null").select(
        entity, F.lit("gap").alias("kind"), F.col("sk_e").alias("sk_s"), F.col("sk_next").alias("sk_e")
    )
    outer_gaps = blocks.withColumn("sk_reach", reach).filter("sk_s > sk_reach").select(
        entity, F.lit("gap").alias("kind"), F.col("sk_reach").alias("sk_s"), F.col("sk_s").alias("sk_e")
    )
    return inner.unionByName(across).unionByName(inner_gaps).unionByName(outer_gaps)
