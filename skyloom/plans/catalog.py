"""Queries for the reference's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.geodesy import ecef_m, ground_sample_distance, haversine_km, local_solar_time, swath_width
from skyloom.operators.catalog import (
    append_in, insert_or_ignore, limit_then_filter, match_in_json_list, top_k, top_k_with_ties, update_in,
)
from skyloom.operators.graph import components, hops
from skyloom.operators.series import islands, micros, midpoint_windows, on_grid, revisit_gaps
from skyloom.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at_us", micros(F.col("ts")))


def q_revisit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit_gaps(_events(spark, sf_dir), "user_id", "at_us", "at_us", "event_id")


def q_constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("max_revisit").between(0, 72) & F.col("min_revisit").between(0, 1) & F.col("avg_revisit").between(0, 12)
    return q_revisit_gaps(spark, sf_dir).select("user_id", inside.alias("kept"))


def q_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midpoint_windows(_events(spark, sf_dir), "user_id", "event_id", "at_us")


def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), "user_id", "event_id", "at_us", 6 * 3_600_000_000)


def q_topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_with_ties(table(spark, sf_dir, "orders"), "o_orderdate", 25).select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))


def q_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.to_date("o_orderdate") <= F.to_date(F.lit("1998-01-01"))))
    return top_k(due, "o_totalprice", 20, "o_orderkey").select("o_orderkey", "o_totalprice")


def q_topk_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    lowest, highest = (top_k(part, "p_retailprice", 20, "p_partkey", ascending) for ascending in (True, False))
    return lowest.withColumn("direction", F.lit("asc")).unionByName(highest.withColumn("direction", F.lit("desc")))


def q_limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return limit_then_filter(orders, "o_totalprice", 2000, "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


def q_not_equal_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    flagged = table(spark, sf_dir, "orders").join(some.agg(F.min("l_returnflag").alias("flag")), "o_orderkey", "left")
    return flagged.filter(F.col("flag") != "R").select("o_orderkey", "flag")


def _busy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_discount >= 0.09").select(F.col("l_suppkey").alias("s_suppkey"))


def q_update_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return update_in(suppliers, "s_suppkey", _busy_suppliers(spark, sf_dir), {"s_acctbal": 0.0})


def q_update_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array(F.count("*")).cast("array<bigint>").alias("counts"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left")
    return append_in(suppliers, "s_suppkey", _busy_suppliers(spark, sf_dir), "counts", 99)


def q_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    batch = customer.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0))
    return insert_or_ignore(customer.filter("c_custkey % 2 = 0"), batch, "c_custkey", "c_name")


def q_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def q_json_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = q_json_path(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    texts = listed.groupBy("user_id").agg(F.to_json(F.collect_list(F.col("k").cast("long"))).alias("ks"))
    return match_in_json_list(texts, "ks", 7).select("user_id", F.lit(7).cast("long").alias("k"))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return on_grid(rows, F.col("l_quantity"), F.col("l_quantity") + 15, 10)


def q_interval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", "t")


def q_first_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity")
    first = _sampled(spark, sf_dir).groupBy("l_suppkey", "t").agg(F.min(order).alias("r"))
    return first.select("l_suppkey", "t", "r.l_orderkey", "r.l_linenumber")


def q_pairs_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    other = s.select(F.col("s_suppkey").alias("b"), "s_nationkey")
    return s.withColumnRenamed("s_suppkey", "a").join(other, "s_nationkey").filter("a < b").select("a", "b")


def q_symmetric_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = q_pairs_lt(spark, sf_dir)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def q_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "part").select("p_brand").distinct())


def _orders_of_a_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    month = day.between(F.to_date(F.lit("1997-03-01")), F.to_date(F.lit("1997-03-30")))
    return table(spark, sf_dir, "orders").filter(month).select(F.col("o_custkey").alias("c_custkey"))


def q_semi_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(_orders_of_a_month(spark, sf_dir), "c_custkey", "left_semi").select("c_custkey", "c_name")


def q_left_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _orders_of_a_month(spark, sf_dir).groupBy("c_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def q_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'").select("p_partkey")
    ordered = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    missing, extra = wanted.join(ordered, "p_partkey", "left_anti"), ordered.join(wanted, "p_partkey", "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def q_cluster_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_discount").cast("decimal(10,4)").alias("w"))
    placed = lines.join(nation, "l_suppkey")
    a = placed.select("l_orderkey", F.col("nation").alias("a"), "w")
    b = placed.select("l_orderkey", F.col("nation").alias("b")).distinct()
    strength = a.join(b, "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.sum("w").cast("decimal(20,4)").alias("strength"))
    return strength.filter("strength > 0.7").select("a", "b", "strength")


def q_duplicate_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey")
    return groups.agg(F.array_sort(F.collect_list("l_orderkey")).alias("l_orderkeys")).filter(F.size("l_orderkeys") > 1)


def q_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each nation's suppliers ship, of all parts."""
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    per_nation = shipped.join(table(spark, sf_dir, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.count_distinct("l_partkey").alias("shipped"))
    wanted = table(spark, sf_dir, "part").agg(F.count_distinct("p_partkey").alias("wanted"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey")).join(per_nation, "s_nationkey", "left")
    done = F.coalesce("shipped", F.lit(0)).cast("long")
    coverage = F.when(F.col("wanted") == 0, F.lit(0.0)).otherwise(F.round(done / F.col("wanted"), 4))
    return nations.crossJoin(F.broadcast(wanted)).select(F.col("s_nationkey").cast("long").alias("nation"), done.alias("shipped"), coverage.alias("coverage"))


def q_bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coverage")
    conditions: list[tuple[str, Column]] = [
        (">1", c > 1), ("=1", c == 1), ("0.9-1", (c >= 0.9) & (c < 1)), ("0.8-0.9", (c >= 0.8) & (c < 0.9)), ("<0.8", c < 0.8),
    ]
    counts = q_coverage_report(spark, sf_dir).agg(F.count("*").alias("total"), *(F.count_if(k).alias(f"n{i}") for i, (_, k) in enumerate(conditions)))
    listed = F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(conditions)))
    rows = counts.select("total", F.explode(listed).alias("b"))
    return rows.select("b.bucket", "b.n", F.round(F.col("b.n") * 100 / F.nullif("total", F.lit(0)), 4).alias("percent"))


def q_duration_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(12,2)").alias("d"))
    wide = lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("d"))
    return wide.select("l_returnflag", *(F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s.lower()) for s in ("F", "O")))


def q_norm_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    norms = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.sqrt(squares).alias("d"))
    least = norms.groupBy(F.col("label").alias("l")).agg(F.min("d").alias("least"))
    return norms.join(least, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", F.round(F.col("least") / F.nullif("d", F.lit(0.0)), 6).alias("w"))


def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("text", r"[ \t\n\r]+", " "), "^ | $", "")
    n = F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")
    sizes = table(spark, sf_dir, "documents").select("lang", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n"))
    spread = [F.round(F.percentile("n", p), 6).alias(name) for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return sizes.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"),
        F.min("n").alias("least"), F.max("n").alias("most"), *spread,
    )


def q_token_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 bins of equal width over n_chars, the last one closed; one bin where all values are equal."""
    sizes = table(spark, sf_dir, "documents").select("n_chars").filter("n_chars is not null")
    ends = sizes.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    binned = F.expr("CASE WHEN hi = lo THEN 0 ELSE least((n_chars - lo) * 30 div (hi - lo), 29) END").cast("long")
    return sizes.crossJoin(F.broadcast(ends)).groupBy(binned.alias("bin")).agg(F.count("*").alias("n"))


def q_ws_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("text", r"[ \t\n\r]+", " "), "^ | $", "")
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("text"))


def q_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line").filter("line <> ''")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's place, made of its key."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (key % 179 - 89).cast("double").alias("lat"), (key * 7 % 359 - 179).cast("double").alias("lon"))


def q_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = haversine_km(F.col("lat"), F.col("lon"), F.lit(31.0), F.lit(121.0))
    return _places(spark, sf_dir).select("c_custkey", F.round(there, 6).alias("km"))


def q_lla_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = zip("xyz", ecef_m(F.col("lat"), F.col("lon"), F.lit(500.0), None), strict=True)
    return _places(spark, sf_dir).select("c_custkey", *(F.round(value, 3).alias(name) for name, value in axes))


def q_gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    gsd = ground_sample_distance(0.001, F.lit(600.0) + F.col("lon"), F.col("lat"), None)
    return _places(spark, sf_dir).select("c_custkey", F.round(gsd, 6).alias("gsd"))


def q_swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.lit(7000.0) + F.col("lat"), F.lit(300.0) + F.col("lon")
    return _places(spark, sf_dir).select("c_custkey", F.round(swath_width(x, y, F.lit(100.0), F.lit(30.0), None), 6).alias("km"))


def q_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("user_id") * 7 % 359 - 179).cast("double")
    return table(spark, sf_dir, "events").select("event_id", local_solar_time(F.col("ts").cast("timestamp"), lon).alias("local_time"))


def _co_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers, smaller key first, that ship parts of one order at least twice."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = lines.withColumnRenamed("l_suppkey", "a").join(lines.withColumnRenamed("l_suppkey", "b"), "l_orderkey").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")


def q_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _co_supply(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("s_suppkey"))
    return ends.groupBy("s_suppkey").agg(F.count("*").alias("degree"))


def q_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at supplier 1."""
    return _co_supply(spark, sf_dir).filter("a = 1 or b = 1").select(F.expr("if(a = 1, b, a)").alias("s_suppkey"), "n")


def q_endpoint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    edges = _co_supply(spark, sf_dir)
    for end in ("a", "b"):
        edges = edges.join(known.withColumnRenamed("s_suppkey", end), end, "left_semi")
    return edges.select("a", "b", "n")


def q_hops_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at most three edges from supplier 1."""
    return hops(_co_supply(spark, sf_dir), "a", "b", 1, 3).select(F.col("node").alias("s_suppkey"), "hop")


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "supplier"), "s_suppkey", _co_supply(spark, sf_dir), "a", "b")


def q_duration_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link strength of every two nations, 0 where they have none."""
    links = q_cluster_strength(spark, sf_dir).select("a", "b", F.col("strength").cast("double").alias("w"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    wide = both.groupBy("a").pivot("b", list(range(25))).agg(F.first("w"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a")).join(wide, "a", "left")
    return nations.select(F.col("a").alias("nation"), *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"n{n}") for n in range(25)))


def q_think_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as reasoning and a JSON array in one text, read back."""
    record = F.to_json(F.array(F.struct(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))))
    text = F.concat(F.lit("<think>"), F.col("l_returnflag"), F.lit("</think>\n"), record)
    pattern = r"(?s)<think>(.*?)</think>(.*?)\[(.*)\]$"
    body = F.from_json(F.concat(F.lit("["), F.regexp_extract(text, pattern, 3), F.lit("]")), "array<struct<k: bigint, s: bigint>>")
    read = table(spark, sf_dir, "lineitem").select(F.regexp_extract(text, pattern, 1).alias("reasoning"), F.get(body, F.lit(0)).alias("r"))
    return read.select("reasoning", F.col("r.k").alias("k"), F.col("r.s").alias("s"))


def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("l_suppkey", F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("k")))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(best.alias("l_suppkey"), F.max("l_extendedprice").alias("price"))


def q_ts_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss.SSS").alias("simulator")
    )


QUERIES = {name: query for name, query in list(globals().items()) if name.startswith("q_")}

_GAPS = """
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE ts IS NOT NULL
           UNION ALL SELECT user_id, NULL FROM events WHERE ts IS NULL),
     revisit AS (
       SELECT user_id, coalesce(round(avg(gap) / 3600000000, 6), 99999) AS avg_revisit, coalesce(round(max(gap) / 3600000000, 6), 99999) AS max_revisit,
              coalesce(round(min(gap) / 3600000000, 6), 99999) AS min_revisit
       FROM g GROUP BY user_id)
"""
_GRID = """
WITH s AS (SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity, g.t
           FROM lineitem, (SELECT CAST(unnest(range(0, 101, 10)) AS BIGINT) AS t) g WHERE g.t BETWEEN l_quantity AND l_quantity + 15)
"""
_PAIRS = "WITH p AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey < y.s_suppkey)\n"
_BUSY = "(SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09)"
_MONTH = "(SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-30')"
_COVERAGE = """
WITH shipped AS (SELECT s_nationkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey),
     coverage AS (
       SELECT CAST(n_nationkey AS BIGINT) AS nation, coalesce(n, 0) AS shipped,
              CASE WHEN wanted = 0 THEN 0 ELSE round(coalesce(n, 0) / wanted, 4) END AS coverage
       FROM nation LEFT JOIN shipped ON s_nationkey = n_nationkey, (SELECT count(DISTINCT p_partkey) AS wanted FROM part))
"""
_STRENGTH = """
WITH p AS (SELECT l_orderkey, CAST(s_nationkey AS BIGINT) AS nation, CAST(l_discount AS DECIMAL(10, 4)) AS w
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
     links AS (
       SELECT x.nation AS a, y.nation AS b, CAST(sum(x.w) AS DECIMAL(20, 4)) AS strength
       FROM p x JOIN (SELECT DISTINCT l_orderkey, nation FROM p) y USING (l_orderkey) WHERE x.nation < y.nation GROUP BY ALL HAVING sum(x.w) > 0.7)
"""
_CO_SUPPLY = """
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
     e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM l x JOIN l y USING (l_orderkey)
           WHERE x.l_suppkey < y.l_suppkey GROUP BY ALL HAVING count(*) >= 2)
"""
_CLEAN = r"regexp_replace(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '^ | $', '', 'g')"
_LAT, _LON = "CAST(c_custkey % 179 - 89 AS DOUBLE)", "CAST(c_custkey * 7 % 359 - 179 AS DOUBLE)"
_NORMAL = f"6378137.0 / sqrt(1 - e2 * sin(radians({_LAT})) * sin(radians({_LAT})))"

ORACLE_SQL = {
    "q_revisit_gaps": _GAPS + "SELECT * FROM revisit",
    "q_constraint_check": _GAPS
    + "SELECT user_id, max_revisit BETWEEN 0 AND 72 AND min_revisit BETWEEN 0 AND 1 AND avg_revisit BETWEEN 0 AND 12 AS kept FROM revisit",
    "q_midpoints": """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us,
                  coalesce(lead(epoch_us(ts)) OVER w - epoch_us(ts), epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS width
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, (2 * us - width) // 2000000 AS start_s, (2 * us + width) // 2000000 AS end_s FROM e
""",
    "q_islands": """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us,
                  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS opens
           FROM events),
     n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM e)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM n GROUP BY user_id, no
""",
    "q_topk_ties": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders QUALIFY rank() OVER (ORDER BY o_orderdate DESC NULLS LAST) <= 25
""",
    "q_topk_filtered": """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01'
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 20
""",
    "q_topk_dynamic": """
(SELECT p_partkey, p_retailprice, 'asc' AS direction FROM part ORDER BY p_retailprice ASC NULLS FIRST, p_partkey NULLS FIRST LIMIT 20)
UNION ALL (SELECT p_partkey, p_retailprice, 'desc' FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey NULLS FIRST LIMIT 20)
""",
    "q_limit_then_filter": """
SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 2000)
WHERE o_orderstatus = 'F'
""",
    "q_not_equal_nulls": """
SELECT o_orderkey, flag FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)
ON l_orderkey = o_orderkey WHERE flag <> 'R'
""",
    "q_update_in": f"SELECT s_suppkey, s_name, CASE WHEN s_suppkey IN {_BUSY} THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier",
    "q_update_append": f"""
WITH c AS (SELECT l_suppkey, [count(*)] AS counts FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, CASE WHEN s_suppkey IN {_BUSY} THEN list_append(coalesce(counts, []), 99::BIGINT) ELSE counts END AS counts
FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey
""",
    "q_insert_ignore": """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, -1.0::DOUBLE FROM customer b WHERE c_custkey % 3 = 0
  AND NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_custkey % 2 = 0 AND t.c_custkey = b.c_custkey)
""",
    "q_json_path": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "q_json_lateral": """
WITH j AS (SELECT user_id, to_json(list(CAST(json_extract_string(props, '$.k') AS BIGINT))) AS ks FROM events GROUP BY user_id),
     u AS (SELECT user_id, unnest(from_json(ks, '["BIGINT"]')) AS k FROM j)
SELECT user_id, k FROM u WHERE k = 7
""",
    "q_interval_grid": _GRID + "SELECT l_orderkey, l_linenumber, l_suppkey, t FROM s",
    "q_first_interval": _GRID
    + """SELECT l_suppkey, t, l_orderkey, l_linenumber FROM s
QUALIFY row_number() OVER (PARTITION BY l_suppkey, t ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) = 1""",
    "q_pairs_lt": _PAIRS + "SELECT a, b FROM p",
    "q_symmetric_closure": _PAIRS + "SELECT a, b FROM p UNION ALL SELECT b, a FROM p",
    "q_cross_product": "SELECT r_name, p_brand FROM region, (SELECT DISTINCT p_brand FROM part)",
    "q_semi_visible": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN {_MONTH}",
    "q_left_empty": f"""
SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {_MONTH} GROUP BY o_custkey) ON o_custkey = c_custkey
""",
    "q_missing_extra": """
WITH w AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2'), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40)
SELECT p_partkey, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM o)
UNION ALL SELECT l_partkey, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)
""",
    "q_cluster_strength": _STRENGTH + "SELECT a, b, strength FROM links",
    "q_duration_matrix": _STRENGTH
    + ", m AS (SELECT a, b, CAST(strength AS DOUBLE) AS w FROM links UNION ALL SELECT b, a, CAST(strength AS DOUBLE) FROM links) SELECT CAST(n_nationkey AS BIGINT) AS nation, "
    + ", ".join(f"coalesce(max(w) FILTER (WHERE b = {n}), 0) AS n{n}" for n in range(25))
    + " FROM nation LEFT JOIN m ON a = n_nationkey GROUP BY n_nationkey",
    "q_duplicate_assign": """
SELECT l_partkey, l_suppkey, list(l_orderkey ORDER BY l_orderkey) AS l_orderkeys FROM lineitem GROUP BY ALL HAVING count(*) > 1
""",
    "q_coverage_report": _COVERAGE + "SELECT nation, shipped, coverage FROM coverage",
    "q_bucket_share": _COVERAGE
    + """, b AS (SELECT unnest([{'bucket': '>1', 'n': count_if(coverage > 1)}, {'bucket': '=1', 'n': count_if(coverage = 1)},
                     {'bucket': '0.9-1', 'n': count_if(coverage >= 0.9 AND coverage < 1)},
                     {'bucket': '0.8-0.9', 'n': count_if(coverage >= 0.8 AND coverage < 0.9)}, {'bucket': '<0.8', 'n': count_if(coverage < 0.8)}]) AS r,
              count(*) AS total FROM coverage)
SELECT r.bucket AS bucket, CAST(r.n AS BIGINT) AS n, round(r.n * 100 / nullif(total, 0), 4) AS percent FROM b
""",
    "q_duration_pivot": """
SELECT l_returnflag, coalesce(CAST(sum(d) FILTER (WHERE l_linestatus = 'F') AS DOUBLE), 0) AS f,
       coalesce(CAST(sum(d) FILTER (WHERE l_linestatus = 'O') AS DOUBLE), 0) AS o
FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(12, 2)) AS d FROM lineitem) GROUP BY l_returnflag
""",
    "q_norm_weight": """
WITH d AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS d FROM embeddings)
SELECT vec_id, round(min(d) OVER (PARTITION BY label) / nullif(d, 0), 6) AS w FROM d
""",
    "q_token_stats": f"""
WITH c AS (SELECT lang, {_CLEAN} AS t FROM documents),
     s AS (SELECT lang, CAST(CASE WHEN t IS NULL OR t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS n FROM c)
SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most,
       round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS p75
FROM s GROUP BY lang
""",
    "q_token_hist": """
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least((n_chars - lo) * 30 // (hi - lo), 29) END AS BIGINT) AS bin, count(*) AS n
FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) WHERE n_chars IS NOT NULL GROUP BY 1
""",
    "q_ws_normalize": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "q_split_records": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
     n AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM n WHERE line <> ''
""",
    "q_haversine": f"""
WITH p AS (SELECT c_custkey, radians({_LAT}) AS lat, radians(31.0 - {_LAT}) / 2 AS dlat, radians(121.0 - {_LON}) / 2 AS dlon FROM customer),
     h AS (SELECT c_custkey, sin(dlat) * sin(dlat) + cos(lat) * cos(radians(31.0)) * sin(dlon) * sin(dlon) AS a FROM p)
SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM h
""",
    "q_lla_ecef": f"""
WITH k AS (SELECT *, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM customer), n AS (SELECT *, {_NORMAL} AS normal FROM k)
SELECT c_custkey, round((normal + 500) * cos(radians({_LAT})) * cos(radians({_LON})), 3) AS x,
       round((normal + 500) * cos(radians({_LAT})) * sin(radians({_LON})), 3) AS y, round((normal * (1 - e2) + 500) * sin(radians({_LAT})), 3) AS z FROM n
""",
    "q_gsd": f"SELECT c_custkey, CASE WHEN {_LAT} > 0 THEN round(0.001::DOUBLE * (600.0 + {_LON}) / sqrt(sin(radians({_LAT}))), 6) END AS gsd FROM customer",
    "q_swath": f"""
SELECT c_custkey, round((sqrt((7000.0 + {_LAT}) * (7000.0 + {_LAT}) + (300.0 + {_LON}) * (300.0 + {_LON}) + 10000.0) - 6371.0) * tan(radians(30.0)), 6) AS km
FROM customer
""",
    "q_local_time": """
SELECT event_id, strftime(make_timestamp(epoch_us(ts) + CAST((user_id * 7 % 359 - 179) * 240000000 AS BIGINT)), '%H:%M') AS local_time FROM events
""",
    "q_graph_degree": _CO_SUPPLY + "SELECT s_suppkey, count(*) AS degree FROM (SELECT a AS s_suppkey FROM e UNION ALL SELECT b FROM e) GROUP BY s_suppkey",
    "q_neighbors": _CO_SUPPLY + "SELECT CASE WHEN a = 1 THEN b ELSE a END AS s_suppkey, n FROM e WHERE a = 1 OR b = 1",
    "q_endpoint_filter": _CO_SUPPLY
    + "SELECT a, b, n FROM e WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND b IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "q_hops_k": _CO_SUPPLY.replace("WITH", "WITH RECURSIVE", 1)
    + """, b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     r AS (SELECT 1::BIGINT AS s_suppkey, 0::BIGINT AS hop UNION SELECT b.b, hop + 1 FROM r JOIN b ON b.a = s_suppkey WHERE hop < 3)
SELECT s_suppkey, min(hop) AS hop FROM r GROUP BY s_suppkey""",
    "q_components": _CO_SUPPLY.replace("WITH", "WITH RECURSIVE", 1)
    + """, b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     r AS (SELECT s_suppkey, s_suppkey AS other FROM supplier UNION SELECT r.s_suppkey, b.b FROM r JOIN b ON b.a = other)
SELECT s_suppkey, min(other) AS component FROM r GROUP BY s_suppkey""",
    "q_think_json": r"""
WITH t AS (SELECT '<think>' || l_returnflag || '</think>' || chr(10) || '[{"k":' || l_orderkey || ',"s":' || l_suppkey || '}]' AS c FROM lineitem),
     b AS (SELECT c, '[' || regexp_extract(c, '<think>(.*?)</think>(.*?)\[(.*)\]$', 3, 's') || ']' AS j FROM t)
SELECT regexp_extract(c, '<think>(.*?)</think>(.*?)\[(.*)\]$', 1, 's') AS reasoning, CAST(j ->> '$[0].k' AS BIGINT) AS k, CAST(j ->> '$[0].s' AS BIGINT) AS s FROM b
""",
    "q_argmax": """
SELECT l_partkey, l_suppkey, l_extendedprice AS price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC NULLS LAST, l_suppkey) = 1
""",
    "q_ts_format": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%d %b %Y %H:%M:%S.%g') AS simulator FROM orders
""",
}
