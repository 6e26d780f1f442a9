"""The pN_ queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.mixing import mix_sources, mixture_plan
from skyloom.llm.pairs import flag_pairs
from skyloom.llm.residue import find_residue
from skyloom.llm.tokens import count_tokens, encode_corpus
from skyloom.llm.topn import top_n_per_group
from skyloom.session import materialize, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "target_edges").filter(F.col("q").between(0, 1)).select("edge_id", "from_id", "to_id", "q")  # NaN is above every number
    priorities = (
        table(spark, sf_dir, "target_list").filter("priority is not null").groupBy(F.col("id").alias("to_id")).agg(F.max("priority").alias("priority"))
    )
    best = top_n_per_group(
        edges,
        "from_id",
        "q",
        [F.col("priority").desc_nulls_last(), F.col("to_id").asc(), F.col("edge_id").asc()],
        5,
        enrich=lambda rows: rows.join(priorities, "to_id", "left"),
    )
    return best.select(F.col("from_id").cast("long").alias("from_id"), F.col("rank_no").cast("long").alias("rank_no"), "edge_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_pairs(
        table(spark, sf_dir, "sft_records"), "record_id", "instruction", "input_user_data", "output_resoning_data", "output_result_data"
    )
    return flagged.filter(F.size("defects") > 0).select("record_id", F.get("defects", F.lit(0)).alias("defect"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sizes")


def _schedule(weights: DataFrame) -> DataFrame:
    """The curriculum of p8: a source's weight starts at 1 and goes linearly to the number of times it may be repeated,
    so that sources which are often repeated come late."""
    ends = F.array(F.struct(F.lit(0.0).alias("time"), F.lit(1.0).alias("weight")), F.struct(F.lit(1.0).alias("time"), F.col("max_repeats").cast("double").alias("weight")))
    return weights.select("source", F.explode(ends).alias("k")).select("source", "k.time", "k.weight")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weights = table(spark, sf_dir, "mix_weights")
    return mix_sources(_sizes(spark, sf_dir), weights, schedule=_schedule(weights))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p8 that SQL can express: what is taken of each source, with sizes in characters as the table has them."""
    sizes = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("n_tokens"))
    plan = mixture_plan(sizes, table(spark, sf_dir, "mix_weights"))
    return plan.select("source", "available", F.round("share", 8).alias("share"), F.round("demand", 3).alias("demand"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents"), "doc_id", "text").filter("residue is not null").select("doc_id")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_report": p8_report, "p8_plan": p8_plan, "p9_found": p9_found}
ORACLE_SQL: dict[str, str] = {
    "p8_plan": """
WITH h AS (SELECT source, sum(n_chars) AS available FROM documents WHERE source IS NOT NULL GROUP BY source),
     j AS (SELECT coalesce(w.source, h.source) AS source, coalesce(target_share, 0) AS target_share, coalesce(max_repeats, 0) AS max_repeats, CAST(coalesce(available, 0) AS BIGINT) AS available
           FROM mix_weights w FULL JOIN h ON h.source = w.source),
     l AS (SELECT *, available > 0 AND target_share > 0 AND max_repeats > 0 AS live FROM j),
     s AS (SELECT *, CASE WHEN live THEN target_share / sum(target_share) FILTER (WHERE live) OVER () ELSE 0 END AS share FROM l),
     z AS (SELECT *, min(available * max_repeats / share) FILTER (WHERE live) OVER () AS size FROM s)
SELECT source, available, round(share, 8) AS share, round(CASE WHEN live THEN least(share * size, available * max_repeats) ELSE 0 END, 3) AS demand FROM z
""",
    "p2_found": """
WITH edges AS (SELECT DISTINCT edge_id, from_id, to_id, q FROM target_edges WHERE q >= 0 AND q <= 1 AND from_id IS NOT NULL),
     prio AS (SELECT id, max(priority) AS priority FROM target_list WHERE priority IS NOT NULL GROUP BY id),
     ranked AS (
       SELECT e.from_id, e.edge_id,
              row_number() OVER (PARTITION BY e.from_id
                                 ORDER BY e.q DESC, p.priority DESC NULLS LAST, e.to_id ASC NULLS FIRST, e.edge_id) AS rank_no
       FROM edges e LEFT JOIN prio p ON p.id = e.to_id)
SELECT CAST(from_id AS BIGINT) AS from_id, CAST(rank_no AS BIGINT) AS rank_no, edge_id FROM ranked WHERE rank_no <= 5
""",
}
