"""Flagship: one headline result for each entity and metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.picks import latest_pick
from factloom.plans.registry import query
from factloom.session import table

HEADLINE_SQL = """
SELECT l_partkey AS model_id, l_returnflag AS benchmark_id, l_extendedprice AS score,
       self_reported, measured_at, snapshot_id
FROM (
  SELECT l.*, (l_linenumber > 4)::INT AS self_reported, l_orderkey AS snapshot_id,
         coalesce(l_shipdate, o_orderdate) AS measured_at,
         row_number() OVER (PARTITION BY l_partkey, l_returnflag
           ORDER BY (l_linenumber > 4)::INT, coalesce(l_shipdate, o_orderdate) DESC NULLS LAST,
                    l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
  FROM lineitem l LEFT JOIN (SELECT o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) o
    ON o_orderkey = l_orderkey)
WHERE rn = 1
"""


@query("o_win_01", HEADLINE_SQL)
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent beats self-reported, then the newest effective date."""
    orders = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_orderdate").alias("o_orderdate"))
    facts = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    facts = facts.select(
        F.col("l_partkey").alias("model_id"),
        F.col("l_returnflag").alias("benchmark_id"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linenumber") > 4).cast("int").alias("self_reported"),
        F.coalesce("l_shipdate", "o_orderdate").alias("measured_at"),
        F.col("l_orderkey").alias("snapshot_id"),
        "l_linenumber",
    )
    order = [F.asc("self_reported"), F.desc_nulls_last("measured_at"), F.desc("snapshot_id"), F.desc("l_linenumber"), F.desc("score")]
    return latest_pick(facts, ["model_id", "benchmark_id"], order).drop("l_linenumber")
