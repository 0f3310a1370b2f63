"""Roles that the given tables play: entities, results, prices, series and snapshots.

Each role is a DataFrame and the same thing as SQL; a query's SQL twin names the roles it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table

SQL = {
    "organization": "SELECT n_nationkey AS id, n_name AS display_name, n_regionkey AS parent_id FROM nation",
    "model": "SELECT p_partkey AS id, p_name AS name, p_brand AS developer, p_type AS family, p_size AS context, p_retailprice AS price, (p_size % 2 = 0) AS open_weights, CAST(DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) AS release_date FROM part",
    "snapshot": "SELECT o_orderkey AS id, o_orderpriority AS source_id, o_orderdate AS fetched_at, o_custkey AS owner_id, o_totalprice AS size FROM orders",
    "surface": "SELECT s_suppkey AS id, s_nationkey AS provider_id, s_name AS name, s_acctbal AS balance FROM supplier",
    "result": "SELECT l_partkey AS model_id, l_returnflag AS benchmark_id, l_extendedprice AS score, (l_linenumber > 4) AS self_reported, l_shipdate AS measured_at, l_orderkey AS snapshot_id, l_linenumber AS rank, l_discount AS ci, l_suppkey AS surface_id FROM lineitem",
    "price": "SELECT l_partkey AS model_id, l_suppkey AS surface_id, l_linestatus AS component, l_quantity AS amount, l_shipdate AS valid_from, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate + to_days(CAST(l_quantity AS INTEGER) * 20) END AS valid_to, l_orderkey AS snapshot_id, l_linenumber AS line, l_returnflag AS source_id, l_extendedprice AS total FROM lineitem",
    "series": "SELECT event_id AS id, user_id AS model_id, ts AS t, value AS elo, event_type AS kind, props FROM events",
}


def with_roles(body: str, *names: str) -> str:
    """``body`` with the named roles as common table expressions."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    return f"WITH {ctes}, {body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def organization(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS display_name", "n_regionkey AS parent_id")


def model(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS developer", "p_type AS family", "p_size AS context", "p_retailprice AS price", "p_size % 2 = 0 AS open_weights", "date_add(DATE'2020-01-01', CAST(p_partkey % 1500 AS INT)) AS release_date")


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS source_id", "o_orderdate AS fetched_at", "o_custkey AS owner_id", "o_totalprice AS size")


def surface(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS provider_id", "s_name AS name", "s_acctbal AS balance")


def result(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_partkey AS model_id", "l_returnflag AS benchmark_id", "l_extendedprice AS score", "l_linenumber > 4 AS self_reported", "l_shipdate AS measured_at", "l_orderkey AS snapshot_id", "l_linenumber AS rank", "l_discount AS ci", "l_suppkey AS surface_id")


def price(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr("l_partkey AS model_id", "l_suppkey AS surface_id", "l_linestatus AS component", "l_quantity AS amount", "l_shipdate AS valid_from", "l_linenumber AS line", "l_orderkey AS snapshot_id", "l_returnflag AS source_id", "l_extendedprice AS total")
    end = F.expr("valid_from + make_dt_interval(CAST(amount AS INT) * 20)")
    return df.withColumn("valid_to", F.when(F.col("line") % 3 == 0, F.lit(None)).otherwise(end))


def series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS id", "user_id AS model_id", "ts AS t", "value AS elo", "event_type AS kind", "props")
