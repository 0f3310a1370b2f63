"""Ordered picks: feeds, ends, outliers, nearness to the median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import ranges


def bounded_feed(rows: DataFrame, category: str, order: Sequence[Column], per_category: int) -> DataFrame:
    """The first rows of each category, with the category's total and whether it was cut.

    Totals are counted apart, so the ranking needs no window over whole categories.
    """
    if per_category < 1:
        raise ValueError("per_category must be at least 1")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_rn") <= per_category).drop("_rn")
    totals = rows.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("total"))
    return ranked.join(totals, F.col(category).eqNullSafe(F.col("_c"))).drop("_c").withColumn("truncated", F.col("total") > per_category)


def ends_nulls_last(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The first k rows in both directions, nulls last in both; up and down are the places.

    Two sorts that keep k rows, and counts. A row's place at one end gives its place at the other:
    of v rows with a value, down is v less the lesser and equal ones, plus the equal ones before it.
    """
    n = rows.agg(F.count(value).alias("_v"))
    first = rows.orderBy(F.asc_nulls_last(value), F.asc(key)).limit(k).withColumn("_at", F.row_number().over(Window.orderBy(F.asc_nulls_last(value), F.asc(key))))  # of k rows
    last = rows.orderBy(F.desc_nulls_last(value), F.asc(key)).limit(k).withColumn("_at", F.row_number().over(Window.orderBy(F.desc_nulls_last(value), F.asc(key))))
    same = Window.partitionBy("_end", value).orderBy(key)
    pool = first.withColumn("_end", F.lit(0)).union(last.withColumn("_end", F.lit(1))).withColumn("_eq", F.row_number().over(same) - 1)
    values = pool.select(F.col(value).alias("_value")).where(F.col("_value").isNotNull()).distinct()  # at most 2 k
    ties = rows.join(F.broadcast(values), F.col(value) == F.col("_value")).groupBy("_value").agg(F.count("*").alias("_ties"))
    pool = pool.join(F.broadcast(n)).join(F.broadcast(ties), F.col(value) == F.col("_value"), "left")
    other = F.col("_v") - (F.col("_at") - 1 - F.col("_eq")) - F.col("_ties") + F.col("_eq") + 1
    there = F.when(F.col(value).isNull(), F.col("_at")).otherwise(other)
    up, down = F.when(F.col("_end") == 0, F.col("_at")).otherwise(there), F.when(F.col("_end") == 1, F.col("_at")).otherwise(there)
    return pool.select(*rows.columns, up.cast("long").alias("up"), down.cast("long").alias("down")).distinct()


def outliers(rows: DataFrame, group: str, value: str, key: str, k: int) -> DataFrame:
    """The k greatest and k least rows of each group, marked top and bottom."""
    a = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.asc(key)))
    b = F.row_number().over(Window.partitionBy(group).orderBy(F.asc(value), F.asc(key)))
    marked = rows.withColumn("top", a <= k).where("top").unionByName(rows.withColumn("top", F.lit(False)).withColumn("_b", b).where(F.col("_b") <= k).drop("_b").withColumn("top", F.lit(False)).withColumn("bottom", F.lit(True)), allowMissingColumns=True)
    return marked.groupBy(*rows.columns).agg(F.max("top").alias("top"), F.coalesce(F.max("bottom"), F.lit(False)).alias("bottom"))


def nearest_median(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows nearest to the median, with their distance."""
    middle = ranges.median(rows, [], value, "_m")
    return rows.join(F.broadcast(middle)).withColumn("gap", F.abs(F.col(value) - F.col("_m"))).drop("_m").orderBy("gap", value, key).limit(k)


def by_priority(rows: DataFrame, column: str, first: Sequence[str], out: str) -> DataFrame:
    """Listed values in their order, then the others by name."""
    place = F.lit(len(first))
    for i, v in reversed(list(enumerate(first))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return rows.withColumn(out, place).orderBy(out, column)
