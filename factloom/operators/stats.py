"""Modes, medians and the index-based quantiles that are not percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import ranges


def mode_low(value: Column) -> Column:
    """The most frequent positive value; of equally frequent ones the lowest. Null if there is none."""
    return F.mode(F.when(value > 0, value), True)


def priority_mode(rows: DataFrame, keys: Sequence[str], source: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """``mode_low`` of the first source in ``order`` that has a positive value."""
    modes = rows.groupBy(*keys).agg(*[mode_low(F.when(F.col(source) == s, F.col(value))).alias(f"_m{i}") for i, s in enumerate(order)])
    return modes.select(*keys, F.coalesce(*[f"_m{i}" for i in range(len(order))]).alias(out))


def ranked(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds _i, the place of the value in its group from 0 (largest last), and _n, the group's size; for many groups of moderate size."""
    w = Window.partitionBy(*keys)
    return rows.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1)


def rank_quantile_desc(rows: DataFrame, keys: Sequence[str], value: str, share: float, out: str, few_keys: bool = False) -> DataFrame:
    """Element floor(share * n) of each group's values in descending order (not a percentile); ``few_keys`` for large groups."""
    r = (ranges.ranked if few_keys else ranked)(rows, keys, value)
    return r.where(F.col("_n") - 1 - F.col("_i") == F.floor(F.col("_n") * share)).groupBy(*keys).agg(F.max(value).alias(out))


def index_quantile(rows: DataFrame, keys: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """Element round_half_even(share * (n - 1)) of each group's ascending values."""
    r = ranked(rows, keys, value)
    return r.where(F.col("_i") == F.bround((F.col("_n") - 1) * share)).groupBy(*keys).agg(F.max(value).alias(out))


def first_samples(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, sample: str) -> DataFrame:
    """Count of each group and its first k samples joined by commas; no group is collected whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    head = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(sample).cast("string").alias("s")))), lambda x: x["s"]), ",").alias("samples"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(head, list(keys))
