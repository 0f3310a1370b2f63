"""One row of each group: picks, survivors, newest snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import spread


def latest_pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group under a total order (Spark limits groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exact duplicates on ``keys`` (null equals null) reduced to the first by ``order``."""
    return latest_pick(df, keys, order)


def first_and_count(df: DataFrame, keys: Sequence[str], first: str, out: str) -> DataFrame:
    """(keys, first, out): duplicates on ``keys`` (null equals null) with their least ``first`` and their number. No group is sorted, and a task holds the sums of its rows, of which it has ``TASK_ROWS`` or a shuffle's share."""
    return spread(df.select(*keys, first), *keys).groupBy(*keys).agg(F.min(first).alias(first), F.count("*").alias(out))


def newest_per(df: DataFrame, group: str, version: str) -> DataFrame:
    """Rows whose ``version`` is the greatest of its ``group``."""
    top = df.groupBy(group).agg(F.max(version).alias("_top"))
    return df.join(top.withColumnRenamed(group, "_g"), (F.col("_g") == F.col(group)) & (F.col("_top") == F.col(version)), "left_semi")
