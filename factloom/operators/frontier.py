"""Frontiers, records and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.ranges import carried, in_ranges


def _running_best(points: DataFrame, cost: str, gain: str, low_cost: bool) -> DataFrame:
    """(cost, best): for each distinct cost its best gain, and ``prev``: the best among better costs.

    Points are first reduced to the best of each cost in ranges, so that the ordered pass runs over
    ranges of costs in parallel: a range only needs the best of the ranges before it.
    """
    best = points.where(F.col(cost).isNotNull() & F.col(gain).isNotNull()).groupBy(cost).agg(F.max(gain).alias("best"))
    sign = 1 if low_cost else -1
    best = in_ranges(best, [], F.col(cost) * sign)
    tops = best.groupBy("_b").agg(F.max("best").alias("_top"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tops = tops.select(F.col("_b").alias("_bb"), F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(F.col(cost) * sign).rowsBetween(Window.unboundedPreceding, -1)
    out = best.join(F.broadcast(tops), F.col("_b") == F.col("_bb")).withColumn("prev", F.greatest(F.max("best").over(inside), F.col("_before")))
    return out.select(F.col(cost).alias("_cost"), "best", "prev")


def pareto_dominance(points: DataFrame, cost: str, gain: str, low_cost: bool = True) -> DataFrame:
    """Points that no other is at least as good as in both and better in one; equal points all stay.

    A point survives exactly if it has the best gain of its cost and beats all better costs strictly,
    so no point is compared with every other.
    """
    edge = _running_best(points, cost, gain, low_cost).where("prev IS NULL OR best > prev")
    return points.join(edge, (F.col(cost) == F.col("_cost")) & (F.col(gain) == F.col("best"))).select(*points.columns)


def pareto_sweep(points: DataFrame, cost: str, gain: str, ties: list[str], low_cost: bool = True) -> DataFrame:
    """Like ``pareto_dominance``, but of equal points only the first by ``ties`` stays (strictly rising gain)."""
    edge = pareto_dominance(points, cost, gain, low_cost)
    w = Window.partitionBy(cost).orderBy(*ties)
    return edge.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def records(series: DataFrame, key: str, time: str, value: str, ties: list[str]) -> DataFrame:
    """Rows whose value exceeds every earlier one of their key.

    Runs over ranges of time within a key; a range only needs the greatest value of those before it.
    """
    ranged = carried(in_ranges(series, [key], F.col(time)), [key], F.max(value), F.max, "_before")
    w = Window.partitionBy(key, "_b").orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, -1)
    m = F.greatest(F.max(value).over(w), F.col("_before"))
    return ranged.withColumn("_m", m).where(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m", "_b", "_before")
