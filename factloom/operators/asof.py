"""As-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.ranges import carried, in_ranges


def latest_at_or_before(cuts: DataFrame, facts: DataFrame, key: str, cut: str, time: str, ties: Sequence[str] = ()) -> DataFrame:
    """For each (key, cut): the last fact at or before it. ``cuts`` has one row a key.

    An equi join on the key and one aggregate by the greatest (time, ties).
    """
    c = cuts.select(F.col(key).alias("_k"), F.col(cut).alias("_cut"))
    hit = facts.join(c, (F.col(key) == F.col("_k")) & (F.col(time) <= F.col("_cut")))
    best = hit.groupBy(key, F.col("_cut").alias(cut)).agg(F.max(F.struct(time, *ties, *[x for x in facts.columns if x not in (key, time, *ties)])).alias("b"))
    return best.select(key, cut, "b.*")


def asof_grid(facts: DataFrame, key: str, time: str, grid: Column, value: str, ties: Sequence[str], out: str, few_keys: bool = False) -> DataFrame:
    """(key, grid time, value): the last value at or before each grid time, for keys that have one.

    Grid rows are merged into the key's own rows and the last value is carried forward, so that no
    fact meets more than its own key's rows and grid times. With ``few_keys`` a key's rows are dealt
    out in ranges of time, each with the last value of those before it.
    """
    points = facts.select(key, F.col(time).alias("_t"), *ties, F.col(value).alias("_v"), F.lit(0).alias("_g"))
    marks = facts.select(key).distinct().select(key, F.explode(grid).alias("_t"), *[F.lit(None).cast(facts.schema[t].dataType).alias(t) for t in ties], F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(1).alias("_g"))
    both, part = points.unionByName(marks), [key]
    if few_keys:
        last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", *ties)))
        both = carried(in_ranges(both, [key], F.col("_t"), points), [key], last, lambda c: F.last(c, ignorenulls=True), "_before")
        part = [key, "_b"]
    w = Window.partitionBy(*part).orderBy("_t", "_g", *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_v", ignorenulls=True).over(w)
    both = both.withColumn("_last", F.coalesce(found, "_before") if few_keys else found)
    return both.where("_g = 1 AND _last IS NOT NULL").select(key, F.col("_t").alias(out), F.col("_last").alias(value))


def delta_over(facts: DataFrame, key: str, time: str, value: str, days: int, ties: Sequence[str] = ()) -> DataFrame:
    """(key, latest, before, delta): the latest value less the last one at least ``days`` earlier."""
    end = facts.groupBy(F.col(key).alias("_k")).agg(F.max(time).alias("_end"))
    rows = facts.join(end, F.col(key) == F.col("_k"))
    old = F.col(time) <= F.col("_end") - F.expr(f"INTERVAL {days} DAYS")
    order = F.struct(time, *ties)
    out = rows.groupBy(key).agg(F.max_by(value, order).alias("latest"), F.max_by(F.when(old, F.col(value)), F.when(old, order)).alias("before"))
    return out.withColumn("delta", F.col("latest") - F.col("before"))
