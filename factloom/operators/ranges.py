"""Ranges of an ordering column, so that an ordered pass over a key with very many rows runs in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A range is to hold about so many rows of its key.
ROWS = 100_000


def place_in(edges: Column, by: Column, most: int) -> Column:
    """How many of the ascending ``edges`` (``most`` or fewer) lie below ``by``: a binary search, bit by bit."""
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(bits, F.lit(0), lambda low, step: F.when(F.get(edges, low + step - 1) < by, low + step).otherwise(low))


def in_ranges(rows: DataFrame, keys: Sequence[str], by: Column, edges_of: DataFrame | None = None, out: str = "_b") -> DataFrame:
    """Adds ``out``, the number of the range of ``by`` that a row is in within its key (nulls in the first).

    A key has as many ranges as its rows need (``ROWS`` a range), at most one a shuffle partition (64 at least), so they
    follow the cluster and the data; a small key is one range. Edges come from ``edges_of`` (``rows``); keys are few, and
    their edges are joined to the rows, broadcast if Spark finds them small. A row finds its range by binary search.
    """
    n = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_k{i}" for i in range(len(keys))]
    fine = F.percentile_approx(by, [i / n for i in range(1, n)], 20 * n)
    edges = (rows if edges_of is None else edges_of).groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(fine.alias("_fine"), F.count("*").alias("_rows"))
    step = F.greatest(F.lit(1), F.floor(F.lit(n * ROWS) / F.col("_rows")).cast("int"))
    edges = edges.select(*names, F.filter("_fine", lambda e, i: (i + 1) % step == 0).alias("_edges"))
    on = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    joined = rows.join(edges, on, "left") if on else rows.join(F.broadcast(edges))
    return joined.withColumn(out, F.when(by.isNull(), 0).otherwise(F.coalesce(place_in(F.col("_edges"), by, n - 1), F.lit(0)))).drop("_edges", *names)


def carried(ranged: DataFrame, keys: Sequence[str], total: Column, carry, out: str, bucket: str = "_b") -> DataFrame:
    """Adds ``out``: what the ranges before a row's own come to.

    ``total`` sums up one range; ``carry(column)`` does so with the ranges before, as a window aggregate.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sums = ranged.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(bucket).alias("_kb")).agg(total.alias("_total"))
    before = Window.partitionBy(*names).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_kb", carry(F.col("_total")).over(before).alias(out))
    on = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    return ranged.join(sums, [*on, F.col(bucket) == F.col("_kb")]).drop("_kb", *names)


def ranked(rows: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Adds _i, the place of the value in its group from 0 (largest last), and _n, the group's size, range by range."""
    some = rows.where(F.col(value).isNotNull())
    placed = carried(in_ranges(some, keys, F.col(value)), keys, F.count("*"), F.sum, "_before")
    names = [f"_g{i}" for i in range(len(keys))]
    sizes = some.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value, *ties)
    numbered = placed.withColumn("_i", F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))).drop("_b", "_before")
    on = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    return (numbered.join(sizes, on) if on else numbered.join(F.broadcast(sizes))).drop(*names)


def median(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, out): the exact median of each group, the mean of the middle two.

    Equal values are counted first; the middle ones are then found by the counts of ranges before
    theirs, so no buffer holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = carried(in_ranges(counts, keys, F.col(value)), keys, F.sum("_c"), F.sum, "_before")
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    upto = F.coalesce("_before", F.lit(0)) + F.sum("_c").over(inside)
    names = [f"_g{i}" for i in range(len(keys))]
    sizes = counts.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(F.sum("_c").alias("_n"))
    on = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    marked = placed.withColumn("_upto", upto)
    marked = marked.join(sizes, on) if on else marked.join(F.broadcast(sizes))
    middle = marked.where((F.col("_upto") > F.floor((F.col("_n") - 1) / 2)) & (F.col("_upto") - F.col("_c") <= F.floor(F.col("_n") / 2)))
    return middle.groupBy(*keys).agg((0.5 * F.min(value) + 0.5 * F.max(value)).alias(out))
