"""Change events: a value that differs from the one before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the previous one of their keys, with ``before``.

    The first row of a key is no change; null and null are equal.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return marked.where((F.col("_n") > 1) & ~F.col("before").eqNullSafe(F.col(value))).drop("_n")


def last_of_day(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], day: str = "day") -> DataFrame:
    """The last row of each day of each key."""
    dated = rows.withColumn(day, F.to_date(time))
    best = dated.groupBy(*keys, day).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order)])).alias("_b"))
    return best.select(*keys, day, "_b.*")
