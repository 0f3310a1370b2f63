"""Quality gates: every check gives rows (check, severity, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, check: str, severity: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def downgrade(found: DataFrame, baseline: DataFrame, signature: Sequence[str]) -> DataFrame:
    """``found`` with severity: error, or warning for issues that the baseline has, too."""
    known = baseline.select(*[F.col(c).alias(f"_{c}") for c in signature]).distinct().withColumn("_known", F.lit(True))
    on = None
    for c in signature:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    out = found.join(known, on, "left")
    return out.withColumn("severity", F.when(F.col("_known"), "warning").otherwise("error")).select(*found.columns, "severity")


# Cadences and their periods in days; cadences that follow no schedule.
PERIODS = {"hour": 1, "live": 1, "continuous": 1, "frequent": 1, "daily": 1, "periodic": 1, "weekly": 7, "month": 30}
UNSCHEDULED = ("frozen", "event", "release", "on-demand", "on demand", "on-change", "maintained", "on request")


def stale_days(cadence: Column) -> Column:
    """Days until a source of this cadence is stale: three periods, at least 14; null without schedule."""
    c = F.lower(F.trim(F.coalesce(cadence, F.lit(""))))
    period = F.coalesce(*[F.when(c.contains(k), F.lit(d)) for k, d in PERIODS.items()])
    return F.when(~c.rlike("|".join(UNSCHEDULED)), F.greatest(period * 3, F.when(period.isNotNull(), F.lit(14))))


def summary(all_issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, blocked."""
    out = all_issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.withColumn("blocked", F.col("errors") > 0)
