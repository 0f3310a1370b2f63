"""Dates: what a fact's date is, and keys of periods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_date(sources: Mapping[str, Column]) -> Column:
    """(at, origin): the first date that is there and where it came from."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("at"), F.lit(name).alias("origin"))) for name, c in sources.items()])


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO time; null if it is none."""
    return F.unix_millis(text.try_cast("timestamp"))


def week_key(t: Column) -> Column:
    """Year and week counted from the first of January (not the ISO week)."""
    return F.concat(F.year(t), F.lit("-"), F.floor((F.dayofyear(t) - 1) / 7).cast("int"))


def partial_date(text: Column) -> Column:
    """YYYY-MM-DD, or the first of the month of YYYY-MM."""
    return text.try_cast("date")
