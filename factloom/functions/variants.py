"""JSON of unknown shape as VARIANT values, walked level by level in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import durable


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, VOID for a JSON null, or the scalar's type; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text(v: Column) -> Column:
    """A scalar as text, anything else as JSON; a JSON null and blank text as null."""
    t = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when((kind(v) != "VOID") & (t != ""), t)


def exploded(rows: DataFrame, column: str) -> DataFrame:
    """A row for each member of the object, or item of the array, in ``column``: adds pos, key (null for items) and value.

    Members come in the order of their names, as VARIANT keeps them. Other values give no row.
    """
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer())).where("pos IS NOT NULL")


def walked(rows: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, path, key, value): every member of the objects in ``column``, at any depth below objects.

    ``path`` has the places of the objects on the way, so that a member comes before those below its
    own object, as when one object after the other is searched. One job a level; there are as many as the deepest
    payload has.
    """
    level = rows.select(row_id, F.array().cast("array<int>").alias("path"), F.col(column).alias("_v")).where(kind(F.col("_v")) == "OBJECT")
    out = None
    while True:
        found = durable(exploded(level, "_v").select(row_id, "path", "pos", "key", "value"))
        here = found.select(row_id, "path", "key", "value")
        out = here if out is None else out.unionByName(here)
        level = found.where(kind(F.col("value")) == "OBJECT").select(row_id, F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("_v"))
        if level.isEmpty():
            return out


def first_of(members: DataFrame, row_id: str, within: Column | None = None) -> DataFrame:
    """(row_id, key, value) of ``walked`` members: the first value of each key, a JSON null being none, as text."""
    some = members if within is None else members.where(within)
    return some.where(kind(F.col("value")) != "VOID").groupBy(row_id, "key").agg(F.min_by(text(F.col("value")), "path").alias("value"))
