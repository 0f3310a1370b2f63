"""Nested results: parallel arrays, documents with children, merged maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columnar_series(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key with parallel arrays of ``columns``, in ``order``."""
    rest = [c for c in columns if c not in order]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_s"))
    return packed.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in columns])


def children(parents: DataFrame, rows: DataFrame, parent_key: str, child_key: str, order: Sequence[str], name: str) -> DataFrame:
    """``parents`` with their child rows as an ordered array of structs (empty if none)."""
    rest = [c for c in rows.columns if c not in (child_key, *order)]
    packed = rows.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    out = parents.join(packed, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def merge_maps(*maps: Column) -> Column:
    """Maps merged; later ones win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k))
