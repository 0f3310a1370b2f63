"""Promotion of source records to facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.jsonx import canonical
from factloom.functions.text import parse_float
from factloom.operators.nested import merge_maps
from factloom.operators.picks import newest_per


def linked(records: DataFrame, links: DataFrame, keep_unlinked: bool, key: str = "source_model_id") -> DataFrame:
    """Records with model_id; those without one are kept with null, or skipped."""
    m = links.select(F.col(key).alias("_k"), "model_id")
    return records.join(m, F.col(key) == F.col("_k"), "left" if keep_unlinked else "inner").drop("_k")


def newest(records: DataFrame, source: str = "source_id", snapshot: str = "snapshot_id") -> DataFrame:
    """Only records of each source's newest snapshot."""
    return newest_per(records, source, snapshot)


def prices(records: DataFrame, columns: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Price columns as (component, amount), missing ones left out."""
    long = records.unpivot([*keys], list(columns), "component", "amount")
    return long.replace(dict(columns), subset=["component"]).where("amount IS NOT NULL")


def capabilities(records: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Capability columns as (capability, value) text; missing ones left out."""
    text = records.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([*keys], list(columns), "capability", "value").where("value IS NOT NULL")


def matrix(rows: DataFrame, key: str, values: str, columns: Sequence[str]) -> DataFrame:
    """A row of values by column as long facts; a row of another width is an error when read."""
    checked = F.when(F.size(values) == len(columns), F.col(values)).otherwise(F.raise_error(F.concat(F.lit("row width differs: "), F.col(key).cast("string"))))
    long = rows.select(key, F.posexplode(checked).alias("_p", "score"))
    return long.select(key, F.get(F.array(*map(F.lit, columns)), F.col("_p")).alias("benchmark_id"), "score").where("score IS NOT NULL")


def price_windows(rows: DataFrame, key: str, start: str, intro_days: str, intro: str, standard: str) -> DataFrame:
    """An introductory window and the standard one after it, which do not overlap."""
    end = F.expr(f"date_add({start}, CAST({intro_days} AS INT))")
    first = rows.where(F.col(intro).isNotNull()).select(key, F.lit("intro").alias("tier"), F.col(intro).alias("amount"), F.col(start).alias("valid_from"), F.date_add(end, -1).alias("valid_to"))
    then = rows.select(key, F.lit("standard").alias("tier"), F.col(standard).alias("amount"), F.when(F.col(intro).isNotNull(), end).otherwise(F.col(start)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return first.union(then)


def measured(facts: DataFrame, links: DataFrame, benchmarks: Sequence[str], capability_names: Mapping[str, str], components: Mapping[str, str]) -> dict[str, DataFrame]:
    """results, capabilities, prices and reviews from one parse: ``facts(snapshot_id, source_model_id, slug, model_version, kind, field, value)``.

    Results of known benchmarks keep records without a model, which are also put up for review, each once; capabilities
    (fields renamed by ``capability_names``) and prices (by ``components``) need one. A price's condition is the version and slug of its
    record as JSON with sorted keys, else its id.
    """
    f = linked(facts, links, True)
    number = parse_float(F.col("value"))
    has, keys = F.col("model_id").isNotNull(), ["snapshot_id", "source_model_id", "model_id"]
    given = F.filter(F.array(F.struct(F.lit("model_version").alias("k"), F.col("model_version").alias("v")), F.struct(F.lit("slug").alias("k"), F.col("slug").alias("v"))), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    condition = F.to_json(F.map_from_entries(F.when(F.size(given) > 0, given).otherwise(F.array(F.struct(F.lit("source_model_id").alias("k"), F.col("source_model_id").alias("v"))))))
    named = lambda names: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("field"))
    text = F.when(F.col("field") == "release_date", F.col("value")).otherwise(number.cast("string"))
    return {
        "results": f.where((F.col("kind") == "evaluation") & F.col("field").isin(*benchmarks) & number.isNotNull()).select(*keys, F.col("field").alias("benchmark_id"), number.alias("score")),
        "capabilities": f.where(has & (F.col("kind") == "capability") & F.col("field").isin(*capability_names) & text.isNotNull()).select(*keys, named(capability_names).alias("capability"), text.alias("value")),
        "prices": f.where(has & (F.col("kind") == "pricing") & F.col("field").isin(*components) & number.isNotNull()).select(*keys, named(components).alias("component"), number.alias("amount"), condition.alias("condition")),
        "reviews": f.where(~has).select("snapshot_id", "source_model_id").distinct(),
    }


def launch_cells(sets: DataFrame, models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """A row for each cell of vendors' own tables: what becomes of it (``status``) and, if it is taken, the fact.

    ``sets(set_id, published_at, condition, columns, rows)``: a column has label, slug and condition, a row benchmark_id, label, metric,
    values and condition. Columns without a slug are comparisons and, like empty cells, skipped; a benchmark that ``benchmarks(id)``
    lacks is unknown, a slug that ``models(id, slug)`` lacks unresolved. The condition is that of the set, the row and the column, the
    later one winning, as JSON with sorted keys, or null. A row of another width than the columns is an error when read.
    """
    r = sets.select("set_id", "published_at", F.col("condition").alias("_set"), "columns", F.explode("rows").alias("_r"))
    say = F.concat(F.col("set_id"), F.lit(": row "), F.col("_r.label"), F.lit(" has "), F.size("_r.values"), F.lit(" values for "), F.size("columns"), F.lit(" columns"))
    cells = F.when(F.size("_r.values") == F.size("columns"), F.arrays_zip(F.col("columns").alias("c"), F.col("_r.values").alias("v"))).otherwise(F.raise_error(say))
    z = r.select("set_id", "published_at", "_set", "_r", F.posexplode(cells).alias("place", "_z"))
    known = benchmarks.select(F.col("id").alias("_b")).distinct()
    ids = models.select(F.col("slug").alias("_slug"), F.col("id").alias("model_id"))
    j = z.join(known, F.col("_r.benchmark_id") == F.col("_b"), "left").join(ids, F.col("_z.c.slug") == F.col("_slug"), "left")
    empty = F.create_map().cast("map<string,string>")
    merged = merge_maps(*[F.coalesce(c, empty) for c in ("_set", "_r.condition", "_z.c.condition")])
    status = F.when((F.coalesce("_z.c.slug", F.lit("")) == "") | F.col("_z.v").isNull(), "skipped").when(F.col("_b").isNull(), "unknown benchmark").when(F.col("model_id").isNull(), "unresolved").otherwise("taken")
    out = j.select("set_id", F.col("_r.label").alias("row_label"), F.col("_z.c.label").alias("column_label"), status.alias("status"), "model_id", F.col("_r.benchmark_id").alias("benchmark_id"), F.col("_z.v").cast("double").alias("score"), F.col("_r.metric").alias("metric"), F.when(F.size(merged) > 0, canonical(merged)).alias("condition"), F.col("published_at").alias("measured_at"))
    taken = F.col("status") == "taken"
    return out.select("set_id", "row_label", "column_label", "status", *[F.when(taken, F.col(c)).alias(c) for c in ("model_id", "benchmark_id", "score", "metric", "condition", "measured_at")])
