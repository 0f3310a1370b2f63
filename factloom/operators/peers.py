"""Documents over a cohort of peers: prices, cached prices, specifications, freshness, lineages.

A value that a document can't do without is an error when read, named by the peer's ``slug``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(value: Column, what: str) -> Column:
    """A positive number, or an error that names what is missing."""
    return F.when((value > 0) & ~F.isnan(value), value).otherwise(F.raise_error(F.concat(F.lit(f"missing {what} for "), F.coalesce("slug", F.lit("?")))).cast("double"))


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def price_label(v: Column) -> Column:
    """Dollars: whole ones without a point, under a cent with up to four places, else with up to three, cents with two."""
    cents = v * 100
    small = F.when(cents == F.floor(cents), F.format_string("%.2f", v)).otherwise(_trimmed(F.format_string("%.3f", v)))
    text = F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).when(v < 0.01, _trimmed(F.format_string("%.4f", v))).when(v < 1, small).otherwise(_trimmed(F.format_string("%.3f", v)))
    return F.concat(F.lit("$"), text)


def compact_tokens(v: Column) -> Column:
    """Tokens in thousands or millions, of 1,000 if they divide evenly, else of 1,024."""
    even = v % 1000 == 0
    millions = F.format_string("%.2f", F.when(even, v / 1e6).otherwise(v / 1048576))
    short = F.regexp_replace(F.regexp_replace(millions, r"\.00$", ""), r"(\.\d)0$", "$1")
    thousands = F.round(v / F.when(even, 1000).otherwise(1024)).cast("long").cast("string")
    return F.when(v >= 1_000_000, F.concat(short, F.lit("M"))).otherwise(F.concat(thousands, F.lit("K")))


def price_ladder(peers: DataFrame) -> DataFrame:
    """(slug, input, output, input_label, output_label) of ``peers(slug, input, output)``; both prices are required."""
    p = peers.select("slug", required(F.col("input"), "input price").alias("input"), required(F.col("output"), "output price").alias("output"))
    return p.select("*", price_label(F.col("input")).alias("input_label"), price_label(F.col("output")).alias("output_label"))


def cache_economics(peers: DataFrame, hit_rate: float = 0.9) -> DataFrame:
    """(slug, input, cache_read, effective, discount, label, label_x) of ``peers(slug, input, cache_read)``: what a token costs where ``hit_rate`` are read from a cache."""
    p = peers.select("slug", required(F.col("input"), "input price").alias("input"), required(F.col("cache_read"), "cache price").alias("cache_read"))
    p = p.withColumn("effective", hit_rate * F.col("cache_read") + (1 - hit_rate) * F.col("input")).withColumn("discount", 1 - F.col("effective") / F.col("input"))
    return p.select("*", F.concat(F.lit("-"), F.floor(F.col("discount") * 100 + 0.5).cast("string"), F.lit("%")).alias("label"), F.sqrt(F.col("effective") * F.col("input")).alias("label_x"))


def spec_card(peers: DataFrame, capabilities: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``peers`` (slug, id and others) with the greatest value of each of ``wanted`` capabilities, required, and its label in tokens.

    ``capabilities(model_id, capability, value)``: values are text; what is no whole number counts as its leading digits.
    """
    number = F.coalesce(F.regexp_extract("value", r"^\s*(-?[0-9]+)", 1).try_cast("bigint"), F.lit(0))
    c = capabilities.where(F.col("capability").isin(*wanted)).groupBy(F.col("model_id").alias("_m")).agg(*[F.max(F.when(F.col("capability") == w, number)).alias(f"_{w}") for w in wanted])
    j = peers.join(c, F.col("id") == F.col("_m"), "left")
    return j.select(*peers.columns, *[required(F.col(f"_{w}").cast("double"), w).cast("long").alias(w) for w in wanted]).withColumns({f"{w}_label": compact_tokens(F.col(w)) for w in wanted})


def freshness(peers: DataFrame) -> DataFrame:
    """(slug, cutoff, release, gap_months) of ``peers(slug, cutoff, release)`` that disclose a cutoff: months of 30.44 days between both."""
    months = F.round(F.datediff("release", "cutoff") / 30.44, 3)
    return peers.where("cutoff IS NOT NULL AND release IS NOT NULL").select("slug", "cutoff", "release", months.alias("gap_months"))


def lineage(points: DataFrame) -> DataFrame:
    """(slug, first, points) of ``points(slug, date, score)``: each one's finite scores by date, and when they begin."""
    some = points.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return some.groupBy("slug").agg(F.min("date").alias("first"), F.array_sort(F.collect_list(F.struct("date", "score"))).alias("points"))
