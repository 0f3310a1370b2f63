"""Typed checks of payload fields and what is derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(payload: Column, required: Mapping[str, str]) -> Column:
    """Names of fields of a JSON object that are missing or of another type than said.

    Types are int (true and false are none), text (not blank) and list.
    """
    tests = []
    for name, kind in required.items():
        raw = F.get_json_object(payload, f"$.{name}")
        typed = F.variant_get(F.try_parse_json(payload), f"$.{name}", "variant")
        what = F.schema_of_variant(typed)
        if kind == "int":
            good = what == "BIGINT"
        elif kind == "text":
            good = (what == "STRING") & (F.trim(raw) != "")
        else:
            good = what.startswith("ARRAY")
        tests.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def split_valid(rows: DataFrame, payload: str, required: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their problems)."""
    marked = rows.withColumn("problems", problems(F.col(payload), required))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def alias_kind(s: Column) -> Column:
    """What a source's name looks like: a path, a dated version, a route with a suffix, or plain."""
    return F.when(s.contains(":"), "route").when(s.rlike("[0-9]{4}-?[0-9]{2}-?[0-9]{2}"), "dated").when(s.contains("/"), "path").otherwise("plain")


def size_bytes(candidates: Sequence[Column]) -> Column:
    """The first candidate that is a positive whole number."""
    return F.coalesce(*[F.when(c.try_cast("bigint") > 0, c.try_cast("bigint")) for c in candidates])


def run_order(runs: int, models: DataFrame, key: str, interleaved: bool) -> DataFrame:
    """Every model in every run, with its place: run by run, or model by model."""
    each = models.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return each.orderBy("run", key) if interleaved else each.orderBy(key, "run")
