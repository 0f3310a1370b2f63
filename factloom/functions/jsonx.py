"""JSON helpers. Fixed paths stay on the JVM; recursion over unknown shapes is an Arrow UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names whose values are never published (fixed values).
SECRET = re.compile(r"(api[_-]?key|token$|secret|password|authorization|credential)", re.I)


def object_or_empty(s: Column) -> Column:
    """The object as map<string,string>; an empty map if the text is no object."""
    return F.coalesce(F.when(F.typeof(s) == "string", F.from_json(F.when(F.trim(s).startswith("{"), s), "map<string,string>")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def path_coalesce(s: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(s, p) for p in paths])


def canonical(m: Column) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def modalities(s: Column) -> Column:
    """A JSON array, a JSON string or bare text as a list."""
    t = F.trim(s)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(t, '^"|"$', "")))


def _redacted(value):
    if isinstance(value, dict):
        return {k: _redacted(v) for k, v in value.items() if not SECRET.search(k)}
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    return None if isinstance(value, str) and re.match(r"^(/|[A-Za-z]:\\|file://)", value) else value


@F.pandas_udf(T.StringType())
def redact(s: pd.Series) -> pd.Series:
    """Drops secret-like keys at any depth and nulls absolute paths; text that is no JSON gives null."""

    def one(text):
        try:
            return json.dumps(_redacted(json.loads(text)), sort_keys=True)
        except (TypeError, ValueError):
            return None

    return s.map(one)


def nested_lookup(key: str):
    """A function of a JSON column: the first value of ``key`` at any depth, as JSON text, breadth first."""

    @F.pandas_udf(T.StringType())
    def find(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                level = [json.loads(text)]
            except (TypeError, ValueError):
                return None
            while level:
                below = []
                for v in level:
                    if isinstance(v, dict):
                        if key in v:
                            return json.dumps(v[key], sort_keys=True)
                        below += v.values()
                    elif isinstance(v, list):
                        below += v
                level = below
            return None

        return s.map(one)

    return find
