"""Pieces of published documents and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_map(rows: DataFrame, key: str, name: str, fields: Sequence[str], out: str) -> DataFrame:
    """One row a key with a map from ``name`` to a struct of ``fields``; (key, name) must be unique."""
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.struct(*fields)))).alias(out))


def as_json(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as JSON text, null fields written out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_document(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines; an empty document is an error and leaves what is there."""
    if rows.isEmpty():
        raise ValueError(f"refusing to write an empty document to {path}")
    rows.write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown_cell(c: Column) -> Column:
    """Text of a table cell: pipes escaped, line breaks as spaces, null empty."""
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def markdown_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


def status_from_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """(source, status, detail) from lines ``name: ok``, ``name: FAILED reason`` or ``name: skipped``."""
    name = F.regexp_extract(text, r"^\s*([A-Za-z0-9_.-]+)\s*:", 1)
    rest = F.regexp_extract(text, r":\s*(.*)$", 1)
    status = F.when(rest.rlike("(?i)^failed"), "failed").when(rest.rlike("(?i)^ok"), "ok").when(rest.rlike("(?i)^skip"), "skipped")
    return lines.select(name.alias("source"), status.alias("status"), rest.alias("detail")).where("source <> '' AND status IS NOT NULL")
