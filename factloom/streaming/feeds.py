"""Streaming variants. The batch operators are the contract; these are an extension of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_payloads(spark: SparkSession, folder: str, schema: str, keep: str = "7 days") -> DataFrame:
    """JSON files dropped into ``folder``, each content once within ``keep`` of its fetched_at."""
    raw = spark.readStream.schema(schema).json(folder)
    hashed = raw.withColumn("content_hash", F.sha2("body", 256)).withWatermark("fetched_at", keep)
    return hashed.dropDuplicatesWithinWatermark(["source_id", "url", "content_hash"])


def windowed_counts(events: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts and greatest values in tumbling windows; rows later than ``late`` are left out."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), *keys, "n", "top")


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply(batch, id)`` on every micro-batch; ``apply`` must be idempotent by id."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
