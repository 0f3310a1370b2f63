"""Validity windows: in force at a time, capping, bounding, coalescing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from factloom.session import durable


def valid_at(start: str, end: str, at: Column) -> Column:
    """Whether [start, end] holds ``at``; a null end is open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open intervals meet; null ends (and starts) are open."""
    return F.coalesce(start < other_end, F.lit(True)) & F.coalesce(other_start < end, F.lit(True))


def cap_windows(rows: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str]) -> DataFrame:
    """Ends that reach past the next start of the same keys are set to it; adds ``capped``.

    Null starts come first. Equal starts give the earlier row a window of no length.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start), *ties)
    nxt = F.lead(start).over(w)
    late = nxt.isNotNull() & (F.col(end).isNull() | (F.col(end) > nxt))
    return rows.withColumn("_next", nxt).withColumn("capped", F.coalesce(late, F.lit(False))).withColumn(end, F.when(F.col("capped"), F.col("_next")).otherwise(F.col(end))).drop("_next")


def bound_by_next(rows: DataFrame, keys: Sequence[str], time: str, out: str) -> DataFrame:
    """Adds ``out``: the next distinct ``time`` among rows of the same keys, null for the last."""
    times = rows.select(*keys, time).distinct()
    nxt = times.withColumn(out, F.lead(time).over(Window.partitionBy(*keys).orderBy(time)))
    right = nxt.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_t"), out)
    on = F.col(time).eqNullSafe(F.col("_t"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(right, on).drop("_t", *[f"_{k}" for k in keys])


def coalesce_islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str]) -> DataFrame:
    """Equal facts whose intervals overlap, as one row an island: keys, start, end, n.

    A row opens an island if it begins at or after the greatest end so far. Null starts and ends are
    open. Right for rows that end after they begin; ``fold_islands`` is for others.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start), *ties)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.col(end).isNull()).over(before)
    reach = F.max(end).over(before)
    first = F.row_number().over(w) == 1
    new = first | ~(F.coalesce(open_before, F.lit(False)) | F.coalesce(F.col(start) < reach, F.lit(True)))
    marked = rows.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_island").agg(F.min_by(start, F.struct(F.col(start).isNotNull(), start)).alias(start), F.when(F.max(F.col(end).isNull()), F.lit(None)).otherwise(F.max(end)).alias(end), F.count("*").alias("n"))
    return merged.drop("_island")


#: What a run of rows does to the island before it, (start, end): it goes on as (start, max(end, most)) if
#: end > reach and start < least; else the run ends with the island (last_start, last_end), whatever came before.
Step = tuple[float, float, float, float, float]


def joins(island: tuple[float, float], start: float, end: float) -> bool:
    """Whether a row meets the island so far; no island is one that ends before all starts."""
    return island[1] > start and end > island[0]


def after(island: tuple[float, float], step: Step) -> tuple[float, float]:
    """The island that ``step`` leaves after ``island``."""
    reach, least, most, last_start, last_end = step
    return (island[0], max(island[1], most)) if island[1] > reach and island[0] < least else (last_start, last_end)


def then(one: Step, two: Step) -> Step:
    """Two steps as one. Rows come by start, so once a run breaks the island before it, what follows is the same for every such island."""
    reach = one[0] if one[2] > two[0] else max(one[0], two[0])
    return (reach, min(one[1], two[1]), max(one[2], two[2]), *after(one[3:], two))


def row_step(start: float, end: float) -> Step:
    return start, end, end, start, end


NO_ISLAND = (float("inf"), float("-inf"))


def with_islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str], out: str = "island") -> DataFrame:
    """Adds ``out``, a number for each island: rows of equal ``keys`` that meet one after the other, by start and ``ties``.

    A row joins the island so far if it begins before its end and ends after its start (null starts and
    ends are open); then the later of both ends holds. Else it opens the next island, even if it ends
    before it begins. Dates, times and numbers are compared as doubles, times in microseconds. What a run of rows does to the island before it has a closed form (``Step``), so
    ranges of the order, a partition each, are folded apart; two such steps a partition go through the
    driver, and each range is folded again from where the ranges before it left off. Rows of one key may lie in
    many partitions; memory doesn't grow with them.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema[start].dataType.typeName()
    of_day = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
    number = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_date(c.cast("date")) * F.lit(86400e6) + of_day(c) * F.lit(1e6)}.get(kind, lambda c: c)
    low, high = (F.coalesce(number(F.col(c)).cast("double"), F.lit(open_)) for c, open_ in ((start, float("-inf")), (end, float("inf"))))
    order = [*keys, F.asc_nulls_first(start), *ties]
    placed = durable(rows.withColumns({"_low": low, "_high": high}).repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())

    def runs(batch):
        """(first row of a run of equal keys, the row after it, its keys)"""
        values = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows
        values = [tuple("NaN" if x != x else x for x in v) for v in values]
        cuts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
        return zip(cuts, [*cuts[1:], len(values)], [values[i] for i in cuts], strict=True)

    def summed(batches):
        """The first and the last run of a partition as steps; only these go on beyond it."""
        import pyarrow as pa

        found, at = [], 0
        for batch in batches:
            low, high = (batch.column(c).to_pylist() for c in ("_low", "_high"))
            for i, j, key in runs(batch):
                if not found or found[-1][0] != repr(key):
                    found = [*found[:1], [repr(key), batch.column("_part")[0].as_py(), None, 0]]
                run = found[-1]
                for x in range(i, j):
                    if run[2] is None or not joins(run[2][3:], low[x], high[x]):
                        run[3] = at + x  # the row that opens the last island
                    step = row_step(low[x], high[x])
                    run[2] = then(run[2], step) if run[2] else step
            at += batch.num_rows
        out = [{"part": part, "place": i, "key": key, "step": list(step), "opens": opens} for i, (key, part, step, opens) in enumerate(found)]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("place", pa.int32()), ("key", pa.string()), ("step", pa.list_(pa.float64())), ("opens", pa.int64())]))

    steps = placed.select(*keys, "_low", "_high", "_part").mapInArrow(summed, "part int, place int, key string, step array<double>, opens long")
    carried, before = {}, (None, NO_ISLAND, -1)  # key, island and its number, as they are before a partition
    for r in sorted(steps.collect(), key=lambda r: (r["part"], r["place"])):
        if r["place"] == 0:
            carried[r["part"]] = before
        island, of = (before[1], before[2]) if before[0] == r["key"] else (NO_ISLAND, -1)
        whole = island[1] > r["step"][0] and island[0] < r["step"][1]  # all of the run's rows join it
        before = (r["key"], after(island, tuple(r["step"])), of if whole else (r["part"] << 33) + r["opens"])
    share = rows.sparkSession.sparkContext.broadcast(carried)  # a row a partition

    def numbered(batches):
        import pyarrow as pa

        key_of, island, of, at = None, NO_ISLAND, -1, 0
        for batch in batches:
            if not at and batch.num_rows:
                part = batch.column("_part")[0].as_py()
                key_of, island, of = share.value[part]
            low, high, got = (*(batch.column(c).to_pylist() for c in ("_low", "_high")), [])
            for i, j, key in runs(batch):
                if repr(key) != key_of:
                    key_of, island = repr(key), NO_ISLAND
                for x in range(i, j):
                    if joins(island, low[x], high[x]):
                        island = (island[0], max(island[1], high[x]))
                    else:
                        island, of = (low[x], high[x]), (part << 33) + at + x
                    got.append(of)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(got, pa.int64())], [*batch.schema.names[:-3], out])

    return placed.select(*rows.columns, "_low", "_high", "_part").mapInArrow(numbered, StructType([*rows.schema.fields, StructField(out, LongType())]))


def fold_islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Like ``coalesce_islands`` for intervals that may end before they begin: keys, start, end, n, and ``first`` of each island's first row."""
    islands = with_islands(rows, keys, start, end, ties, "_island")
    begin = F.struct(F.col(start).isNotNull().alias("known"), F.col(start).alias("s"), *ties)
    held = [F.min_by(c, begin).alias(c) for c in (start, *first)]
    latest = F.when(F.max(F.col(end).isNull()), F.lit(None)).otherwise(F.max(end)).alias(end)
    return islands.groupBy(*keys, "_island").agg(*held, latest, F.count("*").alias("n")).drop("_island")
