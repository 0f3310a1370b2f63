"""Shared parts: durable intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    own = {c.lower() for c in df.columns}
    return [next(c for c in (f"{n}{'_' * k}" for k in range(len(own) + 1)) if c.lower() not in own) for n in names]


#: Folders that this process has filled in the shared folder.
_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared one."""
    _made.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Deletes all folders made by ``new_folder`` so far, and says how many; to be called once no frame made from them is read any more.

    Checkpoints go with their frames where spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    gone = 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``durable``, as compressed Parquet: for tables with large columns."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(kept: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``kept`` (a durable table of a few numbers a row) to be broadcast if it has at most ``most_rows`` rows.

    Beyond that it is joined by shuffling.
    """
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _toward_min(pairs: DataFrame, keep: str, heavy: int) -> DataFrame:
    """For each u: link the neighbours named by ``keep`` (and u itself) to the least of u and its neighbours.

    Least values are pre-aggregated, then joined back. Nodes of more than ``heavy`` neighbours are
    few (at most pairs / heavy) and are broadcast, so that no node's neighbours are one group.
    """
    least = durable(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"), "n"))
    many = F.broadcast(least.where(F.col("n") > heavy).select(F.col("mu").alias("hu"), F.col("m").alias("hm")))
    known = pairs.join(many, F.col("u") == F.col("hu"), "left")
    few = least.where(F.col("n") <= heavy).select("mu", "m", F.lit(0).alias("one"))
    side = F.when(F.col("hm").isNull(), 0).otherwise(F.hash("v").bitwiseOR(F.lit(1)))  # never 0: a heavy node's rows meet none
    joined = known.withColumn("side", side).join(few, (F.col("u") == F.col("mu")) & (F.col("side") == F.col("one")), "left").select("u", "v", F.coalesce("hm", "m").alias("m"))
    if keep == "larger":
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("mu != m").select(F.col("mu").alias("u"), F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(edges: DataFrame, max_rounds: int = 60, heavy: int = 100_000) -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: rows (node, component), component = least node.

    Alternates large-star and small-star steps until nothing changes; every round is a few joins
    over the edges and is written to the shared folder. Nodes without an edge are not returned.
    Null ends and loops are ignored. Nodes of more than ``heavy`` neighbours (or a 5,000th of all edges, so that these
    nodes stay few) are dealt out by neighbour. Raises if it has not settled after ``max_rounds`` rounds.
    """
    star = durable(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, heavy = None, max(heavy, star.count() // 5_000)
    for _ in range(max_rounds):
        mark = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = _toward_min(_both_ways(star), "larger", heavy).where("u != v").distinct()
        # as Parquet: a checkpoint hands its plan's constraints on, which would grow from round to round
        star = stored(_toward_min(large, "smaller", heavy).where("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
