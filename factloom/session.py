"""Session builder used by the bench, the tests and the command line."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "factloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; ``conf`` wins over these defaults."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a plan writes and reads back, in spark.checkpoint.dir, which all executors share.

    Only a local master may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once, its partitions as they are, and kept in the shared folder, so that a lost executor costs no lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


#: A task is to hold about so many rows.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its rows (or ``rows``) need, if those are more than a shuffle has; else as it is."""
    parts = (df.count() if rows is None else rows) // TASK_ROWS + 1
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once as Parquet in the shared folder, so that its size is known to plans that read it."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
