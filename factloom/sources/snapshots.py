"""Raw payloads: content-addressed snapshots and a registry of sources."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.merge import insert_ignore
from factloom.sources.commits import Store, run_isolated
from factloom.sources.parsers import PARSERS

#: Sources that are listed but have no parser here: nothing is read from them.
UNAVAILABLE = ("litellm", "llm_prices", "livebench", "anthropic_api", "openai_api", "gemini_api", "mistral_api", "hf_model_card", "provider_blog", "lmarena_mirror", "scale_seal")


def registry(spark: SparkSession) -> DataFrame:
    """(source_id, available) of all known sources."""
    rows = [(n, True) for n in PARSERS] + [(n, False) for n in UNAVAILABLE]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("source_id"), F.lit(a).alias("available")) for n, a in rows])))


def read_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a drop folder as (url, content, content_hash, fetched_at)."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.col("path").alias("url"), "content", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("fetched_at"))


def new_snapshots(known: DataFrame, drop: DataFrame, source_id: str) -> DataFrame:
    """Known snapshots plus those whose (source, url, hash) is new."""
    rows = drop.select(F.lit(source_id).alias("source_id"), *[c for c in known.columns if c != "source_id"])
    return insert_ignore(known, rows, ["source_id", "url", "content_hash"], [F.asc("fetched_at")])


def raw_name(fetched_at, content_hash):
    """File name of a raw payload: time and the first eight digits of the hash."""
    return F.concat(F.date_format(fetched_at, "yyyyMMdd'T'HHmmss"), F.lit("_"), F.substring(content_hash, 1, 8), F.lit(".raw"))


def write_payloads(rows: DataFrame, root: str) -> int:
    """Files below ``root``, a folder that all executors share, from ``rows(path, content)``: how many.

    A task that runs again writes the same file; rows without a path or content write none.
    """

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(root if root.startswith("file:") or "://" in root else f"file://{root}")
        for batch in batches:
            n = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is not None and content is not None:
                    where.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                    with where.open_output_stream(f"{top}/{path}") as out:
                        out.write(content)
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.select("path", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def missing_payloads(recorded: DataFrame, root: str, path: str = "raw_path") -> DataFrame:
    """Rows of ``recorded`` that name no file below ``root``, or one without content.

    Files are listed by Spark with their lengths; their contents aren't read. A folder that isn't there holds no files.
    """
    spark = recorded.sparkSession
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not where.exists(top):
        return recorded
    base = where.makeQualified(top).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("length > 0").select(F.substr("path", F.lit(len(base) + 2)).alias("_file"))
    return recorded.join(files, F.col(path) == F.col("_file"), "left_anti")


def run_sources(store: Store, raw: dict[str, DataFrame]) -> DataFrame:
    """(source, n, failed, error): every source's payloads parsed and kept as a table of ``store``, each by itself.

    A source that fails, when it is planned or at any row, keeps the table of its last good run.
    """
    return run_isolated(store, {name: partial(lambda n: PARSERS[n](raw[n]), name) for name in raw})


def exit_code(status: DataFrame) -> int:
    """1 if every source failed, else 0."""
    return int(status.where("failed = 0").isEmpty() and not status.isEmpty())
