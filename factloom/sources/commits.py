"""Several tables that change together or not at all: data in staging folders, published by one manifest.

A store is a folder with ``data`` and ``manifests``. A commit writes every table to a new folder below
``data``; only when all are whole is a manifest put in place that names, for each table, the folder
that holds it. Readers see the tables of the newest manifest, so they never see half a commit. A
manifest's number may be taken once: of two commits that began from the same one, the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit was published since this one began."""


class Rejected(ValueError):
    """Nothing was written, as the plan has problems."""


class Store:
    """Tables below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def version(self) -> int:
        """The number of the newest manifest, 0 if there is none."""
        folder = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([0, *(int(n) for n in names if n.isdigit())])

    def manifest(self, version: int | None = None) -> dict:
        """{table: {path, schema, rows}} of a version; empty before the first commit."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"manifests/{version:09d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.read(name, version) for name in self.manifest(version)}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest)."""
        entry = self.manifest(version)[name]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def stage(self, name: str, rows: DataFrame) -> dict:
        """``rows`` in a folder that nothing names yet; what a manifest says of it."""
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        try:
            rows.write.mode("errorifexists").parquet(path)
        except BaseException:
            self._drop(path)
            raise
        return {"path": path, "schema": rows.schema.jsonValue(), "rows": self.spark.read.schema(rows.schema).parquet(path).count()}

    def _drop(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def publish(self, staged: Mapping[str, dict], base: int) -> int:
        """Makes ``staged`` visible beside the other tables of version ``base``: one rename, which fails if the number is taken."""
        text, number = json.dumps(self.manifest(base) | dict(staged), sort_keys=True), base + 1
        hidden, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{number:09d}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(hidden, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(hidden, False)
            if self._fs.exists(final):
                raise Conflict(f"version {number} was published by another commit") from e
            raise
        return number

    def commit(self, plans: Mapping[str, DataFrame], problems: DataFrame | None = None, dry_run: bool = False, base: int | None = None) -> dict[str, DataFrame]:
        """The tables that ``plans`` make, all published together; in a dry run the plans themselves, and nothing is written.

        With rows in ``problems`` nothing is written and ``Rejected`` is raised. A failure while one
        of the tables is written leaves all of them as they were.
        """
        if problems is not None and (found := problems.limit(5).collect()):
            raise Rejected("; ".join(", ".join(map(str, r)) for r in found))
        if dry_run:
            return dict(plans)
        base, staged = self.version() if base is None else base, {}
        try:
            for name, rows in plans.items():
                staged[name] = self.stage(name, rows)
            version = self.publish(staged, base)
        except BaseException:
            for entry in staged.values():
                self._drop(entry["path"])
            raise
        return {name: self.read(name, version) for name in plans}

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last ``keep`` manifests names, and says how many; not beside a commit that runs."""
        version, named, gone = self.version(), set(), 0
        for v in range(max(1, version - keep + 1), version + 1):
            named |= {e["path"].rpartition("/")[2] for e in self.manifest(v).values()}
        if self._fs.exists(self._path("data")):
            for f in self._fs.listStatus(self._path("data")):
                if f.getPath().getName() not in named:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone


def run_isolated(store: Store, plans: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(source, n, failed, error): each source's plan made, read and staged by itself; those that came through are published together.

    Spark reads nothing before a write, so a source fails wherever its first bad row is; what it had
    written by then is deleted, and the table of its last good run stays. Rows are counted in what was
    written.
    """
    base, staged, status = store.version(), {}, []
    for name, plan in plans.items():
        try:
            staged[name] = store.stage(name, plan())
            status.append((name, staged[name]["rows"], 0, None))
        except Exception as e:  # noqa: BLE001  any source may fail in any way; it is reported
            lines = [x.strip() for x in str(e).splitlines() if x.strip()] or [""]
            status.append((name, 0, 1, f"{type(e).__name__}: {lines[0]}"[:300]))
    try:
        if staged:
            store.publish(staged, base)
    except BaseException:
        for entry in staged.values():
            store._drop(entry["path"])
        raise
    return store.spark.createDataFrame(status, "source string, n long, failed int, error string")
