"""Paged sources: a Spark data source whose partitions are the pages of something that is fetched by offset."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(offset, length) -> the text of a page, JSON with rows and, on the first, num_rows_total.
Fetch = Callable[[int, int], str]


#: Up to so many pages are a partition each; of more, a partition is a run of pages.
PARTITIONS = 1_000


class Page(InputPartition):
    def __init__(self, offsets: range, body: str | None = None):
        self.offsets, self.body = offsets, body


class PageReader(DataSourceReader):
    """The first page is fetched when the scan is planned, as it says how many there are; the others in tasks, each tried again by itself."""

    def __init__(self, fetch: Fetch, length: int, tries: int, wait: float):
        self.fetch, self.length, self.tries, self.wait = fetch, length, tries, wait

    def page(self, offset: int) -> str:
        for turn in range(self.tries):
            try:
                return self.fetch(offset, self.length)
            except Exception:
                if turn + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**turn)
        raise ValueError("tries must be 1 or more")

    def partitions(self) -> list[Page]:
        body = self.page(0)
        first = json.loads(body)
        rows = first.get("rows") if isinstance(first, dict) else None
        n = len(rows) if isinstance(rows, list) else 0
        total = first.get("num_rows_total") if isinstance(first, dict) else None
        total = n if total is None else int(total)
        rest = range(self.length, total if n else 0, self.length)
        run = max(1, -(-len(rest) // PARTITIONS))
        return [Page(range(1), body), *(Page(rest[i : i + run]) for i in range(0, len(rest), run))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for offset in partition.offsets:
            yield offset, partition.body if partition.body is not None else self.page(offset)


def read_pages(spark: SparkSession, fetch: Fetch, length: int = 100, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """(offset, body): a row a page, a partition a page (of over ``PARTITIONS`` pages, runs of them). ``fetch`` runs in tasks, so it is to hold no connection.

    Pages are as many as the first one's ``num_rows_total`` says; without it, or if the first has no rows, there is one. A page that
    fails ``tries`` times ends the read.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "factloom_pages"

        def schema(self) -> str:
            return "offset long, body string"

        def reader(self, schema) -> DataSourceReader:
            return PageReader(fetch, length, tries, wait)

    spark.dataSource.register(Pages)
    return spark.read.format("factloom_pages").load()


def enriched(spark: SparkSession, wanted: DataFrame, fetch: Callable[[str], tuple[int, str]], limit: int = 150) -> DataFrame:
    """(model_id, status, body) of the ``limit`` newest of ``wanted(model_id, created)``, one fetch each in tasks.

    Ties go to the lesser id. A fetch that raises has the status 0 and its error as body, so failures
    can be counted; the limit is the feature, as the source allows so many calls.
    """
    from pyspark.sql import functions as F

    some = wanted.where("model_id IS NOT NULL").orderBy(F.desc_nulls_last("created"), "model_id").limit(limit).repartition(min(limit, 32), "model_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for model in batch.column(0).to_pylist():
                try:
                    out.append((model, *fetch(model)))
                except Exception as e:  # noqa: BLE001  any call may fail in any way; it is counted
                    out.append((model, 0, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(("model_id", "status", "body"), r, strict=True)) for r in out], pa.schema([("model_id", pa.string()), ("status", pa.int32()), ("body", pa.string())]))

    return some.select("model_id").mapInArrow(run, "model_id string, status int, body string")
