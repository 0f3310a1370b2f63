"""Importance resampling toward a target distribution: n-gram bucket gains, Gumbel noise, and the highest scores.

Every text becomes an array of bucket numbers; a gain per bucket tells how much commoner it is in the
target. A text's weight is the sum of its buckets' gains. Which rows are drawn is settled by a
distributed quickselect: random pivot keys, exact counts of the rows above, at and below each, and
on with the interval that holds the k-th key. Only the rows drawn are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, fresh, stored

BUCKETS = 10_000
#: Bytes of words stay, in lower case; all others part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320


def _shifts(most: int) -> np.ndarray:
    """``[n, k, b]``: what byte k of a checksum, of value b, becomes after n further zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    out = [np.stack(rows)]
    for _ in range(most):
        out.append((out[-1] >> np.uint32(8)) ^ step[out[-1] & np.uint32(255)])
    return np.stack(out)


LONGEST = 160
SHIFT = _shifts(LONGEST).ravel()


def _shifted(crc: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """Checksums after ``by`` further zero bytes each."""
    at, byte = np.asarray(by, np.intp) * 1024, crc.astype("<u4").view(np.uint8).reshape(-1, 4)
    out = SHIFT.take(at + byte[:, 0])
    for k in range(1, 4):
        out ^= SHIFT.take(at + (byte[:, k] + np.intp(256 * k)))
    return out


#: The CRC-32 of a space, shifted by the length of the word after it.
SPACE = _shifted(np.full(LONGEST, zlib.crc32(b" "), np.uint32), np.arange(LONGEST))


def words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def buckets(some: list[bytes], size: int = BUCKETS, step: int = 100_000) -> Iterator[np.ndarray]:
    """Bucket numbers of all runs of one to three of the words ``some``, about three times ``step`` of them at a time.

    The CRC-32 of a run follows from those of the run without its last word and of that word; only
    runs whose last word is very long are read again.
    """
    for lo in range(0, len(some), step):
        own = some[lo : lo + step + 2]  # runs that begin with one of the first ``step`` words
        alone = np.fromiter(map(zlib.crc32, own), np.uint32, len(own))
        length = np.fromiter(map(len, own), np.intp, len(own))
        by = np.minimum(length, LONGEST - 1)
        spaced = alone ^ SPACE[by]  # of a space and the word
        long, crc = length > by, alone
        for n in range(3):
            first = min(step, len(own) - n)
            if first <= 0:
                break
            if n:
                crc = _shifted(crc[:first], by[n : n + first] + 1) ^ spaced[n : n + first]
                for i in np.flatnonzero(long[n : n + first]):
                    crc[i] = zlib.crc32(b" ".join(own[i : i + n + 1]))
            yield (crc[:first] % np.uint32(size)).astype(np.intp)


def counts(texts: DataFrame, size: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of ``texts(text)`` are in each bucket; a task counts all its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for b in buckets(words(text.as_py()), size):
                    total += np.bincount(b, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, in thousandths of a nat: the log ratio of its smoothed shares in ``target`` and ``raw``."""
    both = []
    for texts in (raw, target):
        n = [0] * size
        for r in counts(texts, size).collect():  # at most ``size`` rows
            n[r["bucket"]] = r["n"]
        both.append(n)
    s, t = both
    whole_s, whole_t = float(sum(s) + size), float(sum(t) + size)
    return np.array([math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in range(size)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, the same for equal ids."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, size: int = BUCKETS, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row a row of ``docs(doc_id, text)``.

    Texts without words weigh 0; a null id has the noise of an empty one.
    """
    share = docs.sparkSession.sparkContext.broadcast(gains(docs, target, size))  # ``size`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, n, weight = words(text.as_py()), 0, 0
                for b in buckets(own, size):
                    n += len(b)
                    weight += int(share.value[b].sum())
                rows.append((doc_id, len(own), n, weight, weight + noise(doc_id, seed)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _after(key: list[str], pivot: tuple) -> Column:
    """Whether a row's key comes after ``pivot``, in ascending order of the columns ``key``."""
    out = F.lit(False)
    for name, value in reversed(list(zip(key, pivot, strict=True))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _before(key: list[str], pivot: tuple) -> Column:
    """Whether it comes before."""
    out = F.lit(False)
    for name, value in reversed(list(zip(key, pivot, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = 15, seed: int = 42) -> tuple | None:
    """The k-th least (from 1) key of ``rows``, by the columns ``key``, numbers without nulls; None if there are fewer.

    Each round takes ``pivots`` random keys of the interval that holds the k-th, counts the rows of
    the interval at and between them exactly, in one pass, and goes on with the part that holds the
    k-th; done once that is a pivot itself. ``rows`` should be durable: each round reads it twice.
    """
    inside, rest = F.lit(True), k
    for turn in range(10_000):
        here = rows.where(inside)
        some = here.withColumn("_r", F.xxhash64(*key, F.lit(seed + turn))).orderBy("_r", *key).select(*key).limit(pivots)
        at = sorted({tuple(r) for r in some.collect()})
        if not at:
            return None
        # 2i: between pivots i-1 and i; 2i + 1: at pivot i
        place = sum((_after(key, p).cast("int") + (~_before(key, p)).cast("int") for p in at), F.lit(0))
        n = {r["_p"]: r["n"] for r in here.groupBy(place.alias("_p")).agg(F.count("*").alias("n")).collect()}
        for part in range(2 * len(at) + 1):
            if rest <= n.get(part, 0):
                break
            rest -= n.get(part, 0)
        else:
            return None
        if part % 2:
            return at[part // 2]
        low, high = part // 2 - 1, part // 2
        inside = inside & (_after(key, at[low]) if low >= 0 else F.lit(True)) & (_before(key, at[high]) if high < len(at) else F.lit(True))
    raise RuntimeError("no end of rounds")


def ranked(rows: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: their place from 1 by the columns ``key``; rows of equal keys in any order.

    Ranges of keys are sorted apart, by key and a number of the row's own, so that equal keys part as
    well; ranks add the sizes of the ranges before, of which there is one a partition.
    """
    salt, part, place = fresh(rows, "_salt", "_part", "_place")
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = durable(rows.withColumn(salt, F.monotonically_increasing_id())).repartitionByRange(n, *key, salt).sortWithinPartitions(*key, salt)
    kept = stored(sorted_.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))))
    sizes = {r[part]: r["n"] for r in kept.groupBy(part).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    starts = F.broadcast(spark.createDataFrame(list(before.items()) or [(-1, 0)], f"{part} int, _before long"))
    return kept.join(starts, part).withColumn(name, F.col(place) + F.col("_before") + 1).drop(salt, part, place, "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, size: int = BUCKETS, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row a row of ``docs(doc_id, text)``.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down: those of the
    highest scores, of equal scores the smaller doc_id, null last. Ranks count them from 1; other rows have null. Null
    and empty texts have no words. Rows that repeat a doc_id and text are told apart by nothing, so any of them
    is drawn first. Empty tables give no rows, an empty ``target`` counts nothing; other columns are not read.
    """
    last = F.lit(2**63 - 1)
    rows = scored(docs, target, size, seed).withColumns({"_s": -F.col("score"), "_n": F.col("doc_id").isNull().cast("int"), "_d": F.coalesce("doc_id", last), "_f": F.col("n_features")})
    rows = stored(rows.withColumn("_able", F.col("n_words") >= least_words))
    key, able = ["_s", "_n", "_d", "_f"], rows.where("_able")
    k = percent * able.count() // 100
    cut = kth_key(able.select(*key), key, k) if k else None
    names = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn = F.col("_able") & ~_after(key, cut)
    won = ranked(rows.where(drawn), key).select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")).union(won)
