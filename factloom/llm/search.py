"""Exact top-k by inner product: branch and bound in a ball tree per shard.

Vectors go to cells around fitted centres, cells are cut into shards, and each shard gets a ball tree.
A ball of centre c and radius r holds no vector whose inner product with q exceeds q c + |q| r. A
query visits cells in the order of that bound, more of them in each round; the k-th score that it
has by then goes along, and cells, shards and nodes whose bound lies below it are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import durable, stored

NONE = -(2**63)
FOUND = "query long, no long, vec_id long, score long"


class BallTree:
    """Balls around the rows of ``x``: halves by the projection on the line between two far points, down to ``leaf`` rows."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.order, self.nodes = np.arange(len(x)), []
        y = x.astype(np.float64)
        stack = [(0, len(x), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            rows = self.order[lo:hi]
            centre = y[rows].mean(0)
            gap = np.sqrt(((y[rows] - centre) ** 2).sum(1))
            number = len(self.nodes)
            self.nodes.append((lo, hi, centre, float(gap.max()), []))
            if parent >= 0:
                self.nodes[parent][4].append(number)
            if hi - lo <= leaf or not gap.max():
                continue
            one = y[rows[gap.argmax()]]
            two = y[rows[((y[rows] - one) ** 2).sum(1).argmax()]]
            self.order[lo:hi] = rows[np.argsort(y[rows] @ (two - one), kind="stable")]
            middle = (lo + hi) // 2
            stack += [(middle, hi, number), (lo, middle, number)]


def bound(q: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No inner product of the rows of ``q``, of lengths ``size``, with what the ball holds is above this, roundings included."""
    most = q @ centre + size * radius
    return most + 1e-9 * (size * (np.sqrt(centre @ centre) + radius)) + 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles, or in numbers of any size where these would round."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The ``k`` best of each query: rows (-score, id is null, id, number) in ascending order."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth, self.rows = k, kth.copy(), [[] for _ in kth]

    def add(self, i: int, rows: list[tuple]) -> None:
        self.rows[i] = heapq.nsmallest(self.k, [*self.rows[i], *rows])
        if len(self.rows[i]) == self.k:
            self.kth[i] = max(self.kth[i], -self.rows[i][-1][0])


def search(tree: BallTree, x: np.ndarray, no: np.ndarray, ids: np.ndarray, null: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> Best:
    """What of ``x`` may be among the ``k`` best of each row of ``q``, whose k-th score is ``kth`` or more.

    Nodes are visited by the highest bound that any query has; only queries whose bound reaches their
    k-th score go on into a node. Rows whose number is the query's ``own`` are left out.
    """
    best, f = Best(kth, k), q.astype(np.float64)
    size = np.sqrt((f * f).sum(1))
    limit = bound(f, size, tree.nodes[0][2], tree.nodes[0][3])
    heap = [(-limit.max(initial=-np.inf), 0, np.arange(len(q)), limit)]
    while heap:
        _, number, at, limit = heapq.heappop(heap)
        live = limit >= best.kth[at]
        at = at[live]
        if not len(at):
            continue
        lo, hi, _, _, below = tree.nodes[number]
        for child in below:
            limit = bound(f[at], size[at], tree.nodes[child][2], tree.nodes[child][3])
            heapq.heappush(heap, (-limit.max(), child, at, limit))
        if below:
            continue
        for lo in range(lo, hi, 4096):
            rows = tree.order[lo : min(lo + 4096, hi)]
            score = products(q[at], x[rows])
            hit = (score >= best.kth[at][:, None]) & (no[rows][None, :] != own[at][:, None])
            for j in np.flatnonzero(hit.any(1)):
                some = np.flatnonzero(hit[j])
                if len(some) > 4 * k:  # all that tie with the k-th stay
                    least = np.partition(score[j, some], len(some) - k)[len(some) - k]
                    some = some[score[j, some] >= least]
                r = rows[some]
                best.add(int(at[j]), list(zip((-score[j, some]).tolist(), null[r].tolist(), ids[r].tolist(), no[r].tolist(), strict=True)))
    return best


def whole_numbers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(no, vec_id, x, length): components as floor(scale * component), 8 bytes each, of the usable rows of ``vectors(vec_id, embedding)``.

    Vectors that are null, or hold a null or non-finite component, are left out; numbers beyond 64 bits become
    the least or greatest one. ``no`` tells rows apart.
    """
    e = F.col("embedding").cast("array<double>")
    usable = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda v: F.floor(v * scale).cast("long")).alias("e"), F.monotonically_increasing_id().alias("no"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, cut = np.ascontiguousarray(np.asarray(b.column(2).flatten()), "<i8"), np.asarray(b.column(2).offsets)
            x = [flat[i:j].tobytes() for i, j in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), pa.array(np.diff(cut), pa.int32())], ["no", "vec_id", "x", "length"])

    return rows.select("no", "vec_id", "e").mapInArrow(packed, "no long, vec_id long, x binary, length int")


def _matrix(column: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), length)


def _centres(x: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres or fewer: rows far from each other, moved to the means of what is nearest, a few times."""
    y = x.astype(np.float64)
    c = y[:1]
    far = ((y - c[0]) ** 2).sum(1)
    while len(c) < n and far.max() > 0:
        c = np.vstack([c, y[far.argmax()]])
        far = np.minimum(far, ((y - c[-1]) ** 2).sum(1))
    for _ in range(rounds):
        near = _nearest(y, c)
        c = np.stack([y[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def _nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * y @ c.T).argmin(1)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard: int = 8192, block: int = 2048, sample: int = 4096, max_cells: int = 256, growth: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with all other rows.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``every``; the
    vectors are those of ``whole_numbers``, and others take no part. Ties go to the smaller vec_id, null
    last. Rows that repeat a vec_id or vector are rows of their own: only the query's row itself isn't searched. Vectors of
    another length are not searched. A query with fewer other rows gets all of them; empty tables
    give no rows; other columns are not read.

    Centres of at most ``max_cells`` cells are fitted on at most ``sample`` vectors of the least
    hashes; every vector is in a cell, and the cells' radii come from all vectors, so results are
    exact. A shard holds about ``shard`` vectors. A task searches one shard for a block of about
    ``block`` queries. In each round a query visits ``growth`` times as many cells as in the one before.
    """
    base = durable(whole_numbers(vectors, scale))
    parts = [_of_length(base.where(F.col("length") == r["length"]), r["length"], r["n"], every, k, shard, block, sample, max_cells, growth) for r in base.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()]
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for p in parts[1:]:
        found = found.union(p)
    return found


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "no")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _of_length(rows: DataFrame, length: int, n: int, every: int, k: int, shard: int, block: int, sample: int, max_cells: int, growth: int) -> DataFrame:
    spark = rows.sparkSession
    # of equal vectors only the k + 1 first can be among any query's k best
    same = Window.partitionBy("x").orderBy(F.asc_nulls_last("vec_id"), "no")
    first = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r")
    some = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    centres = spark.sparkContext.broadcast(_centres(_matrix([r["x"] for r in some], length), max(1, min(max_cells, n // shard))))  # at most max_cells vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            y = _matrix(b.column(2).to_pylist(), length).astype(np.float64)
            near = _nearest(y, c)
            gap = np.sqrt(((y - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.int32()), pa.array(gap)], ["no", "vec_id", "x", "cell", "gap"])

    placed = stored(first.select("no", "vec_id", "x").mapInArrow(place, "no long, vec_id long, x binary, cell int, gap double"))
    cells = placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()  # at most max_cells
    cuts = {r["cell"]: -(-r["n"] // shard) for r in cells}
    balls = spark.sparkContext.broadcast((centres.value[[r["cell"] for r in cells]], np.array([r["radius"] for r in cells]), np.array([r["cell"] for r in cells], np.int32)))
    shards = F.broadcast(spark.createDataFrame(list(cuts.items()), "cell int, cuts int"))  # one row a cell
    candidates = placed.join(shards, "cell").select("cell", F.pmod(F.xxhash64("no"), F.col("cuts")).cast("int").alias("cut"), "no", "vec_id", "x")
    queries = durable(rows.where(F.col("vec_id") % every == 0).select(F.col("no").alias("query"), F.col("vec_id").alias("query_id"), "x"))
    blocks = max(1, -(-queries.count() // block))
    state = queries.select("query", "x", F.lit(NONE).alias("kth"))
    best, seen = None, 0
    while seen < len(cells):
        upto = len(cells) if not growth else max(1, seen * growth)
        visits = durable(state.mapInArrow(_visits(balls, length, seen, upto), "query long, x binary, kth long, cell int"))
        if not visits.head(1):
            break
        asked = visits.join(shards, "cell").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        # a shard is sent to the blocks whose queries visit its cell
        wanted = asked.select(F.col("cell").alias("to"), F.col("block").alias("by")).distinct()
        sent = candidates.join(F.broadcast(wanted) if blocks <= 64 else wanted, F.col("cell") == F.col("to")).select("to", F.col("cut").alias("piece"), "by", "no", "vec_id", "x")
        got = sent.groupBy("to", "piece", "by").cogroup(asked.groupBy("cell", "cut", "block")).applyInPandas(_searched(length, k), FOUND)
        best = stored(_best_rows(got if best is None else best.drop("rank").unionByName(got), k))
        kth = best.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        state = queries.join(kth, "query", "left").select("query", "x", F.coalesce("kth", F.lit(NONE)).alias("kth"))
        seen = upto
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.join(queries.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visits(balls, length: int, seen: int, upto: int):
    """For each query the cells from the ``seen``-th to the ``upto``-th best bound that may hold one of its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, cells = balls.value
        for b in batches:
            q = _matrix(b.column(1).to_pylist(), length).astype(np.float64)
            size = np.sqrt((q * q).sum(1))
            limit = np.stack([bound(q, size, c, r) for c, r in zip(centres, radii, strict=True)], 1)
            rank = np.argsort(np.argsort(-limit, axis=1, kind="stable"), axis=1)
            at, cell = np.nonzero((rank >= seen) & (rank < upto) & (limit >= np.asarray(b.column(2))[:, None]))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(cells[cell])], ["query", "x", "kth", "cell"])

    return run


def _searched(length: int, k: int):
    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "no", "vec_id", "score")})
        x, no, null = _matrix(list(shard.x), length), shard.no.to_numpy(), shard.vec_id.isna().to_numpy()
        ids = shard.vec_id.astype("Int64").fillna(0).to_numpy(np.int64)
        best = search(BallTree(x), x, no, ids, null, _matrix(list(asked.x), length), asked["query"].to_numpy(), asked.kth.to_numpy(), k)
        rows = [(query, n, None if empty else i, -s) for query, found in zip(asked["query"], best.rows, strict=True) for s, empty, i, n in found]
        out = pd.DataFrame(rows, columns=["query", "no", "vec_id", "score"])
        return out.astype({"query": "int64", "no": "int64", "vec_id": "Int64", "score": "int64"})

    return run
