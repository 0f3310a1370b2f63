"""Embedding near-dedup by dual traversal of a cover tree: exact pairs above a cosine threshold.

Unit vectors at cosine t or more are at most sqrt(2 - 2t) apart. The tree's levels are nested and
their radii halve; each node keeps the largest distance to any vector below it. Two nodes farther
apart than both these bounds and the threshold distance have no pair between them and are pruned
with everything below. Vectors of leaf pairs that remain are compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import components, durable, fresh


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors in double precision) of those entries that are usable."""
    keep, out = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top  # so that squares neither overflow nor vanish
            keep.append(i)
            out.append(x / math.sqrt(float(x @ x)))
    return np.array(keep, np.int64), np.array(out) if out else np.zeros((0, 0))


class CoverTree:
    """Centres in nested levels; level i's centres are more than 2 / 2**i apart and cover the sample within it.

    ``levels[i]`` is the number of centres that level i has: its centres are the first of ``centres``,
    so each level holds the one above. ``parent[j]`` is the centre above j in the level before it.
    """

    def __init__(self, sample: np.ndarray, max_centres: int):
        self.centres, self.levels, self.parent = sample[:1], [min(1, len(sample))], [0]
        radius = 1.0
        while len(self.centres) and radius > 1e-3:
            far = _distances(sample, self.centres)
            near, at = far.min(1), far.argmin(1)
            chosen, above = [], []
            while len(self.centres) + len(chosen) <= max_centres and (k := int(near.argmax())) >= 0 and near[k] > radius:
                chosen.append(sample[k])
                above.append(int(at[k]))
                near = np.minimum(near, _distances(sample, sample[k : k + 1])[:, 0])
            if len(self.centres) + len(chosen) > max_centres:
                break  # a level is kept whole or not at all
            if chosen:
                self.centres = np.vstack([self.centres, chosen])
                self.parent += above
            self.levels.append(len(self.centres))
            radius /= 2

    def paths(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x its node at every level, and the distance to it: the nearest child each time."""
        nodes, gaps = np.zeros((len(x), len(self.levels)), np.int32), np.zeros((len(x), len(self.levels)))
        if not len(x):
            return nodes, gaps
        far = _distances(x, self.centres)
        gaps[:, 0] = far[:, 0]
        parent = np.array(self.parent)
        for i in range(1, len(self.levels)):
            old, new = self.levels[i - 1], self.levels[i]
            known = np.arange(new)
            above = np.where(known < old, known, parent[:new])
            allowed = above[None, :] == nodes[:, i - 1][:, None]
            nodes[:, i] = np.where(allowed, far[:, :new], np.inf).argmin(1)
            gaps[:, i] = far[np.arange(len(x)), nodes[:, i]]
        return nodes, gaps

    def leaf_pairs(self, cover: np.ndarray, count: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """Dual traversal from (root, root): leaf pairs a <= b not pruned at any level.

        ``cover[i, j]`` bounds the distance from centre j to all vectors below it at level i,
        ``count[i, j]`` is how many there are.
        """
        pairs = [(0, 0)] if self.levels[0] and count[0, 0] else []
        gap = _distances(self.centres, self.centres) if len(self.centres) else None
        for i in range(1, len(self.levels)):
            children: dict[int, list[int]] = {}
            for j in range(self.levels[i]):
                if count[i, j]:
                    children.setdefault(j if j < self.levels[i - 1] else self.parent[j], []).append(j)
            below = set()
            for p, q in pairs:
                for a in children.get(p, []):
                    for b in children.get(q, []):
                        if gap[a, b] <= cover[i, a] + cover[i, b] + reach + 1e-9:
                            below.add((min(a, b), max(a, b)))
            pairs = sorted(below)
        return pairs


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _compare(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, same: bool, threshold: float, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's rows, links of b's rows, group labels of all rows) among the pairs of two blocks.

    Pairs are found by the matrix product of a slice of rows at a time; they are counted, with the
    numbers ``na`` and ``nb`` of vectors that each row stands for, and never listed.
    """
    of_a, of_b, label = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    for lo in range(0, len(a), rows):
        hit = a[lo : lo + rows] @ b.T >= threshold
        if same:
            hit[np.arange(len(hit)), np.arange(lo, lo + len(hit))] = False
        some = np.nonzero(hit.any(1))[0]
        if not len(some):
            continue
        of_a[lo + some] = hit[some] @ nb
        of_b += na[lo : lo + rows] @ hit
        for i in some:
            groups = np.unique(label[np.append(np.nonzero(hit[i])[0] + shift, lo + i)])
            for g in groups[1:]:
                label[label == g] = groups[0]
    return of_a, of_b, label


def links(vectors: DataFrame, threshold: float = 0.95, sample: int = 4096, max_centres: int = 256, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding)``.

    Equal vectors (after scaling to length one) are compared once, for all that share them. The tree
    is fitted on at most ``sample`` distinct vectors, of the least hashes, and has at most
    ``max_centres`` centres; every vector is indexed, whatever its distance, and the covering radii
    come from all vectors, so no pair is lost. A leaf is cut into blocks of about ``block`` vectors,
    so a task holds two blocks at most. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing. Null vec_ids link like others, but never name a
    component; repeated rows each count; vectors of other lengths only link among themselves;
    an empty table gives no rows; other columns are ignored.
    """

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = unit_groups(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(x, pa.binary())], ["vec_id", "x"])

    base = durable(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(normal, "vec_id long, x binary").withColumn("h", F.md5("x")))
    distinct = durable(base.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("h").alias("h")))
    parts = []
    for (length,) in sorted(distinct.select(F.length("x")).distinct().collect()):
        parts.append(_of_length(distinct.where(F.length("x") == length), length // 8, threshold, sample, max_centres, block))
    if parts:
        found = parts[0][0]
        edges = parts[0][1]
        for f, e in parts[1:]:
            found, edges = found.union(f), edges.union(e)
        found = durable(found.groupBy("key").agg(F.sum("n_links").alias("n_links")))
        group = components(edges)
        of = distinct.withColumn("key", F.col("h")).join(group, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
        first = of.groupBy("component").agg(F.min("least").alias("first"))
        of = of.join(first, "component").join(found, "key", "left").select(F.col("key").alias("_key"), "first", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        good = base.join(of, F.col("h") == F.col("_key")).select("vec_id", "n_links", F.col("first").alias("component_id"))
    else:
        good = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).where("false")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    alone = vectors.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def unit_groups(column: pa.Array) -> tuple[list[int], list[bytes]]:
    """Row numbers of usable vectors and their unit vectors as bytes."""
    lists = column.to_pylist()
    keep, out = [], []
    for i, v in enumerate(lists):
        rows, x = unit([v])
        if len(rows):
            keep.append(i)
            out.append(_pack(x[0] + 0.0))  # no negative zeros
    return keep, out


def _of_length(distinct: DataFrame, dim: int, threshold: float, sample: int, max_centres: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, n_links) and edges (u, v) among distinct vectors of ``dim`` components; keys are 128-bit hashes of x."""
    spark = distinct.sparkSession
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-7
    some = distinct.select("x", "h").orderBy("h").limit(sample).collect()
    tree = CoverTree(np.array([np.frombuffer(r.x) for r in some]).reshape(-1, dim), max_centres)
    share = spark.sparkContext.broadcast(tree)  # at most max_centres vectors
    depth = len(tree.levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, dim)
            nodes, gaps = share.value.paths(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(nodes.tolist(), pa.list_(pa.int32())), pa.array(gaps.tolist(), pa.list_(pa.float64()))], ["x", "h", "n", "nodes", "gaps"])

    placed = durable(distinct.select("x", "h", "n").mapInArrow(place, "x binary, h string, n long, nodes array<int>, gaps array<double>"))
    bounds = placed.select(F.posexplode(F.arrays_zip("nodes", "gaps")).alias("level", "z")).groupBy("level", "z.nodes").agg(F.max("z.gaps").alias("r"), F.count("*").alias("n")).collect()
    cover, count = np.zeros((depth, len(tree.centres))), np.zeros((depth, len(tree.centres)), np.int64)
    for r in bounds:
        cover[r.level, r.nodes], count[r.level, r.nodes] = r.r, r.n
    last = depth - 1
    blocks = {j: max(1, -(-int(count[last, j]) // block)) for j in range(len(tree.centres)) if count[last, j]}
    pairs = tree.leaf_pairs(cover, count, reach)
    # block rows: which vectors are where; a leaf's blocks are dealt by hash
    deal = spark.createDataFrame([(int(j), int(n)) for j, n in blocks.items()] or [(-1, 1)], "leaf int, blocks int")
    with_blocks = placed.select("x", "h", "n", F.col("nodes")[last].alias("leaf")).join(F.broadcast(deal), "leaf").withColumn("b", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    # partners of a leaf: a bounded table, at most max_centres squared
    table = spark.createDataFrame([(int(a), int(b), blocks[a], blocks[b]) for a, b in pairs] or [(-1, -1, 1, 1)], "a int, b int, na int, nb int")
    number = lambda leaf, b: F.concat_ws(".", leaf, b)
    left = with_blocks.join(F.broadcast(table), F.col("leaf") == F.col("a")).select("x", "h", "n", "a", table["b"].alias("q"), with_blocks["b"].alias("mine"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).where("a != q or mine <= other")
    left = left.select("x", "h", "n", number("a", "mine").alias("p"), number("q", "other").alias("q"), F.lit(0).alias("side"))
    right = with_blocks.join(F.broadcast(table), F.col("leaf") == table["b"]).select("x", "h", "n", F.col("a").alias("p0"), "leaf", with_blocks["b"].alias("mine"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("other")).where("p0 != leaf or other < mine")
    right = right.select("x", "h", "n", number("p0", "other").alias("p"), number("leaf", "mine").alias("q"), F.lit(1).alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = pdf.p.iloc[0] == pdf.q.iloc[0]
        two = one if same else two
        a, b = (np.frombuffer(b"".join(s.x)).reshape(-1, dim) for s in (one, two))
        of_a, of_b, label = _compare(a, one.n.to_numpy(), b, two.n.to_numpy(), same, threshold)
        keys = one.h.to_numpy() if same else np.concatenate([one.h.to_numpy(), two.h.to_numpy()])
        n = of_a if same else np.concatenate([of_a, of_b])
        on = n > 0
        return pd.DataFrame({"key": keys[on], "n_links": n[on], "root": keys[label[on]]})

    out = durable(left.union(right).groupBy("p", "q").applyInPandas(compare, "key string, n_links long, root string"))
    return out.select("key", "n_links"), out.select(F.col("key").alias("u"), F.col("root").alias("v"))


def keep_first(vectors: DataFrame, **options) -> DataFrame:
    """``vectors`` without those that have a lesser vec_id in their component; rows without vec_id stay."""
    (of,) = fresh(vectors, "_of")
    lead = links(vectors, **options).where("kept").select(F.col("vec_id").alias(of)).distinct()
    return vectors.join(lead, F.col("vec_id") == F.col(of), "left_semi").union(vectors.where("vec_id is null"))
