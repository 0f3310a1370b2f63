"""Cross-tokenizer alignment: groups of tokens that cover the same bytes, and how well pairs of ids go together.

A batch's texts are encoded by both tokenizers into Arrow lists. Lists are flattened with their
parent indices, running sums of token lengths give each token's end in its own text, and an Acero
hash join of both sides' (document, end) keys finds the ends that both share: these cut the tokens
into groups. Links are counted by ``Table.group_by`` in the tasks and merged by Spark.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import durable, stored
from factloom.llm.packing import SPECIAL, tokenizer

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
SCORED = "row long, n_best long, count_sum long, missed array<struct<pair:long,times:long>>"


class Pair:
    """Both tokenizers, with the bytes of their tokens.

    ``json_path`` and ``ranks_path`` name one byte-level vocabulary (as tokenizer file and as ranks),
    ``model_path`` a vocabulary of pieces.
    """

    def __init__(self, json_path: str, ranks_path: str, model_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(json_path)
        plain.encode_special_tokens = True  # their strings are ordinary text
        quick = tokenizer(json_path, ranks_path)
        self.encode_a = lambda text: plain.encode(text, add_special_tokens=False).ids if SPECIAL in text else quick(text)
        with open(ranks_path, "rb") as f:
            ranks = {int(n): base64.b64decode(token) for token, n in map(bytes.split, f)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(size)]
        b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.bytes_a = pa.array([ranks.get(i, b"") for i in range(max(ranks) + 1)], pa.large_binary())
        self.bytes_b, self.size_b = pa.array(b, pa.large_binary()), size

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = pa.array([self.encode_a(" " + t) for t in texts], pa.list_(pa.int32()))
        return a, pa.array(self.pieces.encode(texts, num_threads=1), pa.list_(pa.int32()))


@functools.cache
def tokenizers(json_path: str, ranks_path: str, model_path: str) -> Pair:
    return Pair(json_path, ranks_path, model_path)


def _ends(lists: pa.ListArray, token_bytes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview, np.ndarray]:
    """Of flattened ``lists``: ids, parents, ends in bytes within the own list; all bytes, and each list's place in them."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    joined = pc.take(token_bytes, ids)
    total = np.asarray(pc.cumulative_sum(pc.binary_length(joined)))
    cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    at = np.append(0, total)[cuts]
    data = memoryview(joined.buffers()[2] or b"")[: at[-1]]
    parent = np.asarray(parent)
    return np.asarray(ids), parent, total - at[parent], data, at


def _same(a: tuple, b: tuple, raw: list[bytes]) -> list[int]:
    """Numbers of the texts whose tokens' bytes are the text on both sides."""
    return [i for i, x in enumerate(raw) if all(s[3][s[4][i] : s[4][i + 1]].tobytes() == x for s in (a, b))]


def _hashes(a_ids: np.ndarray, b_ids: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, n_docs: int) -> list[str]:
    """SHA-256 of each document's groups written as text; every token's string carries the separator before it."""
    first = np.append(True, doc[1:] != doc[:-1])  # groups that begin a document
    separators = pa.array([",", ";", "|", ""], pa.large_string())

    def strings(ids: np.ndarray, sizes: np.ndarray, start: np.ndarray | int) -> pa.Array:
        which = np.zeros(len(ids), np.int8)
        which[np.cumsum(sizes) - sizes] = start
        return pc.binary_join_element_wise(separators.take(pa.array(which)), pc.cast(pa.array(ids), pa.large_string()), pa.scalar("", pa.large_string()))

    both = pa.concat_arrays([strings(a_ids, p, np.where(first, 3, 1)), strings(b_ids, q, 2)])
    group = np.concatenate([np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)])
    line = both.take(pa.array(np.argsort(group, kind="stable")))  # a group's A ids, then its B ids
    tokens = np.bincount(doc, weights=p + q, minlength=n_docs).astype(np.int64)
    at = np.frombuffer(line.buffers()[1], np.int64)[np.append(0, np.cumsum(tokens))]
    data = memoryview(line.buffers()[2])
    return [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]


def _links(a_ids: np.ndarray, b_ids: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, size_b: int, step: int) -> pa.Table:
    """(doc, pair, times) of all links of groups with ``p`` A ids and ``q`` B ids, ``step`` links at a time."""
    upto, a0, b0 = np.cumsum(p * q), np.cumsum(p) - p, np.cumsum(q) - q
    parts = []
    for lo in range(0, int(upto[-1]), step):
        n = np.arange(lo, min(lo + step, int(upto[-1])))
        g = np.searchsorted(upto, n, "right")
        t = n - (upto - p * q)[g]
        pair = a_ids[a0[g] + t // q[g]].astype(np.int64) * size_b + b_ids[b0[g] + t % q[g]]
        parts.append(pa.table({"doc": doc[g], "pair": pair, "times": np.ones(len(n), np.int64)}).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"]))
    links = pa.concat_tables(parts)
    if len(parts) > 1:
        links = links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"])
    return links.sort_by([("doc", "ascending"), ("pair", "ascending")])


def aligned(texts: list[str | None], both: Pair, step: int = 1_000_000) -> dict[str, list | pa.Array]:
    """Columns of ``ALIGNED`` but doc_id for some texts."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
    rows = [i for i, t in enumerate(texts) if t]
    offsets, pairs, times = np.zeros(n + 1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if rows:
        lists = both.encode([texts[i] for i in rows])
        a, b = _ends(lists[0], both.bytes_a), _ends(lists[1], both.bytes_b)
        good = _same(a, b, [b" " + texts[i].encode() for i in rows])
        if len(good) < len(rows):
            rows = [rows[i] for i in good]
            lists = [x.take(pa.array(good, pa.int64())) for x in lists]
            a, b = _ends(lists[0], both.bytes_a), _ends(lists[1], both.bytes_b)
    if rows:
        rows = np.array(rows)
        reach = int(max(a[2].max(), b[2].max())) + 1
        sides = [pa.table({"key": parent.astype(np.int64) * reach + end, name: np.arange(len(end))}) for (_, parent, end, _, _), name in ((a, "ia"), (b, "ib"))]
        cuts = sides[0].join(sides[1], "key", join_type="inner", use_threads=False).sort_by("ia")
        ia, ib = np.asarray(cuts["ia"]), np.asarray(cuts["ib"])
        p, q, doc = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1), a[1][ia].astype(np.int64)
        for name, doc_of, each in (("n_a", a[1], None), ("n_b", b[1], None), ("n_groups", doc, None), ("n_links", doc, p * q)):
            out[name][rows] = np.bincount(doc_of, minlength=len(rows)) if each is None else np.add.reduceat(each, np.unique(doc, return_index=True)[1])
        for i, h in zip(rows, _hashes(a[0], b[0], p, q, doc, len(rows)), strict=True):
            out["groups_sha256"][i] = h
        links = _links(a[0], b[0], p, q, doc, both.size_b, step)
        sizes = np.zeros(n, np.int64)
        sizes[rows] = np.bincount(np.asarray(links["doc"]), minlength=len(rows))
        offsets, pairs, times = np.append(0, np.cumsum(sizes)).astype(np.int32), np.asarray(links["pair"]), np.asarray(links["times"])
    return out | {"pairs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs)), "times": pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))}


def align(docs: DataFrame, json_path: str, ranks_path: str, model_path: str, chunk: int = 1_000_000) -> DataFrame:
    """Columns of ``ALIGNED``, one row a row of ``docs(doc_id, text)``.

    ``pairs`` are the distinct linked pairs of the text, each as A id times B's vocabulary size plus
    B id, ``times`` how many links each has. Texts are taken ``chunk`` characters at a time, a longer
    one by itself. Texts that are null or empty, or whose tokens don't give their bytes back, have no
    tokens. Null and repeated doc_ids keep their rows, an empty table gives none, other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(json_path, ranks_path, model_path)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0)).cumsum()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + chunk, "right")))
                part = batch.slice(lo, hi - lo)
                cols = aligned(part.column(1).to_pylist(), both)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) if not isinstance(c, pa.Array) else c for c in cols.values())], ["doc_id", *cols])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def _counted(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many rows each pair is; partial counts of a task, given out when they have ``most`` rows."""
    held = None

    def merged(*tables: pa.Table) -> pa.Table:
        return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

    for batch in batches:
        pair = pc.list_flatten(batch.column(0))
        for lo in range(0, len(pair), most):
            some = pair.slice(lo, most)
            now = pa.table({"pair": some, "n": pa.array(np.ones(len(some), np.int64))})
            held = merged(held, now) if held is not None else merged(now)
            if held.num_rows >= most:
                yield from held.to_batches()
                held = None
    if held is not None:
        yield from held.to_batches()


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the rows of ``links(pairs)`` that hold each pair, and whether no other pair of its A id is in more.

    Partial counts of tasks are merged by Spark; an A id has at most ``size_b`` pairs.
    """
    n = links.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return n.withColumn("best", F.col("n") == F.max("n").over(own))


def _head(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs have that count or more; 0 if all pairs fit."""
    bins = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    if sum(bins.values()) <= most:
        return 0
    held, cut = 0, max(bins) + 1
    while held + bins.get(cut - 1, 0) <= most:
        cut -= 1
        held += bins.get(cut, 0)
    return 2**cut


def alignment(docs: DataFrame, json_path: str, ranks_path: str, model_path: str, most: int = 500_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of ``docs``.

    Rows are as in ``align``. Counts of pairs reach the tasks in two ways with the same result: the
    most frequent ones, at most ``most`` (24 MB), by a broadcast, so that no frequent pair is a join key
    of many rows; all others, each in few documents, by a shuffled join. Every text is encoded once.
    """
    spark = docs.sparkSession
    size_b = tokenizers(json_path, ranks_path, model_path).size_b
    links = stored(align(docs, json_path, ranks_path, model_path).withColumn("row", F.monotonically_increasing_id()))
    counts = durable(pair_counts(links, size_b))
    cut = _head(counts, most)
    head = counts.where(F.col("n") >= cut).orderBy("pair").toArrow()
    share = spark.sparkContext.broadcast([np.asarray(head[c]) for c in ("pair", "n")] + [head["best"].to_numpy(zero_copy_only=False)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = share.value
        for batch in batches:
            lists, sizes = batch.column(1), np.diff(np.asarray(batch.column(1).offsets))
            pair, times = np.asarray(pc.list_flatten(lists)), np.asarray(pc.list_flatten(batch.column(2)))
            at = np.searchsorted(known, pair)
            hit = np.append(known, -1)[at] == pair
            found = np.where(hit, at, len(known))
            upto = lambda x: np.append(0, np.cumsum(x))[np.append(0, np.cumsum(sizes))]
            sums = [np.diff(upto(times * np.append(x, 0)[found])) for x in (best.astype(np.int64), n)]
            missed = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], ["pair", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(upto(~hit).astype(np.int32)), missed)], ["row", "n_best", "count_sum", "missed"])

    found = links.select("row", "pairs", "times").mapInArrow(look_up, SCORED)
    if cut:
        found = stored(found)
        rare = found.select("row", F.inline("missed")).join(counts.where(F.col("n") < cut), "pair")
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
        found = found.join(rare, "row", "left").select("row", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"))
    return links.join(found.select("row", "n_best", "count_sum"), "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
