"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios."""

from __future__ import annotations

import ast
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import durable

#: Letters of either case stand for themselves in a word's shape, digits for one digit; marks stay.
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)))


def _shape(word: bytes) -> bytes:
    """A word's shape, each run of one class as one letter: b'Ab-12%%%' gives b'Xx-9%'."""
    s = word.translate(_SHAPE)
    return bytes(c for c, before in zip(s, b"\0" + s) if c != before)[:12]


def ngrams(text: str, known: dict[bytes, bytes]) -> set:
    """The distinct n-grams of a whole text: words, and one to three shapes in a row.

    A word that repeats one of the two words before it has the shape ``=``, and the share of distinct
    words (in eighths, alone and with the length) is one more indicator, so that repetitive text is seen at any length.
    """
    words = text.encode().split()
    kinds = []
    for w in words:
        s = known.get(w)
        if s is None:
            s = _shape(w)
            if len(known) < 200_000:
                known[w] = s
        kinds.append(s)
    kinds = [b"=" if w == a or w == b else s for w, a, b, s in zip(words, [b"", *words], [b"", b"", *words], kinds)]
    distinct = set(words)
    out: set = {*distinct, *((s,) for s in set(kinds)), *set(zip(kinds, kinds[1:])), *set(zip(kinds, kinds[1:], kinds[2:]))}
    share = 8 * len(distinct) // max(1, len(words))
    out |= {(share,), (len(words).bit_length(), share)}
    return out


@dataclass(frozen=True)
class Model:
    """weights by n-gram and a bias give a margin; slope and shift turn it into a score."""

    weights: dict
    bias: float
    slope: float
    shift: float = 0.0

    def score(self, text: str, known: dict[bytes, bytes]) -> float:
        get = self.weights.get
        m = self.bias + math.fsum(get(g, 0.0) for g in ngrams(text, known))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * m + self.shift))))


def dual_coordinate_descent(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights w that minimise |w|^2/2 + cost * sum(hinge(y * x.w)); row i has x[j] at each j of rows[i].

    One dual variable a time: its step is the gradient over the row's squared norm, kept in [0, cost].
    """
    w, alpha, order = np.zeros(len(x)), np.zeros(len(y)), np.random.default_rng(seed)
    values = [x[r] for r in rows]
    norms = np.array([max(1e-12, float(v @ v)) for v in values])
    weight = cost * np.where(y > 0, (y <= 0).sum() / max(1, (y > 0).sum()), 1.0).clip(0.05, 20)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * float(w[r] @ v) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), weight[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of best likelihood, by Newton steps.

    Targets stay a little inside 0 and 1, so that separable classes give a finite slope.
    """
    good = y > 0
    t = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(m, [g @ margins, g.sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, min_docs: int = 5, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30) -> Model:
    """Learns from at most ``sample`` labelled rows (those of the least hashed doc_id), and only from
    rows whose crc32(doc_id as text) mod 5 is not 0.

    The bound keeps what reaches the driver small at every size. Of labels that contradict each other
    the least counts, of documents that repeat a doc_id the text of the least hash; null texts are empty. N-grams in fewer than ``min_docs``
    of these documents are left out. With rows of one class, or none, every score is that class's
    share (one half without rows).
    """
    use = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).where("_id is not null and _y is not null and crc32(cast(_id as string)) % 5 != 0")
    use = use.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(use), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), F.col("_y").cast("int").alias("y"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            got = [[repr(g) for g in ngrams(t.as_py(), known)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.string()))], ["doc_id", "y", "grams"])

    seen = durable(texts.mapInArrow(grams, "doc_id long, y int, grams array<string>"))
    counts = [r.g for r in seen.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= min_docs).select("g").collect()]
    index = {g: i for i, g in enumerate(sorted(counts))}
    numbers = docs.sparkSession.sparkContext.broadcast(index)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(numbers.value[g] for g in row if g in numbers.value) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "y", "at"])

    # the driver gets the numbers of those n-grams only
    data = sorted((r.doc_id, r.y, r.at) for r in seen.mapInArrow(kept, "doc_id long, y int, at array<int>").toLocalIterator())
    y = np.array([1.0 if d[1] == 1 else -1.0 for d in data])
    if not len(y) or abs(y.sum()) == len(y) or not index:
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 1.0)
    pos, neg = np.full(len(index), smoothing), np.full(len(index), smoothing)
    rows = [np.array(d[2], dtype=np.int64) for d in data]
    for r, label in zip(rows, y, strict=True):
        (pos if label > 0 else neg)[r] += 1
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    norm = np.sqrt(np.mean([max(1.0, float((ratio[r] ** 2).sum())) for r in rows]))
    x = np.append(ratio / norm, 1.0)  # the last is the bias
    rows = [np.append(r, len(index)) for r in rows]
    w = dual_coordinate_descent(rows, x, y, cost, epochs)
    scaled = w * x
    slope, shift = calibrate(np.array([w[r] @ x[r] for r in rows]), y)
    return Model({ast.literal_eval(g): float(scaled[i]) for g, i in index.items() if scaled[i]}, float(scaled[-1]), slope, shift)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.3, with_text: bool = False) -> DataFrame:
    """Adds score and predicted to the columns ``keep`` (doc_id) of ``docs``; null text counts as empty.

    Only the text is read for a score. An empty text gets the score of a text without words. Columns
    of ``keep`` named score or predicted are replaced.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "predicted", *(() if with_text else ("text",)))]
    share = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the n-grams of the sample
    rows = docs.select(*keep) if with_text else docs.select(*keep, "text")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            got = [share.value.score(t.as_py() or "", known) for t in batch.column(at)]
            kept = batch.columns if with_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.float64())], [*keep, "score"])

    schema = T.StructType([*(f for f in rows.schema if with_text or f.name in keep), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns, whatever they are called."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            yield batch.filter(pa.array([share.value.score(t.as_py() or "", known) >= threshold for t in batch.column(at)], pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with a dot would not resolve
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out() -> Column:
    """True for rows kept out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def python_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def top_weights(model: Model, n: int = 20) -> list[tuple]:
    """The n-grams that speak most for and against quality."""
    order = Counter({g: w for g, w in model.weights.items()}).most_common()
    return order[:n] + order[-n:]
