"""Mixing sources to target weights."""

import math
import random
from collections import Counter, defaultdict

import xxhash

from factloom.llm import mixing
from tests.llm.test_other_ops import frame



def brute_targets(sizes, share=1.5, limit=2.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    got, left, total = {}, set(order), share * sum(sizes.values())
    while left:
        rest = total - sum(got.values())
        over = {s for s in left if rest * weight[s] / sum(weight[t] for t in left) > limit * sizes[s]}
        if not over:
            return got | {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        got |= {s: limit * sizes[s] for s in over}
        left -= over
    return got


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 900), ["b", "a", "é", None, "Z", "hot"][min(5, i % 9)]) for i in range(400)] + [(900, None, "a"), (None, "x y", "b"), (901, "dup dup", "a"), (901, "dup dup", "a"), (902, "", "nothing")]
    docs = frame(spark, rows)
    got = mixing.taken(docs, block=32, shard_blocks=256).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 4 * 32
    again = mixing.taken(docs.repartition(5), block=32, shard_blocks=256).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 5, 17, 100, 4097):
        got = sorted(r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).cast("long").alias("p")).collect())
        assert got == list(range(n))


def test_mix_of_nothing(spark):
    assert mixing.taken(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.taken(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, [(1, "a b", "a")])).columns == ["doc_id", "text", "lang", "source", "n_chars", "sequence_id", "media"]


def xx(value, seed, width=8):
    return xxhash.xxh64_intdigest(int(value).to_bytes(width, "little", signed=True), seed & (2**64 - 1))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(*parts):
    """Spark's xxhash64 of (number, bytes it has) parts."""
    h = 42
    for v, width in parts:
        h = xx(v, h, width)
    return signed(h)


def brute_permuted(x, n, *seed):
    rows = math.isqrt(n - 1) + 1
    cols = -(-n // rows)

    def step(x):
        left, right = divmod(x, cols)
        for k in range(3):
            left = (left + hashed((right, 8), *seed, (2 * k, 4)) % rows) % rows
            right = (right + hashed((left, 8), *seed, (2 * k + 1, 4)) % cols) % cols
        return left * cols + right

    x = step(x)
    while x >= n:
        x = step(x)
    return x


def brute_taken(placed, block, shard_blocks, seed=42):
    """(sid, at, copy) -> words, from the places of documents alone: draws, permutations and blocks again in Python."""
    sources = {r.sid: r for r in placed if r.source_size}
    blocks = {s: -(-r.source_size // block) for s, r in sources.items()}
    want = {s: min(math.floor(r.target * blocks[s] / r.source_size + 0.5), 2 * blocks[s]) for s, r in sorted(sources.items())}
    total, numbers = sum(want.values()), Counter()
    for i in range(total):
        shard, k = divmod(i, shard_blocks)
        at = hashed((seed, 4), (shard, 8), (k + 1, 8)) % total
        for s in sorted(want):
            if at < want[s]:
                numbers[s] += 1
                break
            at -= want[s]
    times = Counter()
    for s in want:  # whatever is drawn, numbers below the target are taken, those beyond are not
        for k in range(want[s]):
            turn, x = divmod(k, blocks[s])
            times[s, brute_permuted(x, blocks[s], (seed, 4), (s, 4), (turn, 8))] += 1
    out = {}
    for r in placed:
        for c in range(r.copies if r.size else 0):
            lo = r.at + c * r.size
            out[r.sid, r.at, c] = sum(times[r.sid, b] * (min(lo + r.size, (b + 1) * block) - max(lo, b * block)) for b in range(lo // block, (lo + r.size - 1) // block + 1))
    return out, numbers, want


def test_taken_words_equal_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 300), rng.choice(["a", "b", "c", None])) for i in range(150)] + [(7, "same row", "a")] * 40 + [(None, "", "b")] * 5
    docs = frame(spark, rows)
    placed, pieces = mixing.mixture(docs, block=16, shard_blocks=64)
    placed, pieces = placed.collect(), pieces.collect()
    for s in {r.sid for r in placed}:  # the documents of a source lie side by side
        at = 0
        for r in sorted((r for r in placed if r.sid == s and r.size), key=lambda r: r.at):
            assert r.at == at
            at += r.size * r.copies
        assert all(r.source_size == at for r in placed if r.sid == s)
    want, drawn, targets = brute_taken(placed, 16, 64)
    got = Counter()
    for r in pieces:
        got[r.sid, r.at, r.copy] += r.words
    assert {k: v for k, v in want.items() if v} == dict(got)
    shards = Counter((r.shard, r.sid) for r in {(r.shard, r.sid, r["pass"], r.idx): r for r in pieces}.values())
    last = -(-sum(targets.values()) // 64)
    for s in targets:  # what was drawn and is not beyond the target lies in drawn shards, the rest in closing ones
        assert sum(n for (shard, sid), n in shards.items() if sid == s and shard < last) == min(drawn[s], targets[s])
    assert max(Counter(shard for shard, _ in shards.elements()).values()) <= 64


def test_pieces_reach_the_output_as_they_stand(spark):
    rows = [(i, "\n".join(f"d{i}w{k}  x" for k in range(i % 40)), "ab"[i % 2]) for i in range(120)] + [(None, " one\ttwo ", "a"), (5, "dup dup", "a"), (5, "dup dup", "a"), (6, None, "a")]
    docs = frame(spark, rows).withColumnsRenamed({"media": "_key", "sequence_id": "_cut"})
    got = mixing.mixed(docs, block=8, shard_blocks=16).collect()
    took = Counter()
    for r in mixing.taken(docs, block=8, shard_blocks=16).collect():
        took[r.doc_id] += r.taken
    text = defaultdict(list)
    for d, t, _ in rows:
        text[d].append(t or "")
    words = Counter()
    for r in got:
        assert any(r.text in t for t in text[r.doc_id]) and r.text == r.text.strip() and r.n_chars == len(r.text) and (r["_key"], r["_cut"], r.lang) == (1, "q", "en")
        words[r.doc_id] += len(r.text.split())
    assert words == +took
