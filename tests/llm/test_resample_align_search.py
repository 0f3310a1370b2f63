"""Importance resampling, token alignment and top-k search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import align, resample, search
from factloom.llm.entry import OP13_SQL, QUERIES, tokenizer_paths
from tests.compare import connect, difference

DOCS = "doc_id long, text string, source string, n_words string, rank int, weight string"
VECS = "vec_id long, embedding array<float>, label string, x string, no int"
TEXTS = ["Hello WORLD, it's 3.5 o'clock", None, "", "...", "één twee é ÉÉN", "a" * 500 + " b " + "c" * 400 + " d", "x y " * 400, "Hello WORLD, it's 3.5 o'clock", "Ünïcode words of the benchmark text, " * 9]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", "n", 0, "w") for d, t in rows], DOCS)


# importance resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    whole_s, whole_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10000) / ((s[b] + 1) * (whole_t + 10000)))) for b in range(10000)]
    out = []
    for d, text in rows:
        words, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([words, d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    k = 5 * len(able) // 100
    for r in out:
        r.append(None)
    for i, r in enumerate(able[:k]):
        r[5] = i + 1
    return Counter(tuple(r[1:]) for r in out)


def test_resample_against_a_plain_version(spark):
    rng = random.Random(5)
    vocabulary = [rng.choice("abcdéZ") * rng.randint(1, 5) + str(i) for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(i + 1000, t) for i, t in enumerate(TEXTS)] + [(None, "no id " * 30), (None, "no id " * 30), (7, rows[7][1])]
    rows += [(9, vocabulary[0] * 200 + " x" * 50)] * 40  # copies of one row compete with each other
    target = ["Benchmark words of the text", None, "", " ".join(vocabulary[:9])]
    got = resample.resample(docs(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, target)


def test_resample_of_given_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    want = plain_resample([(r.doc_id, r.text) for r in read("documents").collect()], [r.text for r in read("benchmark").collect()])
    assert Counter(map(tuple, QUERIES["op11_importance_resampling"](spark, sf).collect())) == want
    empty = docs(spark, [])
    assert resample.resample(empty, empty).collect() == []
    assert [r["rank"] for r in resample.resample(docs(spark, [(1, "few words")]), empty).collect()] == [None]


def test_kth_key_and_ranks_with_many_equal_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 5]), rng.randint(0, 3)) for _ in range(500)] + [(rng.randint(-99, 99), i) for i in range(500)]
    frame, order = spark.createDataFrame(rows, "a long, b long").cache(), sorted(rows)
    for k in (1, 2, 499, 700, 1000):
        assert resample.kth_key(frame, ["a", "b"], k, pivots=3) == order[k - 1]
    assert resample.kth_key(frame, ["a", "b"], 1001) is None
    got = sorted(map(tuple, resample.ranked(frame, ["a", "b"]).select("rank", "a", "b").collect()))
    assert [r[0] for r in got] == list(range(1, 1001))
    assert [r[1:] for r in got] == order


# token alignment


def paths():
    return *tokenizer_paths(), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(paths()[0])
    tok.encode_special_tokens = True
    with open(paths()[0]) as f:
        entry = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    sp = sentencepiece.SentencePieceProcessor(model_file=paths()[2])

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found = []
    for d, text in rows:
        text = text or ""
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        ba, bb = [bytes(byte_of[c] for c in entry[i]) for i in a], [piece(i) for i in b]
        groups = []
        if text and b"".join(ba) == b"".join(bb) == b" " + text.encode():
            i = j = x = y = 0
            one, two = [], []
            while i < len(a) or j < len(b):
                if x <= y:
                    one.append(a[i])
                    x += len(ba[i])
                    i += 1
                else:
                    two.append(b[j])
                    y += len(bb[j])
                    j += 1
                if x == y:
                    groups.append((one, two))
                    one, two = [], []
        found.append((d, groups))
    count = Counter()
    for _, groups in found:
        count.update({(x, y) for one, two in groups for x in one for y in two})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = Counter()
    for d, groups in found:
        links = [(x, y) for one, two in groups for x in one for y in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        out[d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


@pytest.mark.parametrize("most", [500_000, 300, 0])
def test_alignment_against_a_plain_version(spark, most):
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").collect()
    extra = [*TEXTS, "<|endoftext|> <s> </s> <unk>", "a ▁ b", "  two  spaces \n\n\t lines ", "\0 zero", "日本語の文章と中国话" * 9, "🙂🙃 ﬁ ①", " ", "\n", "aaaa" * 300, "ab" * 700]
    rows = [(r.doc_id, r.text) for r in read[:120]] + [(10_000 + i, t) for i, t in enumerate(extra)] + [(None, "no id"), (None, "no id"), (3, "again")]
    got = align.alignment(docs(spark, rows).repartition(3), *paths(), most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows)


def test_alignment_in_parts_and_of_nothing(spark):
    both = align.tokenizers(*paths())
    texts = ["aaaa" * 300, "x y z", "日本語" * 50]
    whole, parts = align.aligned(texts, both), align.aligned(texts, both, step=7)
    assert all(list(whole[k]) == list(parts[k]) for k in whole)
    assert align.alignment(docs(spark, []), *paths()).collect() == []
    assert [tuple(r) for r in align.alignment(docs(spark, [(1, None), (2, "")]), *paths()).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# top-k search


def plain_top(rows, every=50, k=5):
    ok = [(i, v, [math.floor(256 * float(np.float32(x))) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for i, v, e in ok:
        if v is None or v % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), w is None, w or 0) for j, w, f in ok if j != i and len(f) == len(e))
        out.update((v, n + 1, None if null else w, -s) for n, (s, null, w) in enumerate(scores[:k]))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, "l", "x", 0) for v, e in rows], VECS)


@pytest.mark.parametrize("options", [{}, {"shard": 40, "block": 3, "sample": 50, "max_cells": 8}, {"shard": 60, "max_cells": 16, "growth": 2}])
def test_top_k_against_a_plain_version(spark, options):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # copies, queries among them
    rows += [(50, rows[1][1]), (50, rows[1][1]), (None, rows[2][1]), (None, rows[0][1])]
    rows += [(600, None), (650, [None] * 8), (700, [math.nan] * 8), (750, [math.inf] + [0.0] * 7), (800, [0.0] * 8), (850, []), (900, [1.0, 2.0]), (901, [3.0, -2.0]), (950, [5.0])]
    got = search.top_k(vectors(spark, rows).repartition(3), **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == plain_top(rows)


def test_top_k_of_given_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert not difference(QUERIES["op13_exact_top_k"](spark, sf), connect(sf), OP13_SQL)
    assert search.top_k(vectors(spark, [])).collect() == []
    assert search.top_k(vectors(spark, [(50, [1.0])])).collect() == []


def test_bounds_leave_nodes_out():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 9, (1000, 4)) + 500 * c for c in np.eye(4, dtype=np.int64)])
    tree, seen = search.BallTree(x, leaf=32), []

    class Rows(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                seen.append(len(key))
            return super().__getitem__(key)

    q = np.array([[900, 0, 0, 0]])
    n = np.arange(len(x))
    best = search.search(tree, x.view(Rows), n, n, np.zeros(len(x), bool), q, np.array([-1]), np.array([search.NONE]), 5)
    assert [-r[0] for r in best.rows[0]] == sorted((x @ q[0]).tolist(), reverse=True)[:5]
    assert sum(seen) < 1100
    big = np.array([[2**40, 3], [-(2**40), 5]])
    assert search.products(big, big).tolist() == [[2**63 - 1, -(2**63) + 1], [-(2**63) + 1, 2**63 - 1]]
    assert search.products(big[:, 1:] + 2**30, big[:, 1:]).tolist() == [[(3 + 2**30) * 3, (3 + 2**30) * 5], [(5 + 2**30) * 3, (5 + 2**30) * 5]]
