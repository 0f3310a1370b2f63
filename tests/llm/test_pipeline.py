"""The pipeline's stages."""

import corpus_pipeline as P
from factloom.llm import mixing, packing, quality
from factloom.llm.entry import tokenizer_paths
from tests.llm.test_text_ops import brute_lines

SF = "/root/testdata/sf0.001"


def brute_near(rows, n=5):
    """The least doc_id of each group of texts linked by shingles alone."""
    grams = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        grams[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(grams)
    alike = lambda a, b: a == b or bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b))
    first = {i: i for i in ids}
    for _ in ids:
        new = {i: min(first[j] for j in ids if alike(grams[i], grams[j])) for i in ids}
        if new == first:
            break
        first = new
    return {i for i in ids if first[i] == i}


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = P.quality_classifier(spark, docs, SF)
    model = quality.fit(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text or "", {}) >= 0.3}
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    lined = P.line_dedup(spark, kept, SF).cache()
    want = brute_lines([r.text for r in kept.collect()])
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in lined.collect()} == {r.doc_id: want.get(r.text) for r in kept.collect()}
    one = P.simhash_near_dedup(spark, lined, SF)
    assert {r.doc_id for r in one.collect()} == brute_near([(r.doc_id, r.text) for r in lined.collect()])
    mix = P.mixing_sources(spark, one, SF).collect()
    took = {r.doc_id: r.taken for r in mixing.taken(one).collect()}
    words = {}
    for r in mix:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: n for d, n in took.items() if n}
    packed = P.packing_windows(spark, spark.createDataFrame(mix, docs.schema), SF).collect()
    encode = packing.tokenizer(tokenizer_paths()[0], None)
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in mix)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]


def test_the_whole_pipeline_runs(spark):
    out = P.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= ids and all(0 < r.length <= 1024 for r in out)


CLASH = "doc_id long, text string, lang string, source string, n_chars int, _id int, _body string, _drop string, _times int, score double, predicted int, _key string, _of int, _cut int, _copy int, `a.b` int"


def test_stages_carry_any_columns_and_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(d, t, "en", s, 5, 1, "b", "d", 2, 0.5, 7, "k", 3, 4, 5, 6) for d, t, s in [(1, text, "a"), (1, text + " more", "a"), (2, text, "b"), (2, text, "b"), (None, text, None), (None, None, None), (3, "", "a"), (4, "w " * 50_000, "b")]]
    docs = spark.createDataFrame(rows, CLASH)
    for data in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:4]:
            got = stage(spark, data, SF)
            assert got.columns == docs.columns, name
            assert all(tuple(r)[5:] == rows[0][5:] for r in got.collect()), name
        assert P.packing_windows(spark, data, SF).count() >= data.count()
