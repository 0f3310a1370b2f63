"""Parsers on payloads that are damaged or of another shape."""

import pytest

from factloom.sources.parsers import PARSERS

BODIES = [None, "", " ", "{", "[", "[]", "{}", "null", "3", '"text"', '{"data": null}', '{"data": {}}', '{"data": [null, 3, {}]}', '[null, {"a": {"b": [1]}}]', "<html><body><table><tr><td>x</table>", "name,score\n", "name,score\na,b,c\n\"a\n", "- a: 1\n  b: [", "def f(:", "x" * 100_000, "\x00퟿"]


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_damaged_payloads_stop_no_parser(spark, name):
    raw = spark.createDataFrame(list(enumerate(BODIES)), "snapshot_id long, body string")
    rows = PARSERS[name](raw).collect()
    assert len(rows) <= 3 * len(BODIES)


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_an_empty_table_gives_no_rows(spark, name):
    assert PARSERS[name](spark.createDataFrame([], "snapshot_id long, body string")).collect() == []


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "snapshot_id long, body string")


def test_csv_as_the_csv_module_reads_it(spark):
    import csv
    import io
    import random

    from pyspark.sql import functions as F

    from factloom.sources import parsers

    rng = random.Random(8)
    texts = ['a,b\n1,2', 'a,a,b\n1,2,3\n4', '"x,\ny","q""q"\r\n1,"2\r\n3"\r\n\r\n,\n', 'a,b\n5" screen,"open', 'a\n""\n\nb', 'a,b\n"x"y,z\n"1""2"tail,3', ",\n,", "é,ü\n" + "w" * 50_000 + ',"' + 'v""' * 20_000 + '"']
    texts += ["".join(rng.choice(['a', 'b', ',', ',', '"', '""', '\n', '\r\n', ' ', 'é']) for _ in range(rng.randint(1, 40))) for _ in range(400)]

    got = bodies(spark, *texts).select("snapshot_id", parsers.csv_records(F.col("body")).alias("r")).collect()
    for r in got:
        want = [x for x in csv.reader(io.StringIO(texts[r.snapshot_id], newline="")) if x]
        assert [x for x in r.r if x != [""]] == [x for x in want if x != [""]], texts[r.snapshot_id]

    table = ["n,s,s,t\nm,1,2,3\nshort,1\n\nlong,1,2,3,4,5\n", "﻿n,s\r\n\"two\r\nlines\",7"]
    rows = {(r.snapshot_id, r.row["n"]): r.row for r in parsers.table_rows(bodies(spark, *table)).collect()}
    for i, text in enumerate(table):
        want = [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(text.lstrip("﻿"), newline=""))]
        assert [rows[i, w["n"]] for w in want] == want


def test_registries_are_read_not_run(spark):
    source = """
import os
raise SystemExit
_TEXT_GENERATION_MODELS = {
    'Single': ('mod', 'Cls'),  # "Comment": ("no", "no"),
    "Two": (
        "mod2", 'Cls2',
    ), "Twice": ("old", "Old"), "Three": ("a", "b", "c"), 7: ("x", "y"), "Call": (f(), "y"), "Name": x, **more,
}
_TRANSFORMERS_BACKEND_MODELS = {"Other": ("mod", "X"), "Twice": ("new", "New")}
_UNKNOWN_MODELS = {"No": ("a", "b")}
_MULTIMODAL_MODELS = _X = {"No": ("a", "b")}
_MULTIMODAL_MODELS: dict = {"No": ("a", "b")}
_REWARD_MODELS = {"T": ("transformers", "T")}
"""
    got = PARSERS["vllm"](bodies(spark, source, "x = (", None, "\0")).collect()
    assert [(r.snapshot_id, r.source_model_id, r.registry, r.module, r["class"], r.backend) for r in got] == [
        (0, "Other", "_TRANSFORMERS_BACKEND_MODELS", "mod", "X", "transformers"), (0, "Single", "_TEXT_GENERATION_MODELS", "mod", "Cls", "native"), (0, "T", "_REWARD_MODELS", "transformers", "T", "transformers"),
        (0, "Twice", "_TRANSFORMERS_BACKEND_MODELS", "new", "New", "transformers"), (0, "Two", "_TEXT_GENERATION_MODELS", "mod2", "Cls2", "native"),
    ]


def test_rows_of_the_software_board(spark):
    row = '<div title="{} + prox: mean@5 56.3%, worst@5 44.5%, best@5 66.7%" class="g"><span class="a tabular-nums b">{}</span><span>±<!-- -->11.1</span>{}</div>\n<div class="relative h-5">x</div>'
    page = row.format("Thinking Machines Inkling 5.1", 1, "<i>$138.55</i><i>11.6h</i>") + row.format("Acme One", 10, "<i>70m</i>") + row.format("Solo", "x", "")
    got = PARSERS["frontierswe"](bodies(spark, page, page.replace("relative h-5", "other"), 'title="A B: mean@5 1%"')).orderBy("snapshot_id", "source_model_id").collect()
    assert [tuple(r)[1:] for r in got if r.snapshot_id == 0] == [
        ("frontierswe_v2::inkling-5-1", "Inkling 5.1", "Thinking Machines", "prox", 56.3, 44.5, 66.7, 1, 11.1, 138.55, 11.6),
        ("frontierswe_v2::one", "One", "Acme", "prox", 56.3, 44.5, 66.7, 10, 11.1, None, 1.17),
        ("frontierswe_v2::solo", "Solo", "unknown", "prox", 56.3, 44.5, 66.7, None, 11.1, None, None),
    ]
    assert [(r.name, r.mean, r["rank"], r.hours) for r in got if r.snapshot_id == 1] == [("Inkling 5.1", 56.3, None, None), ("One", 56.3, None, None), ("Solo", 56.3, None, None)]


def test_evaluations_in_payloads_of_any_shape(spark):
    import json

    from factloom.sources.parsers import artificialanalysis_facts

    row = {"id": 5, "slug": "s", "name": "N", "model_creator": {"name": "C"}, "evaluations": {"deep": {"gpqa": "81.5%"}, "own": 3, "hle": "n/a", "skip": "x"}, "hle": "1,000", "pricing": {"price_1m_input_tokens": 2.5}, "meta": {"speed": {"median_output_tokens_per_second": 90}, "release_date": "2025-05-01"}}
    low = {"slug": "only", "aime": None, "x": {"aime": 7}}
    shapes = [[row, low, 3, None], {"data": {"a": row, "b": low}}, {"data": [], "models": [row, low]}, {"results": {"k": {"name": "Just A Name!", "gpqa": 1}}}, {"data": "text"}, 7, {"items": [{"gpqa": 1}]}]
    got = {}
    for r in artificialanalysis_facts(bodies(spark, *map(json.dumps, shapes), "no json")).collect():
        got.setdefault(r.snapshot_id, set()).add((r.source_model_id, r.name, r.creator, r.kind, r.field, r.value))
    both = {("5", "N", "C", "evaluation", "gpqa", "81.5%"), ("5", "N", "C", "evaluation", "own", "3"), ("5", "N", "C", "evaluation", "hle", "1,000"), ("5", "N", "C", "pricing", "price_1m_input_tokens", "2.5"), ("5", "N", "C", "capability", "median_output_tokens_per_second", "90"), ("5", "N", "C", "capability", "release_date", "2025-05-01"), ("only", None, None, "evaluation", "aime", "7")}
    assert got == {0: both, 1: both, 2: both, 3: {("just-a-name", "Just A Name!", None, "evaluation", "gpqa", "1")}}


def test_pages_are_planned_and_tried_again(spark, tmp_path):
    import json
    import os

    from factloom.sources import pages

    def fetch(offset, length):
        mark = tmp_path / f"{offset}"
        if offset == 4 and not mark.exists():  # fails once
            mark.write_text("")
            raise OSError("gone")
        (tmp_path / f"seen-{offset}-{os.getpid()}").write_text("")
        return json.dumps({"rows": [{"row": {"link": f"https://h/o/m{i}", "complete": str(i)}} for i in range(offset, min(offset + length, 9))], "num_rows_total": 9})

    got = pages.read_pages(spark, fetch, 2, wait=0.01)
    assert got.rdd.getNumPartitions() == 5 and sorted(r.offset for r in got.collect()) == [0, 2, 4, 6, 8]
    rows = PARSERS["bigcodebench"](got).where("benchmark_id = 'complete'").collect()
    assert sorted((r.source_model_id, r.score) for r in rows) == [(f"o/m{i}", float(i)) for i in range(9)]
    assert [r.offset for r in pages.read_pages(spark, lambda o, n: '{"rows": []}').collect()] == [0]
    assert [r.offset for r in pages.read_pages(spark, lambda o, n: '{"rows": [1, 2]}', 2).collect()] == [0]

    def broken(offset, length):
        if offset:
            raise OSError("gone for good")
        return '{"rows": [1], "num_rows_total": 2}'

    with pytest.raises(Exception, match="gone for good"):
        pages.read_pages(spark, broken, 1, tries=2, wait=0.01).collect()


def test_the_newest_are_enriched_and_failures_counted(spark):
    from factloom.sources import pages

    wanted = spark.createDataFrame([("a", 3), ("b", 1), ("c", 3), ("d", None), ("e", 2), (None, 9)], "model_id string, created long")

    def fetch(model):
        if model == "c":
            raise TimeoutError("late")
        return (404 if model == "e" else 200), f"body {model}"

    assert sorted(map(tuple, pages.enriched(spark, wanted, fetch, 3).collect())) == [("a", 200, "body a"), ("c", 0, "TimeoutError: late"), ("e", 404, "body e")]
    assert pages.enriched(spark, wanted, fetch).count() == 5
