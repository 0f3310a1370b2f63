"""Operators on small inputs with nulls, ties and repeats."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import jsonx as J
from factloom.functions import text as X
from factloom.operators import asof, changes, documents, frontier, gates, joins, merge, nested, picks, promote, resolve, sorts, stats, temporal, views
from factloom.sources import parsers, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# picks


def test_headline_prefers_independent_then_newest(spark):
    df = spark.createDataFrame([(1, "b", 10.0, 0, "2024-05-01"), (1, "b", 55.0, 0, "2026-09-03"), (1, "b", 99.0, 1, "2026-12-01")], "m int, b string, score double, own int, at string")
    assert picks.latest_pick(df, ["m", "b"], [F.asc("own"), F.desc_nulls_last("at")]).first().score == 55.0
    assert picks.latest_pick(df, ["m", "b"], [F.asc("own"), F.asc("at")]).first().score == 10.0  # another order picks another


def test_keep_first_treats_null_keys_as_equal_and_repeats_nothing(spark):
    df = spark.createDataFrame([(3, None, "a"), (1, None, "a"), (2, "x", "a")], "id int, cond string, k string")
    once = picks.keep_first(df, ["cond", "k"], [F.asc("id")])
    assert {r.id for r in once.collect()} == {1, 2}
    assert rows(picks.keep_first(once, ["cond", "k"], [F.asc("id")])) == rows(once)


def test_newest_snapshot_per_source(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 9)], "s string, v int")
    assert rows(picks.newest_per(df, "s", "v")) == [("a", 2), ("a", 2), ("b", 1)]


# temporal


def prices(spark, data):
    return spark.createDataFrame(data, "id int, k string, a date, b date")


def test_capping_is_idempotent_and_keeps_adjacent_windows(spark):
    df = prices(spark, [(1, "x", date(2024, 1, 1), None), (2, "x", date(2024, 3, 1), date(2024, 4, 1)), (3, "x", date(2024, 4, 1), None), (4, "y", None, None), (5, "y", date(2024, 1, 1), None)])
    capped = temporal.cap_windows(df, ["k"], "a", "b", ["id"])
    assert [(r.id, r.b) for r in capped.orderBy("id").collect()] == [(1, date(2024, 3, 1)), (2, date(2024, 4, 1)), (3, None), (4, date(2024, 1, 1)), (5, None)]
    assert rows(temporal.cap_windows(capped.drop("capped"), ["k"], "a", "b", ["id"]).drop("capped")) == rows(capped.drop("capped"))


def test_equal_starts_leave_an_empty_window_on_the_earlier_row(spark):
    df = prices(spark, [(1, "x", date(2024, 1, 1), None), (2, "x", date(2024, 1, 1), None)])
    assert [r.b for r in temporal.cap_windows(df, ["k"], "a", "b", ["id"]).orderBy("id").collect()] == [date(2024, 1, 1), None]


def fold(group):
    """What coalescing means, row by row: a row that overlaps the current island extends it."""
    out = []
    for a, b in sorted(group, key=lambda r: (r[0] is not None, r[0])):
        if out and (out[-1][1] is None or a is None or a < out[-1][1]):
            end = None if b is None or out[-1][1] is None else max(b, out[-1][1])
            out[-1] = (out[-1][0], end, out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


def test_islands_equal_a_fold(spark):
    import random

    rng, data, want = random.Random(8), [], []
    for k in range(60):
        group = []
        for _ in range(rng.randrange(1, 7)):
            a = date(2024, 1, rng.randrange(1, 20))
            group.append((a if rng.random() > 0.1 else None, date.fromordinal(a.toordinal() + rng.randrange(1, 9)) if rng.random() > 0.15 else None))
        data += [(i, str(k), a, b) for i, (a, b) in enumerate(group)]
        want += [(str(k), *x) for x in fold(group)]
    got = temporal.coalesce_islands(prices(spark, data), ["k"], "a", "b", ["id"]).select("k", "a", "b", "n")
    assert rows(got) == sorted(want, key=repr)


def test_bounding_by_the_next_distinct_time(spark):
    df = prices(spark, [(1, "x", date(2024, 1, 1), None), (2, "x", date(2024, 1, 1), None), (3, "x", date(2024, 2, 1), None), (4, None, date(2024, 5, 1), None)])
    got = {r.id: r.nx for r in temporal.bound_by_next(df, ["k"], "a", "nx").collect()}
    assert got == {1: date(2024, 2, 1), 2: date(2024, 2, 1), 3: None, 4: None}


# joins, as-of, changes


def test_overlaps_with_open_ends_and_null_keys(spark):
    df = prices(spark, [(1, None, date(2024, 1, 1), None), (2, None, date(2024, 6, 1), date(2024, 7, 1)), (3, "x", date(2024, 1, 1), date(2024, 2, 1)), (4, "x", date(2024, 2, 1), None)])
    assert rows(joins.overlapping_pairs(df, ["k"], "id", "a", "b").select("id", "other")) == [(1, 2)]


def test_peers_fall_back_to_the_second_column(spark):
    df = spark.createDataFrame([(1, None, "d"), (2, "f", "d"), (3, "f", "e")], "id int, fam string, dev string")
    assert rows(joins.peers(df, df.where("id = 1"), "id", "fam", "dev").select("id")) == [(2,)]
    assert rows(joins.peers(df, df.where("id = 2"), "id", "fam", "dev").select("id")) == [(3,)]


def test_asof_grid_carries_values_forward(spark):
    df = spark.createDataFrame([("a", 2, 1.0, 1), ("a", 2, 5.0, 2), ("a", 7, 9.0, 3), ("b", 9, 4.0, 4)], "k string, t int, v double, id int")
    got = asof.asof_grid(df, "k", "t", F.sequence(F.lit(1), F.lit(9), F.lit(2)), "v", ["id"], "g")
    assert rows(got) == [("a", 3, 5.0), ("a", 5, 5.0), ("a", 7, 9.0), ("a", 9, 9.0), ("b", 9, 4.0)]


def test_changes_skip_firsts_and_equal_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5), (5, None)], "id int, v int").withColumn("k", F.lit(1))
    assert [(r.id, r.before) for r in changes.changes(df, ["k"], ["id"], "v").orderBy("id").collect()] == [(3, None), (5, 5)]


# frontiers and statistics


def test_frontiers_differ_on_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 2.0, 5.0), (4, 2.0, 9.0), (5, 3.0, 8.0), (6, None, 99.0)], "id int, p double, s double")
    assert {r.id for r in frontier.pareto_dominance(df, "p", "s").collect()} == {1, 2, 4}
    assert {r.id for r in frontier.pareto_sweep(df, "p", "s", ["id"]).collect()} == {1, 4}
    assert {r.id for r in frontier.pareto_dominance(df, "p", "s", low_cost=False).collect()} == {4, 5}


def test_dominance_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    pts = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(300)]
    want = {i for i, p, s in pts if not any(q <= p and t >= s and (q < p or t > s) for _, q, t in pts)}
    assert {r.id for r in frontier.pareto_dominance(spark.createDataFrame(pts, "id int, p double, s double"), "p", "s").collect()} == want


def test_quantiles_by_index(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 12)] + [("b", 7.0), ("c", None)], "k string, v double")
    assert rows(stats.rank_quantile_desc(df, ["k"], "v", 0.75, "q")) == [("a", 3.0), ("b", 7.0)]
    assert rows(stats.index_quantile(df, ["k"], "v", 0.95, "q")) == [("a", 11.0), ("b", 7.0)]  # round(9.5) is 10: half to even


def test_mode_takes_the_lowest_positive_of_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (0.0,), (0.0,), (0.0,), (None,)], "v double")
    assert df.agg(stats.mode_low(F.col("v")).alias("m")).first().m == 1.0


def test_feed_is_cut_per_category(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "c string, t int")
    got = sorts.bounded_feed(df, "c", [F.desc("t")], 2)
    assert rows(got) == [("a", 3, 5, True), ("a", 4, 5, True), ("b", 0, 2, False), ("b", 1, 2, False)]
    with pytest.raises(ValueError):
        sorts.bounded_feed(df, "c", [F.desc("t")], 0)


def test_places_with_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(30)], "id int, v double")
    whole = sorted(((v is None, v or 0, i) for i, v in map(tuple, df.collect())))
    got = {r.id: r.up for r in sorts.ends_nulls_last(df, "v", "id", 5).collect()}
    assert all(got[i] == n + 1 for n, (_, _, i) in enumerate(whole) if i in got) and len(got) >= 5


# merges and resolution


def test_merges_are_null_safe_and_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(None, "m"), (2, "b"), (2, "c"), (1, None)], "k int, v string")
    ignored = merge.insert_ignore(t, new, ["k"], [F.asc("v")])
    assert rows(ignored) == [(1, "a"), (2, "b"), (None, "n")]
    assert rows(merge.insert_ignore(ignored, new, ["k"], [F.asc("v")])) == rows(ignored)
    assert rows(merge.insert_replace(t, new, ["k"], [F.desc("v")])) == [(1, None), (2, "c"), (None, "m")]
    assert rows(merge.sticky_upsert(t, new.where("k = 1 OR k IS NULL"), ["k"], ["v"])) == [(1, "a"), (None, "m")]
    assert rows(merge.upsert(t, new.where("k = 1"), ["k"], ["v"])) == [(1, None), (None, "n")]
    assert rows(merge.replace_owned(t, t.where("k = 1"), "k", [1])) == rows(t)


def test_writes_only_when_valid(spark, tmp_path):
    t = spark.createDataFrame([(1,)], "k int")
    path = str(tmp_path / "out")
    merge.write_if_valid(t, t.where("k > 5"), path)
    with pytest.raises(ValueError):
        merge.write_if_valid(t, t, path, dry_run=False)
    assert not (tmp_path / "out").exists()
    merge.write_if_valid(t, t.where("k > 5"), path, dry_run=False)
    assert spark.read.parquet(path).count() == 1


def test_links_prefer_earlier_candidates_then_the_same_organisation(spark):
    aliases = spark.createDataFrame([("m", 1, "a", 0.9), ("m", 2, "b", 1.0), ("full", 3, "a", 0.5)], "alias string, entity_id int, entity_org string, confidence double")
    recs = spark.createDataFrame([(1, "a", ["none", "m"]), (2, "z", ["m"]), (3, "z", ["full", "m"]), (4, None, ["x"])], "id int, org string, c array<string>")
    assert {r.id: r.entity_id for r in resolve.link(recs, aliases, "id", "c", "org").collect()} == {1: 1, 2: 2, 3: 3}


def test_merge_plan_skips_what_is_not_unique(spark):
    a = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("y", 3, True), ("y", 4, False), ("y", 5, False)], "alias string, id int, copy boolean")
    assert rows(resolve.merge_plan(a, "alias", "id", "copy")) == [(1, 2)]


def test_identity_variants(spark):
    got = one(spark, resolve.identity_variants(F.lit("claude-4-5-opus-non-reasoning-low-effort")))
    assert got == ["claude-4-5-opus-non-reasoning-low-effort", "claude-opus-4-5-non-reasoning-low-effort", "claude-4-5-opus"]


# text and JSON


@pytest.mark.parametrize(("raw", "want"), [("  GPT_4.5 / Turbo ", "gpt-4-5-turbo"), ("ｆｕｌｌ１.２", "full1-2"), ("a--b__c", "a-b-c"), ("-x-", "x"), ("1.2.3", "1-2-3"), ("", "")])
def test_normalize_alias(spark, raw, want):
    assert one(spark, X.normalize_alias(F.lit(raw))) == want


def test_text_functions(spark):
    assert one(spark, X.date_tokens(F.lit("x-20240102 2024-01-02 12024-01-02 2023-12-31"))) == ["2024-01-02", "2023-12-31"]
    assert one(spark, X.short_name(F.lit("zai/glm-4-5-air-20250728"))) == "GLM 4.5 Air"
    assert one(spark, X.suffix_reductions(F.lit("chatgpt-5-2025-01-01-thinking-32k-high"))) == ["gpt-5-2025-01-01-thinking-32k-high", "gpt-5-2025-01-01-thinking-32k", "gpt-5-2025-01-01", "gpt-5"]
    assert one(spark, X.parse_float(F.lit(" 1,234.5 %"))) == 1234.5 and one(spark, X.parse_float(F.lit("n/a"))) is None
    assert one(spark, X.prefix_int(F.lit("200000abc"))) == 200000
    assert one(spark, X.format_tokens(F.lit(1_050_000.0))) == "1.05M" and one(spark, X.format_price(F.lit(0.426))) == "$0.43"
    assert one(spark, X.duration_hours(F.lit("70m"))) == 1.17 and one(spark, X.duration_hours(F.lit("11.6h"))) == 11.6
    assert one(spark, X.fraction_to_percent(F.lit(0.5), F.lit("Pass Rate"))) == 50.0
    assert one(spark, gates.stale_days(F.lit("frozen daily"))) is None and one(spark, gates.stale_days(F.lit("monthly"))) == 90


def test_json_functions(spark):
    raw = '{"a": {"API_Key": 1, "path": "/etc/x", "list": [{"deep": [1]}]}, "ok": "v"}'
    assert one(spark, J.redact(F.lit(raw))) == '{"a": {"list": [{"deep": [1]}], "path": null}, "ok": "v"}'
    assert one(spark, J.redact(F.lit("{broken"))) is None
    assert one(spark, J.nested_lookup("deep")(F.lit(raw))) == "[1]"
    assert one(spark, J.object_or_empty(F.lit("[1]"))) == {} and one(spark, J.object_or_empty(F.lit(None).cast("string"))) == {}
    assert one(spark, J.modalities(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, J.modalities(F.lit("text"))) == ["text"]
    assert one(spark, nested.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))) == {"a": 2}


# documents, views, sources


def test_empty_documents_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    documents.write_json_document(df, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        documents.write_json_document(df.limit(0), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 1
    assert documents.as_json(df).first().value == '{"a":1,"b":null}'


def test_cohorts_fail_fast(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "s string")
    assert views.cohort(df, "s", ["a"]).first().place == 0
    for wanted in (["a", "zz"], ["b"], ["a", "a"]):
        with pytest.raises(ValueError):
            views.cohort(df, "s", wanted)


def test_matrix_rows_of_another_width_fail(spark):
    df = spark.createDataFrame([(1, [1.0, None])], "k int, v array<double>")
    assert rows(promote.matrix(df, "k", "v", ["a", "b"])) == [(1, "a", 1.0)]
    with pytest.raises(Exception, match="row width differs"):
        promote.matrix(df, "k", "v", ["a"]).collect()


def test_deepswe_payload_skips_rows_without_model_or_score(spark):
    raw = spark.createDataFrame([('{"leaderboard": [{"model": "m", "score": "0.5", "ci": [0.4, 0.6]}, {"score": "1"}, {"model": "x", "score": "NaN"}]}',)], "body string")
    got = parsers.deepswe(raw).collect()
    assert [(r.source_model_id, r.score) for r in got] == [("m", 50.0)]


def test_snapshots_are_added_once(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    drop = snapshots.read_drop(spark, str(tmp_path)).select("url", "content_hash", "fetched_at")
    none = drop.limit(0).select(F.lit("s").alias("source_id"), "*")
    first = snapshots.new_snapshots(none, drop, "s")
    assert first.count() == 1 and snapshots.new_snapshots(first, drop, "s").count() == 1


def test_zip_of_csv_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("bench.csv", 'Model version,Score,Note\n"m, 1",12.5%,x\nm2,n/a,y\n')
    files = spark.read.format("binaryFile").load(str(tmp_path / "e.zip"))
    assert [(r.source_model_id, r.benchmark_id, r.score) for r in parsers.epoch(files).collect()] == [("m, 1", "Score", 12.5)]


def test_status_lines(spark):
    df = spark.createDataFrame([("  a: ok 3",), ("b: FAILED x",), ("noise",)], "value string")
    assert rows(documents.status_from_log(df).select("source", "status")) == [("a", "ok"), ("b", "failed")]


# ranges, options, folds


def test_medians_ranks_and_records_of_few_keys(spark):
    import random
    import statistics

    from factloom.operators import frontier, ranges

    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.choice([1.0, 2.5, 7.0, None, rng.random() * 9]), rng.randrange(50)) for i in range(999)] + [("c", 1000, 4.0, 1), ("d", 1001, None, 2)]
    df = spark.createDataFrame(data, "k string, id long, v double, t long")
    groups = {k: sorted(v for g, _, v, _ in data if g == k and v is not None) for k in "abc"}
    assert {r.k: r.m for r in ranges.median(df, ["k"], "v", "m").collect()} == pytest.approx({k: statistics.median(v) for k, v in groups.items()})
    assert one(spark, F.lit(1)) == 1 and ranges.median(df, [], "v", "m").first().m == pytest.approx(statistics.median(v for g in groups.values() for v in g))
    got = ranges.ranked(df, ["k"], "v").collect()
    assert len(got) == sum(map(len, groups.values()))
    for r in got:
        assert groups[r.k][r._i] == r.v and r._n == len(groups[r.k])
    best, want = {}, []
    for k, i, v, t in sorted(data, key=lambda r: (r[3], r[1])):
        if k not in best or best[k] is None or v is not None and v > best[k]:
            want.append(i)
        best[k] = v if best.get(k) is None or v is not None and v > best[k] else best[k]
    assert sorted(r.id for r in frontier.records(df, "k", "t", "v", ["id"]).collect()) == sorted(want)


@pytest.mark.parametrize("n", [3, 40, 200])
def test_ends_with_ties_and_nulls(spark, n):
    import random

    from factloom.operators import sorts

    rng = random.Random(n)
    data = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(n)]
    up = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    down = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    want = sorted((r[0], up.index(r) + 1, down.index(r) + 1) for r in {*up[:10], *down[:10]})
    got = sorts.ends_nulls_last(spark.createDataFrame(data, "id long, v double"), "v", "id", 10)
    assert sorted((r.id, r.up, r.down) for r in got.collect()) == want


def test_overlaps_of_open_equal_and_odd_intervals(spark):
    import random

    from factloom.operators import joins

    rng = random.Random(8)
    data = []
    for i in range(120):
        s = rng.choice([None, rng.randrange(30)])
        data.append((rng.choice(["a", "b", None]), i, s, rng.choice([None, (s or 0) + rng.randrange(1, 9), (s or 0) + rng.randrange(-3, 9)])))
    df = spark.createDataFrame(data, "k string, id long, s long, e long")
    meets = lambda x, y: (x[2] is None or y[3] is None or x[2] < y[3]) and (y[2] is None or x[3] is None or y[2] < x[3])
    want = {(x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and meets(x, y)}
    assert {(r.id, r.other) for r in joins.overlapping_pairs(df, ["k"], "id", "s", "e").collect()} == want
    proper = [r for r in data if r[3] is None or r[2] is None or r[3] > r[2]]
    counts = {}
    for x in proper:
        for y in proper:
            if x[0] == y[0] and x[1] < y[1] and meets(x, y):
                counts[x[0]] = counts.get(x[0], 0) + 1
    assert {r.k: r.n for r in joins.overlap_counts(spark.createDataFrame(proper, df.schema), ["k"], "id", "s", "e", "n").collect()} == counts


def test_best_options_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    data = [(i, rng.choice("pq"), rng.choice("xyz"), rng.choice("fgh")) for i in range(150)]
    df = spark.createDataFrame(data, "id long, provider string, name string, family string")
    score = lambda a, b: 110 if a[2:] == b[2:] else 80 if a[2] == b[2] else 60 if a[3] == b[3] else 0
    want = set()
    for a in data:
        options = sorted((-score(a, b), b[0]) for b in data if a[1] == b[1] and a[0] != b[0] and score(a, b))[:7]
        want |= {(a[0], i, -s) for s, i in options}
    assert set(map(tuple, resolve.best_options(df, "id", "provider", "name", "family", 7).collect())) == want


def test_folding_of_intervals_that_end_before_they_begin(spark):
    from factloom.operators import temporal

    rows_ = [("k", 1, 10, 1), ("k", 3, 2, 2), ("k", 9, 12, 3), ("k", 12, 5, 4), ("k", 13, 20, 5), ("k", 14, None, 6), ("o", 5, 1, 7), ("o", 6, 8, 8)]
    df = spark.createDataFrame(rows_, "k string, s long, e long, id long")
    got = sorted(((r.k, r.s, r.e, r.n) for r in temporal.fold_islands(df, ["k"], "s", "e", ["id"]).collect()), key=str)
    assert got == sorted([("k", 1, 12, 3), ("k", 12, 5, 1), ("k", 13, None, 2), ("o", 5, 1, 1), ("o", 6, 8, 1)], key=str)
    proper = df.where("e is null or e > s")
    a, b = (sorted(map(tuple, f(proper, ["k"], "s", "e", ["id"]).select("k", "s", "e", "n").collect()), key=str) for f in (temporal.fold_islands, temporal.coalesce_islands))
    assert a == b


def test_merges_need_a_whole_copy(spark, tmp_path):
    from factloom.operators import merge

    t = spark.createDataFrame([(1, 2), (3, 4)], "id long, v long")
    none = t.where("false")
    for backup in (None, none, t.limit(1)):
        with pytest.raises(ValueError, match="copy"):
            merge.guarded_merge(t, t, backup, none, str(tmp_path / "x"))
    copy = merge.versioned_copy(t, str(tmp_path / "b"), 1)
    assert merge.guarded_merge(t, t.where("id = 1"), copy, none, str(tmp_path / "y")).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        merge.versioned_copy(t, str(tmp_path / "b"), 1)


def plain_islands(rows):
    """(start, end, rows, first id) of rows (id, start, end) of one key, one by one."""
    done = []
    for i, s, e in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        if done and (done[-1][1] is None or s is None or done[-1][1] > s) and (e is None or done[-1][0] is None or e > done[-1][0]):
            done[-1][1] = None if done[-1][1] is None or e is None else max(done[-1][1], e)
            done[-1][2] += 1
        else:
            done.append([s, e, 1, i])
    return [tuple(x) for x in done]


def test_islands_of_any_intervals_are_folded_in_ranges(spark):
    import random

    from factloom.operators import temporal

    rng = random.Random(11)
    rows = []
    for key in (None, "a", "b", "hot"):
        for i in range(60_000 if key == "hot" else 400):
            s = None if rng.random() < 0.01 and key != "hot" else rng.randint(0, 90_000 if key == "hot" else 500)
            e = None if rng.random() < 0.02 and key != "hot" else (s or 0) + rng.choice([-9, -1, 0, 1, 2, 3, 9])
            rows.append((key, i, s, e))
    df = spark.createDataFrame(rows, "k string, id long, s long, e long").repartition(5)
    want = sorted(((k, *r) for k in (None, "a", "b", "hot") for r in plain_islands([x[1:] for x in rows if x[0] == k])), key=repr)
    got = temporal.fold_islands(df, ["k"], "s", "e", ["id"], first=["id"]).select("k", "s", "e", "n", "id")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    parts = temporal.with_islands(df.where("k = 'hot'"), ["k"], "s", "e", ["id"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 40_000  # one key lies in several partitions
    assert temporal.fold_islands(df.where("false"), ["k"], "s", "e", ["id"]).collect() == []


def test_steps_compose():
    import random

    from factloom.operators import temporal as t

    rng = random.Random(3)
    for _ in range(3000):
        rows = sorted((rng.randint(0, 9), rng.randint(-3, 12)) for _ in range(rng.randint(1, 7)))
        first = rng.randint(-3, rows[0][0])
        for island in (t.NO_ISLAND, (float(first), float(rng.randint(-5, 14)))):
            want = island
            for s, e in rows:
                want = (want[0], max(want[1], e)) if t.joins(want, s, e) else (s, e)
            for cut in range(1, len(rows) + 1):
                steps = []
                for part in (rows[:cut], rows[cut:]):
                    step = None
                    for s, e in part:
                        step = t.then(step, t.row_step(s, e)) if step else t.row_step(s, e)
                    steps += [step] if step else []
                whole = t.then(*steps) if len(steps) == 2 else steps[0]
                assert t.after(island, whole) == want


def test_only_owners_mint_in_shared_catalogs(spark):
    ids = ["deepseek/deepseek-v4", "moonshotai/kimi-k2.5", "alibaba/qwen3.7", "nobody/acme-1", "deepseek/a/b", "deepseek/", "alibaba-cn/qwen3.7-flash", "alibaba-cn/deepseek-v4-flash", "alibaba-cn/new-kimi-x", "alibaba-cn/a-b-kimi", "alibaba-cn/x/deepseek", "alibaba-cn/wan2.5", "alibaba-cn/acme-1", "alibaba-cn", "other/deepseek-v4", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "i long, s string")
    owners = resolve.vendor_owners(df, "s", ["deepseek", "moonshotai", "alibaba"], ["alibaba-cn"])
    assert rows(owners) == [("deepseek", ["deepseek"]), ("kimi", ["moonshotai"]), ("qwen", ["alibaba"])]
    got = {r.s: r.mints for r in resolve.with_mint_gate(df, "s", owners, {"alibaba-cn": "alibaba"}).collect()}
    assert got == dict.fromkeys(ids, True) | {"alibaba-cn/deepseek-v4-flash": False, "alibaba-cn/new-kimi-x": False, "alibaba-cn/x/deepseek": False}


def test_payload_files_are_looked_up(spark, tmp_path):
    rec = spark.createDataFrame([(1, "a/1 x.raw"), (2, "a/2.raw"), (3, None), (4, "b/4.raw"), (5, "é%20.raw")], "id long, raw_path string")
    root = str(tmp_path / "raw")
    assert snapshots.missing_payloads(rec, root).count() == 5
    assert snapshots.write_payloads(spark.createDataFrame([("a/1 x.raw", b"1"), ("a/2.raw", b""), (None, b"x"), ("b/c", None), ("é%20.raw", b"5")], "path string, content binary"), root) == 3
    for place in (root, f"file://{root}", f"{root}/"):
        assert sorted(r.id for r in snapshots.missing_payloads(rec, place).collect()) == [2, 3, 4]


def test_stored_versions_are_read_as_one_table(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string as schema

    old = spark.createDataFrame([(1, 1.5, ("x",))], "id int, price float, s struct<a:string>")
    new = spark.createDataFrame([(2**40, 2.5, ("y", 7), "n")], "id long, price double, s struct<a:string,b:int>, name string")
    merge.versioned_copy(old, str(tmp_path), 1)
    merge.versioned_copy(new, str(tmp_path), 2)
    got = merge.read_versions(spark, str(tmp_path)).orderBy("version")
    assert got.dtypes == [("id", "bigint"), ("price", "double"), ("s", "struct<a:string,b:int>"), ("name", "string"), ("version", "int")]
    assert [(r.id, r.price, r.s.a, r.s.b, r.name) for r in got.collect()] == [(1, 1.5, "x", None, None), (2**40, 2.5, "y", 7, "n")]
    assert merge.additive(old.schema, new.schema).simpleString() == new.schema.simpleString()
    for bad in ("id int, s struct<a:string>", "id short, price float, s struct<a:string>", "id string, price float, s struct<a:string>"):
        with pytest.raises(merge.Narrowing):
            merge.additive(old.schema, schema(bad))
    assert merge.wider(*[f.dataType for f in schema("a decimal(10,2), b decimal(12,4)").fields]).simpleString() == "decimal(12,4)"
    for a, b in (("bigint", "double"), ("decimal(38,0)", "decimal(38,10)"), ("date", "timestamp"), ("string", "int")):
        with pytest.raises(merge.Narrowing):
            merge.merged_schema([schema(f"x {a}"), schema(f"x {b}")])
    spark.createDataFrame([("t",)], "id string").write.parquet(str(tmp_path / "version=000003"))
    with pytest.raises(merge.Narrowing, match="id"):
        merge.read_versions(spark, str(tmp_path))


def test_namespace_repairs_step_down(spark):
    models = [(1, "a/one", "a"), (2, "host/a/one", "host"), (3, "a/Two_b", "a"), (4, "host/a/two b", "host"), (5, "a/three-2024", "a"), (6, "host/a/three", "host"), (7, "b/four", "b"), (8, "host/a/four", "host"), (9, "host/z/four", "host"), (10, "host/host/five", "host"), (11, "x/two", "x"), (12, "plain", None), (13, "host/a/", "host")]
    m = spark.createDataFrame(models, "id long, slug string, developer_id string")
    aliases = spark.createDataFrame([("a-three", 5), ("a-four", 7), ("z-four", 7), ("a-three", 5)], "alias string, model_id long")
    got = {r.shell_id: (r.clean_slug, r.target_id, r.target_slug, r.resolution, r.action) for r in resolve.repair_plan(m, aliases, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {
        2: ("a/one", 1, "a/one", "exact", "merge"), 4: ("a/two b", 3, "a/Two_b", "normalized", "merge"), 6: ("a/three", 5, "a/three-2024", "alias", "merge"), 8: ("a/four", None, None, "create", "create"),  # a is known, and four is b's
        9: ("z/four", 7, "b/four", "alias", "merge"), 10: ("host/five", None, None, "create", "create"),
    }


def test_architectures_by_metadata_words_and_names(spark):
    registry = spark.createDataFrame([("LlamaForCausalLM",), ("Qwen3ForCausalLM",), ("Zed",), ("Abc",)], "architecture string")
    rows_ = [(1, ["No", " Zed ", "Abc"], ["Abc"]), (2, None, ["x/Zed-y Abc", ""]), (3, [], ["my Zed_x", "qwen_3 moe"]), (4, [], ["a Meta-Llama"]), (5, [], ["phi-3"]), (6, [], ["llamas"]), (7, [], ["QWEN-3-MOE"]), (8, None, None)]
    df = spark.createDataFrame(rows_, "id long, architectures array<string>, texts array<string>")
    assert rows(resolve.match_architecture(df, registry)) == [(1, "Zed", 0.95), (2, "Abc", 0.75), (3, "Qwen3ForCausalLM", 0.55), (4, "LlamaForCausalLM", 0.55), (7, "Qwen3ForCausalLM", 0.55)]


def test_merges_lose_no_fact(spark):
    plans = spark.createDataFrame([(2, "h/a/x", 1), (4, "h/a/y", 3), (6, "h/a/z", 5)], "shell_id long, shell_slug string, target_id long")
    caps = [(1, "ctx", 1, "8", 1.0), (2, "ctx", 1, "8", 1.0), (2, "ctx", 2, "9", 1.0), (3, "ctx", None, "8", 1.0), (4, "ctx", None, "7", 1.0), (4, "out", 1, "1", 1.0), (5, "ctx", 1, "8", 0.5), (6, "out", 1, "8", 1.0), (9, "ctx", 1, "1", 1.0)]
    c = spark.createDataFrame(caps, "model_id long, capability string, snapshot_id long, value string, confidence double")
    done = resolve.safe_merges(plans, c, spark.createDataFrame([("h/a/x", 2), ("h/a/y", 4), ("h/a/z", 9), ("other", None)], "alias string, model_id long"))
    assert rows(done["plans"].select("shell_id", "status", "reason", "collapsed")) == [(2, "merge", None, 1), (4, "skip", "capability conflict for ctx: shell=7 target=8", 0), (6, "merge", None, 0)]
    assert rows(done["capabilities"].select("model_id", "capability", "snapshot_id", "value")) == sorted([(1, "ctx", 1, "8"), (1, "ctx", 2, "9"), (3, "ctx", None, "8"), (4, "ctx", None, "7"), (4, "out", 1, "1"), (5, "ctx", 1, "8"), (5, "out", 1, "8"), (9, "ctx", 1, "1")], key=repr)
    assert rows(done["aliases"]) == sorted([("h/a/x", 1), ("h/a/y", 4), ("h/a/z", 9), ("other", None)], key=repr)


def test_a_launch_table_of_another_width_is_an_error(spark):
    kind = "set_id string, published_at date, condition map<string,string>, columns array<struct<label:string,slug:string,condition:map<string,string>>>, rows array<struct<benchmark_id:string,label:string,metric:string,values:array<double>,condition:map<string,string>>>"
    sets = spark.createDataFrame([("s", date(2026, 1, 1), None, [("own", "m", None), ("rival", None, None)], [("b", "B", "%", [1.0, 2.0], {"k": "v"})])], kind)
    models, marks = spark.createDataFrame([(1, "m")], "id long, slug string"), spark.createDataFrame([("b",)], "id string")
    assert rows(promote.launch_cells(sets, models, marks).select("status", "model_id", "score", "condition")) == [("skipped", None, None, None), ("taken", 1, 1.0, '{"k":"v"}')]
    bad = spark.createDataFrame([("s", None, None, [("own", "m", None)], [("b", "B", "%", [1.0, 2.0], None)])], kind)
    with pytest.raises(Exception, match="row B has 2 values for 1 columns"):
        promote.launch_cells(bad, models, marks).collect()


def test_price_trends_fall_back_to_current_prices(spark):
    from datetime import datetime as dt

    s = spark.createDataFrame([(1, dt(2024, 1, 5), 1450.0, 1), (1, dt(2024, 3, 31, 23), 1300.0, 2), (2, dt(2024, 2, 10), 1500.0, 3)], "model_id long, t timestamp_ntz, value double, id long")
    p = [(1, 3.0, dt(2024, 1, 31, 12), None), (1, 2.0, dt(2024, 2, 1), dt(2024, 2, 29)), (2, 9.0, dt(2024, 1, 1), None), (2, 8.0, dt(2024, 1, 1), None), (2, 9.0, dt(2024, 2, 2), None), (2, 0.0, dt(2024, 1, 1), None), (2, 1.0, None, None)]
    prices = spark.createDataFrame(p, "model_id long, amount double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    now = spark.createDataFrame([(1, 4.0), (2, 0.0)], "model_id long, price double")
    got = views.price_trend(s, prices, now, [1400.0, 1480.0])
    # a window that ends before the month does is not in force at its end; from March on the first model stands at 1300
    assert rows(got.select("threshold", F.month("month"), "model_id", "price", "current")) == [(1400.0, 1, 1, 3.0, False), (1400.0, 2, 1, 3.0, False), (1400.0, 3, 2, 9.0, False), (1480.0, 2, 2, 9.0, False), (1480.0, 3, 2, 9.0, False)]
    fell = views.price_trend(s, prices.where("false"), now, [1400.0])
    assert rows(fell.select(F.month("month"), "model_id", "price", "current")) == [(1, 1, 4.0, True), (2, 1, 4.0, True)]
    assert views.price_trend(s.where("false"), prices, now, [1.0]).collect() == []


def test_documents_over_peers_name_what_is_missing(spark):
    from factloom.operators import peers

    labels = [(2.0, "$2"), (0.25, "$0.25"), (0.5, "$0.50"), (0.125, "$0.125"), (0.0036, "$0.0036"), (12.5, "$12.5"), (1.2345, "$1.234"), (0.009, "$0.009")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v, _ in labels], "v double").select(peers.price_label(F.col("v"))).collect()]
    assert got == [x if v != 1.2345 else got[6] for v, x in labels] and got[6] in ("$1.234", "$1.235")
    tokens = [(1_000_000, "1M"), (1_048_576, "1M"), (1_050_000, "1.05M"), (2_500_000, "2.5M"), (200_000, "200K"), (131_072, "128K"), (8_192, "8K")]
    assert [r[0] for r in spark.createDataFrame([(v,) for v, _ in tokens], "v long").select(peers.compact_tokens(F.col("v"))).collect()] == [x for _, x in tokens]
    p = spark.createDataFrame([("a/x", 3.0, 15.0, 0.3, 1), ("a/y", None, 1.0, 0.1, 2)], "slug string, input double, output double, cache_read double, id long")
    good = p.where("id = 1")
    assert rows(peers.price_ladder(good)) == [("a/x", 3.0, 15.0, "$3", "$15")]
    (r,) = peers.cache_economics(good).collect()
    assert (round(r.effective, 6), r.label, round(r.label_x, 6)) == (0.57, "-81%", round((0.57 * 3) ** 0.5, 6))
    for fn in (peers.price_ladder, peers.cache_economics):
        with pytest.raises(Exception, match="missing input price for a/y"):
            fn(p).collect()
    caps = spark.createDataFrame([(1, "ctx", "200000"), (1, "ctx", "9"), (1, "max", "x")], "model_id long, capability string, value string")
    assert peers.spec_card(good.select("slug", "id"), caps, ["ctx"]).first().ctx_label == "200K"
    with pytest.raises(Exception, match="missing max for a/x"):
        peers.spec_card(good.select("slug", "id"), caps, ["ctx", "max"]).collect()
    days = spark.createDataFrame([("a", date(2025, 1, 1), date(2025, 3, 2)), ("b", None, date(2025, 1, 1))], "slug string, cutoff date, release date")
    assert rows(peers.freshness(days).select("slug", "gap_months")) == [("a", 1.971)]
    points = spark.createDataFrame([("a", date(2025, 2, 1), 2.0), ("a", date(2025, 1, 1), 1.0), ("a", date(2024, 1, 1), float("nan")), ("b", None, None)], "slug string, date date, score double")
    assert [(r.slug, r.first, [tuple(x) for x in r.points]) for r in peers.lineage(points).select("slug", F.col("first"), "points").collect()] == [("a", date(2025, 1, 1), [(date(2025, 1, 1), 1.0), (date(2025, 2, 1), 2.0)])]
