"""Queries on tables that are larger, or repeat more, than the given ones."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def same_as_sql(spark, path, name, **tables):
    """The rows of a query over ``tables`` (SQL), which must be those of its SQL twin."""
    sf, db = str(path), duckdb.connect()
    for t, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{sf}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


def parts(ids, name="'n'", kind="'t'", size="30"):
    return f"SELECT i AS p_partkey, {name} AS p_name, 'Brand#11' AS p_brand, {kind} AS p_type, CAST({size} AS INTEGER) AS p_size, 12.5 AS p_retailprice FROM {ids} x(i)"


def test_labels_of_a_million_and_more(spark, tmp_path):
    ids = "(VALUES (999::BIGINT), (1000), (1250), (999999), (1000000), (1250000), (2005000), (12345678))"
    assert {r[0]: r[4] for r in same_as_sql(spark, tmp_path, "o_str_20", part=parts(ids))}[1000000] == "1M"


def test_linking_makes_no_pairs_of_an_alias(spark, tmp_path):
    """3,000 entries of one alias wait and 3,000 are approved; all pairs would be 9,000,000 rows of a join."""
    from unittest import mock

    from factloom.operators import resolve

    most = []
    with mock.patch.object(resolve, "ladder", side_effect=lambda *a, ladder=resolve.ladder: most.append(a[2][0][1].count()) or ladder(*a)):
        rows = same_as_sql(spark, tmp_path, "o_sup_17", part=parts("range(6000)", size="20 + 10 * (i % 2)"))
    assert most == [3000] and {r[1:] for r in rows} == {(None, "waiting"), (0, "linked")}


def test_options_of_a_group_are_found_once(spark):
    """200 entities of one name and family get 10 options each; a group has one list, and null names and families are no others' equals."""
    from factloom.operators import resolve

    rows = [(i, "p", "n", "f") for i in range(200)] + [(200, "p", "n", None), (201, "p", "n", None), (202, "p", None, "f"), (203, None, "n", "f"), (204, "p", "m", "f"), (205, "p", "m", "g")]
    df = spark.createDataFrame(rows, "id long, provider string, name string, family string")
    score = lambda a, b: 110 if a[2] and a[2] == b[2] and a[3] and a[3] == b[3] else 80 if a[2] and a[2] == b[2] else 60 if a[3] and a[3] == b[3] else 0
    want = set()
    for a in rows:
        found = sorted((-score(a, b), b[0]) for b in rows if a[0] != b[0] and a[1] and a[1] == b[1] and score(a, b))[:10]
        good = [s for s, _ in found if s <= -80]
        want |= {(a[0], e, -s, -s >= 80 and len(good) == 1) for s, e in found}
    lists = resolve.option_lists(df, "id", "provider", "name", "family", 10)
    assert set(map(tuple, resolve.suggested_options(lists).collect())) == want
    assert set(map(tuple, resolve.best_options(df, "id", "provider", "name", "family", 10).collect())) == {w[:3] for w in want}


def test_a_flagged_join_has_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    from factloom import session
    from factloom.operators import joins

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    left = spark.createDataFrame([(i % 700 if i % 9 else None, i) for i in range(1000)], "k long, v long")
    got = joins.flagged(left, spark.range(0, 700, 5).union(spark.range(0, 10)), {"k": "id"}, "hit")
    assert got.rdd.getNumPartitions() == 21
    assert {(r.k, r.v, r.hit) for r in got.collect()} == {(k, i, k is not None and (k % 5 == 0 or k < 10)) for i in range(1000) for k in [i % 700 if i % 9 else None]} and got.count() == 1000


def test_window_prices_meet_wanted_months_alone(spark):
    from factloom.operators import views

    t = lambda d: f"TIMESTAMP_NTZ'{d}'"
    prices = spark.sql(f"SELECT * FROM VALUES (1L, 5D, {t('2024-01-10')}, NULL), (1L, 5D, {t('2024-02-01')}, {t('2024-03-30')}), (1L, 4D, {t('2024-01-31')}, {t('2024-06-30 23:59:59.999')}), (1L, 3D, {t('2024-03-01')}, {t('2024-03-02')}), (2L, 0D, {t('2024-01-01')}, NULL) p(k, amount, s, e)")
    wanted = spark.sql(f"SELECT k, m AS month FROM VALUES (1L), (2L) a(k), VALUES ({t('2024-02-01')}), ({t('2024-03-01')}), ({t('2024-06-01')}) b(m)")
    got = views.window_prices(prices, "k", "amount", "s", "e", wanted)
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert sorted((r.k, r.month.month, r.price) for r in got.collect()) == [(1, 2, 5.0), (1, 3, 4.0), (1, 6, 4.0)]


def test_peers_are_counted_without_a_groups_rows(spark):
    from factloom.operators import joins

    rows = [(i, "a", "x") for i in range(5, 300)] + [(1, None, "x"), (2, None, "x"), (3, "b", None), (4, "b", None), (301, "c", "x")]
    plan = joins.peer_counts(spark.createDataFrame(rows, "id long, dev string, family string"), "id", "dev", "family")
    assert "collect_set" not in plan._jdf.queryExecution().toString()
    got = {r.id: (r.peers, r.first_peer) for r in plan.collect()}
    assert got == {i: (294, 6 if i == 5 else 5) for i in range(5, 300)} | {1: (1, 2), 2: (1, 1), 3: (0, None), 4: (0, None), 301: (0, None)}


def test_many_pages_are_runs_of_a_partition(spark, tmp_path, monkeypatch):
    import json

    from factloom.sources import pages

    monkeypatch.setattr(pages, "PARTITIONS", 4)
    reader = pages.PageReader(lambda o, n: json.dumps({"rows": [1], "num_rows_total": 95}), 10, 1, 0)
    assert [list(p.offsets) for p in reader.partitions()] == [[0], [10, 20, 30], [40, 50, 60], [70, 80, 90]]
    assert [o for p in reader.partitions() for o, _ in reader.read(p)] == list(range(0, 95, 10))
    got = same_as_sql(spark, tmp_path, "o_src_14", part=parts("range(10250)", size="i % 50"))  # pages of more than one folder
    assert len(got) == 10250 + 5125


def test_first_and_count_holds_no_groups_rows(spark, monkeypatch):
    from factloom import session
    from factloom.operators import picks

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    df = spark.createDataFrame([(i % 3 if i % 3 else None, "k", 1000 - i) for i in range(1000)], "a long, b string, s long")
    got = picks.first_and_count(df, ["a", "b"], "s", "n")
    assert "Window" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() == 21
    assert {tuple(r) for r in got.collect()} == {(None, "k", 1, 334), (1, "k", 3, 333), (2, "k", 2, 333)}
