"""Commits of several tables, isolated sources, rebuilt owners."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import merge
from factloom.sources import snapshots
from factloom.sources.commits import Conflict, Rejected, Store, run_isolated


def values(df):
    return sorted(r[0] for r in df.collect())


def data(root):
    return sorted(os.listdir(root / "data"))


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() == 0 and store.tables() == {}
    store.commit({"a": spark.range(3), "b": spark.range(5)})
    before = data(tmp_path)
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):  # the first table is whole by then
        store.commit({"a": spark.range(9), "b": broken})
    assert store.version() == 1 and data(tmp_path) == before
    assert values(store.read("a")) == [0, 1, 2] and store.read("b").count() == 5
    with pytest.raises(Rejected, match="bad row"):
        store.commit({"a": spark.range(9)}, problems=spark.range(1).select(F.lit("bad row")))
    plan = store.commit({"a": spark.range(9)}, dry_run=True)
    assert plan["a"].count() == 9 and store.version() == 1 and data(tmp_path) == before
    store.commit({"a": spark.range(9)}, problems=spark.range(0))
    assert store.read("a").count() == 9 and store.read("b").count() == 5 and store.read("a", 1).count() == 3


def test_a_number_is_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    base = store.version()
    store.commit({"a": spark.range(1)}, base=base)
    held = data(tmp_path)
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(2)}, base=base)
    assert store.version() == 1 and data(tmp_path) == held and store.read("a").count() == 1
    assert not [n for n in os.listdir(tmp_path / "manifests") if n.startswith("_")]
    store.commit({"a": spark.range(2)})
    assert store.vacuum() == 1 and store.read("a").count() == 2


def test_a_table_is_read_while_it_is_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"a": spark.range(3)})
    old = store.read("a")
    store.commit({"a": old.select((F.col("id") + 10).alias("id"))})
    assert values(old) == [0, 1, 2] and values(store.read("a")) == [10, 11, 12]


def test_sources_are_kept_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    raw = lambda *bodies: spark.createDataFrame([(b,) for b in bodies], "body string")
    good = raw('[{"model_name": "m", "avg": "1.5"}]')
    first = snapshots.run_sources(store, {"mteb": good, "openrouter": raw('{"data": [{"id": "a", "pricing": {"prompt": "0.000001"}}]}')})
    assert {(r.source, r.n, r.failed) for r in first.collect()} == {("mteb", 1, 0), ("openrouter", 1, 0)} and snapshots.exit_code(first) == 0
    rows = spark.range(20, numPartitions=4).select(F.when(F.col("id") == 11, F.raise_error(F.lit("cut off"))).otherwise(F.lit('[{"model_name": "n", "avg": "2"}]')).cast("string").alias("body"))
    again = snapshots.run_sources(store, {"mteb": rows, "openrouter": raw('{"data": [{"id": "b"}, {"id": "c"}]}'), "aider": good.drop("body")}).collect()
    assert {(r.source, r.n, r.failed) for r in again} == {("mteb", 0, 1), ("openrouter", 2, 0), ("aider", 0, 1)}
    assert "cut off" in next(r.error for r in again if r.source == "mteb")
    assert values(store.read("mteb").select("source_model_id")) == ["m"]  # of the last good run
    assert values(store.read("openrouter").select("source_model_id")) == ["b", "c"]
    none = run_isolated(store, {"x": lambda: spark.range(1).select("nothing")})
    assert snapshots.exit_code(none) == 1 and store.version() == 2
    assert run_isolated(store, {}).collect() == []


def files(path):
    return {d: sorted(f for f in os.listdir(path / d) if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def test_rebuilt_owners_leave_other_folders_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b", 1.0), (2, "7", 2.0), (3, None, 3.0), (4, "d", 4.0)], "id long, owner string, v double")
    path = tmp_path / "t"
    rows.write.partitionBy("owner").parquet(str(path))
    before = files(path)
    new = spark.createDataFrame([(9, "a/b", 9.0), (8, "d", 8.0)], "id long, owner string, v double")
    for _ in range(2):
        got = merge.rebuild_owned(new, str(path), "owner", ["a/b", None, "gone"])
        assert sorted(map(tuple, got.collect())) == [(2, "7", 2.0), (4, "d", 4.0), (9, "a/b", 9.0)]
    after = files(path)
    assert after["owner=7"] == before["owner=7"] and after["owner=d"] == before["owner=d"]
    assert set(after) == {"owner=7", "owner=d", "owner=a%2Fb"} and after["owner=a%2Fb"] != before["owner=a%2Fb"]


def test_a_copy_needs_the_same_rows(spark, tmp_path):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    other = spark.createDataFrame([(1, "x"), (3, "y")], "id long, v string")
    with pytest.raises(ValueError, match="copy"):
        merge.guarded_merge(t, t, other, t.where("false"), str(tmp_path / "x"))
    assert merge.guarded_merge(t, t, t, t.where("false"), str(tmp_path / "x")).count() == 2
