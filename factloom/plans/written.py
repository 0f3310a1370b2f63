"""What is written and read back: sinks, archives, versions, guarded writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import documents, merge, resolve
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import shared_folder
from factloom.sources import commits, parsers


@query("o_snk_01", with_roles("SELECT id, developer, CAST(price AS DOUBLE) AS price FROM model", "model"))
def snk_01(spark, sf):
    path = shared_folder(spark, "models")
    documents.write_json_document(R.model(spark, sf).select("id", "developer", "price"), path)
    return spark.read.schema("id long, developer string, price double").json(path)


@query("o_snk_02", with_roles("SELECT 'models' AS document, count(*) AS n FROM model UNION ALL SELECT 'prices', count(*) FROM price UNION ALL SELECT 'changes', count(*) FROM snapshot", "model", "price", "snapshot"))
def snk_02(spark, sf):
    every = {"models": R.model(spark, sf).select("id", "name"), "prices": R.price(spark, sf).select("model_id", "amount"), "changes": R.snapshot(spark, sf).select("id", "fetched_at")}
    root, out = shared_folder(spark, "documents"), None
    for name, rows in every.items():
        documents.write_json_document(rows, f"{root}/{name}")
        one = spark.read.text(f"{root}/{name}").agg(F.lit(name).alias("document"), F.count("*").alias("n")).select("document", "n")
        out = one if out is None else out.union(one)
    return out


@query("o_snk_06", with_roles("SELECT id, elo AS tps, 1 AS run FROM series WHERE kind = 'view' UNION ALL SELECT id, elo, 2 FROM series WHERE kind = 'click'", "series"))
def snk_06(spark, sf):
    path, s = shared_folder(spark, "speed"), R.series(spark, sf)
    for run, kind in ((1, "view"), (2, "click")):
        documents.append_jsonl(s.where(F.col("kind") == kind).select("id", F.col("elo").alias("tps"), F.lit(run).alias("run")), path)
    return spark.read.schema("id long, tps double, run int").json(path)


@query("o_src_04", with_roles("SELECT id // 50 AS archive, developer || '/m' || id AS source_model_id, 'score' AS benchmark_id, CAST(price AS DOUBLE) AS score FROM model UNION ALL SELECT id // 50, developer || '/m' || id, 'share', CAST(context AS DOUBLE) FROM model WHERE id % 3 <> 0", "model"))
def src_04(spark, sf):
    m = R.model(spark, sf).select("id", F.expr("id div 50").alias("archive"), F.concat("developer", F.lit("/m"), "id").alias("name"), F.col("price").cast("string").alias("score"), F.when(F.col("id") % 3 != 0, F.concat("context", F.lit("%"))).otherwise(F.lit("")).alias("share"))
    line = F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit('"')), "score", "share", "id")
    bodies = m.groupBy(F.col("archive").cast("string").alias("path")).agg(F.concat(F.lit("Model,score,share,id\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("body"))
    found = parsers.epoch(parsers.zipped_csv(bodies, "benchmarks.csv"))
    return found.select(F.col("path").cast("long").alias("archive"), "source_model_id", "benchmark_id", "score")


@query("o_dml_06", with_roles("SELECT id, source_id, size FROM snapshot WHERE source_id NOT IN ('5-LOW', '2-HIGH') UNION ALL SELECT id, source_id, size + 1 FROM snapshot WHERE source_id = '5-LOW'", "snapshot"))
def dml_06(spark, sf):
    """A table in folders of its owners; two owners are rebuilt, one of them without rows, and once more."""
    s, path = R.snapshot(spark, sf).select("id", "source_id", "size"), shared_folder(spark, "owned")
    s.write.partitionBy("source_id").parquet(path)
    new = s.where("source_id = '5-LOW'").withColumn("size", F.col("size") + 1)
    merge.rebuild_owned(new, path, "source_id", ["5-LOW", "2-HIGH"])
    return merge.rebuild_owned(new, path, "source_id", ["5-LOW", "2-HIGH"])


@query("o_dml_08", with_roles("SELECT 'model' AS kind, id, CAST(price AS DOUBLE) + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS value FROM model UNION ALL SELECT 'surface', id, CASE WHEN id % 3 = 0 THEN -1 ELSE CAST(balance AS DOUBLE) END FROM surface UNION ALL SELECT 'dry run', id, 0 FROM model WHERE id % 7 = 0", "model", "surface"))
def dml_08(spark, sf):
    """Two tables change in one commit; a dry run before gives its plan and changes nothing, a batch with problems neither."""
    m, s = R.model(spark, sf).select("id", F.col("price").cast("double").alias("price")), R.surface(spark, sf).select("id", F.col("balance").cast("double").alias("balance"))
    store = commits.Store(spark, shared_folder(spark, "store"))
    old = store.commit({"model": m, "surface": s})
    new = {"model": merge.upsert(old["model"], m.where("id % 7 = 0").withColumn("price", F.col("price") + 1), ["id"], ["price"]), "surface": merge.upsert(old["surface"], s.where("id % 3 = 0").withColumn("balance", F.lit(-1.0)), ["id"], ["balance"])}
    plan = store.commit(new, dry_run=True)["model"].join(store.read("model").withColumnsRenamed({"id": "_id", "price": "_price"}), (F.col("id") == F.col("_id")) & (F.col("price") != F.col("_price")))
    try:
        store.commit({"model": m.where("false")}, problems=m.where("price > 0").select("id"))
    except commits.Rejected:
        done = store.commit(new)
    return done["model"].select(F.lit("model").alias("kind"), "id", F.col("price").alias("value")).union(done["surface"].select(F.lit("surface"), "id", "balance")).union(plan.select(F.lit("dry run"), "id", F.lit(0.0)))


@query("o_dml_10", with_roles("SELECT id, CASE WHEN id % 10 = 3 THEN id - 1 ELSE id END AS target FROM model", "model"))
def dml_10(spark, sf):
    m = R.model(spark, sf).select("id", F.col("id").alias("target"))
    moves = m.where("id % 10 = 3").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
    root = shared_folder(spark, "merge")
    backup = merge.versioned_copy(m, f"{root}/backup", 1)
    plan = merge.rewrite_keys(m, "target", moves)
    return merge.guarded_merge(m, plan, backup, plan.where("target IS NULL"), f"{root}/new")


@query("o_dml_11", with_roles("SELECT 1 AS version, id, price FROM model WHERE id % 5 = 0 UNION ALL SELECT 2, id, price FROM model", "model"))
def dml_11(spark, sf):
    m, root = R.model(spark, sf).select("id", "price"), shared_folder(spark, "versions")
    for version, rows in ((1, m.where("id % 5 = 0")), (2, m)):
        merge.versioned_copy(rows, root, version)
    return spark.read.schema("id long, price double, version int").parquet(root).select("version", "id", "price")


@query("o_sup_01", with_roles("SELECT 1 AS version, CAST(id AS BIGINT) AS id, CAST(context AS DOUBLE) AS context, NULL AS display_name FROM model WHERE id % 2 = 0 UNION ALL SELECT 2, id, CAST(context AS DOUBLE) + 0.5, name FROM model", "model"))
def sup_01(spark, sf):
    """A second version adds a column and widens two; both are read as one table."""
    m, root = R.model(spark, sf), shared_folder(spark, "versions")
    first = m.where("id % 2 = 0").select(F.col("id").cast("int").alias("id"), F.col("context").cast("int").alias("context"))
    second = m.select(F.col("id").cast("long").alias("id"), (F.col("context") + F.lit(0.5)).alias("context"), F.col("name").alias("display_name"))
    merge.versioned_copy(first, root, 1)
    merge.additive(first.schema, second.schema)
    merge.versioned_copy(second, root, 2)
    return merge.read_versions(spark, root)


@query("o_pro_18", with_roles("SELECT 'mteb' AS source, count(*) AS n, 0 AS failed FROM model UNION ALL SELECT 'swebench', 0, 1 UNION ALL SELECT 'aider', 0, 1 UNION ALL SELECT 'written', count(*), 0 FROM model", "model"))
def pro_18(spark, sf):
    """One source comes through, one breaks off at a row in the middle, one can't be planned."""
    m = R.model(spark, sf)
    body = F.to_json(F.array(F.struct(F.concat(F.lit("m"), "id").alias("model_name"), F.col("price").alias("avg"))))
    good = m.select(F.col("id").alias("snapshot_id"), body.alias("body"))
    bad = m.withColumn("body", F.when(F.col("id") % 100 == 50, F.raise_error(F.lit("no such page"))).otherwise(F.lit("{}"))).select("id", "body")
    plans = {"mteb": lambda: parsers.PARSERS["mteb"](good), "swebench": lambda: parsers.PARSERS["swebench"](bad), "aider": lambda: parsers.PARSERS["aider"](m.select("id"))}
    store = commits.Store(spark, shared_folder(spark, "run"))
    status = commits.run_isolated(store, plans)
    return status.select("source", "n", "failed").union(store.read("mteb").agg(F.count("*").alias("n")).select(F.lit("written"), "n", F.lit(0)))


@query("o_sup_17", with_roles("WITH q AS (SELECT id, developer || '/' || name AS alias, context > 25 AS approved FROM model), e AS (SELECT alias, min(id) AS entity_id FROM q WHERE NOT approved GROUP BY 1) SELECT q.id, e.entity_id, CASE WHEN NOT approved THEN 'waiting' WHEN e.entity_id IS NULL THEN 'new' ELSE 'linked' END AS status FROM q LEFT JOIN e ON approved AND q.alias = e.alias", "model"))
def sup_17(spark, sf):
    """A guarded approval run: a copy, then the accepted entries linked again, a gate, and one write."""
    q = R.model(spark, sf).select("id", F.concat("developer", F.lit("/"), "name").alias("alias"), (F.col("context") > 25).alias("approved"))
    root = shared_folder(spark, "approvals")
    backup = merge.versioned_copy(q, f"{root}/backup", 1)
    known = q.where("NOT approved").groupBy("alias").agg(F.min("id").alias("entity_id"))  # the ladder takes the least, so no alias's pairs are made
    linked = resolve.ladder(q.where("approved"), "id", [(0.95, q.where("approved").join(known, "alias").select("id", "entity_id"))], 0.9)
    linked = linked.select(F.col("id").alias("_id"), "entity_id")
    status = F.when(~F.col("approved"), "waiting").when(F.col("entity_id").isNull(), "new").otherwise("linked")
    plan = q.join(linked, F.col("id") == F.col("_id"), "left").select("id", "entity_id", status.alias("status"))
    problems = plan.groupBy("id").count().where("count > 1")
    return merge.guarded_merge(q, plan, backup, problems, f"{root}/new")
