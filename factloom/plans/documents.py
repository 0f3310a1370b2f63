"""Published documents: nested composites, compared in flattened form."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.jsonx import path_coalesce
from factloom.operators import changes, joins, nested, picks, sorts, stats
from factloom.operators.documents import score_map
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import table

BEST = "SELECT DISTINCT ON (model_id, benchmark_id) model_id, benchmark_id, score, self_reported FROM result ORDER BY model_id, benchmark_id, self_reported, measured_at DESC, snapshot_id DESC, rank DESC, score DESC"


def best(spark, sf):
    order = ["self_reported", F.desc("measured_at"), F.desc("snapshot_id"), F.desc("rank"), F.desc("score")]
    return picks.latest_pick(R.result(spark, sf), ["model_id", "benchmark_id"], [F.asc("self_reported"), *order[1:]]).select("model_id", "benchmark_id", "score", "self_reported")


@query("o_doc_01", with_roles("SELECT source_id, max(fetched_at) AS newest, count(*) AS snapshots, (SELECT count(*) FROM model) AS models, (SELECT count(*) FROM result) AS results FROM snapshot GROUP BY 1", "snapshot", "model", "result"))
def doc_01(spark, sf):
    s = R.snapshot(spark, sf).groupBy("source_id").agg(F.max("fetched_at").alias("newest"), F.count("*").alias("snapshots"))
    models, results = R.model(spark, sf).agg(F.count("*").alias("models")), R.result(spark, sf).agg(F.count("*").alias("results"))
    return s.join(F.broadcast(models)).join(F.broadcast(results))  # one row each


@query("o_doc_02", with_roles(f"WITH b AS ({BEST}), c AS (SELECT model_id, amount, component, count(*) AS n FROM price WHERE amount > 0 GROUP BY ALL), md AS (SELECT model_id, component, arg_min(amount, struct_pack(n := -n, a := amount)) AS amount FROM c GROUP BY ALL) SELECT m.id, m.name, m.context, (SELECT amount FROM md WHERE md.model_id = m.id AND component = 'F') AS price_in, (SELECT amount FROM md WHERE md.model_id = m.id AND component = 'O') AS price_out, (SELECT score FROM b WHERE b.model_id = m.id AND benchmark_id = 'A') AS score_a, (SELECT score FROM b WHERE b.model_id = m.id AND benchmark_id = 'R') AS score_r FROM model m", "model", "result", "price"))
def doc_02(spark, sf):
    on = lambda c: stats.mode_low(F.when(F.col("component") == c, F.col("amount")))
    prices = R.price(spark, sf).groupBy("model_id").agg(on("F").alias("price_in"), on("O").alias("price_out"))
    scores = score_map(best(spark, sf), "model_id", "benchmark_id", ["score", "self_reported"], "scores")
    m = R.model(spark, sf).select(F.col("id").alias("model_id"), "name", "context").join(prices, "model_id", "left").join(scores, "model_id", "left")
    at = lambda b: F.try_element_at("scores", F.lit(b))["score"]
    return m.select(F.col("model_id").alias("id"), "name", "context", "price_in", "price_out", at("A").alias("score_a"), at("R").alias("score_r"))


@query("o_doc_03", with_roles(f"WITH b AS ({BEST}) SELECT model_id, max(CASE WHEN benchmark_id = 'A' THEN score END) AS a, max(CASE WHEN benchmark_id = 'N' THEN score END) AS n, bool_or(self_reported) AS any_self FROM b GROUP BY 1", "result"))
def doc_03(spark, sf):
    b = best(spark, sf)
    return b.groupBy("model_id").agg(F.max(F.when(F.col("benchmark_id") == "A", F.col("score"))).alias("a"), F.max(F.when(F.col("benchmark_id") == "N", F.col("score"))).alias("n"), F.bool_or("self_reported").alias("any_self"))


@query("o_doc_04", with_roles("SELECT DISTINCT ON (kind, model_id) kind, model_id, elo AS tps, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM series ORDER BY kind, model_id, t DESC, elo DESC, id", "series"))
def doc_04(spark, sf):
    s = picks.keep_first(R.series(spark, sf), ["kind", "model_id"], [F.desc("t"), F.desc("elo"), F.asc("id")])
    return s.select("kind", "model_id", F.col("elo").alias("tps"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("o_doc_05", with_roles("SELECT benchmark_id, count(*) AS results, count(*) FILTER (WHERE model_id % 13 = 0) AS unresolved, arg_min(score, struct_pack(s := -score, m := model_id)) AS first_score FROM result GROUP BY 1", "result"))
def doc_05(spark, sf):
    r = R.result(spark, sf).withColumn("model_id", F.when(F.col("model_id") % 13 != 0, F.col("model_id")))
    return r.groupBy("benchmark_id").agg(F.count("*").alias("results"), F.count_if(F.col("model_id").isNull()).alias("unresolved"), F.max("score").alias("first_score"))


@query("o_doc_06", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cost FROM events WHERE event_id % 3 <> 0")
def doc_06(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, F.replace("props", F.lit('"k"'), F.lit('"mean_cost"'))).otherwise(F.replace("props", F.lit('"k"'), F.lit('"cost"')))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), path_coalesce(raw, ["$.cost", "$.mean_cost"]).try_cast("double").alias("cost")).where("cost IS NOT NULL")


@query("o_doc_07", with_roles("SELECT model_id, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days, string_agg(CAST(elo AS VARCHAR), ',' ORDER BY day) AS elos FROM (SELECT DISTINCT ON (model_id, day) model_id, CAST(t AS DATE) AS day, elo FROM series ORDER BY model_id, day, t DESC, id DESC) GROUP BY 1", "series"))
def doc_07(spark, sf):
    daily = changes.last_of_day(R.series(spark, sf), ["model_id"], "t", ["t", "id"])
    s = nested.columnar_series(daily, ["model_id"], ["day"], ["day", "elo"])
    return s.select("model_id", F.array_join(F.col("day").cast("array<string>"), ",").alias("days"), F.array_join(F.col("elo").cast("array<string>"), ",").alias("elos"))


@query("o_doc_08", with_roles("SELECT benchmark_id, model_id, string_agg(CAST(CAST(seen AS DATE) AS VARCHAR), ',' ORDER BY seen) AS days, string_agg(CAST(score AS VARCHAR), ',' ORDER BY seen) AS scores FROM (SELECT benchmark_id, model_id, measured_at AS seen, arg_max(score, struct_pack(a := snapshot_id, b := rank, c := score)) AS score FROM result WHERE NOT self_reported GROUP BY ALL) GROUP BY ALL", "result"))
def doc_08(spark, sf):
    r = R.result(spark, sf).where("NOT self_reported").groupBy("benchmark_id", "model_id", F.col("measured_at").alias("at")).agg(F.max_by("score", F.struct("snapshot_id", "rank", "score")).alias("score"))
    s = nested.columnar_series(r, ["benchmark_id", "model_id"], ["at"], ["at", "score"])
    return s.select("benchmark_id", "model_id", F.array_join(F.transform("at", lambda t: t.cast("date").cast("string")), ",").alias("days"), F.array_join(F.col("score").cast("array<string>"), ",").alias("scores"))


@query("o_doc_09", with_roles("SELECT m.id, p.component, p.amount, p.valid_from FROM model m JOIN price p ON p.model_id = m.id", "model", "price"))
def doc_09(spark, sf):
    p = R.price(spark, sf).select("model_id", "component", "valid_from", "amount")
    d = nested.children(R.model(spark, sf).select("id"), p, "id", "model_id", ["component", "valid_from", "amount"], "prices")
    return d.select("id", F.inline("prices"))


@query("o_doc_10", with_roles("SELECT DISTINCT m.id, u.name AS alias FROM result r JOIN model m ON m.id = r.model_id JOIN surface u ON u.id = r.surface_id WHERE r.ci > 0.08", "result", "model", "surface"))
def doc_10(spark, sf):
    r = R.result(spark, sf).where("ci > 0.08").select("model_id", "surface_id").distinct()
    return joins.semi(r, R.model(spark, sf), {"model_id": "id"}).join(R.surface(spark, sf), F.col("surface_id") == F.col("id")).select(F.col("model_id").alias("id"), F.col("name").alias("alias"))


FEED = """WITH r AS (SELECT model_id, measured_at, score, lag(score) OVER w AS before, row_number() OVER w AS n, snapshot_id FROM result WINDOW w AS (PARTITION BY benchmark_id, model_id ORDER BY measured_at, snapshot_id, rank, score)),
p AS (SELECT model_id, valid_from, amount, lag(amount) OVER w AS before, row_number() OVER w AS n, snapshot_id FROM price WINDOW w AS (PARTITION BY model_id, surface_id, component, source_id ORDER BY valid_from, snapshot_id, line, amount, total)),
e AS (SELECT 'benchmark_changed' AS category, model_id AS entity, measured_at AS observed, before, score AS after, snapshot_id AS tie FROM r WHERE n > 1 AND before IS DISTINCT FROM score
 UNION ALL SELECT 'price_changed', model_id, valid_from, before, amount, snapshot_id FROM p WHERE n > 1 AND before IS DISTINCT FROM amount
 UNION ALL SELECT 'source_refreshed', owner_id, fetched_at, NULL, size, id FROM snapshot
 UNION ALL SELECT 'model_added', id, CAST(release_date AS TIMESTAMP), NULL, price, id FROM model
 UNION ALL SELECT 'alias_first_seen', model_id, min(measured_at), NULL, CAST(surface_id AS DOUBLE), min(snapshot_id) FROM result GROUP BY model_id, surface_id),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY observed DESC, entity, tie, after) AS rn, count(*) OVER (PARTITION BY category) AS total FROM e)
SELECT category, entity, observed, before, after, total, total > 1000 AS truncated FROM k WHERE rn <= 1000"""


@query("o_doc_11", with_roles(FEED, "result", "price", "snapshot", "model"))
def doc_11(spark, sf):
    none = F.lit(None).cast("double").alias("before")
    c = lambda cat, e, o, b, a, t: [F.lit(cat).alias("category"), F.col(e).alias("entity"), o.alias("observed"), b, F.col(a).cast("double").alias("after"), F.col(t).alias("tie")]
    r = changes.changes(R.result(spark, sf), ["benchmark_id", "model_id"], ["measured_at", "snapshot_id", "rank", "score"], "score")
    p = changes.changes(R.price(spark, sf), ["model_id", "surface_id", "component", "source_id"], ["valid_from", "snapshot_id", "line", "amount", "total"], "amount")
    alias = R.result(spark, sf).groupBy("model_id", "surface_id").agg(F.min("measured_at").alias("o"), F.min("snapshot_id").alias("s"))
    events = joins.union_all([
        r.select(*c("benchmark_changed", "model_id", F.col("measured_at"), F.col("before"), "score", "snapshot_id")),
        p.select(*c("price_changed", "model_id", F.col("valid_from"), F.col("before"), "amount", "snapshot_id")),
        R.snapshot(spark, sf).select(*c("source_refreshed", "owner_id", F.col("fetched_at"), none, "size", "id")),
        R.model(spark, sf).select(*c("model_added", "id", F.col("release_date").cast("timestamp_ntz"), none, "price", "id")),
        alias.select(*c("alias_first_seen", "model_id", F.col("o"), none, "surface_id", "s")),
    ])
    return sorts.bounded_feed(events, "category", [F.desc("observed"), F.asc("entity"), F.asc("tie"), F.asc("after")], 1000).drop("tie")


@query("o_doc_12", with_roles("SELECT m.id, min(x.seen) AS first_seen, max(x.seen) AS last_seen, (SELECT count(*) FROM model o WHERE o.developer = m.developer AND o.family = m.family AND o.id <> m.id) AS peers FROM model m LEFT JOIN (SELECT model_id, measured_at AS seen FROM result UNION ALL SELECT model_id, valid_from FROM price) x ON x.model_id = m.id GROUP BY m.id, m.developer, m.family", "model", "result", "price"))
def doc_12(spark, sf):
    seen = R.result(spark, sf).select("model_id", F.col("measured_at").alias("seen")).union(R.price(spark, sf).select("model_id", "valid_from")).groupBy("model_id").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    m = R.model(spark, sf)
    size = m.groupBy(F.col("developer").alias("_d"), F.col("family").alias("_f")).agg((F.count("*") - 1).alias("peers"))
    j = m.join(size, F.col("developer").eqNullSafe(F.col("_d")) & F.col("family").eqNullSafe(F.col("_f")))
    return j.join(seen, F.col("id") == F.col("model_id"), "left").select("id", "first_seen", "last_seen", "peers")


@query("o_doc_13", with_roles("SELECT p.model_id, u.id AS surface_id, u.name, p.component, min(p.amount) AS low, count(*) AS n FROM price p JOIN surface u ON u.id = p.surface_id GROUP BY ALL", "price", "surface"))
def doc_13(spark, sf):
    p = R.price(spark, sf).groupBy("model_id", "surface_id", "component").agg(F.min("amount").alias("low"), F.count("*").alias("n"))
    run = p.groupBy("model_id", "surface_id").agg(F.array_sort(F.collect_list(F.struct("component", "low", "n"))).alias("prices"))  # two components
    named = run.join(R.surface(spark, sf).select(F.col("id").alias("surface_id"), "name"), "surface_id")
    return named.select("model_id", "surface_id", "name", F.inline("prices"))
