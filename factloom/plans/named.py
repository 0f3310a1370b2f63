"""The named analysis queries and the quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gates, joins, picks
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles


def _m(spark, sf, *cols):
    return R.model(spark, sf).select(F.col("id").alias("model_id"), *cols)


@query("o_q_01", with_roles("SELECT m.id AS model_id, m.developer, r.benchmark_id, r.score, p.component, p.amount, r.measured_at FROM result r JOIN model m ON m.id = r.model_id JOIN price p ON p.model_id = m.id WHERE NOT r.self_reported AND p.component IN ('F', 'O') AND p.amount IS NOT NULL AND r.benchmark_id = 'A' AND r.rank = 1 AND p.line = 2", "result", "model", "price"))
def q_01(spark, sf):
    r = R.result(spark, sf).where("NOT self_reported AND benchmark_id = 'A' AND rank = 1 AND score IS NOT NULL").select("model_id", "benchmark_id", "score", "measured_at")
    p = R.price(spark, sf).where("component IN ('F', 'O') AND amount IS NOT NULL AND line = 2").select("model_id", "component", "amount")
    return r.join(_m(spark, sf, "developer"), "model_id").join(p, "model_id")


@query("o_q_02", with_roles("SELECT m.id AS model_id, r.benchmark_id, r.score, r.rank, r.ci, r.measured_at, s.fetched_at FROM result r JOIN model m ON m.id = r.model_id LEFT JOIN snapshot s ON s.id = r.snapshot_id WHERE r.benchmark_id ILIKE 'a%'", "result", "model", "snapshot"))
def q_02(spark, sf):
    r = R.result(spark, sf).where(F.col("benchmark_id").ilike("a%") & F.col("score").isNotNull()).select("model_id", "benchmark_id", "score", "rank", "ci", "measured_at", "snapshot_id")
    s = R.snapshot(spark, sf).select(F.col("id").alias("snapshot_id"), "fetched_at")
    return joins.semi(r, R.model(spark, sf), {"model_id": "id"}).join(s, "snapshot_id", "left").drop("snapshot_id")


@query("o_q_03", with_roles("SELECT id AS model_id, developer, family, release_date, CAST(context AS BIGINT) AS tokens FROM model WHERE regexp_matches(CASE WHEN id % 4 = 0 THEN 'none' ELSE context || 'k' END, '^[0-9]') ORDER BY tokens DESC, release_date DESC", "model"))
def q_03(spark, sf):
    from factloom.functions.text import prefix_int

    raw = F.when(F.col("id") % 4 == 0, "none").otherwise(F.concat("context", F.lit("k")))
    m = R.model(spark, sf).withColumn("v", raw).where(F.col("v").rlike("^[0-9]"))
    return m.select(F.col("id").alias("model_id"), "developer", "family", "release_date", prefix_int(F.col("v")).alias("tokens")).orderBy(F.desc("tokens"), F.desc("release_date"))


@query("o_q_04", with_roles("SELECT r.model_id, r.score, p.amount, round(p.amount / nullif(r.score, 0), 9) AS per_point FROM result r JOIN model m ON m.id = r.model_id JOIN price p ON p.model_id = m.id WHERE p.component = 'O' AND r.benchmark_id = 'R' AND r.rank = 1 AND p.line = 1", "result", "model", "price"))
def q_04(spark, sf):
    r = joins.semi(R.result(spark, sf).where("benchmark_id = 'R' AND rank = 1").select("model_id", "score"), R.model(spark, sf), {"model_id": "id"})
    p = R.price(spark, sf).where("component = 'O' AND line = 1").select("model_id", "amount")
    return r.join(p, "model_id").withColumn("per_point", F.round(F.col("amount") / F.nullif("score", F.lit(0.0)), 9))


@query("o_q_05", with_roles("SELECT benchmark_id, open_weights, model_id, score FROM (SELECT r.benchmark_id, coalesce(m.open_weights, FALSE) AS open_weights, m.id AS model_id, r.score, row_number() OVER (PARTITION BY r.benchmark_id, coalesce(m.open_weights, FALSE) ORDER BY r.score DESC, m.id) AS rn FROM result r JOIN model m ON m.id = r.model_id WHERE NOT r.self_reported) WHERE rn = 1", "result", "model"))
def q_05(spark, sf):
    best = R.result(spark, sf).where("NOT self_reported").groupBy("benchmark_id", "model_id").agg(F.max("score").alias("score"))
    j = best.join(_m(spark, sf, F.coalesce("open_weights", F.lit(False)).alias("open_weights")), "model_id")
    return picks.latest_pick(j, ["benchmark_id", "open_weights"], [F.desc("score"), F.asc("model_id")]).select("benchmark_id", "open_weights", "model_id", "score")


@query("o_q_06", with_roles("WITH t AS (SELECT * FROM model WHERE id = 7), p AS (SELECT m.* FROM model m CROSS JOIN t WHERE (t.family IS NOT NULL AND m.family = t.family) OR (t.family IS NULL AND m.developer = t.developer)) SELECT p.id AS model_id, r.benchmark_id, r.score, r.rank, max(p.context) AS context, min(CASE WHEN c.component = 'F' THEN c.amount END) AS input_price, min(CASE WHEN c.component = 'O' THEN c.amount END) AS output_price FROM p LEFT JOIN result r ON r.model_id = p.id LEFT JOIN price c ON c.model_id = p.id WHERE r.benchmark_id IN ('A', 'R') GROUP BY p.id, r.benchmark_id, r.score, r.rank", "model", "result", "price"))
def q_06(spark, sf):
    m = R.model(spark, sf)
    t = m.where("id = 7").select(F.col("id").alias("_k"), F.col("family").alias("_f"), F.col("developer").alias("_d")).limit(1)
    on = F.when(F.col("_f").isNotNull(), F.col("family") == F.col("_f")).otherwise(F.col("developer") == F.col("_d"))
    peers = m.join(F.broadcast(t), on).select(F.col("id").alias("model_id"), "context")
    cost = R.price(spark, sf).groupBy("model_id").agg(F.min(F.when(F.col("component") == "F", F.col("amount"))).alias("input_price"), F.min(F.when(F.col("component") == "O", F.col("amount"))).alias("output_price"))
    r = R.result(spark, sf).where("benchmark_id IN ('A', 'R')").select("model_id", "benchmark_id", "score", "rank").distinct()
    return r.join(peers, "model_id").join(cost, "model_id", "left")


@query("o_q_07", with_roles("SELECT u.provider_id, p.component, p.amount, p.valid_from, p.valid_to, p.source_id, s.fetched_at FROM price p JOIN model m ON m.id = p.model_id LEFT JOIN surface u ON u.id = p.surface_id LEFT JOIN snapshot s ON s.id = p.snapshot_id WHERE m.id BETWEEN 10 AND 20", "price", "model", "surface", "snapshot"))
def q_07(spark, sf):
    p = joins.semi(R.price(spark, sf).where("model_id BETWEEN 10 AND 20"), R.model(spark, sf), {"model_id": "id"})
    u = R.surface(spark, sf).select(F.col("id").alias("surface_id"), "provider_id")
    s = R.snapshot(spark, sf).select(F.col("id").alias("snapshot_id"), "fetched_at")
    return p.join(u, "surface_id", "left").join(s, "snapshot_id", "left").select("provider_id", "component", "amount", "valid_from", "valid_to", "source_id", "fetched_at")


@query("o_q_08", with_roles("SELECT s.source_id, u.name AS alias, count(*) AS seen, min(s.fetched_at) AS first_seen, max(s.fetched_at) AS last_seen FROM result r JOIN snapshot s ON s.id = r.snapshot_id JOIN surface u ON u.id = r.surface_id WHERE r.model_id = 7 GROUP BY ALL", "result", "snapshot", "surface"))
def q_08(spark, sf):
    r = R.result(spark, sf).where("model_id = 7").join(R.snapshot(spark, sf).select(F.col("id").alias("snapshot_id"), "source_id", "fetched_at"), "snapshot_id").join(R.surface(spark, sf).select(F.col("id").alias("surface_id"), F.col("name").alias("alias")), "surface_id")
    return r.groupBy("source_id", "alias").agg(F.count("*").alias("seen"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"))


@query("o_q_09", with_roles("SELECT m.name, r.score, r.rank, r.ci, s.source_id, s.fetched_at FROM result r LEFT JOIN model m ON m.id = r.model_id LEFT JOIN snapshot s ON s.id = r.snapshot_id WHERE r.benchmark_id = 'N' ORDER BY r.score DESC, r.rank, r.model_id, r.snapshot_id LIMIT 20", "result", "model", "snapshot"))
def q_09(spark, sf):
    top = R.result(spark, sf).where("benchmark_id = 'N'").orderBy(F.desc("score"), "rank", "model_id", "snapshot_id").limit(20)
    return top.join(_m(spark, sf, "name"), "model_id", "left").join(R.snapshot(spark, sf).select(F.col("id").alias("snapshot_id"), "source_id", "fetched_at"), "snapshot_id", "left").select("name", "score", "rank", "ci", "source_id", "fetched_at")


@query("o_q_10", with_roles("SELECT id, name, developer, family, release_date FROM model WHERE CAST(release_date AS VARCHAR) >= '2023-01-01'", "model"))
def q_10(spark, sf):
    return R.model(spark, sf).where(F.col("release_date").cast("string") >= "2023-01-01").select("id", "name", "developer", "family", "release_date")


# quality gates


@query("o_qg_01", with_roles("SELECT 'orphan_reference' AS \"check\", 'error' AS severity, CAST(r.model_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM result r LEFT JOIN (SELECT id FROM model WHERE id % 9 <> 4) m ON m.id = r.model_id WHERE m.id IS NULL GROUP BY r.model_id", "result", "model"))
def qg_01(spark, sf):
    lost = joins.orphans(R.result(spark, sf), R.model(spark, sf).where("id % 9 <> 4"), {"model_id": "id"}).groupBy("model_id").agg(F.count("*").alias("n"))
    return gates.issues(lost, "orphan_reference", "error", F.col("model_id"), F.col("n"))


@query("o_qg_02", with_roles("SELECT 'missing_provenance' AS \"check\", 'error' AS severity, CAST(r.snapshot_id AS VARCHAR) AS key, CAST(r.model_id AS VARCHAR) AS detail FROM result r LEFT JOIN snapshot s ON s.id = r.snapshot_id WHERE s.id IS NULL OR trim(coalesce(nullif(s.source_id, '2-HIGH'), '')) = ''", "result", "snapshot"))
def qg_02(spark, sf):
    s = R.snapshot(spark, sf).where(~joins.blank(F.nullif("source_id", F.lit("2-HIGH"))))
    return gates.issues(joins.orphans(R.result(spark, sf), s, {"snapshot_id": "id"}), "missing_provenance", "error", F.col("snapshot_id"), F.col("model_id"))


@query("o_qg_03", with_roles("SELECT 'duplicate_slug' AS \"check\", 'error' AS severity, developer || '/' || name AS key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS detail FROM model GROUP BY 3 HAVING count(*) > 1", "model"))
def qg_03(spark, sf):
    slug = F.concat("developer", F.lit("/"), "name").alias("slug")
    d = R.model(spark, sf).groupBy(slug).agg(F.count("*").alias("n"), F.expr("listagg(CAST(id AS STRING), ',') WITHIN GROUP (ORDER BY id)").alias("ids")).where("n > 1")
    return gates.issues(d, "duplicate_slug", "error", F.col("slug"), F.col("ids"))


@query("o_qg_04", with_roles("SELECT 'overlapping_price' AS \"check\", 'error' AS severity, a.model_id || ':' || a.surface_id || ':' || a.component AS key, a.snapshot_id || '.' || a.line || '-' || b.snapshot_id || '.' || b.line AS detail FROM price a JOIN price b ON a.model_id = b.model_id AND a.surface_id = b.surface_id AND a.component = b.component AND (a.snapshot_id, a.line, a.total) < (b.snapshot_id, b.line, b.total) AND coalesce(a.valid_from < b.valid_to, TRUE) AND coalesce(b.valid_from < a.valid_to, TRUE)", "price"))
def qg_04(spark, sf):
    p = R.price(spark, sf).withColumn("id", F.struct("snapshot_id", "line", "total"))
    pairs = joins.overlapping_pairs(p, ["model_id", "surface_id", "component"], "id", "valid_from", "valid_to")
    name = lambda c: F.concat(F.col(f"{c}.snapshot_id"), F.lit("."), F.col(f"{c}.line"))
    return gates.issues(pairs, "overlapping_price", "error", F.concat_ws(":", "model_id", "surface_id", "component"), F.concat(name("id"), F.lit("-"), name("other")))


@query("o_qg_05", "SELECT 'missing_snapshot_raw_payload' AS \"check\", 'error' AS severity, CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 11 <> 0 THEN 'p' || page_id % 10 || '/' || page_id || '.raw' END AS detail FROM pages WHERE html IS NULL OR html = '' OR page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 13 = 0")
def qg_05(spark, sf):
    """Every 7th payload isn't written, every 11th has no path, every 13th is empty."""
    from factloom.session import shared_folder, table
    from factloom.sources.snapshots import missing_payloads, write_payloads

    path = F.concat(F.lit("p"), F.col("page_id") % 10, F.lit("/"), "page_id", F.lit(".raw"))
    pages = table(spark, sf, "pages").select("page_id", "html", F.when(F.col("page_id") % 11 != 0, path).alias("raw_path"))
    root = shared_folder(spark, "payloads")
    write_payloads(pages.where("page_id % 7 <> 0").select(F.col("raw_path").alias("path"), F.when(F.col("page_id") % 13 == 0, "").otherwise(F.col("html")).alias("content")), root)
    return gates.issues(missing_payloads(pages.select("page_id", "raw_path"), root), "missing_snapshot_raw_payload", "error", F.col("page_id"), F.col("raw_path"))


@query("o_qg_06", "SELECT 'missing_condition' AS \"check\", 'warning' AS severity, CAST(event_id AS VARCHAR) AS key, event_type AS detail FROM events WHERE event_id % 11 = 0")
def qg_06(spark, sf):
    from factloom.session import table

    raw = F.when(F.col("event_id") % 11 == 0, F.lit(" ")).otherwise(F.col("props"))
    return gates.issues(table(spark, sf, "events").where(joins.blank(raw)), "missing_condition", "warning", F.col("event_id"), F.col("event_type"))


@query("o_qg_07", with_roles("SELECT 'stale_source' AS \"check\", 'warning' AS severity, source_id AS key, CAST(date_diff('day', max(fetched_at), TIMESTAMP '2001-08-20') AS VARCHAR) AS detail FROM snapshot GROUP BY source_id HAVING date_diff('day', max(fetched_at), TIMESTAMP '2001-08-20') > CASE WHEN source_id LIKE '1%' THEN 14 WHEN source_id LIKE '2%' THEN 21 ELSE 90 END", "snapshot"))
def qg_07(spark, sf):
    cadence = F.when(F.col("source_id").startswith("1"), "daily").when(F.col("source_id").startswith("2"), "weekly").otherwise("monthly")
    age = F.datediff(F.lit("2001-08-20").cast("date"), F.max("fetched_at"))
    s = R.snapshot(spark, sf).groupBy("source_id").agg(age.alias("age")).where(F.col("age") > gates.stale_days(cadence))
    return gates.issues(s, "stale_source", "warning", F.col("source_id"), F.col("age"))


@query("o_qg_08", with_roles("SELECT 'count_regression' AS \"check\", 'error' AS severity, benchmark_id AS key, n || ' of ' || base AS detail FROM (SELECT benchmark_id, count(*) FILTER (WHERE measured_at < TIMESTAMP '1997-01-01') AS n, count(*) AS base FROM result GROUP BY 1) WHERE n * 2 < base", "result"))
def qg_08(spark, sf):
    c = R.result(spark, sf).groupBy("benchmark_id").agg(F.count_if(F.expr("measured_at < TIMESTAMP_NTZ'1997-01-01'")).alias("n"), F.count("*").alias("base")).where("n * 2 < base")
    return gates.issues(c, "count_regression", "error", F.col("benchmark_id"), F.concat("n", F.lit(" of "), "base"))


@query("o_qg_09", with_roles("WITH i AS (SELECT DISTINCT model_id FROM result WHERE ci > 0.08), b AS (SELECT DISTINCT model_id FROM result WHERE ci > 0.09) SELECT count(*) FILTER (WHERE b.model_id IS NULL) AS errors, count(*) FILTER (WHERE b.model_id IS NOT NULL) AS warnings, count(*) FILTER (WHERE b.model_id IS NULL) > 0 AS blocked FROM i LEFT JOIN b USING (model_id)", "result"))
def qg_09(spark, sf):
    r = R.result(spark, sf)
    return gates.summary(gates.downgrade(r.where("ci > 0.08").select("model_id").distinct(), r.where("ci > 0.09"), ["model_id"]))
