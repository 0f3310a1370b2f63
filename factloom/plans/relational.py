"""Filters, joins, sorts and set operations over the roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import joins, picks, sorts
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import table


@query("o_flt_01", with_roles("SELECT id AS modelId, developer AS developerId, price AS listPrice FROM model", "model"))
def flt_01(spark, sf):
    return R.model(spark, sf).select(F.col("id").alias("modelId"), F.col("developer").alias("developerId"), F.col("price").alias("listPrice"))


@query("o_flt_02", with_roles("SELECT * FROM result WHERE benchmark_id = 'R' AND NOT self_reported AND score <> 0 AND measured_at IS NOT NULL", "result"))
def flt_02(spark, sf):
    return R.result(spark, sf).where("benchmark_id = 'R' AND NOT self_reported AND score <> 0 AND measured_at IS NOT NULL")


@query("o_flt_03", with_roles("SELECT id, source_id FROM snapshot WHERE source_id IN ('1-URGENT', '2-HIGH')", "snapshot"))
def flt_03(spark, sf):
    return R.snapshot(spark, sf).select("id", "source_id").where(F.col("source_id").isin("1-URGENT", "2-HIGH"))


@query("o_flt_04", with_roles("SELECT id, name FROM model WHERE id IN (SELECT model_id FROM result WHERE score > 100000)", "model", "result"))
def flt_04(spark, sf):
    return joins.semi(R.model(spark, sf).select("id", "name"), R.result(spark, sf).where("score > 100000"), {"id": "model_id"})


@query("o_flt_05", with_roles("SELECT * FROM snapshot WHERE id IN (SELECT max(id) FROM snapshot GROUP BY source_id)", "snapshot"))
def flt_05(spark, sf):
    return picks.newest_per(R.snapshot(spark, sf), "source_id", "id")


@query("o_flt_06", with_roles("SELECT r.* FROM result r WHERE snapshot_id = (SELECT max(id) FROM snapshot WHERE source_id = '5-LOW' AND id IN (SELECT snapshot_id FROM result))", "result", "snapshot"))
def flt_06(spark, sf):
    result = R.result(spark, sf)
    snaps = joins.semi(R.snapshot(spark, sf).where("source_id = '5-LOW'"), result, {"id": "snapshot_id"})
    return joins.semi(result, snaps.agg(F.max("id").alias("id")), {"snapshot_id": "id"})


@query("o_flt_07", with_roles("SELECT id, name FROM model WHERE name ILIKE 'SMALL\\_%' ESCAPE '\\' OR name LIKE 'red %' OR name ILIKE '%_WIDGET'", "model"))
def flt_07(spark, sf):
    return R.model(spark, sf).select("id", "name").where(F.col("name").ilike(r"SMALL\_%") | F.col("name").like("red %") | F.col("name").ilike("%_WIDGET"))


@query("o_flt_08", with_roles("SELECT id, source_id FROM snapshot WHERE regexp_matches(source_id, '^[0-9]') AND NOT regexp_matches(source_id, '^[45]')", "snapshot"))
def flt_08(spark, sf):
    return R.snapshot(spark, sf).select("id", "source_id").where(F.col("source_id").rlike("^[0-9]") & ~F.col("source_id").rlike("^[45]"))


@query("o_flt_09", with_roles("SELECT id, nullif(source_id, '5-LOW') AS s FROM snapshot WHERE nullif(source_id, '5-LOW') IS NOT DISTINCT FROM NULL OR nullif(source_id, '5-LOW') IS DISTINCT FROM '2-HIGH'", "snapshot"))
def flt_09(spark, sf):
    s = F.nullif("source_id", F.lit("5-LOW"))
    return R.snapshot(spark, sf).select("id", s.alias("s")).where(F.col("s").eqNullSafe(F.lit(None)) | ~F.col("s").eqNullSafe(F.lit("2-HIGH")))


@query("o_flt_10", with_roles("SELECT id FROM snapshot WHERE trim(coalesce(nullif(replace(source_id, '5-LOW', '  '), '2-HIGH'), '')) = ''", "snapshot"))
def flt_10(spark, sf):
    s = F.nullif(F.regexp_replace("source_id", "5-LOW", "  "), F.lit("2-HIGH"))
    return R.snapshot(spark, sf).where(joins.blank(s)).select("id")


@query("o_flt_11", with_roles("SELECT id FROM model WHERE (family IS NOT NULL AND family = 'PROMO') OR (family IS NULL AND developer = 'Brand#1') OR (developer = 'Brand#2')", "model"))
def flt_11(spark, sf):
    family, dev = F.col("family"), F.col("developer")
    return R.model(spark, sf).where((family.isNotNull() & (family == "PROMO")) | (family.isNull() & (dev == "Brand#1")) | (dev == "Brand#2")).select("id")


@query("o_flt_12", with_roles("SELECT id FROM model m WHERE contains(lower(name), 'wid') OR contains(lower(developer), 'brand#1') OR id IN (SELECT id FROM (SELECT l_partkey AS id, string_agg(lower(s_name), chr(10)) AS blob FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) WHERE contains(blob, '#000000007'))", "model"))
def flt_12(spark, sf):
    li, su = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), table(spark, sf, "supplier")
    alias = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).where(F.lower("s_name").contains("#000000007")).select(F.col("l_partkey").alias("_p")).distinct()
    m = R.model(spark, sf).join(alias, F.col("id") == F.col("_p"), "left")
    return m.where(F.lower("name").contains("wid") | F.lower("developer").contains("brand#1") | F.col("_p").isNotNull()).select("id")


@query("o_flt_13", "SELECT event_type, count(*) FILTER (WHERE k IS NOT NULL) AS kept, count(*) FILTER (WHERE k IS NULL) AS skipped FROM (SELECT event_type, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE json_extract_string(props, '$.k') END AS BIGINT) AS k FROM events) GROUP BY 1")
def flt_13(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.get_json_object("props", "$.k"))
    ev = table(spark, sf, "events").select("event_type", raw.try_cast("bigint").alias("k"))
    return ev.groupBy("event_type").agg(F.count_if(F.col("k").isNotNull()).alias("kept"), F.count_if(F.col("k").isNull()).alias("skipped"))


# joins


@query("o_join_01", with_roles("SELECT m.name, r.benchmark_id, r.score, s.fetched_at, u.name AS surface FROM result r JOIN model m ON m.id = r.model_id JOIN snapshot s ON s.id = r.snapshot_id JOIN surface u ON u.id = r.surface_id", "result", "model", "snapshot", "surface"))
def join_01(spark, sf):
    r, m, s, u = (f(spark, sf) for f in (R.result, R.model, R.snapshot, R.surface))
    out = r.join(m.select(F.col("id").alias("model_id"), "name"), "model_id")
    out = out.join(s.select(F.col("id").alias("snapshot_id"), "fetched_at"), "snapshot_id")
    return out.join(u.select(F.col("id").alias("surface_id"), F.col("name").alias("surface")), "surface_id").select("name", "benchmark_id", "score", "fetched_at", "surface")


@query("o_join_02", with_roles("SELECT r.model_id, r.score, s.source_id, u.name AS surface FROM result r LEFT JOIN snapshot s ON s.id = r.snapshot_id AND s.id % 2 = 0 LEFT JOIN surface u ON u.id = r.surface_id AND u.balance > 0", "result", "snapshot", "surface"))
def join_02(spark, sf):
    s = R.snapshot(spark, sf).where("id % 2 = 0").select(F.col("id").alias("snapshot_id"), "source_id")
    u = R.surface(spark, sf).where("balance > 0").select(F.col("id").alias("surface_id"), F.col("name").alias("surface"))
    return R.result(spark, sf).join(s, "snapshot_id", "left").join(u, "surface_id", "left").select("model_id", "score", "source_id", "surface")


@query("o_join_03", with_roles("SELECT m.id, p.amount FROM model m LEFT JOIN price p ON p.model_id = m.id AND p.source_id = 'R' AND p.component = 'F'", "model", "price"))
def join_03(spark, sf):
    p = R.price(spark, sf).where("source_id = 'R' AND component = 'F'").select("model_id", "amount")
    return R.model(spark, sf).join(p, F.col("id") == F.col("model_id"), "left").select("id", "amount")


@query("o_join_04", with_roles("WITH target AS (SELECT * FROM model WHERE id = 7) SELECT m.id, m.name FROM model m CROSS JOIN target t WHERE m.id <> t.id AND (m.family = t.family OR (t.family IS NULL AND m.developer = t.developer))", "model"))
def join_04(spark, sf):
    m = R.model(spark, sf)
    return joins.peers(m, m.where("id = 7"), "id", "family", "developer").select("id", "name")


@query("o_join_05", with_roles("SELECT a.model_id, a.surface_id, a.component, count(*) AS overlaps FROM price a JOIN price b ON a.model_id IS NOT DISTINCT FROM b.model_id AND a.surface_id IS NOT DISTINCT FROM b.surface_id AND a.component IS NOT DISTINCT FROM b.component AND (a.snapshot_id, a.line, a.total) < (b.snapshot_id, b.line, b.total) AND coalesce(a.valid_from < b.valid_to, TRUE) AND coalesce(b.valid_from < a.valid_to, TRUE) GROUP BY ALL", "price"))
def join_05(spark, sf):
    p = R.price(spark, sf).withColumn("id", F.struct("snapshot_id", "line", "total"))
    return joins.overlap_counts(p, ["model_id", "surface_id", "component"], "id", "valid_from", "valid_to", "overlaps")


@query("o_join_06", with_roles("SELECT DISTINCT a.model_id, a.surface_id FROM result a JOIN result b ON a.model_id = b.model_id AND a.surface_id = b.surface_id AND a.snapshot_id < b.snapshot_id", "result"))
def join_06(spark, sf):
    keys = R.result(spark, sf).select("model_id", "surface_id", "snapshot_id")
    # two different snapshots exist exactly if least and greatest differ: no self join is needed
    return keys.groupBy("model_id", "surface_id").agg(F.min("snapshot_id").alias("a"), F.max("snapshot_id").alias("b")).where("a < b").select("model_id", "surface_id")


@query("o_join_07", with_roles("SELECT p.model_id, p.amount, x.top FROM price p JOIN (SELECT nullif(component, 'F') AS c, model_id, max(snapshot_id) AS top FROM price GROUP BY ALL) x ON x.model_id = p.model_id AND x.c IS NOT DISTINCT FROM nullif(p.component, 'F')", "price"))
def join_07(spark, sf):
    p = R.price(spark, sf).withColumn("c", F.nullif("component", F.lit("F")))
    top = p.groupBy(F.col("c").alias("_c"), F.col("model_id").alias("_m")).agg(F.max("snapshot_id").alias("top"))
    return p.join(top, (F.col("model_id") == F.col("_m")) & F.col("c").eqNullSafe(F.col("_c"))).select("model_id", "amount", "top")


@query("o_join_08", with_roles("SELECT r.model_id, r.score, u.name FROM result r JOIN surface u ON u.id = r.surface_id", "result", "surface"))
def join_08(spark, sf):
    return R.result(spark, sf).join(R.surface(spark, sf), F.col("id") == F.col("surface_id")).select("model_id", "score", "name")


@query("o_join_09", with_roles("WITH p AS (SELECT model_id AS id, min(amount) AS price, max(score) AS score FROM (SELECT l_partkey AS model_id, l_quantity AS amount, l_extendedprice AS score FROM lineitem) GROUP BY 1) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.price <= p.price AND o.score >= p.score AND (o.price < p.price OR o.score > p.score))", "model"))
def join_09(spark, sf):
    from factloom.operators.frontier import pareto_dominance

    points = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("price"), F.max("l_extendedprice").alias("score"))
    return pareto_dominance(points, "price", "score")


@query("o_join_10", with_roles("SELECT m.id, (SELECT r.score FROM result r WHERE r.model_id = m.id ORDER BY r.snapshot_id DESC, r.rank DESC, r.score DESC LIMIT 1) AS newest FROM model m", "model", "result"))
def join_10(spark, sf):
    newest = R.result(spark, sf).groupBy("model_id").agg(F.max_by("score", F.struct("snapshot_id", "rank", "score")).alias("newest"))
    return R.model(spark, sf).join(newest, F.col("id") == F.col("model_id"), "left").select("id", "newest")


@query("o_join_11", with_roles("WITH c AS (SELECT model_id, max(t) - INTERVAL 10 DAY AS cut FROM series GROUP BY 1) SELECT c.model_id, s.elo, s.t FROM c JOIN LATERAL (SELECT elo, t FROM series s WHERE s.model_id = c.model_id AND s.t <= c.cut ORDER BY t DESC, id DESC LIMIT 1) s ON TRUE", "series"))
def join_11(spark, sf):
    from factloom.operators.asof import latest_at_or_before

    s = R.series(spark, sf)
    cut = s.groupBy("model_id").agg((F.max("t") - F.expr("INTERVAL 10 DAYS")).alias("cut"))
    return latest_at_or_before(cut, s, "model_id", "cut", "t", ["id"]).select("model_id", "elo", "t")


GRID = "SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-31', INTERVAL 7 DAY)) AS g"


@query("o_join_12", with_roles(f"WITH grid AS ({GRID}), k AS (SELECT DISTINCT model_id FROM series) SELECT k.model_id, g, (SELECT elo FROM series s WHERE s.model_id = k.model_id AND s.t <= g ORDER BY t DESC, id DESC LIMIT 1) AS elo FROM k CROSS JOIN grid WHERE EXISTS (SELECT 1 FROM series s WHERE s.model_id = k.model_id AND s.t <= g)", "series"))
def join_12(spark, sf):
    from factloom.operators.asof import asof_grid

    grid = F.expr("sequence(TIMESTAMP_NTZ'2024-01-03', TIMESTAMP_NTZ'2024-01-31', INTERVAL 7 DAYS)")
    return asof_grid(R.series(spark, sf), "model_id", "t", grid, "elo", ["id"], "g")


@query("o_join_13", with_roles("WITH q AS (SELECT id AS model_id, TIMESTAMP '1998-06-01' AS at FROM model) SELECT q.model_id, count(*) AS n, min(p.amount) AS lowest FROM q JOIN price p ON p.model_id = q.model_id AND p.valid_from <= q.at AND (p.valid_to IS NULL OR p.valid_to >= q.at) GROUP BY 1", "model", "price"))
def join_13(spark, sf):
    from factloom.operators.temporal import valid_at

    p = R.price(spark, sf).where(valid_at("valid_from", "valid_to", F.expr("TIMESTAMP_NTZ'1998-06-01'")))
    return joins.semi(p, R.model(spark, sf), {"model_id": "id"}).groupBy("model_id").agg(F.count("*").alias("n"), F.min("amount").alias("lowest"))


@query("o_join_14", with_roles("SELECT r.model_id, r.snapshot_id FROM result r LEFT JOIN (SELECT id FROM snapshot WHERE id % 10 <> 3) s ON s.id = r.snapshot_id WHERE s.id IS NULL", "result", "snapshot"))
def join_14(spark, sf):
    return joins.orphans(R.result(spark, sf), R.snapshot(spark, sf).where("id % 10 <> 3"), {"snapshot_id": "id"}).select("model_id", "snapshot_id")


@query("o_join_15", with_roles("SELECT model_id, snapshot_id, snapshot_id IN (SELECT id FROM snapshot WHERE source_id = '1-URGENT') AS hit FROM result WHERE snapshot_id IN (SELECT id FROM snapshot WHERE source_id = '1-URGENT') UNION ALL SELECT model_id, snapshot_id, FALSE FROM result WHERE snapshot_id NOT IN (SELECT id FROM snapshot WHERE source_id = '1-URGENT')", "result", "snapshot"))
def join_15(spark, sf):
    r, s = R.result(spark, sf).select("model_id", "snapshot_id"), R.snapshot(spark, sf).where("source_id = '1-URGENT'")
    return joins.flagged(r.where("snapshot_id IS NOT NULL"), s, {"snapshot_id": "id"}, "hit")


@query("o_join_16", with_roles("WITH m AS (SELECT id, family, nullif(developer, 'Brand#1') AS dev FROM model) SELECT a.id, count(b.id) AS peers, min(b.id) AS first_peer FROM m a LEFT JOIN m b ON a.dev IS NOT DISTINCT FROM b.dev AND a.family = b.family AND a.id <> b.id GROUP BY 1", "model"))
def join_16(spark, sf):
    return joins.peer_counts(R.model(spark, sf).select("id", "family", F.nullif("developer", F.lit("Brand#1")).alias("dev")), "id", "dev", "family")


@query("o_join_17", with_roles("WITH s AS (SELECT model_id, benchmark_id, max(score) AS score FROM result WHERE model_id IN (3, 11) GROUP BY ALL) SELECT a.benchmark_id, a.score AS left_score, b.score AS right_score FROM s a JOIN s b ON a.benchmark_id = b.benchmark_id AND a.model_id = 3 AND b.model_id = 11", "result"))
def join_17(spark, sf):
    s = R.result(spark, sf).where("model_id IN (3, 11)").groupBy("benchmark_id").agg(F.max(F.when(F.col("model_id") == 3, F.col("score"))).alias("left_score"), F.max(F.when(F.col("model_id") == 11, F.col("score"))).alias("right_score"))
    return s.where("left_score IS NOT NULL AND right_score IS NOT NULL")


# sorts


@query("o_sort_01", with_roles("SELECT benchmark_id, model_id, score FROM result ORDER BY benchmark_id, score DESC, model_id", "result"))
def sort_01(spark, sf):
    return R.result(spark, sf).select("benchmark_id", "model_id", "score").orderBy("benchmark_id", F.desc("score"), "model_id")


@query("o_sort_02", with_roles("SELECT id, coalesce(nullif(fetched_at, TIMESTAMP '1998-01-01'), TIMESTAMP '1990-01-01') AS at FROM snapshot ORDER BY 2, 1", "snapshot"))
def sort_02(spark, sf):
    at = F.coalesce(F.expr("nullif(fetched_at, TIMESTAMP_NTZ'1998-01-01')"), F.expr("TIMESTAMP_NTZ'1990-01-01'"))
    return R.snapshot(spark, sf).select("id", at.alias("at")).orderBy("at", "id")


@query("o_sort_03", with_roles("SELECT model_id, benchmark_id, score, snapshot_id, rank FROM result ORDER BY score DESC, model_id, snapshot_id, rank LIMIT 20", "result"))
def sort_03(spark, sf):
    return R.result(spark, sf).select("model_id", "benchmark_id", "score", "snapshot_id", "rank").orderBy(F.desc("score"), "model_id", "snapshot_id", "rank").limit(20)


@query("o_sort_04", with_roles("SELECT DISTINCT ON (model_id) model_id, snapshot_id, score FROM result ORDER BY model_id, snapshot_id DESC, score DESC", "result"))
def sort_04(spark, sf):
    best = F.max(F.struct("snapshot_id", "score")).alias("b")
    return R.result(spark, sf).groupBy("model_id").agg(best).select("model_id", "b.snapshot_id", "b.score")


@query("o_sort_05", with_roles("WITH r AS (SELECT kind, id, t, row_number() OVER (PARTITION BY kind ORDER BY t DESC, id DESC) AS rn, count(*) OVER (PARTITION BY kind) AS total FROM series) SELECT kind, id, t, total, total > 25 AS truncated FROM r WHERE rn <= 25", "series"))
def sort_05(spark, sf):
    return sorts.bounded_feed(R.series(spark, sf).select("kind", "id", "t"), "kind", [F.desc("t"), F.desc("id")], 25)


@query("o_sort_06", with_roles("WITH v AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE price END AS v FROM model) SELECT id, v, row_number() OVER (ORDER BY v ASC NULLS LAST, id) AS up, row_number() OVER (ORDER BY v DESC NULLS LAST, id) AS down FROM v QUALIFY up <= 50 OR down <= 50", "model"))
def sort_06(spark, sf):
    v = R.model(spark, sf).select("id", F.when(F.col("id") % 5 != 0, F.col("price")).alias("v"))
    return sorts.ends_nulls_last(v, "v", "id", 50)


@query("o_sort_07", with_roles("WITH r AS (SELECT family, id, price, row_number() OVER (PARTITION BY family ORDER BY price DESC, id) AS a, row_number() OVER (PARTITION BY family ORDER BY price, id) AS b FROM model) SELECT family, id, price, a <= 3 AS top, b <= 3 AS bottom FROM r WHERE a <= 3 OR b <= 3", "model"))
def sort_07(spark, sf):
    return sorts.outliers(R.model(spark, sf).select("family", "id", "price"), "family", "price", "id", 3)


@query("o_sort_08", with_roles("SELECT id, price, abs(price - (SELECT median(price) FROM model)) AS gap FROM model ORDER BY gap, price, id LIMIT 40", "model"))
def sort_08(spark, sf):
    return sorts.nearest_median(R.model(spark, sf).select("id", "price"), "price", "id", 40)


@query("o_sort_09", with_roles("SELECT DISTINCT family, CASE family WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END AS place FROM model ORDER BY place, family", "model"))
def sort_09(spark, sf):
    return sorts.by_priority(R.model(spark, sf).select("family").distinct(), "family", ["PROMO", "LARGE"], "place")


@query("o_sort_10", with_roles("WITH s AS (SELECT model_id, count(*) AS points, arg_max(elo, struct_pack(t := t, id := id)) AS latest FROM series GROUP BY 1 HAVING count(*) >= 8) SELECT * FROM s ORDER BY latest DESC, model_id LIMIT 12", "series"))
def sort_10(spark, sf):
    s = R.series(spark, sf).groupBy("model_id").agg(F.count("*").alias("points"), F.max_by("elo", F.struct("t", "id")).alias("latest"))
    return s.where("points >= 8").orderBy(F.desc("latest"), "model_id").limit(12)


# set operations


@query("o_set_01", with_roles("SELECT 'result' AS category, model_id, measured_at AS at FROM result UNION ALL SELECT 'price', model_id, valid_from FROM price UNION ALL SELECT 'series', model_id, t FROM series UNION ALL SELECT 'snapshot', owner_id, fetched_at FROM snapshot UNION ALL SELECT 'model', id, CAST(release_date AS TIMESTAMP) FROM model", "result", "price", "series", "snapshot", "model"))
def set_01(spark, sf):
    parts = [
        R.result(spark, sf).select(F.lit("result").alias("category"), "model_id", F.col("measured_at").alias("at")),
        R.price(spark, sf).select(F.lit("price").alias("category"), "model_id", F.col("valid_from").alias("at")),
        R.series(spark, sf).select(F.lit("series").alias("category"), "model_id", F.col("t").alias("at")),
        R.snapshot(spark, sf).select(F.lit("snapshot").alias("category"), F.col("owner_id").alias("model_id"), F.col("fetched_at").alias("at")),
        R.model(spark, sf).select(F.lit("model").alias("category"), F.col("id").alias("model_id"), F.col("release_date").cast("timestamp_ntz").alias("at")),
    ]
    return joins.union_all(parts)


@query("o_set_02", with_roles("SELECT model_id, 'cloud' AS origin, amount AS tps FROM price WHERE component = 'O' UNION ALL SELECT model_id, 'local', elo FROM series WHERE kind = 'view'", "price", "series"))
def set_02(spark, sf):
    return joins.union_all([R.price(spark, sf).where("component = 'O'").select("model_id", F.lit("cloud").alias("origin"), F.col("amount").alias("tps")), R.series(spark, sf).where("kind = 'view'").select("model_id", F.lit("local").alias("origin"), F.col("elo").alias("tps"))])


@query("o_set_03", with_roles("SELECT model_id AS id FROM result UNION SELECT model_id FROM series UNION SELECT id FROM model", "result", "series", "model"))
def set_03(spark, sf):
    return joins.union_all([R.result(spark, sf).select(F.col("model_id").alias("id")), R.series(spark, sf).select(F.col("model_id").alias("id")), R.model(spark, sf).select("id")]).distinct()


@query("o_set_04", with_roles("SELECT model_id AS id FROM result INTERSECT SELECT model_id FROM series", "result", "series"))
def set_04(spark, sf):
    return R.result(spark, sf).select(F.col("model_id").alias("id")).intersect(R.series(spark, sf).select(F.col("model_id").alias("id")))


@query("o_set_05", with_roles("SELECT r.snapshot_id, r.model_id, CASE WHEN b.snapshot_id IS NULL THEN 'error' ELSE 'warning' END AS severity FROM (SELECT DISTINCT snapshot_id, model_id FROM result WHERE score < 20000) r LEFT JOIN (SELECT DISTINCT snapshot_id, model_id FROM result WHERE score < 10000) b ON b.snapshot_id = r.snapshot_id AND b.model_id = r.model_id", "result"))
def set_05(spark, sf):
    from factloom.operators.gates import downgrade

    r = R.result(spark, sf).select("snapshot_id", "model_id", "score")
    return downgrade(r.where("score < 20000").select("snapshot_id", "model_id").distinct(), r.where("score < 10000"), ["snapshot_id", "model_id"])
