"""Analytical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import frontier, peers, picks, ranges, views
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import table

# one point an entity: its least price and its greatest score
POINT = "SELECT l_partkey AS id, min(l_quantity) AS price, max(l_extendedprice) AS score, min(l_tax) AS latency, any_value(p_type) AS family, any_value(p_brand) AS developer, any_value(p_size % 2 = 0) AS open_weights, any_value(CAST(DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE)) AS release_date FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"


def points(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("price"), F.max("l_extendedprice").alias("score"), F.min("l_tax").alias("latency"))
    m = R.model(spark, sf).select(F.col("id").alias("_id"), "family", "developer", "open_weights", "release_date")
    return li.join(m, F.col("id") == F.col("_id")).drop("_id")


def with_point(body, *roles):
    ctes = ", ".join([f"point AS ({POINT})", *[f"{r} AS ({R.SQL[r]})" for r in roles]])
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"


@query("o_view_01", with_point("SELECT id, price, score FROM (SELECT *, max(score) OVER (ORDER BY price, score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM point) WHERE m IS NULL OR score > m"))
def view_01(spark, sf):
    return frontier.pareto_sweep(points(spark, sf), "price", "score", ["id"]).select("id", "price", "score")


@query("o_view_02", with_point("SELECT id, price, score FROM point p WHERE NOT EXISTS (SELECT 1 FROM point o WHERE o.price <= p.price AND o.score >= p.score AND (o.price < p.price OR o.score > p.score))"))
def view_02(spark, sf):
    return frontier.pareto_dominance(points(spark, sf), "price", "score").select("id", "price", "score")


@query("o_view_03", with_point("SELECT 'latency' AS axis, id, latency AS x, score FROM (SELECT *, max(score) OVER (ORDER BY latency, score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM point) WHERE m IS NULL OR score > m UNION ALL SELECT 'speed', id, price, score FROM (SELECT *, max(score) OVER (ORDER BY price DESC, score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM point) WHERE m IS NULL OR score > m"))
def view_03(spark, sf):
    p = points(spark, sf)
    slow = frontier.pareto_sweep(p, "latency", "score", ["id"]).select(F.lit("latency").alias("axis"), "id", F.col("latency").alias("x"), "score")
    return slow.union(frontier.pareto_sweep(p, "price", "score", ["id"], low_cost=False).select(F.lit("speed").alias("axis"), "id", F.col("price").alias("x"), "score"))


WEEKS = "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-31', INTERVAL 7 DAY)) AS TIMESTAMP) AS g"
WEEK_GRID = "sequence(TIMESTAMP_NTZ'2024-01-03', TIMESTAMP_NTZ'2024-01-31', INTERVAL 7 DAYS)"
ASOF = f"grid AS ({WEEKS}), at AS (SELECT model_id, g, arg_max(elo, struct_pack(t := t, id := id)) AS elo FROM series JOIN grid ON t <= g GROUP BY ALL)"


@query("o_view_04", with_roles(f"WITH {ASOF} SELECT g, max(elo) AS top, median(elo) AS middle, count(*) AS n, list(elo ORDER BY elo DESC)[CAST(floor(0.75 * count(*)) AS BIGINT) + 1] AS quarter FROM at GROUP BY 1", "series").replace("at AS (", "asof_ AS (").replace("FROM at", "FROM asof_"))
def view_04(spark, sf):
    return views.envelope(R.series(spark, sf), "model_id", "t", "elo", ["id"], F.expr(WEEK_GRID))


@query("o_view_05", with_roles(f"WITH {ASOF} SELECT * FROM (SELECT g, model_id, elo, row_number() OVER (PARTITION BY g ORDER BY elo DESC, model_id) AS place FROM at WHERE g IN (SELECT g FROM at GROUP BY g HAVING count(*) >= 8)) WHERE place <= 20", "series").replace("at AS (", "asof_ AS (").replace("FROM at", "FROM asof_"))
def view_05(spark, sf):
    return views.race_frames(R.series(spark, sf), "model_id", "t", "elo", ["id"], F.expr(WEEK_GRID), 20, 8).select("g", "model_id", "elo", "place")


@query("o_view_05_dataset", with_roles("SELECT kind, frames, row_number() OVER (ORDER BY frames DESC, list_position(['view', 'click', 'purchase', 'error'], kind)) = 1 AS chosen FROM (SELECT kind, count(DISTINCT year(t) || '-' || (dayofyear(t) - 1) // 7) AS frames FROM series WHERE kind IN ('view', 'click', 'purchase', 'error') AND model_id % 5 < 3 GROUP BY 1)", "series"))
def view_05_dataset(spark, sf):
    return views.most_frames(R.series(spark, sf).where("model_id % 5 < 3"), "kind", "t", ["view", "click", "purchase", "error"])


def trend_sql(prices: str) -> str:
    return with_roles(f"""WITH s AS (SELECT model_id, measured_at AS t, CAST(score AS DOUBLE) AS v, snapshot_id * 10 + rank AS id FROM result), lim AS (SELECT date_trunc('month', min(t)) AS lo, date_trunc('month', max(t)) AS hi FROM s),
 months AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month FROM lim), ends AS (SELECT month, month + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS e FROM months),
 standing_ AS (SELECT model_id, month, e, arg_max(v, struct_pack(t := t, i := id)) AS v FROM s JOIN ends ON t <= e GROUP BY ALL),
 good AS (SELECT model_id, month, e, x AS threshold FROM standing_, (VALUES (80000.0::DOUBLE), (95000.0::DOUBLE)) q(x) WHERE v >= x),
 pr AS ({prices}), cnt AS (SELECT g.threshold, g.month, g.model_id, amount, count(*) AS n FROM good g JOIN pr ON pr.model_id = g.model_id AND amount > 0 AND valid_from <= e AND (valid_to IS NULL OR valid_to >= e) GROUP BY ALL),
 w AS (SELECT threshold, month, model_id, arg_min(amount, struct_pack(n := -n, a := amount)) AS price FROM cnt GROUP BY ALL),
 pts AS (SELECT threshold, month, arg_min(model_id, struct_pack(p := price, m := model_id)) AS model_id, min(price) AS price, FALSE AS current FROM w GROUP BY 1, 2
  UNION ALL SELECT threshold, month, arg_min(model_id, struct_pack(p := m.price, m := model_id)), min(m.price), TRUE FROM good JOIN model m ON m.id = model_id WHERE m.price > 0 GROUP BY 1, 2),
 use_ AS (SELECT count(*) FILTER (WHERE current) > 0 AND count(*) FILTER (WHERE NOT current) < 0.6 * count(*) FILTER (WHERE current) AS u FROM pts)
 SELECT threshold, month, model_id, CAST(price AS DOUBLE) AS price, current FROM pts, use_ WHERE current = u""", "result", "price", "model")


def trend(spark, sf, prices):
    series = R.result(spark, sf).select("model_id", F.col("measured_at").alias("t"), F.col("score").cast("double").alias("value"), (F.col("snapshot_id") * 10 + F.col("rank")).alias("id"))
    current = R.model(spark, sf).select(F.col("id").alias("model_id"), F.col("price").cast("double").alias("price"))
    return views.price_trend(series, prices.select("model_id", F.col("amount").cast("double").alias("amount"), "valid_from", "valid_to"), current, [80000.0, 95000.0])


@query("o_view_06", trend_sql("SELECT * FROM price WHERE component = 'F'"))
def view_06(spark, sf):
    return trend(spark, sf, R.price(spark, sf).where("component = 'F'"))


@query("o_view_06_current", trend_sql("SELECT * FROM price WHERE snapshot_id % 500 = 1 AND valid_to IS NOT NULL"))
def view_06_current(spark, sf):
    """Few prices have windows, so current prices take their place."""
    return trend(spark, sf, R.price(spark, sf).where("snapshot_id % 500 = 1 AND valid_to IS NOT NULL"))


@query("o_view_07", with_point("SELECT family, max(score) FILTER (WHERE open_weights) AS best_open, max(score) FILTER (WHERE NOT coalesce(open_weights, FALSE)) AS best_closed, round(max(score) FILTER (WHERE NOT coalesce(open_weights, FALSE)) - max(score) FILTER (WHERE open_weights), 4) AS gap FROM point GROUP BY 1"))
def view_07(spark, sf):
    opened = F.coalesce("open_weights", F.lit(False))
    g = points(spark, sf).groupBy("family").agg(F.max(F.when(opened, F.col("score"))).alias("best_open"), F.max(F.when(~opened, F.col("score"))).alias("best_closed"))
    return g.withColumn("gap", F.round(F.col("best_closed") - F.col("best_open"), 4))


@query("o_view_08", with_roles("SELECT id, release_date, context, round(date_diff('day', release_date, DATE '2026-01-01') / 30.44, 3) AS age FROM model WHERE context >= 25 AND release_date >= DATE '2021-01-01'", "model"))
def view_08(spark, sf):
    return R.model(spark, sf).where("context >= 25 AND release_date >= DATE'2021-01-01'").select("id", "release_date", "context", F.round(F.datediff(F.lit("2026-01-01").cast("date"), "release_date") / 30.44, 3).alias("age"))


@query("o_view_09", with_point("SELECT id, price, score, round(price / score * 1000, 9) AS per_point FROM point WHERE score > 0"))
def view_09(spark, sf):
    return points(spark, sf).where("score > 0").select("id", "price", "score", F.round(F.col("price") / F.col("score") * 1000, 9).alias("per_point"))


@query("o_view_10", with_roles("SELECT benchmark_id, model_id, score FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY score DESC, model_id) AS place FROM (SELECT benchmark_id, model_id, arg_max(score, struct_pack(a := measured_at, b := snapshot_id, c := rank, d := score)) AS score FROM result GROUP BY ALL)) WHERE place <= 40", "result"))
def view_10(spark, sf):
    last = R.result(spark, sf).groupBy("benchmark_id", "model_id").agg(F.max_by("score", F.struct("measured_at", "snapshot_id", "rank", "score")).alias("score"))
    return picks.latest_pick(last, ["benchmark_id"], [F.desc("score"), F.asc("model_id")], 40)


ALTERNATIVES = """WITH t AS (SELECT * FROM point WHERE id = 7),
a AS (SELECT 0 AS i, 'cheaper' AS label, p.id FROM point p, t WHERE p.id <> t.id AND p.price < t.price AND abs(p.score - t.score) <= 3000 ORDER BY abs(p.score - t.score), p.price, p.id LIMIT 1),
b AS (SELECT 1, 'open', p.id FROM point p, t WHERE p.id <> t.id AND p.open_weights AND (NOT t.open_weights OR p.score > t.score) ORDER BY p.score DESC, p.id LIMIT 1),
c AS (SELECT 2, 'sibling', p.id FROM point p, t WHERE p.id <> t.id AND p.family = t.family AND p.release_date <> t.release_date ORDER BY abs(date_diff('day', t.release_date, p.release_date)), p.id LIMIT 1),
d AS (SELECT 3, 'higher', p.id FROM point p, t WHERE p.id <> t.id AND p.score > t.score ORDER BY p.score, p.id LIMIT 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
SELECT arg_min(label, i) AS label, id FROM u GROUP BY id"""


@query("o_view_11", with_point(ALTERNATIVES))
def view_11(spark, sf):
    p = points(spark, sf)
    t = p.where("id = 7").select(*[F.col(c).alias(f"t_{c}") for c in p.columns])
    gap, days = F.abs(F.col("score") - F.col("t_score")), F.abs(F.datediff("release_date", "t_release_date"))
    other = F.col("id") != F.col("t_id")
    parts = [
        views.nearest(p, t, other & (F.col("price") < F.col("t_price")) & (gap <= 3000), [gap, F.asc("price"), F.asc("id")], "cheaper"),
        views.nearest(p, t, other & F.col("open_weights") & (~F.col("t_open_weights") | (F.col("score") > F.col("t_score"))), [F.desc("score"), F.asc("id")], "open"),
        views.nearest(p, t, other & (F.col("family") == F.col("t_family")) & (F.col("release_date") != F.col("t_release_date")), [days, F.asc("id")], "sibling"),
        views.nearest(p, t, other & (F.col("score") > F.col("t_score")), [F.asc("score"), F.asc("id")], "higher"),
    ]
    return views.first_per_id(parts)


@query("o_view_12", with_roles("SELECT model_id, benchmark_id, round(least(100.0, greatest(0.0, v)), 4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY v DESC, benchmark_id) AS rn FROM (SELECT model_id, benchmark_id, max(score) / 800 AS v FROM result GROUP BY ALL)) WHERE rn <= 2", "result"))
def view_12(spark, sf):
    v = R.result(spark, sf).groupBy("model_id", "benchmark_id").agg((F.max("score") / 800).alias("v"))
    return picks.latest_pick(v, ["model_id"], [F.desc("v"), F.asc("benchmark_id")], 2).withColumn("v", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "v")), 4))


PAIRS = """WITH s AS (SELECT id, developer, family, open_weights, row_number() OVER (ORDER BY score DESC, id) AS n FROM point WHERE score IS NOT NULL),
d AS (SELECT n, id, developer, row_number() OVER (PARTITION BY developer ORDER BY n) AS k FROM s WHERE developer IS NOT NULL),
f AS (SELECT n, id, family, row_number() OVER (PARTITION BY family ORDER BY n) AS k FROM s WHERE family IS NOT NULL),
lab AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.developer = b.developer AND a.k = 1 AND b.k = 2 ORDER BY a.n LIMIT 1),
kin AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.family = b.family AND a.k = 1 AND b.k = 2 ORDER BY a.n LIMIT 1),
cross_ AS (SELECT (SELECT arg_min(id, n) FROM d) AS a, (SELECT arg_min(id, n) FROM d WHERE developer <> (SELECT arg_min(developer, n) FROM d)) AS b),
p AS (SELECT 0 AS ord, 'Top Arena leaders' AS label, (SELECT id FROM s WHERE n = 1) AS a, (SELECT id FROM s WHERE n = 2) AS b UNION ALL SELECT 1, 'Best cross-lab matchup', a, b FROM cross_
UNION ALL SELECT 2, 'Open vs closed', (SELECT arg_min(id, n) FROM s WHERE open_weights), (SELECT arg_min(id, n) FROM s WHERE NOT open_weights)
UNION ALL SELECT 3, 'Same-lab faceoff', a, b FROM lab UNION ALL SELECT 4, 'Family matchup', a, b FROM kin
UNION ALL SELECT 4 + x.n, 'Popular matchup', x.id, y.id FROM s x JOIN s y ON y.n = x.n + 1),
q AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord) AS rn FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)
SELECT label, a, b FROM q WHERE rn = 1 ORDER BY ord LIMIT 6"""


@query("o_view_13", with_point(PAIRS))
def view_13(spark, sf):
    return views.suggested_pairs(points(spark, sf), "id", "score", "developer", "family", "open_weights", 6)


@query("o_view_14", with_point("WITH p AS (SELECT a.*, b.id AS id2, b.price AS price2, b.score AS score2 FROM point a JOIN point b ON b.id = a.id + 1) SELECT id, CASE WHEN price = price2 THEN 'tie' WHEN price < price2 THEN 'left' ELSE 'right' END AS cheaper, CASE WHEN score = score2 THEN 'tie' WHEN score > score2 THEN 'left' ELSE 'right' END AS stronger FROM p"))
def view_14(spark, sf):
    a = points(spark, sf).select("id", "price", "score")
    b = a.select((F.col("id") - 1).alias("_id"), F.col("price").alias("price2"), F.col("score").alias("score2"))
    j = a.join(b, F.col("id") == F.col("_id"))
    return j.select("id", views.winner(F.col("price"), F.col("price2"), False).alias("cheaper"), views.winner(F.col("score"), F.col("score2"), True).alias("stronger"))


@query("o_view_15", with_roles("WITH s AS (SELECT model_id, benchmark_id, max(score) AS score FROM result GROUP BY ALL) SELECT a.benchmark_id, a.model_id, round(a.score + b.score, 2) AS total FROM s a JOIN s b ON a.benchmark_id = b.benchmark_id AND b.model_id = a.model_id + 1", "result"))
def view_15(spark, sf):
    s = R.result(spark, sf).groupBy("model_id", "benchmark_id").agg(F.max("score").alias("score"))
    b = s.select((F.col("model_id") - 1).alias("model_id"), "benchmark_id", F.col("score").alias("score2"))
    return s.join(b, ["model_id", "benchmark_id"]).select("benchmark_id", "model_id", F.round(F.col("score") + F.col("score2"), 2).alias("total"))


@query("o_view_16", with_roles("WITH seen AS (SELECT model_id AS id, least(CAST(max(measured_at) + INTERVAL 8000 DAY AS DATE), DATE '2023-06-01') AS last_seen FROM result WHERE model_id % 3 <> 0 GROUP BY 1), r AS (SELECT m.id, release_date, CASE id % 4 WHEN 0 THEN 'retired' WHEN 1 THEN 'stable' ELSE NULL END AS stability FROM model m WHERE release_date <= DATE '2023-06-01'), x AS (SELECT r.*, s.last_seen, coalesce(stability = 'retired', FALSE) AS retired, NOT coalesce(stability = 'retired', FALSE) AND (coalesce(stability = 'stable', FALSE) OR release_date >= DATE '2023-06-01' - 90) AS active FROM r LEFT JOIN seen s USING (id)) SELECT id, retired, active, CASE WHEN active THEN DATE '2023-06-01' ELSE coalesce(last_seen, release_date) END AS display_end FROM x", "model", "result"))
def view_16(spark, sf):
    m = R.model(spark, sf).select("id", "release_date", F.when(F.col("id") % 4 == 0, "retired").when(F.col("id") % 4 == 1, "stable").alias("stability"))
    seen = R.result(spark, sf).where("model_id % 3 <> 0").groupBy(F.col("model_id").alias("id")).agg(F.date_add(F.to_date(F.max("measured_at")), 8000).alias("last_seen"))
    return views.timeline(m, seen, F.lit("2023-06-01").cast("date")).select("id", "retired", "active", "display_end")


@query("o_view_17", with_roles("SELECT a.id, count(*) FILTER (WHERE b.release_date < a.release_date) AS predecessors, count(*) FILTER (WHERE b.release_date > a.release_date) AS successors, count(*) FILTER (WHERE b.release_date = a.release_date AND a.id <> b.id) AS undated, arg_max(b.id, struct_pack(d := b.release_date, i := -b.id)) FILTER (WHERE b.release_date < a.release_date) AS predecessor, arg_min(b.id, struct_pack(d := b.release_date, i := b.id)) FILTER (WHERE b.release_date > a.release_date) AS successor FROM model a JOIN model b ON a.developer = b.developer AND a.family = b.family GROUP BY 1", "model"))
def view_17(spark, sf):
    return views.relatives(R.model(spark, sf), ["developer", "family"], "id", "release_date")


@query("o_view_18", with_roles("WITH u AS (SELECT model_id, 'cloud' AS origin, max(amount) AS tps FROM price GROUP BY 1 UNION ALL SELECT model_id, 'local', max(elo) FROM series WHERE kind = 'view' GROUP BY 1), m AS (SELECT median(tps) AS m FROM u) SELECT model_id, origin, tps, abs(tps - m) AS gap FROM u, m WHERE tps > 0 ORDER BY gap, tps, model_id, origin LIMIT 40", "price", "series"))
def view_18(spark, sf):
    u = R.price(spark, sf).groupBy("model_id").agg(F.max("amount").alias("tps")).select("model_id", F.lit("cloud").alias("origin"), "tps")
    u = u.union(R.series(spark, sf).where("kind = 'view'").groupBy("model_id").agg(F.max("elo").alias("tps")).select("model_id", F.lit("local").alias("origin"), "tps"))
    middle = ranges.median(u, [], "tps", "_m")
    return u.where("tps > 0").join(F.broadcast(middle)).withColumn("gap", F.abs(F.col("tps") - F.col("_m"))).drop("_m").orderBy("gap", "tps", "model_id", "origin").limit(40)


@query("o_view_19", with_point("SELECT developer = 'Brand#3' AS own, id, price, score FROM point WHERE developer = 'Brand#3' OR score > 90000"))
def view_19(spark, sf):
    return points(spark, sf).where("developer = 'Brand#3' OR score > 90000").select((F.col("developer") == "Brand#3").alias("own"), "id", "price", "score")


@query("o_view_20", with_point("SELECT place, p.id, price, score, round(0.9 * latency + 0.1 * price, 6) AS effective FROM point p JOIN (VALUES (0, 9), (1, 3), (2, 12)) c(place, id) ON c.id = p.id"))
def view_20(spark, sf):
    c = views.cohort(points(spark, sf), "id", [9, 3, 12])
    return c.select("place", "id", "price", "score", F.round(0.9 * F.col("latency") + 0.1 * F.col("price"), 6).alias("effective"))


LABEL = "'$' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN v < 0.01 THEN {t4} WHEN v < 1 THEN CASE WHEN v * 100 = floor(v * 100) THEN printf('%.2f', v) ELSE {t3} END ELSE {t3} END"
LABEL = LABEL.format(**{f"t{n}": f"regexp_replace(regexp_replace(printf('%.{n}f', v), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')" for n in (3, 4)})
STEPS = "CASE id % 3 WHEN 0 THEN floor(price) WHEN 1 THEN floor(price) / 1000 ELSE floor(price / 10) / 10000 END"


def peer_rows(spark, sf):
    """All models as peers, with prices of dollars, cents and less."""
    whole, i = F.floor("price").cast("double"), F.col("id")
    step = F.when(i % 3 == 0, whole).when(i % 3 == 1, whole / 1000).otherwise(F.floor(F.col("price") / 10) / 10000)
    return R.model(spark, sf).select("id", F.concat("developer", F.lit("/m"), "id").alias("slug"), step.alias("input"), (2 * step).alias("output"), (step / 10).alias("cache_read"), "release_date", "context")


@query("o_view_20_ladder", with_roles(f"SELECT developer || '/m' || id AS slug, v AS input, 2 * v AS output, {LABEL} AS input_label, (SELECT {LABEL} FROM (SELECT 2 * x.v AS v)) AS output_label FROM (SELECT *, {STEPS} AS v FROM model) x", "model"))
def view_20_ladder(spark, sf):
    return peers.price_ladder(peer_rows(spark, sf))


@query("o_view_20_cache", with_roles(f"SELECT developer || '/m' || id AS slug, v AS input, v / 10 AS cache_read, 0.9::DOUBLE * (v / 10) + 0.1::DOUBLE * v AS effective, round(1 - (0.9::DOUBLE * (v / 10) + 0.1::DOUBLE * v) / v, 9) AS discount, '-81%' AS label, round(sqrt((0.9::DOUBLE * (v / 10) + 0.1::DOUBLE * v) * v), 9) AS label_x FROM (SELECT *, {STEPS} AS v FROM model)", "model"))
def view_20_cache(spark, sf):
    return peers.cache_economics(peer_rows(spark, sf)).withColumns({c: F.round(c, 9) for c in ("discount", "label_x")})


@query("o_view_20_spec", with_roles("SELECT developer || '/m' || id AS slug, id, w AS context_window, o AS max_output, CASE WHEN id % 2 = 0 THEN context || 'K' ELSE regexp_replace(regexp_replace(printf('%.2f', context / 10), '\\.00$', ''), '(\\.\\d)0$', '\\1') || 'M' END AS context_window_label, context || 'K' AS max_output_label FROM (SELECT *, CASE WHEN id % 2 = 0 THEN context * 1000 ELSE context * 100000 + 900000 - 900000 END::BIGINT AS w, (context * 1024)::BIGINT AS o FROM model WHERE context >= 10)", "model"))
def view_20_spec(spark, sf):
    """Windows in thousands and millions; each is given twice, the greater counts."""
    p = peer_rows(spark, sf).where("context >= 10")
    window = F.when(F.col("id") % 2 == 0, F.col("context") * 1000).otherwise(F.col("context") * 100000).cast("long")
    caps = p.select(F.col("id").alias("model_id"), F.explode(F.create_map(F.lit("context_window"), F.concat(window.cast("string"), F.lit(" tokens")), F.lit("max_output"), (F.col("context") * 1024).cast("string"), F.lit("other"), F.lit("x"))).alias("capability", "value"))
    return peers.spec_card(p.select("slug", "id"), caps.union(caps.withColumn("value", F.lit("7"))), ["context_window", "max_output"])


@query("o_view_20_freshness", with_roles("SELECT developer || '/m' || id AS slug, release_date - context * 20 AS cutoff, release_date AS release, round(context * 20 / 30.44, 3) AS gap_months FROM model WHERE id % 4 <> 0", "model"))
def view_20_freshness(spark, sf):
    p = peer_rows(spark, sf)
    return peers.freshness(p.select("slug", F.when(F.col("id") % 4 != 0, F.date_sub("release_date", (F.col("context") * 20).cast("int"))).alias("cutoff"), F.col("release_date").alias("release")))


@query("o_view_20_lineage", with_roles("SELECT 'm' || model_id AS slug, min(measured_at) AS first, list(struct_pack(date := measured_at, score := CAST(score AS DOUBLE)) ORDER BY measured_at, score) AS points FROM result WHERE benchmark_id = 'A' GROUP BY 1", "result"))
def view_20_lineage(spark, sf):
    r = R.result(spark, sf).where("benchmark_id = 'A'")
    return peers.lineage(r.select(F.concat(F.lit("m"), "model_id").alias("slug"), F.col("measured_at").alias("date"), F.col("score").cast("double").alias("score")))


@query("o_view_21", with_point("SELECT family, id, round(max(score - i * 250) OVER (PARTITION BY family ORDER BY score, id ROWS UNBOUNDED PRECEDING) + i * 250, 4) AS placed FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score, id) - 1 AS i FROM point)"))
def view_21(spark, sf):
    d = views.declutter(points(spark, sf).select("family", "id", "score"), "family", "score", 250.0, ["id"])
    return d.select("family", "id", F.round("placed", 4).alias("placed"))


@query("o_view_22", with_point("UNPIVOT (SELECT id, CAST(price AS DOUBLE) AS price, CAST(score AS DOUBLE) AS score, CAST(latency AS DOUBLE) AS latency FROM point) ON price, score, latency INTO NAME label VALUE value"))
def view_22(spark, sf):
    return points(spark, sf).select("id", "price", "score", "latency").unpivot("id", ["price", "score", "latency"], "label", "value")


