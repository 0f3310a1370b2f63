"""Window queries over the roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import asof, changes, frontier, joins, picks, temporal
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles


@query("o_win_02", with_roles("SELECT * EXCLUDE (rn) FROM (SELECT r.*, row_number() OVER (PARTITION BY model_id, benchmark_id ORDER BY measured_at DESC NULLS LAST, snapshot_id DESC, rank DESC, score DESC, surface_id DESC) AS rn FROM result r WHERE snapshot_id IN (SELECT id FROM snapshot WHERE source_id = '1-URGENT')) WHERE rn = 1", "result", "snapshot"))
def win_02(spark, sf):
    order = [F.desc_nulls_last("measured_at"), F.desc("snapshot_id"), F.desc("rank"), F.desc("score"), F.desc("surface_id")]
    own = R.snapshot(spark, sf).where("source_id = '1-URGENT'")
    return picks.latest_pick(joins.semi(R.result(spark, sf), own, {"snapshot_id": "id"}), ["model_id", "benchmark_id"], order)


@query("o_win_03", with_roles("SELECT model_id, benchmark_id, score FROM (SELECT r.*, row_number() OVER (PARTITION BY model_id ORDER BY CASE benchmark_id WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, ci DESC, measured_at DESC NULLS LAST, snapshot_id DESC, score DESC) AS rn FROM result r) WHERE rn = 1", "result"))
def win_03(spark, sf):
    source = F.when(F.col("benchmark_id") == "N", 0).when(F.col("benchmark_id") == "A", 1).otherwise(2)
    order = [source, F.desc("ci"), F.desc_nulls_last("measured_at"), F.desc("snapshot_id"), F.desc("score")]
    return picks.latest_pick(R.result(spark, sf), ["model_id"], order).select("model_id", "benchmark_id", "score")


@query("o_win_04", with_roles("SELECT benchmark_id, open_weights, model_id, score FROM (SELECT r.benchmark_id, m.open_weights, r.model_id, r.score, row_number() OVER (PARTITION BY r.benchmark_id, m.open_weights ORDER BY r.score DESC, r.model_id) AS rn FROM result r JOIN model m ON m.id = r.model_id) WHERE rn = 1", "result", "model"))
def win_04(spark, sf):
    best = R.result(spark, sf).groupBy("benchmark_id", "model_id").agg(F.max("score").alias("score"))
    j = best.join(R.model(spark, sf).select(F.col("id").alias("model_id"), "open_weights"), "model_id")
    return picks.latest_pick(j, ["benchmark_id", "open_weights"], [F.desc("score"), F.asc("model_id")])


@query("o_win_05", with_roles("SELECT * EXCLUDE (rn) FROM (SELECT id, owner_id, nullif(source_id, '5-LOW') AS s, row_number() OVER (PARTITION BY owner_id, nullif(source_id, '5-LOW') ORDER BY id) AS rn FROM snapshot) WHERE rn = 1", "snapshot"))
def win_05(spark, sf):
    rows = R.snapshot(spark, sf).select("id", "owner_id", F.nullif("source_id", F.lit("5-LOW")).alias("s"))
    return picks.keep_first(rows, ["owner_id", "s"], [F.asc("id")])


@query("o_win_06", with_roles("SELECT model_id, id, t, before, elo FROM (SELECT s.*, lag(elo) OVER w AS before, row_number() OVER w AS n FROM series s WINDOW w AS (PARTITION BY model_id ORDER BY t, id)) WHERE n > 1 AND before IS DISTINCT FROM elo", "series"))
def win_06(spark, sf):
    return changes.changes(R.series(spark, sf), ["model_id"], ["t", "id"], "elo").select("model_id", "id", "t", "before", "elo")


CAP = "SELECT model_id, surface_id, component, snapshot_id, line, valid_from, CASE WHEN nx IS NOT NULL AND (valid_to IS NULL OR valid_to > nx) THEN nx ELSE valid_to END AS valid_to, coalesce(nx IS NOT NULL AND (valid_to IS NULL OR valid_to > nx), FALSE) AS capped FROM (SELECT p.*, lead(valid_from) OVER (PARTITION BY model_id, surface_id, component ORDER BY valid_from NULLS FIRST, snapshot_id, line, total, amount) AS nx FROM price p)"


@query("o_win_07", with_roles(CAP, "price"))
def win_07(spark, sf):
    capped = temporal.cap_windows(R.price(spark, sf), ["model_id", "surface_id", "component"], "valid_from", "valid_to", ["snapshot_id", "line", "total", "amount"])
    return capped.select("model_id", "surface_id", "component", "snapshot_id", "line", "valid_from", "valid_to", "capped")


@query("o_win_08", with_roles("WITH d AS (SELECT DISTINCT model_id, component, valid_from FROM price), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY model_id, component ORDER BY valid_from) AS next_seen FROM d) SELECT p.model_id, p.component, p.amount, p.valid_from, n.next_seen FROM price p JOIN n USING (model_id, component, valid_from)", "price"))
def win_08(spark, sf):
    return temporal.bound_by_next(R.price(spark, sf), ["model_id", "component"], "valid_from", "next_seen").select("model_id", "component", "amount", "valid_from", "next_seen")


ISLANDS = """WITH o AS (SELECT model_id, component, valid_from, valid_to, row_number() OVER w AS rn,
 max(valid_to) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
 bool_or(valid_to IS NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before
 FROM price WINDOW w AS (PARTITION BY model_id, component ORDER BY valid_from NULLS FIRST, snapshot_id, line, total, amount)),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR NOT (coalesce(open_before, FALSE) OR coalesce(valid_from < reach, TRUE)) THEN 1 ELSE 0 END) OVER (PARTITION BY model_id, component ORDER BY rn) AS island FROM o)
SELECT model_id, component, min(valid_from) AS valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to, count(*) AS n FROM i GROUP BY model_id, component, island"""


@query("o_win_09", with_roles(ISLANDS, "price"))
def win_09(spark, sf):
    return temporal.coalesce_islands(R.price(spark, sf), ["model_id", "component"], "valid_from", "valid_to", ["snapshot_id", "line", "total", "amount"])


@query("o_win_10", with_roles("SELECT DISTINCT ON (kind, model_id) kind, model_id, id, elo FROM series ORDER BY kind, model_id, t DESC, elo DESC, id", "series"))
def win_10(spark, sf):
    return picks.keep_first(R.series(spark, sf), ["kind", "model_id"], [F.desc("t"), F.desc("elo"), F.asc("id")]).select("kind", "model_id", "id", "elo")


@query("o_win_11", with_roles("SELECT DISTINCT ON (model_id, day) model_id, day, id, elo FROM (SELECT *, CAST(t AS DATE) AS day FROM series) ORDER BY model_id, day, t DESC, id DESC", "series"))
def win_11(spark, sf):
    return changes.last_of_day(R.series(spark, sf), ["model_id"], "t", ["t", "id"]).select("model_id", "day", "id", "elo")


@query("o_win_12", with_roles("SELECT model_id, measured_at AS day, arg_max(score, struct_pack(s := coalesce(CASE WHEN rank % 2 = 0 THEN snapshot_id END, -1), v := score)) AS score FROM result GROUP BY ALL", "result"))
def win_12(spark, sf):
    key = F.coalesce(F.when(F.col("rank") % 2 == 0, F.col("snapshot_id")), F.lit(-1))
    return R.result(spark, sf).groupBy("model_id", F.col("measured_at").alias("day")).agg(F.max_by("score", F.struct(key, "score")).alias("score"))


@query("o_win_13", with_roles("SELECT kind, id, t, elo FROM (SELECT *, max(elo) OVER (PARTITION BY kind ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM series) WHERE m IS NULL OR elo > m", "series"))
def win_13(spark, sf):
    return frontier.records(R.series(spark, sf), "kind", "t", "elo", ["id"]).select("kind", "id", "t", "elo")


DAYS = "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS TIMESTAMP) AS g"


@query("o_win_14", with_roles(f"WITH d AS ({DAYS}), k AS (SELECT DISTINCT kind FROM series), x AS (SELECT kind, t, elo, id FROM series) SELECT k.kind, d.g, (SELECT arg_max(elo, struct_pack(t := t, id := id)) FROM x WHERE x.kind = k.kind AND x.t <= d.g) AS elo FROM k CROSS JOIN d WHERE EXISTS (SELECT 1 FROM x WHERE x.kind = k.kind AND x.t <= d.g)", "series"))
def win_14(spark, sf):
    grid = F.expr("sequence(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-30', INTERVAL 1 DAY)")
    return asof.asof_grid(R.series(spark, sf), "kind", "t", grid, "elo", ["id"], "g", few_keys=True)


@query("o_win_15", with_roles("WITH e AS (SELECT model_id, max(t) AS e FROM series GROUP BY 1), j AS (SELECT s.*, e.e FROM series s JOIN e USING (model_id)) SELECT model_id, arg_max(elo, struct_pack(t := t, id := id)) AS latest, arg_max(elo, struct_pack(t := t, id := id)) FILTER (WHERE t <= e - INTERVAL 7 DAY) AS before, arg_max(elo, struct_pack(t := t, id := id)) - arg_max(elo, struct_pack(t := t, id := id)) FILTER (WHERE t <= e - INTERVAL 7 DAY) AS delta FROM j GROUP BY 1", "series"))
def win_15(spark, sf):
    return asof.delta_over(R.series(spark, sf), "model_id", "t", "elo", 7, ["id"])


# temporal repair


@query("o_tmp_01", with_roles(ISLANDS.replace("model_id, component", "model_id, surface_id, component, amount"), "price"))
def tmp_01(spark, sf):
    return temporal.coalesce_islands(R.price(spark, sf), ["model_id", "surface_id", "component", "amount"], "valid_from", "valid_to", ["snapshot_id", "line", "total"])


ANY_WAY = """WITH RECURSIVE p AS (SELECT model_id AS k, source_id AS c, valid_from AS s, CASE WHEN line % 4 = 1 THEN valid_from - to_days(CAST(amount AS INTEGER)) ELSE valid_to END AS e, snapshot_id AS id, line FROM price),
 r AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY s, id, line) AS rn FROM p),
 f AS (SELECT k, c, rn, s AS fs, e AS fe, id AS first_id, line AS first_line FROM r WHERE rn = 1
  UNION ALL SELECT r.k, r.c, r.rn, CASE WHEN j THEN fs ELSE r.s END, CASE WHEN NOT j THEN r.e WHEN fe IS NULL OR r.e IS NULL THEN NULL ELSE greatest(fe, r.e) END, CASE WHEN j THEN first_id ELSE r.id END, CASE WHEN j THEN first_line ELSE r.line END
  FROM (SELECT f.fs, f.fe, f.first_id, f.first_line, r.*, (f.fe IS NULL OR f.fe > r.s) AND (r.e IS NULL OR r.e > f.fs) AS j FROM f JOIN r ON r.k = f.k AND r.c = f.c AND r.rn = f.rn + 1) r)
 SELECT k AS model_id, c AS source_id, first_id, first_line, fs AS valid_from, last(fe ORDER BY rn) AS valid_to, count(*) AS n FROM f GROUP BY k, c, first_id, first_line, fs"""


@query("o_tmp_01_any", with_roles(ANY_WAY.replace("WITH RECURSIVE", "WITH"), "price").replace("WITH ", "WITH RECURSIVE ", 1))
def tmp_01_any(spark, sf):
    """Facts of one model and source whose windows meet; every line after the first of four ends before it begins."""
    back = F.expr("valid_from - make_dt_interval(CAST(amount AS INT))")
    p = R.price(spark, sf).withColumn("valid_to", F.when(F.col("line") % 4 == 1, back).otherwise(F.col("valid_to")))
    p = p.select("model_id", "source_id", "valid_from", "valid_to", F.col("snapshot_id").alias("first_id"), F.col("line").alias("first_line"))
    return temporal.fold_islands(p, ["model_id", "source_id"], "valid_from", "valid_to", ["first_id", "first_line"], first=["first_id", "first_line"])


@query("o_tmp_02", with_roles("WITH g AS (SELECT model_id, surface_id, component FROM price GROUP BY ALL HAVING count(DISTINCT valid_from) >= 2), d AS (SELECT DISTINCT model_id, surface_id, component, valid_from FROM price JOIN g USING (model_id, surface_id, component)), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY model_id, surface_id, component ORDER BY valid_from) AS nx FROM d) SELECT p.model_id, p.surface_id, p.component, p.snapshot_id, p.line, p.valid_from, n.nx AS valid_to FROM price p JOIN n USING (model_id, surface_id, component, valid_from) WHERE n.nx IS NOT NULL", "price"))
def tmp_02(spark, sf):
    keys = ["model_id", "surface_id", "component"]
    bounded = temporal.bound_by_next(R.price(spark, sf), keys, "valid_from", "nx").where("nx IS NOT NULL")
    return bounded.select(*keys, "snapshot_id", "line", "valid_from", F.col("nx").alias("valid_to"))


@query("o_tmp_03", with_roles(f"SELECT model_id, component, count(*) AS rows_, count(*) FILTER (WHERE capped) AS capped FROM ({CAP}) GROUP BY ALL", "price"))
def tmp_03(spark, sf):
    capped = temporal.cap_windows(R.price(spark, sf), ["model_id", "surface_id", "component"], "valid_from", "valid_to", ["snapshot_id", "line", "total", "amount"])
    return capped.groupBy("model_id", "component").agg(F.count("*").alias("rows_"), F.count_if("capped").alias("capped"))


@query("o_tmp_04", with_roles("SELECT model_id, snapshot_id, line, coalesce(valid_from < TIMESTAMP '1999-01-01', TRUE) AND coalesce(TIMESTAMP '1998-01-01' < valid_to, TRUE) AS meets FROM price", "price"))
def tmp_04(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d}'")
    return R.price(spark, sf).select("model_id", "snapshot_id", "line", temporal.overlaps(F.col("valid_from"), F.col("valid_to"), at("1998-01-01"), at("1999-01-01")).alias("meets"))


@query("o_tmp_05", with_roles("SELECT model_id, benchmark_id, rank, ci, min(snapshot_id) AS snapshot_id, count(*) AS n FROM result GROUP BY model_id, benchmark_id, rank, ci", "result"))
def tmp_05(spark, sf):
    return picks.first_and_count(R.result(spark, sf), ["model_id", "benchmark_id", "rank", "ci"], "snapshot_id", "n")
