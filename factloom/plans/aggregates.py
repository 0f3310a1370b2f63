"""Aggregations over the roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import ranges, stats
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import table


@query("o_agg_01", "SELECT (SELECT count(*) FROM part) AS models, (SELECT count(*) FROM lineitem) AS results, (SELECT count(*) FROM orders) AS snapshots, (SELECT count(*) FROM supplier) AS surfaces")
def agg_01(spark, sf):
    names = {"models": "part", "results": "lineitem", "snapshots": "orders", "surfaces": "supplier"}
    counts = None
    for n, t in names.items():
        one = table(spark, sf, t).agg(F.count("*").alias("c")).select(F.lit(n).alias("n"), "c")
        counts = one if counts is None else counts.union(one)
    return counts.groupBy().pivot("n", list(names)).agg(F.first("c"))


@query("o_agg_02", with_roles("SELECT model_id, benchmark_id, max(TRY_CAST(regexp_extract(CAST(score AS VARCHAR), '^[0-9]+') AS BIGINT)) AS top FROM result GROUP BY ALL", "result"))
def agg_02(spark, sf):
    top = F.max(F.regexp_extract(F.col("score").cast("decimal(18,2)").cast("string"), "^[0-9]+", 0).try_cast("bigint")).alias("top")
    return R.result(spark, sf).groupBy("model_id", "benchmark_id").agg(top)


@query("o_agg_03", with_roles("SELECT model_id, max(CASE WHEN benchmark_id = 'A' THEN score END) AS a, max(CASE WHEN benchmark_id = 'N' THEN score END) AS n, min(CASE WHEN benchmark_id = 'R' THEN score END) AS r FROM result GROUP BY 1", "result"))
def agg_03(spark, sf):
    on = lambda b: F.when(F.col("benchmark_id") == b, F.col("score"))
    return R.result(spark, sf).groupBy("model_id").agg(F.max(on("A")).alias("a"), F.max(on("N")).alias("n"), F.min(on("R")).alias("r"))


@query("o_agg_04", with_roles("WITH c AS (SELECT model_id, source_id, amount, count(*) AS n FROM price WHERE amount > 0 GROUP BY ALL), m AS (SELECT model_id, source_id, amount, row_number() OVER (PARTITION BY model_id, source_id ORDER BY n DESC, amount) AS rn FROM c) SELECT model_id, arg_min(amount, CASE source_id WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS listed FROM m WHERE rn = 1 GROUP BY 1", "price"))
def agg_04(spark, sf):
    return stats.priority_mode(R.price(spark, sf), ["model_id"], "source_id", "amount", ["R", "N", "A"], "listed")


@query("o_agg_05", with_roles("SELECT name, count(DISTINCT developer) AS developers FROM model GROUP BY 1 HAVING count(DISTINCT developer) > 1", "model"))
def agg_05(spark, sf):
    return R.model(spark, sf).groupBy("name").agg(F.count_distinct("developer").alias("developers")).where("developers > 1")


@query("o_agg_06", with_roles("SELECT name, developer, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM model GROUP BY ALL HAVING count(*) > 1", "model"))
def agg_06(spark, sf):
    ids = F.expr("listagg(CAST(id AS STRING), ',') WITHIN GROUP (ORDER BY id)")
    return R.model(spark, sf).groupBy("name", "developer").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


@query("o_agg_07", with_roles("SELECT m.id, string_agg(DISTINCT u.name, ',' ORDER BY u.name) AS aliases FROM model m LEFT JOIN result r ON r.model_id = m.id AND r.score < 20000 LEFT JOIN surface u ON u.id = r.surface_id GROUP BY 1", "model", "result", "surface"))
def agg_07(spark, sf):
    pairs = R.result(spark, sf).where("score < 20000").join(R.surface(spark, sf), F.col("surface_id") == F.col("id")).groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("aliases"))
    return R.model(spark, sf).select("id").join(pairs, F.col("id") == F.col("model_id"), "left").select("id", "aliases")


@query("o_agg_08", with_roles("SELECT owner_id, source_id, min(id) AS first_id FROM snapshot GROUP BY ALL", "snapshot"))
def agg_08(spark, sf):
    return R.snapshot(spark, sf).groupBy("owner_id", "source_id").agg(F.min("id").alias("first_id"))


@query("o_agg_09", with_roles("SELECT r.benchmark_id, max(CASE WHEN m.open_weights THEN score END) AS best_open, max(CASE WHEN NOT m.open_weights OR m.open_weights IS NULL THEN score END) AS best_closed FROM result r JOIN model m ON m.id = r.model_id GROUP BY 1", "result", "model"))
def agg_09(spark, sf):
    best = R.result(spark, sf).groupBy("model_id", "benchmark_id").agg(F.max("score").alias("score"))
    j = best.join(R.model(spark, sf), F.col("id") == F.col("model_id"))
    opened = F.coalesce("open_weights", F.lit(False))
    return j.groupBy("benchmark_id").agg(F.max(F.when(opened, F.col("score"))).alias("best_open"), F.max(F.when(~opened, F.col("score"))).alias("best_closed"))


@query("o_agg_10", with_roles("SELECT kind, median(elo) AS middle FROM series GROUP BY 1", "series"))
def agg_10(spark, sf):
    return ranges.median(R.series(spark, sf), ["kind"], "elo", "middle")


@query("o_agg_11", with_roles("SELECT model_id, list(elo ORDER BY elo DESC)[CAST(floor(0.75 * count(*)) AS BIGINT) + 1] AS q FROM series GROUP BY 1", "series"))
def agg_11(spark, sf):
    return stats.rank_quantile_desc(R.series(spark, sf), ["model_id"], "elo", 0.75, "q")


@query("o_agg_12", with_roles("SELECT model_id, list(elo ORDER BY elo)[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM series GROUP BY 1", "series"))
def agg_12(spark, sf):
    return stats.index_quantile(R.series(spark, sf), ["model_id"], "elo", 0.95, "p95")


@query("o_agg_13", with_roles("SELECT model_id, count(*) FILTER (WHERE kind <> 'error') AS ok, count(*) FILTER (WHERE kind = 'error') AS failed, round(avg(elo) FILTER (WHERE kind <> 'error'), 4) AS mean, median(elo) FILTER (WHERE kind <> 'error') AS middle FROM series GROUP BY 1", "series"))
def agg_13(spark, sf):
    ok = F.col("kind") != "error"
    good = F.when(ok, F.col("elo"))
    return R.series(spark, sf).groupBy("model_id").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(good), 4).alias("mean"), F.median(good).alias("middle"))


@query("o_agg_14", with_roles("SELECT source_id, max(CAST(fetched_at AS VARCHAR)) AS newest, arg_max(id, struct_pack(f := fetched_at, i := id)) AS newest_id FROM snapshot GROUP BY 1", "snapshot"))
def agg_14(spark, sf):
    return R.snapshot(spark, sf).groupBy("source_id").agg(F.max(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).alias("newest"), F.max_by("id", F.struct("fetched_at", "id")).alias("newest_id"))


@query("o_agg_15", with_roles("SELECT developer, family, count(*) AS n, array_to_string(list(id ORDER BY id)[1:3], ',') AS samples FROM model GROUP BY ALL", "model"))
def agg_15(spark, sf):
    return stats.first_samples(R.model(spark, sf), ["developer", "family"], ["id"], 3, "id")


@query("o_agg_16", with_roles("SELECT kind, count(*) AS total FROM series GROUP BY 1", "series"))
def agg_16(spark, sf):
    return R.series(spark, sf).groupBy("kind").agg(F.count("*").alias("total"))


@query("o_agg_17", with_roles("SELECT split_part(name, ' ', 1) AS token, string_agg(DISTINCT developer, ',' ORDER BY developer) AS developers FROM model GROUP BY 1", "model"))
def agg_17(spark, sf):
    token = F.split_part("name", F.lit(" "), F.lit(1)).alias("token")
    return R.model(spark, sf).groupBy(token).agg(F.array_join(F.array_sort(F.collect_set("developer")), ",").alias("developers"))


@query("o_agg_18", with_roles("SELECT model_id, min(seen) AS first_seen, max(seen) AS last_seen FROM (SELECT model_id, measured_at AS seen FROM result UNION ALL SELECT model_id, valid_from FROM price UNION ALL SELECT model_id, valid_to FROM price) GROUP BY 1", "result", "price"))
def agg_18(spark, sf):
    p = R.price(spark, sf)
    at = R.result(spark, sf).select("model_id", F.col("measured_at").alias("seen")).union(p.select("model_id", F.explode(F.array("valid_from", "valid_to"))))
    return at.groupBy("model_id").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


@query("o_agg_19", with_roles("SELECT model_id, component, min(low) AS floor_price FROM (SELECT model_id, surface_id, component, min(amount) AS low FROM price GROUP BY ALL) GROUP BY ALL", "price"))
def agg_19(spark, sf):
    return R.price(spark, sf).groupBy("model_id", "component").agg(F.min("amount").alias("floor_price"))


@query("o_agg_20", with_roles("SELECT model_id, CAST(t AS DATE) AS day, max(elo) AS elo FROM series GROUP BY ALL", "series"))
def agg_20(spark, sf):
    return R.series(spark, sf).groupBy("model_id", F.to_date("t").alias("day")).agg(F.max("elo").alias("elo"))


@query("o_agg_21", with_roles("SELECT developer, count(*) AS n FROM model GROUP BY 1 ORDER BY n DESC, developer", "model"))
def agg_21(spark, sf):
    return R.model(spark, sf).groupBy("developer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "developer")
