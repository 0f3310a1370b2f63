"""State transitions and entity resolution over the roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as X
from factloom.operators import joins, merge, picks, queue, resolve, stats, validate
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.plans.scalars import aliases, norm, with_alias
from factloom.session import table

OLD = "old AS (SELECT o_custkey AS k, min(o_orderkey) AS id, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)"
NEW = "new AS (SELECT o_custkey AS k, max(o_orderkey) AS id, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)"


def old_new(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("id"), F.min("o_totalprice").alias("v"))
    return a, o.where("o_orderkey % 3 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("id"), F.max("o_totalprice").alias("v"))


@query("o_dml_01", f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def dml_01(spark, sf):
    old, new = old_new(spark, sf)
    return merge.insert_ignore(old, new, ["k"], [F.asc("id")])


@query("o_dml_02", f"WITH {OLD}, {NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def dml_02(spark, sf):
    old, new = old_new(spark, sf)
    return merge.insert_replace(old, new, ["k"], [F.desc("id")])


@query("o_dml_03", f"WITH {OLD}, {NEW} SELECT coalesce(o.k, n.k) AS k, coalesce(o.id, n.id) AS id, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n ON o.k = n.k")
def dml_03(spark, sf):
    old, new = old_new(spark, sf)
    return merge.upsert(old, new, ["k"], ["v"])


@query("o_dml_04", f"WITH {OLD}, {NEW} SELECT k, min(id) AS first_seen, max(id) AS last_seen FROM (SELECT k, id FROM old UNION ALL SELECT k, id FROM new) GROUP BY 1")
def dml_04(spark, sf):
    old, new = (d.select("k", F.col("id").alias("first_seen"), F.col("id").alias("last_seen")) for d in old_new(spark, sf))
    return merge.bump_seen(old, new, ["k"], "first_seen", "last_seen")


@query("o_dml_05", f"WITH {OLD}, {NEW} SELECT coalesce(o.k, n.k) AS k, coalesce(o.id, n.id) AS id, CASE WHEN o.k IS NULL THEN CASE WHEN n.k % 2 = 0 THEN n.v END ELSE coalesce(CASE WHEN n.k % 2 = 0 THEN n.v END, o.v) END AS v FROM old o FULL JOIN new n ON o.k = n.k")
def dml_05(spark, sf):
    old, new = old_new(spark, sf)
    return merge.sticky_upsert(old, new.withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v"))), ["k"], ["v"])


@query("o_dml_07", with_roles("SELECT CASE WHEN model_id % 5 = 0 AND model_id + 1 IN (SELECT id FROM model) THEN model_id + 1 ELSE model_id END AS model_id, snapshot_id, rank FROM result", "result", "model"))
def dml_07(spark, sf):
    m = R.model(spark, sf).select("id")
    mapping = joins.semi(m.where("id % 5 = 0").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new")), m, {"new": "id"})
    return merge.rewrite_keys(R.result(spark, sf).select("model_id", "snapshot_id", "rank"), "model_id", mapping)


@query("o_dml_09", with_roles("SELECT id, 'accepted' AS action FROM snapshot WHERE size > 100000 UNION ALL SELECT id, 'rejected' FROM snapshot WHERE size <= 100000", "snapshot"))
def dml_09(spark, sf):
    s = R.snapshot(spark, sf).select("id", "size")
    return s.where("size > 100000").select("id", F.lit("accepted").alias("action")).union(s.where("size <= 100000").select("id", F.lit("rejected").alias("action")))


# entity resolution: aliases of parts are resolved onto parts of an even number
KNOWN = f"known AS (SELECT {norm('s')} AS alias, min(id) AS entity_id, count(DISTINCT id) AS n FROM (SELECT id, s FROM a UNION ALL SELECT id, regexp_replace(s, '^[^/]*/', '') FROM a) WHERE id % 2 = 0 GROUP BY 1)"


def known(spark, sf):
    a = aliases(spark, sf)
    s = a.union(a.select("id", F.regexp_replace("s", "^[^/]*/", ""))).where("id % 2 = 0")
    return s.groupBy(X.normalize_alias(F.col("s"), True).alias("alias")).agg(F.min("id").alias("entity_id"), F.count_distinct("id").alias("n"))


@query("o_er_01", with_alias(f", {KNOWN}, c AS (SELECT id, 0 AS pass, {norm('s')} AS c FROM a UNION ALL SELECT id, 1, {norm('regexp_replace(s, ' + chr(39) + '^[^/]*/' + chr(39) + ', ' + chr(39) * 2 + ')')} FROM a) SELECT id, arg_min(entity_id, pass) AS entity_id, min(pass) AS pass FROM c JOIN known ON alias = c.c GROUP BY id").replace("part) ,", "part),"))
def er_01(spark, sf):
    k = known(spark, sf).select("alias", "entity_id", F.lit(None).cast("string").alias("entity_org"), F.lit(1.0).alias("confidence"))
    r = aliases(spark, sf).select("id", F.lit(None).cast("string").alias("org"), X.norm_variants(F.col("s"), True).alias("c"))
    return resolve.link(r, k, "id", "c", "org").select("id", "entity_id", "pass")


@query("o_er_02", with_alias("SELECT id, lower(regexp_extract(s, '(Brand-[0-9]+)/', 1)) AS org FROM a"))
def er_02(spark, sf):
    return aliases(spark, sf).select("id", X.canonical_org(F.regexp_extract("s", "(Brand-[0-9]+)/", 1), True).alias("org"))


LADDER = f""", {KNOWN}, r AS (SELECT id, {norm('s')} AS full_, {norm('regexp_replace(s, ' + chr(39) + '^[^/]*/' + chr(39) + ', ' + chr(39) * 2 + ')')} AS bare FROM a),
f AS (SELECT r.id, e.id AS entity_id, 1.0 AS c FROM r JOIN a e ON e.id = r.id AND r.id % 4 = 0 UNION ALL SELECT r.id, entity_id, 0.95 FROM r JOIN known ON alias = full_ UNION ALL SELECT r.id, entity_id, 0.7 FROM r JOIN known ON alias = bare)
SELECT r.id, arg_min(f.entity_id, struct_pack(c := -f.c, e := f.entity_id)) AS entity_id, CAST(max(f.c) AS DOUBLE) AS confidence, coalesce(max(f.c) >= 0.9, FALSE) AS auto FROM r LEFT JOIN f ON f.id = r.id GROUP BY r.id"""


@query("o_er_03", with_alias(LADDER).replace("part) ,", "part),"))
def er_03(spark, sf):
    a, k = aliases(spark, sf), known(spark, sf).select("alias", "entity_id")
    r = a.select("id", X.normalize_alias(F.col("s"), True).alias("full"), X.normalize_alias(F.regexp_replace("s", "^[^/]*/", ""), True).alias("bare"))
    rungs = [(1.0, r.where("id % 4 = 0").select("id", F.col("id").alias("entity_id"))), (0.95, r.join(k, F.col("full") == F.col("alias"))), (0.7, r.join(k, F.col("bare") == F.col("alias")))]
    return resolve.ladder(r, "id", rungs, 0.9)


@query("o_er_04", with_roles("SELECT r.model_id, r.snapshot_id, r.rank, coalesce(s.owner_id, u.provider_id) AS entity FROM result r LEFT JOIN (SELECT id, owner_id FROM snapshot WHERE id % 2 = 0) s ON s.id = r.snapshot_id LEFT JOIN surface u ON u.id = r.surface_id", "result", "snapshot", "surface"))
def er_04(spark, sf):
    s = R.snapshot(spark, sf).where("id % 2 = 0").select(F.col("id").alias("snapshot_id"), "owner_id")
    u = R.surface(spark, sf).select(F.col("id").alias("surface_id"), "provider_id")
    return R.result(spark, sf).join(s, "snapshot_id", "left").join(u, "surface_id", "left").select("model_id", "snapshot_id", "rank", F.coalesce("owner_id", F.col("provider_id").cast("long")).alias("entity"))


@query("o_er_05", with_alias(LADDER.replace("SELECT r.id, arg_min", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN coalesce(max(f.c) >= 0.9, FALSE) THEN 'alias' WHEN max(f.c) IS NULL THEN 'unknown' ELSE 'queue' END AS outcome, arg_min") + ") GROUP BY 1").replace("part) ,", "part),"))
def er_05(spark, sf):
    out = F.when(F.col("auto"), "alias").when(F.col("confidence").isNull(), "unknown").otherwise("queue")
    return er_03(spark, sf).groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("o_er_06", f"WITH {OLD}, {NEW} SELECT k, id FROM old UNION SELECT k, id FROM new")
def er_06(spark, sf):
    old, new = old_new(spark, sf)
    return merge.insert_ignore(old.select("k", "id"), new.select("k", "id"), ["k", "id"], [F.asc("id")])


@query("o_er_07", with_alias("SELECT CASE WHEN s LIKE '%:free' THEN 'variant' WHEN regexp_matches(s, '^(us\\.|bedrock/|azure-ai/|Vertex_AI:)') THEN 'reexport' ELSE 'mint' END AS kind, count(*) AS n FROM a GROUP BY 1"))
def er_07(spark, sf):
    kind = F.when(F.col("s").endswith(":free"), "variant").when(X.surface_prefix(F.col("s")).isNotNull(), "reexport").otherwise("mint")
    return aliases(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


CATALOG = """i AS (SELECT id, 'brand-' || b || CASE WHEN id % 3 = 0 THEN '-cn' ELSE '' END || '/' || CASE WHEN id % 15 = 0 THEN 'host/' ELSE '' END || CASE WHEN id % 4 = 1 THEN 'new-' ELSE '' END || replace(name, ' ', '3.5-') AS s, b, id % 3 = 0 AS mixed FROM (SELECT *, split_part(developer, '#', 2) AS b FROM model))"""


def catalog_ids(spark, sf):
    """Every third id is of a namespace that lists others' models too, some with a host in their path."""
    b = F.split_part("developer", F.lit("#"), F.lit(2))
    bare = F.concat(F.when(F.col("id") % 4 == 1, "new-").otherwise(""), F.replace("name", F.lit(" "), F.lit("3.5-")))
    s = F.concat(F.lit("brand-"), b, F.when(F.col("id") % 3 == 0, "-cn").otherwise(""), F.lit("/"), F.when(F.col("id") % 15 == 0, "host/").otherwise(""), bare)
    return R.model(spark, sf).select("id", s.alias("s"))


@query("o_er_08", with_roles(f"""WITH {CATALOG},
 t AS (SELECT DISTINCT regexp_replace(lower(split_part(split_part(s, '/', 2), '-', 1)), '[0-9.]+$', '') AS token, 'brand-' || b AS owner FROM i WHERE NOT mixed AND CAST(b AS INTEGER) % 2 = 1),
 g AS (SELECT i.id, i.s, mixed, 'brand-' || b AS dev, split_part(s, '/', 3) <> '' AS nested, unnest(list_slice(str_split(substr(s, strpos(s, '/') + 1), '-'), 1, 2)) AS seg FROM i),
 x AS (SELECT g.id, bool_or(token IS NOT NULL AND NOT list_contains(owners, dev)) AS other FROM g LEFT JOIN (SELECT token, list(owner) AS owners FROM t WHERE token <> '' GROUP BY 1) o ON o.token = regexp_replace(lower(seg), '[0-9.]+$', '') GROUP BY 1)
 SELECT DISTINCT g.id, g.s AS source_id, NOT mixed OR NOT (nested OR other) AS mints FROM g JOIN x USING (id)""", "model"))
def er_08(spark, sf):
    """Tokens learned from the plain namespaces of odd brands, as a gate for the ids of shared ones."""
    ids, brands = catalog_ids(spark, sf), [str(i) for i in range(1, 26)]
    shared = {f"brand-{b}-cn": f"brand-{b}" for b in brands}
    owners = resolve.vendor_owners(ids, "s", [f"brand-{b}" for b in brands if int(b) % 2], list(shared))
    return resolve.with_mint_gate(ids, "s", owners, shared).select("id", F.col("s").alias("source_id"), "mints")


@query("o_er_09", with_roles("WITH r AS (SELECT id, lower(replace(developer, '#', '-')) || '/' || replace(name, ' ', '-') AS route, CASE WHEN id % 3 = 0 THEN 'Hub/' || replace(name, ' ', '_') END AS hub FROM model), known AS (SELECT lower(replace(developer, '#', '-')) || '/' || replace(name, ' ', '-') AS alias, min(id) AS entity_id FROM model WHERE id % 2 = 0 GROUP BY 1), hit AS (SELECT r.*, entity_id FROM r JOIN known ON route = alias) SELECT DISTINCT entity_id, route AS alias, 'router_id' AS kind, CAST(0.9 AS DOUBLE) AS confidence FROM hit UNION ALL SELECT DISTINCT entity_id, hub, 'hf_repo_id', CAST(0.95 AS DOUBLE) FROM hit WHERE hub IS NOT NULL", "model"))
def er_09(spark, sf):
    m = R.model(spark, sf)
    route = F.concat(F.lower(F.replace("developer", F.lit("#"), F.lit("-"))), F.lit("/"), F.replace("name", F.lit(" "), F.lit("-")))
    hub = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Hub/"), F.replace("name", F.lit(" "), F.lit("_"))))
    routes = m.select("id", route.alias("route"), hub.alias("hub"))
    known = m.where("id % 2 = 0").select(route.alias("alias"), F.col("id").alias("entity_id"))
    return resolve.bridge(routes, "route", "hub", known)


@query("o_er_10", with_roles("SELECT id, CASE WHEN context % 5 = 0 THEN '' ELSE array_to_string(list_sort([x for x in [developer || '/' || stem || suffix, CASE WHEN suffix <> '' THEN developer || '/' || stem END] if x IS NOT NULL]), '|') END AS candidates FROM (SELECT id, context, lower(replace(developer, '#', '-')) AS developer, replace(name, ' ', '-') AS stem, ['', '-thinking', '-non-reasoning-low-effort', '-high'][id % 4 + 1] AS suffix FROM model)", "model"))
def er_10(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, ["", "-thinking", "-non-reasoning-low-effort", "-high"])), (F.col("id") % 4 + 1).cast("int"))
    m = R.model(spark, sf).select("id", F.when(F.col("context") % 5 != 0, F.lower(F.replace("developer", F.lit("#"), F.lit("-")))).alias("creator"), F.concat(F.replace("name", F.lit(" "), F.lit("-")), suffix).alias("slug"))
    return m.select("id", F.array_join(F.array_sort(resolve.scoped_candidates(F.col("creator"), [F.col("slug")])), "|").alias("candidates"))


@query("o_er_11", with_alias(f", {KNOWN} SELECT alias, n AS entities, entity_id AS first FROM known WHERE n > 1").replace("part) ,", "part),"))
def er_11(spark, sf):
    a = aliases(spark, sf)
    s = a.union(a.select("id", F.regexp_replace("s", "^[^/]*/", ""))).where("id % 2 = 0").select("id", X.normalize_alias(F.col("s"), True).alias("alias"))
    return resolve.collisions(s, "alias", "id").select("alias", "entities", "first")


@query("o_er_12", with_roles("WITH x AS (SELECT id, developer || '/' || family AS alias, context > 25 AS is_copy FROM model) SELECT c.id AS old, r.id AS new FROM x c JOIN (SELECT alias, min(id) AS id FROM x WHERE NOT is_copy GROUP BY 1 HAVING count(DISTINCT id) = 1) r USING (alias) WHERE c.is_copy", "model"))
def er_12(spark, sf):
    x = R.model(spark, sf).select("id", F.concat("developer", F.lit("/"), "family").alias("alias"), (F.col("context") > 25).alias("is_copy"))
    return resolve.merge_plan(x, "alias", "id", "is_copy")


# shells are every fourth model; their clean slug is another model's, in the same or other letters, an alias of one, or new
SHELLS = """slugs AS (SELECT id, 'd' || id % 9 AS dev, CASE WHEN id % 4 = 3 THEN 'host/d' || id % 9 || '/' || CASE id % 16 WHEN 3 THEN 'm_' || (id - 9) WHEN 7 THEN 'M ' || (id - 9) WHEN 11 THEN 'alt-' || id ELSE 'new ' || id END
  ELSE 'd' || id % 9 || '/' || CASE WHEN id % 16 = 2 THEN 'alt-' || (id + 9) || '-x' WHEN id % 16 IN (10, 14) THEN 'm_' || id ELSE 'other-' || id END END AS slug FROM model)"""


def shells(spark, sf):
    i = F.col("id")
    shell = F.when(i % 16 == 3, F.concat(F.lit("m_"), i - 9)).when(i % 16 == 7, F.concat(F.lit("M "), i - 9)).when(i % 16 == 11, F.concat(F.lit("alt-"), i)).otherwise(F.concat(F.lit("new "), i))
    other = F.when(i % 16 == 2, F.concat(F.lit("alt-"), i + 9, F.lit("-x"))).when((i % 16).isin(10, 14), F.concat(F.lit("m_"), i)).otherwise(F.concat(F.lit("other-"), i))
    dev = F.concat(F.lit("d"), i % 9)
    return R.model(spark, sf).select("id", dev.alias("developer_id"), F.when(i % 4 == 3, F.concat(F.lit("host/"), dev, F.lit("/"), shell)).otherwise(F.concat(dev, F.lit("/"), other)).alias("slug"))


@query("o_er_13", with_roles(f"""WITH {SHELLS}, n AS (SELECT id, slug, dev, lower(replace(replace(replace(slug, ' ', '-'), '_', '-'), '/', '-')) AS k FROM slugs), u AS (SELECT k, min(id) AS id FROM n GROUP BY 1 HAVING count(*) = 1),
 s AS (SELECT id, slug, dev, substr(slug, 6) AS clean FROM slugs WHERE slug LIKE 'host/%'),
 x AS (SELECT s.*, e.id AS e, u.id AS c, a.id AS a FROM s LEFT JOIN slugs e ON e.slug = s.clean LEFT JOIN u ON u.k = lower(replace(replace(replace(s.clean, ' ', '-'), '_', '-'), '/', '-')) LEFT JOIN slugs a ON s.id % 16 = 11 AND a.id = s.id - 9)
 SELECT x.id AS shell_id, x.slug AS shell_slug, x.dev AS developer_id, clean AS clean_slug, coalesce(e, c, a) AS target_id, t.slug AS target_slug, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'normalized' WHEN a IS NOT NULL THEN 'alias' ELSE 'create' END AS resolution, CASE WHEN coalesce(e, c, a) IS NULL THEN 'create' ELSE 'merge' END AS action
 FROM x LEFT JOIN slugs t ON t.id = coalesce(e, c, a)""", "model"))
def er_13(spark, sf):
    m = shells(spark, sf)
    known = m.where("id % 16 = 2").select(X.normalize_alias(F.concat("developer_id", F.lit("/alt-"), F.col("id") + 9)).alias("alias"), F.col("id").alias("model_id"))
    other = m.where("id % 16 = 1").select(X.normalize_alias(F.concat("developer_id", F.lit("/new-"), F.col("id") + 14)).alias("alias"), F.col("id").alias("model_id"))  # of another name
    return resolve.repair_plan(m, known.union(other), m.select(F.col("developer_id").alias("id")))


# every model against all others of its developer; SQL makes all pairs, Spark doesn't
SCORED = "WITH o AS (SELECT a.id AS record, b.id AS entity, CASE WHEN a.name = b.name AND a.family = b.family THEN 110 WHEN a.name = b.name THEN 80 WHEN a.family = b.family THEN 60 ELSE 0 END AS score FROM model a JOIN model b ON a.developer = b.developer AND a.id <> b.id), t AS (SELECT *, count(*) FILTER (WHERE score >= 80) OVER (PARTITION BY record) AS good, row_number() OVER (PARTITION BY record ORDER BY score DESC, entity) AS rn FROM o WHERE score > 0)"


@query("o_er_14", with_roles(SCORED + " SELECT record, entity, score FROM t WHERE rn <= 10", "model"))
def er_14(spark, sf):
    return resolve.best_options(R.model(spark, sf), "id", "developer", "name", "family", 10)


@query("o_er_15", with_roles(SCORED + " SELECT record, entity, score, score >= 80 AND good = 1 AS suggested FROM t WHERE rn <= 10", "model"))
def er_15(spark, sf):
    return resolve.suggested_options(resolve.option_lists(R.model(spark, sf), "id", "developer", "name", "family", 10))


@query("o_er_16", with_roles("SELECT a.id, string_agg(DISTINCT CAST(b.id AS VARCHAR), ',' ORDER BY CAST(b.id AS VARCHAR)) AS existing FROM model a JOIN model b ON b.name = a.name AND b.developer = a.developer GROUP BY 1", "model"))
def er_16(spark, sf):
    m = R.model(spark, sf).select("id", "name", "developer")
    lists = m.groupBy("name", "developer").agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("existing"))
    return m.join(lists, ["name", "developer"]).select("id", "existing")


@query("o_er_17", with_roles("SELECT developer AS provider, family, count(*) AS n, array_to_string(list(id ORDER BY id)[1:3], ',') AS samples FROM model WHERE context < 20 GROUP BY ALL", "model"))
def er_17(spark, sf):
    return stats.first_samples(R.model(spark, sf).where("context < 20").withColumnRenamed("developer", "provider"), ["provider", "family"], ["id"], 3, "id")


@query("o_er_19", with_roles("SELECT r.snapshot_id, r.rank, coalesce(CASE WHEN r.model_id % 7 <> 0 THEN r.model_id END, m.id) AS model_id FROM result r LEFT JOIN (SELECT id FROM model WHERE id % 2 = 0) m ON m.id = r.model_id AND r.model_id % 7 = 0", "result", "model"))
def er_19(spark, sf):
    r = R.result(spark, sf).select("snapshot_id", "rank", F.col("model_id").alias("name"), F.when(F.col("model_id") % 7 != 0, F.col("model_id")).alias("model_id"))
    m = R.model(spark, sf).where("id % 2 = 0").select("id")
    return r.join(m, F.col("model_id").isNull() & (F.col("name") == F.col("id")), "left").select("snapshot_id", "rank", F.coalesce("model_id", "id").alias("model_id"))


@query("o_er_20", with_roles("""SELECT id, CASE WHEN id % 5 = 0 THEN 'Arch' || (id - id % 7) || 'ForCausalLM' WHEN id % 5 = 1 THEN 'Arch' || id || 'ForCausalLM' WHEN id % 5 = 2 THEN CASE WHEN id % 3 = 0 THEN 'Qwen3ForCausalLM' ELSE 'LlamaForCausalLM' END END AS architecture,
 CASE id % 5 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM model WHERE id % 5 < 3 AND (id % 5 <> 0 OR (id - id % 7) IN (SELECT id FROM model))""", "model"))
def er_20(spark, sf):
    """Architectures from metadata, from words of the texts, and from clear names; names beside them that are registered too."""
    i, m = F.col("id"), R.model(spark, sf).select("id")
    arch = lambda n: F.concat(F.lit("Arch"), n, F.lit("ForCausalLM"))
    listed = F.when(i % 5 == 0, F.array(F.lit("Unknown"), arch(i - i % 7), arch(i)))
    word = F.when(i % 5 == 1, F.concat(F.lit("a repo of ("), arch(i), F.lit(") and LlamaForCausalLMs"))).when(i % 5 == 2, F.when(i % 3 == 0, "Big qwen-3-llama").otherwise("my_Llama llama:v2")).when(i % 5 == 3, "phi 3 mini").otherwise(F.concat(arch(i), F.lit("_x llamas")))
    registry = m.select(arch(i).alias("architecture")).union(spark.range(1).select(F.explode(F.array(F.lit("Qwen3ForCausalLM"), F.lit("LlamaForCausalLM"), F.lit("Qwen3MoeForCausalLM")))))
    return resolve.match_architecture(m.select("id", listed.alias("architectures"), F.array(F.lit(""), word, F.lit("tag")).alias("texts")), registry)


# supporting operators


@query("o_sup_04", with_roles("SELECT id, CAST(price AS DOUBLE) AS v FROM model WHERE id % 4 <> 0", "model"))
def sup_04(spark, sf):
    raw = F.when(F.col("id") % 4 == 0, "n/a").otherwise(F.format_string("%.2f", "price"))
    return R.model(spark, sf).select("id", raw.try_cast("double").alias("v")).where("v IS NOT NULL")


@query("o_sup_05", with_roles("SELECT id, CASE WHEN id % 3 = 1 THEN price END AS v FROM model", "model"))
def sup_05(spark, sf):
    v = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 2, F.lit(float("-inf"))).otherwise(F.col("price"))
    return R.model(spark, sf).select("id", F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v).alias("v"))


@query("o_sup_09", with_roles("SELECT id FROM (SELECT DISTINCT ON (id) id, o, c FROM (SELECT model_id AS id, 0 AS o, -score AS c FROM result WHERE self_reported UNION ALL SELECT id, 1, -price FROM model) ORDER BY id, o, c) ORDER BY o, c, id LIMIT 100", "result", "model"))
def sup_09(spark, sf):
    a = R.result(spark, sf).where("self_reported").select(F.col("model_id").alias("id"), F.lit(0).alias("o"), (-F.col("score")).alias("c"))
    b = R.model(spark, sf).select("id", F.lit(1).alias("o"), (-F.col("price")).alias("c"))
    return picks.keep_first(a.union(b), ["id"], [F.asc("o"), F.asc("c")]).orderBy("o", "c", "id").limit(100).select("id")


@query("o_sup_10", with_roles("SELECT snapshot_id, arg_max(model_id, struct_pack(p := NOT self_reported, c := ci, t := measured_at, m := model_id)) AS model_id FROM result GROUP BY 1", "result"))
def sup_10(spark, sf):
    return R.result(spark, sf).groupBy("snapshot_id").agg(F.max_by("model_id", F.struct(~F.col("self_reported"), "ci", "measured_at", "model_id")).alias("model_id"))


@query("o_sup_13", with_roles("SELECT DISTINCT benchmark_id FROM result WHERE score > 50000", "result"))
def sup_13(spark, sf):
    return R.result(spark, sf).where("score > 50000").select("benchmark_id").distinct()


@query("o_sup_14", with_roles("SELECT id FROM snapshot WHERE id NOT IN (SELECT snapshot_id FROM result) OR id % 10 = 0", "snapshot", "result"))
def sup_14(spark, sf):
    s = R.snapshot(spark, sf).select("id")
    return joins.orphans(s.where("id % 10 <> 0"), R.result(spark, sf), {"id": "snapshot_id"}).union(s.where("id % 10 = 0"))


@query("o_sup_15", with_roles("SELECT id AS model_id, sum(results) AS results, sum(prices) AS prices, sum(points) AS points FROM (SELECT model_id AS id, 1 AS results, 0 AS prices, 0 AS points FROM result UNION ALL SELECT model_id, 0, 1, 0 FROM price WHERE line = 1 UNION ALL SELECT model_id, 0, 0, 1 FROM series) GROUP BY 1", "result", "price", "series").replace("sum(results) AS", "CAST(sum(results) AS BIGINT) AS").replace("sum(prices) AS", "CAST(sum(prices) AS BIGINT) AS").replace("sum(points) AS", "CAST(sum(points) AS BIGINT) AS"))
def sup_15(spark, sf):
    refs = {"results": (R.result(spark, sf), "model_id"), "prices": (R.price(spark, sf).where("line = 1"), "model_id"), "points": (R.series(spark, sf), "model_id")}
    return merge.reference_counts(refs, "model_id")


@query("o_sup_16", with_roles("""WITH c AS (SELECT model_id, benchmark_id AS cap, rank AS snap, CAST(floor(min(score) / 60000) AS BIGINT) AS v FROM result WHERE rank <= 2 GROUP BY ALL), p AS (SELECT id AS shell, id - 1 AS target, 'host/x/' || id AS slug FROM model WHERE id % 10 = 3),
 y AS (SELECT p.shell, p.target, p.slug, min(CASE WHEN a.v <> b.v THEN a.cap || chr(1) || a.snap || chr(1) || a.v || ' target=' || b.v END) AS bad, count(b.cap) FILTER (WHERE a.v = b.v) AS same FROM p LEFT JOIN c a ON a.model_id = p.shell LEFT JOIN c b ON b.model_id = p.target AND b.cap = a.cap AND b.snap = a.snap GROUP BY ALL)
 SELECT shell AS shell_id, target AS target_id, CASE WHEN bad IS NULL THEN 'merge' ELSE 'skip' END AS status, 'capability conflict for ' || split_part(bad, chr(1), 1) || ': shell=' || split_part(split_part(bad, chr(1), 3), ' target', 1) AS reason, CASE WHEN bad IS NULL THEN same ELSE 0 END AS collapsed,
  (SELECT count(*) FROM c WHERE model_id = target) + CASE WHEN bad IS NULL THEN (SELECT count(*) FROM c WHERE model_id = shell) - same ELSE 0 END AS target_capabilities,
  CASE WHEN bad IS NOT NULL THEN CASE shell % 30 WHEN 3 THEN shell WHEN 13 THEN 999999 END ELSE CASE WHEN shell % 30 = 13 THEN 999999 ELSE target END END AS alias_of FROM y""", "result", "model"))
def sup_16(spark, sf):
    """Shells merged into the model before them where no fact differs; some slugs are names already, some of them another model's."""
    c = R.result(spark, sf).where("rank <= 2").groupBy("model_id", F.col("benchmark_id").alias("capability"), F.col("rank").alias("snapshot_id")).agg(F.floor(F.min("score") / 60000).alias("value")).withColumn("confidence", F.lit(1.0))
    m = R.model(spark, sf)
    plans = m.where("id % 10 = 3").select(F.col("id").alias("shell_id"), F.concat(F.lit("host/x/"), "id").alias("shell_slug"), (F.col("id") - 1).alias("target_id"))
    aliases = plans.where("shell_id % 30 IN (3, 13)").select(F.col("shell_slug").alias("alias"), F.when(F.col("shell_id") % 30 == 3, F.col("shell_id")).otherwise(999999).alias("model_id"))
    done = resolve.safe_merges(plans, c, aliases)
    n = done["capabilities"].groupBy(F.col("model_id").alias("_t")).agg(F.count("*").alias("_n"))
    names = done["aliases"].select(F.col("alias").alias("_al"), F.col("model_id").alias("alias_of"))
    j = done["plans"].join(n, F.col("target_id") == F.col("_t"), "left").join(names, F.col("shell_slug") == F.col("_al"), "left")
    return j.select("shell_id", "target_id", "status", F.regexp_replace("reason", " target=.*", "").alias("reason"), "collapsed", F.coalesce("_n", F.lit(0)).alias("target_capabilities"), "alias_of")


@query("o_sup_18", with_roles("SELECT model_id, count(*) FILTER (WHERE kind <> 'error') > 0 AS usable FROM series GROUP BY 1", "series"))
def sup_18(spark, sf):
    return R.series(spark, sf).groupBy("model_id").agg((F.count_if(F.col("kind") != "error") > 0).alias("usable"))


@query("o_sup_20", with_roles("SELECT id, CASE WHEN balance < 0 THEN 'debt' WHEN provider_id < 5 THEN 'local' ELSE 'remote' END || ' · ' || name AS badge FROM surface", "surface"))
def sup_20(spark, sf):
    kind = F.when(F.col("balance") < 0, "debt").when(F.col("provider_id") < 5, "local").otherwise("remote")
    return R.surface(spark, sf).select("id", F.concat_ws(" · ", kind, "name").alias("badge"))


@query("o_sup_21", with_roles("SELECT m.id, coalesce((SELECT arg_max(score, struct_pack(t := measured_at, s := snapshot_id, r := rank, v := score)) FROM result r WHERE r.model_id = m.id AND benchmark_id = 'A'), m.price) AS shown FROM model m", "model", "result"))
def sup_21(spark, sf):
    last = R.result(spark, sf).where("benchmark_id = 'A'").groupBy("model_id").agg(F.max_by("score", F.struct("measured_at", "snapshot_id", "rank", "score")).alias("s"))
    return R.model(spark, sf).join(last, F.col("id") == F.col("model_id"), "left").select("id", F.coalesce("s", "price").alias("shown"))


@query("o_sup_22", with_roles("SELECT id, row_number() OVER (ORDER BY d DESC NULLS LAST, name, id) AS place FROM (SELECT id, name, CASE WHEN id % 3 <> 0 THEN release_date END AS d FROM model) QUALIFY place <= 100", "model"))
def sup_22(spark, sf):
    m = R.model(spark, sf).select("id", "name", F.when(F.col("id") % 3 != 0, F.col("release_date")).alias("d"))
    order = [F.desc_nulls_last("d"), F.asc("name"), F.asc("id")]
    top = m.orderBy(*order).limit(100)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))  # at most 100 rows


@query("o_sup_23", with_roles("SELECT id, price FROM model ORDER BY price DESC NULLS LAST, id LIMIT 50", "model"))
def sup_23(spark, sf):
    sort = {"price": F.desc_nulls_last("price"), "name": F.asc_nulls_last("name")}
    return R.model(spark, sf).orderBy(sort["price"], "id").limit(50).select("id", "price")


@query("o_sup_25", with_roles("SELECT id, kind || ': ' || coalesce(CAST(CAST(elo AS DECIMAL(18, 2)) AS VARCHAR), '—') AS text FROM series", "series"))
def sup_25(spark, sf):
    return R.series(spark, sf).select("id", F.concat("kind", F.lit(": "), F.coalesce(F.col("elo").cast("decimal(18,2)").cast("string"), F.lit("—"))).alias("text"))


@query("o_sup_26", with_roles("SELECT m.id, 'A' AS benchmark_id FROM model m WHERE m.id NOT IN (SELECT model_id FROM result WHERE benchmark_id = 'A' AND score > 90000)", "model", "result"))
def sup_26(spark, sf):
    gap = joins.orphans(R.model(spark, sf).select("id"), R.result(spark, sf).where("benchmark_id = 'A' AND score > 90000"), {"id": "model_id"})
    return gap.withColumn("benchmark_id", F.lit("A"))


@query("o_sup_06", "SELECT event_id AS id, json_extract_string(props, '$.k') AS v FROM events")
def sup_06(spark, sf):
    nested = F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object(nested, "$.a.c"), F.get_json_object(nested, "$.a.b.k")).alias("v"))


@query("o_sup_07", "SELECT event_id AS id, nullif(concat_ws(',', CASE WHEN k % 3 = 1 OR k % 7 = 3 THEN 'n' END, CASE WHEN k % 4 = 2 THEN 'name' WHEN k % 7 = 3 THEN 'name' END, CASE WHEN k % 5 = 4 OR k % 7 = 3 THEN 'tags' END), '') AS problems FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def sup_07(spark, sf):
    # the payloads are the rows' own, damaged by the number in them
    k = F.get_json_object("props", "$.k").cast("long")
    number = F.when(k % 3 == 1, F.lit("true")).otherwise(k.cast("string"))
    name = F.when(k % 4 == 2, F.lit('" "')).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    tags = F.when(k % 5 == 4, F.col("props")).otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]')))
    raw = F.when(k % 7 == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"n": '), number, F.lit(', "name": '), name, F.lit(', "tags": '), tags, F.lit("}")))
    found = validate.problems(raw, {"n": "int", "name": "text", "tags": "list"})
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.nullif(F.array_join(found, ","), F.lit("")).alias("problems"))


@query("o_sup_08", with_alias("SELECT id, CASE WHEN contains(s, ':') THEN 'route' WHEN regexp_matches(s, '[0-9]{4}-?[0-9]{2}-?[0-9]{2}') THEN 'dated' WHEN contains(s, '/') THEN 'path' ELSE 'plain' END AS kind FROM a"))
def sup_08(spark, sf):
    return aliases(spark, sf).select("id", validate.alias_kind(F.col("s")).alias("kind"))


@query("o_sup_11", with_roles("SELECT id, CASE WHEN id % 3 = 0 THEN CAST(context AS BIGINT) WHEN id % 3 = 1 THEN id END AS size FROM model", "model"))
def sup_11(spark, sf):
    first = F.when(F.col("id") % 3 == 0, F.col("context").cast("string")).otherwise(F.lit("-1"))
    second = F.when(F.col("id") % 3 == 1, F.nullif("id", F.lit(0)).cast("string")).otherwise(F.lit("n/a"))
    return R.model(spark, sf).select("id", validate.size_bytes([first, second]).alias("size"))


@query("o_sup_12", with_roles("SELECT id, 'https://api.example/models/' || replace(name, ' ', '+') || '/endpoints' AS url FROM model", "model"))
def sup_12(spark, sf):
    return R.model(spark, sf).select("id", F.concat(F.lit("https://api.example/models/"), F.url_encode("name"), F.lit("/endpoints")).alias("url"))


@query("o_sup_19", with_roles("SELECT id, unnest([1, 2, 3]) AS run FROM model ORDER BY run, id", "model"))
def sup_19(spark, sf):
    return validate.run_order(3, R.model(spark, sf).select("id"), "id", True)


# review of the queue: orders wait to be resolved onto parts; order priorities are the sources, customers the names
QUEUE = """q AS (SELECT o_orderkey AS id, o_orderpriority AS source, o_custkey AS c, o_orderkey % 40 = 1 AS approved, o_orderkey % 13 = 5 AS done, 1 + o_orderkey % (SELECT count(*) FROM part) AS target FROM orders)"""


def review_tables(spark, sf):
    """Every 13th order is done; the name of an order is its customer's, and it may give that and the doubled customer's."""
    o = table(spark, sf, "orders")
    done, name = F.col("o_orderkey") % 13 == 5, lambda c: F.concat(F.lit("c"), c)
    models = R.model(spark, sf).select("id", F.concat(X.slugify("developer"), F.lit("/m"), "id").alias("slug"), X.slugify("developer").alias("developer_id"), F.col("name").alias("display_name"))
    organizations = models.select(F.col("developer_id").alias("id")).distinct().select("id", F.upper("id").alias("display_name"), F.array(F.concat("id", F.lit(" labs"))).alias("aliases"))
    records = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_id"), name(F.col("o_custkey")).alias("name"), F.when(done, name(F.col("o_custkey"))).alias("alias"))
    q = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("record_id"), F.when(done, F.lit(1)).cast("long").alias("model_id"), F.when(done, "resolved").otherwise("pending").alias("status"), done.alias("resolved"), F.array(name(F.col("o_custkey")), name(F.col("o_custkey") * 2), F.lit(" ")).alias("candidates"))
    aliases, audit = spark.createDataFrame([], "source_id string, alias string, model_id long, method string"), spark.createDataFrame([], "queue_id long, record_id long, model_id long, action string")
    return queue.Review(models, organizations, aliases, records, q, audit)


SETTLED = f"""WITH RECURSIVE {QUEUE},
 a AS (SELECT id, source, c, target FROM q WHERE approved AND NOT done),
 seed AS (SELECT source, c, arg_max(target, id) AS m FROM (SELECT id, source, c, target FROM a UNION ALL SELECT id, source, c * 2, target FROM a) GROUP BY 1, 2),
 p AS (SELECT DISTINCT source, c FROM q WHERE NOT approved AND NOT done),
 k AS (SELECT source, c, m, 0 AS round FROM seed UNION ALL SELECT k.source, k.c * 2, k.m, round + 1 FROM k JOIN p ON p.source = k.source AND p.c = k.c WHERE k.c <> 0),
 best AS (SELECT source, c, arg_min(m, round) AS m, min(round) AS round FROM k GROUP BY 1, 2)
 SELECT q.id, CASE WHEN done THEN 'resolved' WHEN approved OR b.m IS NOT NULL THEN 'accepted' ELSE 'pending' END AS status,
  CASE WHEN done THEN 1 WHEN approved THEN target ELSE b.m END AS model_id, done OR approved OR b.m IS NOT NULL AS resolved,
  CASE WHEN done THEN NULL WHEN approved THEN 'accept,drain' WHEN b.m IS NOT NULL THEN 'settle' END AS actions,
  CASE WHEN done OR approved OR b.m IS NOT NULL THEN 'c' || q.c END AS alias
 FROM q LEFT JOIN best b ON b.source = q.source AND b.c = q.c AND NOT approved AND NOT done"""


@query("o_er_18", SETTLED)
def er_18(spark, sf):
    """A batch of approvals, then all that its names make resolvable, over all orders."""
    review = review_tables(spark, sf)
    n = F.broadcast(review.models.agg(F.count("*").alias("_n")))  # one row
    approvals = review.queue.where("id % 40 = 1 AND status = 'pending'").join(n).select(F.col("id").alias("position"), F.col("id").alias("queue_id"), (1 + F.col("id") % F.col("_n")).alias("model_id"))
    done = queue.settle(queue.accept_batch(review, approvals))
    actions = done.audit.groupBy(F.col("queue_id").alias("_q")).agg(F.array_join(F.array_sort(F.collect_list("action")), ",").alias("actions"))
    links = done.records.select(F.col("id").alias("record_id"), "alias")
    return done.queue.join(links, "record_id").join(actions, F.col("id") == F.col("_q"), "left").select("id", "status", "model_id", "resolved", "actions", "alias")


MINTED = f"""WITH {QUEUE}, r AS (SELECT id, source, c, row_number() OVER (ORDER BY id) + (SELECT max(p_partkey) FROM part) AS m, 'brand-' || (11 + id % 3) AS dev FROM q WHERE id % 97 = 3 AND NOT done)
 SELECT m AS id, dev || '/new-' || id AS slug, dev AS developer_id, 'n' || id AS first_alias, source AS source_id, 'resolved' AS status FROM r"""


@query("o_er_18_new_models", MINTED)
def er_18_new_models(spark, sf):
    """Models minted for every 97th order, in order of the batch."""
    review = review_tables(spark, sf)
    dev = F.concat(F.lit("brand-"), 11 + F.col("id") % 3)
    batch = review.queue.where("id % 97 = 3 AND status = 'pending'").select(F.col("id").alias("position"), F.col("id").alias("queue_id"), F.concat(dev, F.lit("/new-"), "id").alias("slug"), dev.alias("developer_id"), F.lit(None).cast("string").alias("display_name"), F.array(F.concat(F.lit("n"), "id"), F.concat(F.lit("x"), "id")).alias("aliases"))
    organizations = spark.range(11, 14).select(F.concat(F.lit("brand-"), "id").alias("id"), F.lit("b").alias("display_name"), F.array().cast("array<string>").alias("aliases"))
    done = queue.accept_new_models(review.changed(organizations=organizations), batch)
    minted = done.queue.join(done.audit.select("queue_id"), F.col("id") == F.col("queue_id")).select("queue_id", "record_id", F.col("model_id").alias("_m"), "status")
    links = done.records.select(F.col("id").alias("record_id"), "source_id", F.col("alias").alias("first_alias"))
    return done.models.join(minted, F.col("id") == F.col("_m")).join(links, "record_id").select("id", "slug", "developer_id", "first_alias", "source_id", "status")


GUARDS = f"""WITH {QUEUE}, b AS (SELECT id AS queue_id, CASE WHEN id % 5 = 1 THEN -id WHEN id % 5 = 2 THEN NULL ELSE 1 END AS target, 2 * id AS position, 1 AS copy, done FROM q WHERE id % 7 = 2
  UNION ALL SELECT id, 1, 2 * id + 1, 2, done FROM q WHERE id % 7 = 2 AND id % 3 = 0 UNION ALL SELECT -id, 1, 2 * id, 1, FALSE FROM q WHERE id % 31 = 0)
 SELECT position, CAST(queue_id AS VARCHAR) AS item, CASE WHEN target IS NULL THEN 'a number is missing' WHEN target < 0 THEN 'model not found' WHEN queue_id < 0 THEN 'queue row not found' ELSE 'queue row is not pending without a candidate' END AS problem
 FROM b WHERE target IS NULL OR target < 0 OR queue_id < 0 OR done OR copy = 2"""


@query("o_er_18_guards", GUARDS)
def er_18_guards(spark, sf):
    """What stops a batch with unknown models and rows, rows that are done, and rows named twice."""
    review = review_tables(spark, sf)
    some = review.queue.where("id % 7 = 2")
    target = F.when(F.col("id") % 5 == 1, -F.col("id")).when(F.col("id") % 5 != 2, F.lit(1))
    one = some.select((2 * F.col("id")).alias("position"), F.col("id").alias("queue_id"), target.cast("long").alias("model_id"))
    again = some.where("id % 3 = 0").select(2 * F.col("id") + 1, "id", F.lit(1).cast("long"))
    unknown = review.queue.where("id % 31 = 0").select(2 * F.col("id"), -F.col("id"), F.lit(1).cast("long"))
    return queue.accept_problems(review, one.union(again).union(unknown))
