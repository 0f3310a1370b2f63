"""Sources, promoters and sinks: payloads are made from the tables and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import documents, promote
from factloom.operators.ranges import ranked
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import durable, shared_folder, table
from factloom.sources import pages
from factloom.sources.parsers import EVALUATIONS, PARSERS, artificialanalysis_facts, lmarena
from factloom.sources.snapshots import new_snapshots, raw_name


def payload(rows, group, item, wrap=lambda a: a):
    """One JSON body a group of rows (of bounded groups: a few hundred rows)."""
    packed = rows.groupBy(group.alias("snapshot_id")).agg(F.collect_list(item).alias("items"))
    return packed.select("snapshot_id", F.to_json(wrap(F.col("items"))).alias("body"))


def parts(spark, sf):
    return R.model(spark, sf)


def batch():
    return F.expr("id div 100")


@query("o_src_01", with_roles("SELECT id // 100 AS snapshot_id, developer || '/m' || id AS source_model_id, name, CAST(release_date AS VARCHAR) AS release_date, open_weights, CAST(price AS DOUBLE) AS input_price, CASE WHEN id % 2 = 0 THEN CAST(context AS DOUBLE) END AS output_price, CAST(context AS BIGINT) * 1000 AS context FROM model", "model"))
def src_01(spark, sf):
    m = parts(spark, sf)
    cost = F.struct(F.col("price").cast("string").alias("input"), F.when(F.col("id") % 2 == 0, F.col("context").cast("string")).otherwise("NaN").alias("output"))
    one = F.struct(F.concat(F.lit("m"), "id").alias("id"), "name", F.col("release_date").cast("string").alias("release_date"), F.col("open_weights").cast("string").alias("open_weights"), cost.alias("cost"), F.struct((F.col("context") * 1000).cast("string").alias("context")).alias("limit"))
    per = m.groupBy(batch().alias("snapshot_id"), "developer").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), "id"), one))).alias("models"))
    raw = per.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("developer", F.struct("models")))).alias("p")).select("snapshot_id", F.to_json("p").alias("body"))
    return PARSERS["models_dev"](raw).select("snapshot_id", "source_model_id", "name", "release_date", "open_weights", "input_price", "output_price", "context")


@query("o_src_02", with_roles("SELECT id // 100 AS snapshot_id, 'x/m' || id AS source_model_id, round(price / 1e6 * 1e6, 6) AS input_price, round(context / 1e6 * 1e6, 6) AS output_price FROM model", "model"))
def src_02(spark, sf):
    item = F.struct(F.concat(F.lit("x/m"), "id").alias("id"), "name", F.struct((F.col("price") / 1e6).cast("string").alias("prompt"), (F.col("context") / 1e6).cast("string").alias("completion")).alias("pricing"))
    out = PARSERS["openrouter"](payload(parts(spark, sf), batch(), item, lambda a: F.struct(a.alias("data"))))
    return out.select("snapshot_id", "source_model_id", F.round("input_price", 6).alias("input_price"), F.round("output_price", 6).alias("output_price"))


@query("o_src_03", with_roles("SELECT id // 100 AS snapshot_id, 'x/m' || id AS source_model_id, i AS pos, CASE i WHEN 0 THEN 'acme' ELSE 'beta' END AS provider, CASE i WHEN 1 THEN 'eu/west' END AS region, CAST(context AS BIGINT) AS context FROM model, (VALUES (0), (1)) v(i) WHERE id % 5 <> 0", "model"))
def src_03(spark, sf):
    ends = F.array(*[F.struct(F.lit(t).alias("tag"), F.col("context").cast("long").alias("context_length"), F.col("price").cast("string").alias("price")) for t in ("acme", "beta/eu/west")])
    item = F.struct(F.concat(F.lit("x/m"), "id").alias("model_id"), F.when(F.col("id") % 5 == 0, 404).otherwise(200).alias("status"), ends.alias("endpoints"))
    return PARSERS["openrouter_endpoints"](payload(parts(spark, sf), batch(), item)).select("snapshot_id", "source_model_id", "pos", "provider", "region", "context")


@query("o_src_05", with_roles("SELECT model_id, kind AS category, elo AS rating FROM series WHERE kind IN ('view', 'click') AND id % 6 <> 0", "series"))
def src_05(spark, sf):
    rating = F.when(F.col("id") % 12 == 0, float("nan")).when(F.col("id") % 6 == 0, None).otherwise(F.col("elo"))
    return lmarena(R.series(spark, sf).select("model_id", F.col("kind").alias("category"), rating.alias("rating")), ["view", "click"])


@query("o_src_06", with_roles("SELECT id // 100 AS snapshot_id, CAST(id AS VARCHAR) AS source_model_id, b AS benchmark_id, CASE b WHEN 'gpqa' THEN CAST(price AS DOUBLE) ELSE CAST(context AS DOUBLE) END AS score FROM model, (VALUES ('gpqa'), ('mmlu')) v(b)", "model"))
def src_06(spark, sf):
    scores = F.create_map(F.lit("gpqa"), F.col("price").cast("string"), F.lit("mmlu"), F.col("context").cast("string"))
    item = F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), "id").alias("slug"), scores.alias("evaluations"))
    return PARSERS["artificialanalysis"](payload(parts(spark, sf), batch(), item, lambda a: F.struct(a.alias("models"))))


FACTS = """m AS (SELECT id, id // 100 AS snapshot_id, CASE WHEN id % 3 = 2 THEN 's' || id ELSE CAST(id AS VARCHAR) END AS source_model_id, 'm' || id AS name, CASE WHEN id % 2 = 0 THEN 'Acme' END AS creator, CASE WHEN id % 3 > 0 THEN 's' || id END AS slug, 'm' || id AS model_version, CAST(context AS VARCHAR) AS c FROM model),
 w AS (SELECT id, snapshot_id, source_model_id, name, creator, slug, model_version, c FROM m),
 facts AS (SELECT * EXCLUDE (id, c), 'evaluation' AS kind, 'gpqa' AS field, c || '%' AS value FROM w UNION ALL SELECT * EXCLUDE (id, c), 'evaluation', 'own', c FROM w
 UNION ALL SELECT * EXCLUDE (id, c), 'evaluation', 'hle', c FROM w WHERE id % 4 = 1 UNION ALL SELECT * EXCLUDE (id, c), 'pricing', 'price_1m_input_tokens', c FROM w
 UNION ALL SELECT * EXCLUDE (id, c), 'capability', 'release_date', '2025-01-01' FROM w WHERE id % 5 = 0)"""


@query("o_src_06_facts", with_roles(f"WITH {FACTS} SELECT * FROM facts", "model"))
def src_06_facts(spark, sf):
    """Payloads that are lists, objects of rows, or rows under a key; fields in the object of their kind, in the row, or deep inside."""
    m = parts(spark, sf).withColumn("c", F.col("context").cast("string"))
    deep = F.struct(F.struct(F.when(F.col("id") % 4 == 1, F.col("c")).alias("hle"), F.when(F.col("id") % 5 == 0, "2025-01-01").alias("release_date")).alias("more"))
    item = F.struct(
        F.when(F.col("id") % 3 != 2, F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), "id")).alias("slug"), F.concat(F.lit("m"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.struct(F.lit("Acme").alias("name"))).alias("model_creator"),
        F.struct(F.when(F.col("id") % 2 == 0, F.concat("c", F.lit("%"))).alias("gpqa"), F.col("c").alias("own"), F.lit("n/a").alias("aime")).alias("evaluations"), F.when(F.col("id") % 2 == 1, F.concat("c", F.lit("%"))).alias("gpqa"),
        F.struct(F.struct(F.col("c").alias("price_1m_input_tokens")).alias("usd")).alias("pricing"), deep.alias("extra"),
    )
    packed = m.groupBy(batch().alias("snapshot_id")).agg(F.collect_list(item).alias("items"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), "id"), item))).alias("named"))
    k = F.col("snapshot_id") % 3
    body = F.when(k == 0, F.to_json("items")).when(k == 1, F.to_json(F.struct(F.array().cast("array<int>").alias("data"), F.col("items").alias("results")))).otherwise(F.to_json(F.struct(F.col("named").alias("data"))))
    return artificialanalysis_facts(packed.select("snapshot_id", body.alias("body")))


@query("o_src_07", with_roles("SELECT id // 100 AS snapshot_id, 'r/' || id AS source_model_id, CASE WHEN id % 2 = 0 THEN 'm-q4_k_m.gguf' ELSE 'm.safetensors' END AS file, CAST(context AS BIGINT) AS size, CASE WHEN id % 2 = 0 THEN 'gguf' ELSE 'safetensors' END AS format, CASE WHEN id % 2 = 0 THEN 'gguf:q4_k_m' END AS quantization FROM model WHERE id % 7 <> 0", "model"))
def src_07(spark, sf):
    name = F.when(F.col("id") % 2 == 0, "m-q4_k_m.gguf").otherwise("m.safetensors")
    item = F.struct(F.concat(F.lit("r/"), "id").alias("repo_id"), F.when(F.col("id") % 7 == 0, 401).otherwise(200).alias("status"), F.array(F.lit("text")).alias("tags"), F.array(F.struct(name.alias("rfilename"), F.col("context").cast("long").alias("size"))).alias("siblings"))
    return PARSERS["huggingface"](payload(parts(spark, sf), batch(), item))


@query("o_src_08", with_roles("SELECT id // 100 AS snapshot_id, 'Arch' || id AS source_model_id, CASE WHEN id % 2 = 0 THEN '_MULTIMODAL_MODELS' ELSE '_TRANSFORMERS_BACKEND_MODELS' END AS registry, CASE WHEN id % 10 = 0 THEN 'transformers' ELSE 'mod.m' || context END AS module, 'Cls' || id AS class, CASE WHEN id % 10 = 0 OR id % 2 = 1 THEN 'transformers' ELSE 'native' END AS backend FROM model", "model"))
def src_08(spark, sf):
    """Registries with both kinds of quotes, comments, line breaks and entries that name no model."""
    module = F.when(F.col("id") % 10 == 0, "transformers").otherwise(F.concat(F.lit("mod.m"), "context"))
    double = F.concat(F.lit('    "Arch'), "id", F.lit('": ("'), module, F.lit('", "Cls'), "id", F.lit('"),  # "Old": ("a", "b"),'))
    single = F.concat(F.lit("    'Arch"), "id", F.lit("': (\n        '"), module, F.lit("',\n        'Cls"), "id", F.lit("',\n    ), 'Three' : ('a', 'b', 'c'), 7: ('a', 'b'),"))
    line = F.when(F.col("id") % 3 == 0, single).otherwise(double)
    of = lambda odd: F.array_join(F.collect_list(F.when(F.col("id") % 2 == odd, line)), "\n")
    raw = parts(spark, sf).groupBy(batch().alias("snapshot_id")).agg(of(0).alias("even"), of(1).alias("odd"))
    head, other = "import os\n_MULTIMODAL_MODELS = {\n", '\n}\n_OTHER = {"No": ("a", "b")}\n_TRANSFORMERS_BACKEND_MODELS = {\n'
    return PARSERS["vllm"](raw.select("snapshot_id", F.concat(F.lit(head), "even", F.lit(other), "odd", F.lit("\n}\n")).alias("body")))


@query("o_src_09", with_roles("SELECT id // 100 AS snapshot_id, 'verified-set' AS benchmark_id, 'm' || id AS source_model_id, CASE WHEN id % 2 = 0 THEN CAST(context AS DOUBLE) ELSE round(context / 100.0 * 100, 6) END AS score FROM model", "model"))
def src_09(spark, sf):
    one = F.struct(F.concat(F.lit("m"), "id").alias("name"), F.col("release_date").cast("string").alias("date"), F.when(F.col("id") % 2 == 0, F.col("context").cast("string")).alias("resolved"), (F.col("context") / 100).cast("string").alias("resolve_rate"))
    raw = payload(parts(spark, sf), batch(), one, lambda a: F.struct(F.array(F.struct(F.lit("Verified Set").alias("name"), a.alias("results"))).alias("leaderboards")))
    return PARSERS["swebench"](raw).select("snapshot_id", "benchmark_id", "source_model_id", F.round("score", 6).alias("score"))


@query("o_src_10", with_roles("SELECT id // 100 AS snapshot_id, 'm' || id AS model, CAST(context AS DOUBLE) AS pass_rate FROM model", "model"))
def src_10(spark, sf):
    text = F.concat(F.lit("- dirname: d"), "id", F.lit("\n  model: 'm"), "id", F.lit("'\n  pass_rate_2: "), "context")
    raw = parts(spark, sf).groupBy(batch().alias("snapshot_id")).agg(F.array_join(F.collect_list(text), "\n").alias("body"))
    long = PARSERS["aider"](raw)
    return long.groupBy("snapshot_id", "record").pivot("key", ["model", "pass_rate_2"]).agg(F.first("value")).select("snapshot_id", "model", F.col("pass_rate_2").try_cast("double").alias("pass_rate"))


@query("o_src_11", with_roles("SELECT id // 100 AS snapshot_id, 'm' || id AS source_model_id, CAST(context AS DOUBLE) AS score, 2.5::DOUBLE AS ci FROM model WHERE id % 9 <> 0", "model"))
def src_11(spark, sf):
    item = F.struct(F.when(F.col("id") % 9 != 0, F.concat(F.lit("m"), "id")).alias("model"), F.when(F.col("id") % 2 == 0, F.col("context") / 100).otherwise(F.when(F.col("context") > 1, F.col("context")).otherwise(F.lit(0.01))).cast("string").alias("score"), F.array(F.lit(10.0), F.lit(15.0)).alias("ci"))
    out = PARSERS["deepswe"](payload(parts(spark, sf), batch(), item, lambda a: F.struct(a.alias("rows"))))
    return out.select("snapshot_id", "source_model_id", F.round("score", 6).alias("score"), "ci")


@query("o_src_12", with_roles("""SELECT id // 100 AS snapshot_id, 'frontierswe_v2::m' || id AS source_model_id, 'M' || id AS name, CASE WHEN id % 2 = 0 THEN 'Moonshot AI' ELSE 'Acme' END AS vendor, 'prox' AS harness, CAST(context AS DOUBLE) AS mean, 1.5::DOUBLE AS worst, 99.0::DOUBLE AS best,
 CASE WHEN w THEN id % 100 END AS rank, CASE WHEN w THEN 5.3::DOUBLE END AS ci, CASE WHEN w AND id % 3 > 0 THEN 9.25::DOUBLE END AS cost, CASE WHEN w THEN CASE WHEN id % 5 = 0 THEN 1.17::DOUBLE ELSE 11.5 END END AS hours
 FROM (SELECT *, (id // 100) % 4 < 3 AS w FROM model)""", "model"))
def src_12(spark, sf):
    """Rows with their markup; every fourth page has none of the separators."""
    title = F.concat(F.lit('<div title="'), F.when(F.col("id") % 2 == 0, "Moonshot AI").otherwise("Acme"), F.lit(" M"), "id", F.lit(" + prox: mean@5 "), "context", F.lit('%, worst@5 1.5%, best@5 99%" class="grid">'))
    cost = F.when(F.col("id") % 3 > 0, "<span>$9.25</span>").otherwise("")
    row = F.concat(F.lit('<span class="x tabular-nums y"> '), (F.col("id") % 100).cast("string"), F.lit("</span><span>±<!-- -->5.3</span>"), cost, F.lit("<span>"), F.when(F.col("id") % 5 == 0, "70m").otherwise("11.5h"), F.lit("</span></div>\n"))
    end = F.when(batch() % 4 < 3, '<div class="relative h-5">').otherwise("<p>")
    raw = parts(spark, sf).groupBy(batch().alias("snapshot_id")).agg(F.array_join(F.collect_list(F.concat(title, row, end)), "").alias("body"))
    return PARSERS["frontierswe"](raw)


@query("o_src_13", with_roles("SELECT id // 100 AS snapshot_id, 'm' || id AS source_model_id, 'MMBench' AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model", "model"))
def src_13(spark, sf):
    block = F.create_map(F.lit("META"), F.create_map(F.lit("Overall"), F.lit("1")), F.lit("MMBench"), F.create_map(F.lit("Overall"), F.col("context").cast("string")))
    raw = parts(spark, sf).groupBy(batch().alias("snapshot_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), "id"), block))).alias("r")).select("snapshot_id", F.to_json(F.struct(F.col("r").alias("results"))).alias("body"))
    return PARSERS["openvlm"](raw)


@query("o_src_14", with_roles("SELECT 'org/m' || id AS source_model_id, b AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model, (VALUES ('complete'), ('instruct')) v(b) WHERE b = 'complete' OR id % 2 = 0", "model"))
def src_14(spark, sf):
    """Rows in pages of 100, kept a hundred pages a folder, a page a line; the scan plans as many pages as the first one says."""
    row = F.struct(F.concat(F.lit("https://hf.example/org/m"), "id").alias("link"), F.col("context").cast("string").alias("complete"), F.when(F.col("id") % 2 == 0, F.col("context").cast("string")).alias("instruct"))
    m = ranked(parts(spark, sf), [], "id").withColumn("page", F.floor(F.col("_i") / 100).cast("int"))
    bodies = m.groupBy("page", "_n").agg(F.collect_list(F.struct(row.alias("row"))).alias("rows")).select("page", F.to_json(F.struct("rows", F.when(F.col("page") == 0, F.col("_n")).alias("num_rows_total"))).alias("value"))
    root = shared_folder(spark, "pages")
    lines = bodies.select(F.floor(F.col("page") / 100).alias("block"), F.concat("page", F.lit("\t"), "value").alias("value"))
    lines.repartition("block").write.partitionBy("block").text(root)
    held = {}  # the block that a task read last: its pages come one after the other

    def fetch(offset: int, length: int) -> str:
        from pyarrow import fs

        page = offset // length
        if page // 100 not in held:
            where, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
            files = where.get_file_info(fs.FileSelector(f"{path}/block={page // 100}"))
            text = "".join(where.open_input_stream(f.path).read().decode() for f in files if f.path.endswith(".txt"))
            held.clear()
            held[page // 100] = dict(line.split("\t", 1) for line in text.split("\n") if line)
        return held[page // 100].get(str(page), "")

    return PARSERS["bigcodebench"](pages.read_pages(spark, fetch, 100)).drop("offset")


WIDE = """SELECT id // 100 AS snapshot_id, 'm' || id || CASE WHEN (id // 100) % 2 = 1 AND id % 4 = 1 THEN ',' || chr(10) || '"q"' ELSE '' END AS source_model_id, b AS benchmark_id, CASE b WHEN 'Average' THEN CAST(context AS DOUBLE) ELSE CAST(id AS DOUBLE) END AS score
 FROM model, (VALUES ('Average'), ('IFEval')) v(b) WHERE b = 'Average' OR (id // 100) % 2 = 0 OR id % 6 <> 3"""


def wide_name():
    """The name of a model in ``csv_or_json``."""
    return F.concat(F.lit("m"), "id", F.when((batch() % 2 == 1) & (F.col("id") % 4 == 1), ',\n"q"').otherwise(""))


def csv_or_json(spark, sf, name):
    """Half of the bodies are CSV: names with commas, line breaks and quotes, a name for two columns, records that end early, blank lines."""
    m = parts(spark, sf).withColumn("b", batch())
    row = F.create_map(F.lit(name), F.concat(F.lit("m"), "id"), F.lit("Average"), F.concat("context", F.lit(" %")), F.lit("IFEval"), F.col("id").cast("string"), F.lit("Type"), F.lit("chat"))
    j = m.where("b % 2 = 0").groupBy("b").agg(F.collect_list(row).alias("r")).select(F.col("b").alias("snapshot_id"), F.to_json("r").alias("body"))
    rest = F.when(F.col("id") % 6 == 3, "").otherwise(F.concat(F.lit(","), "id", F.lit(',"chat, tuned",extra')))
    line = F.concat(F.lit('"m'), "id", F.when(F.col("id") % 4 == 1, ',\n""q""').otherwise(""), F.lit('",7,'), "context", F.lit("%"), rest, F.when(F.col("id") % 5 == 0, "\r\n").otherwise(""))
    c = m.where("b % 2 = 1").groupBy("b").agg(F.array_join(F.collect_list(line), "\r\n").alias("l")).select(F.col("b").alias("snapshot_id"), F.concat(F.lit(f"{name},Average,Average,IFEval,Type\r\n"), "l").alias("body"))
    return j.union(c)


@query("o_src_15", with_roles(WIDE, "model"))
def src_15(spark, sf):
    return PARSERS["open_llm_lb"](csv_or_json(spark, sf, "fullname"))


@query("o_src_16", with_roles(WIDE, "model"))
def src_16(spark, sf):
    return PARSERS["mteb"](csv_or_json(spark, sf, "model_name"))


@query("o_src_17", with_roles("SELECT id // 100 AS snapshot_id, 'slug' || id AS source_model_id, CAST(context AS DOUBLE) AS tps FROM model WHERE id % 3 <> 0", "model"))
def src_17(spark, sf):
    conf = F.struct(F.col("id").cast("string").alias("key"), F.concat(F.lit("slug"), "id").alias("canonicalSlug"), F.concat(F.lit("sel"), "id").alias("ompSelector"))
    rec = F.struct(F.concat(F.lit("sel"), "id").alias("model"), F.when(F.col("id") % 3 == 0, "error").otherwise("ok").alias("status"), F.col("context").cast("string").alias("tps"))
    raw = parts(spark, sf).groupBy(batch().alias("snapshot_id")).agg(F.collect_list(conf).alias("models"), F.collect_list(rec).alias("records")).select("snapshot_id", F.to_json(F.struct("models", "records")).alias("body"))
    return PARSERS["omp_speedtest"](raw)


@query("o_src_20", "SELECT 'pages' AS source_id, url, sha256(html) AS content_hash, min(page_id) AS id FROM pages GROUP BY ALL")
def src_20(spark, sf):
    p = table(spark, sf, "pages").select("url", F.sha2("html", 256).alias("content_hash"), F.col("page_id").alias("id"), F.col("page_id").alias("fetched_at"))
    known = p.where("id % 3 = 0").groupBy(F.lit("pages").alias("source_id"), "url", "content_hash").agg(F.min("id").alias("id"), F.min("fetched_at").alias("fetched_at"))
    every = new_snapshots(known, p, "pages")
    # a later row of a known payload may have the lesser number
    return every.select("source_id", "url", "content_hash").join(p.groupBy("url", "content_hash").agg(F.min("id").alias("id")), ["url", "content_hash"])


@query("o_src_21", with_roles("SELECT DISTINCT source_id, upper(source_id) AS name FROM snapshot", "snapshot"))
def src_21(spark, sf):
    return R.snapshot(spark, sf).select("source_id").distinct().withColumn("name", F.upper("source_id"))


# promoters


@query("o_pro_01", with_roles("SELECT id AS model_id, c AS component, CASE c WHEN 'input_token' THEN CAST(price AS DOUBLE) ELSE CAST(context AS DOUBLE) END AS amount FROM model, (VALUES ('input_token'), ('output_token')) v(c) WHERE c = 'input_token' OR id % 2 = 0", "model"))
def pro_01(spark, sf):
    recs = src_01(spark, sf)
    links = parts(spark, sf).select(F.concat("developer", F.lit("/m"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.prices(promote.linked(recs, links, False), {"input_price": "input_token", "output_price": "output_token"}, ["model_id"])


@query("o_pro_02", with_roles("SELECT provider_id, balance > 0 AS direct, min(id) AS id FROM surface GROUP BY ALL", "surface"))
def pro_02(spark, sf):
    from factloom.operators.picks import keep_first

    s = R.surface(spark, sf).select("provider_id", (F.col("balance") > 0).alias("direct"), "id")
    return keep_first(s, ["provider_id", "direct"], [F.asc("id")])


@query("o_pro_03", with_roles("SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN name END, CASE WHEN id % 3 = 1 THEN 'p' || provider_id END, 'none') AS label FROM surface", "surface"))
def pro_03(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.when(F.col("id") % 3 == 0, F.col("name")).alias("display")).alias("meta"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("p"), "provider_id")).alias("provider")))
    s = R.surface(spark, sf).select("id", doc.alias("d"))
    return s.select("id", F.coalesce(F.get_json_object("d", "$.meta.display"), F.get_json_object("d", "$.provider"), F.lit("none")).alias("label"))


@query("o_pro_04", with_roles("SELECT id AS model_id, c AS capability, CASE c WHEN 'context' THEN CAST(context AS VARCHAR) ELSE family END AS value FROM model, (VALUES ('context'), ('family')) v(c) WHERE c = 'family' OR id % 4 <> 0", "model"))
def pro_04(spark, sf):
    m = parts(spark, sf).select(F.col("id").alias("model_id"), F.when(F.col("id") % 4 != 0, F.col("context")).alias("context"), "family")
    return promote.capabilities(m, ["context", "family"], ["model_id"])


@query("o_pro_05", with_roles("SELECT r.model_id, r.benchmark_id, r.score FROM result r WHERE r.snapshot_id = (SELECT max(snapshot_id) FROM result x WHERE x.benchmark_id = r.benchmark_id)", "result"))
def pro_05(spark, sf):
    return promote.newest(R.result(spark, sf), "benchmark_id", "snapshot_id").select("model_id", "benchmark_id", "score")


@query("o_pro_06", with_roles("SELECT s.id, m.id AS model_id, s.elo FROM series s LEFT JOIN (SELECT id FROM model WHERE id % 2 = 0) m ON m.id = s.model_id", "series", "model"))
def pro_06(spark, sf):
    links = parts(spark, sf).where("id % 2 = 0").select(F.col("id").alias("source_model_id"), F.col("id").alias("model_id"))
    recs = R.series(spark, sf).select("id", F.col("model_id").alias("source_model_id"), "elo")
    return promote.linked(recs, links, True).select("id", "model_id", "elo")


@query("o_pro_07", with_roles("SELECT id AS model_id, 'MMBench' AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model UNION ALL SELECT id, 'verified-set', CASE WHEN id % 2 = 0 THEN CAST(context AS DOUBLE) ELSE round(context / 100.0 * 100, 6) END FROM model", "model"))
def pro_07(spark, sf):
    recs = src_13(spark, sf).select("source_model_id", "benchmark_id", "score").union(src_09(spark, sf).select("source_model_id", "benchmark_id", "score"))
    links = parts(spark, sf).select(F.concat(F.lit("m"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(recs, links, True).select("model_id", "benchmark_id", "score")


@query("o_pro_08", with_roles("SELECT id AS model_id, 'Average' AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model UNION ALL SELECT id, 'IFEval', CAST(id AS DOUBLE) FROM model WHERE ((id // 100) % 2 = 0 OR id % 6 <> 3)", "model"))
def pro_08(spark, sf):
    links = parts(spark, sf).select(wide_name().alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(src_15(spark, sf), links, True).select("model_id", "benchmark_id", "score")


@query("o_pro_09", with_roles("SELECT id AS model_id, 'Average' AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model WHERE id % 3 = 0 UNION ALL SELECT id, 'IFEval', CAST(id AS DOUBLE) FROM model WHERE id % 3 = 0 AND ((id // 100) % 2 = 0 OR id % 6 <> 3)", "model"))
def pro_09(spark, sf):
    links = parts(spark, sf).where("id % 3 = 0").select(wide_name().alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(src_16(spark, sf), links, False).select("model_id", "benchmark_id", "score")


@query("o_pro_10", with_roles("SELECT id AS model_id, 'deepswe' AS benchmark_id, CAST(context AS DOUBLE) AS score FROM model WHERE id % 9 <> 0 UNION ALL SELECT NULL, 'frontierswe', CAST(context AS DOUBLE) FROM model", "model"))
def pro_10(spark, sf):
    links = parts(spark, sf).select(F.concat(F.lit("m"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    recs = src_11(spark, sf).select("source_model_id", F.lit("deepswe").alias("benchmark_id"), "score").union(src_12(spark, sf).select("source_model_id", F.lit("frontierswe").alias("benchmark_id"), F.col("mean").alias("score")))
    return promote.linked(recs, links, True).select("model_id", "benchmark_id", "score")


#: What fields of a payload are called as capabilities and as price components.
CAPABILITY_NAMES = {"median_output_tokens_per_second": "median_output_tokens_per_second", "median_time_to_first_token_seconds": "median_time_to_first_token_seconds", "median_time_to_first_answer_token": "median_time_to_first_answer_token", "artificial_analysis_release_date": "release_date"}
COMPONENTS = {"price_1m_input_tokens": "input_token", "price_1m_output_tokens": "output_token", "price_1m_blended_3_to_1": "blended_token"}


@query("o_pro_11", with_roles(f"""WITH {FACTS}, f AS (SELECT facts.*, l.id AS model_id FROM facts LEFT JOIN (SELECT id, source_model_id FROM m WHERE id % 2 = 0) l USING (source_model_id))
 SELECT 'results' AS part, snapshot_id, source_model_id, model_id, field AS name, CAST(replace(value, '%', '') AS DOUBLE) AS number, NULL AS text FROM f WHERE kind = 'evaluation' AND field <> 'own'
 UNION ALL SELECT 'capabilities', snapshot_id, source_model_id, model_id, 'artificial_analysis_release_date', NULL, value FROM f WHERE kind = 'capability' AND model_id IS NOT NULL
 UNION ALL SELECT 'prices', snapshot_id, source_model_id, model_id, 'input_token', CAST(value AS DOUBLE), '{{"model_version":"' || model_version || '"' || CASE WHEN slug IS NULL THEN '' ELSE ',"slug":"' || slug || '"' END || '}}' FROM f WHERE kind = 'pricing' AND model_id IS NOT NULL
 UNION ALL SELECT DISTINCT 'reviews', snapshot_id, source_model_id, NULL, NULL, NULL, NULL FROM f WHERE model_id IS NULL""", "model"))
def pro_11(spark, sf):
    """Results, capabilities, prices and reviews from one parse; half of the records have a model."""
    linked = F.when(F.col("id") % 3 == 2, F.concat(F.lit("s"), "id")).otherwise(F.col("id").cast("string"))
    links = parts(spark, sf).where("id % 2 = 0").select(linked.alias("source_model_id"), F.col("id").alias("model_id"))
    p = promote.measured(durable(src_06_facts(spark, sf)), links, EVALUATIONS, {v: k for k, v in CAPABILITY_NAMES.items()}, COMPONENTS)
    one = lambda part, name, number, text: p[part].select(F.lit(part).alias("part"), "snapshot_id", "source_model_id", "model_id", name.alias("name"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    none = F.lit(None)
    out = one("results", F.col("benchmark_id"), F.col("score"), none).union(one("capabilities", F.col("capability"), none, F.col("value"))).union(one("prices", F.col("component"), F.col("amount"), F.col("condition")))
    return out.union(p["reviews"].select(F.lit("reviews"), "snapshot_id", "source_model_id", none.cast("long"), none.cast("string"), none.cast("double"), none.cast("string")))


@query("o_pro_12", with_roles("SELECT id AS model_id, CAST(context AS DOUBLE) AS tps FROM model WHERE id % 3 <> 0", "model"))
def pro_12(spark, sf):
    slug = parts(spark, sf).select(F.concat(F.lit("slug"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(src_17(spark, sf), slug, False).select("model_id", "tps")


@query("o_pro_13", with_roles("SELECT id AS model_id, c AS capability, CASE c WHEN 'module' THEN CASE WHEN id % 10 = 0 THEN 'transformers' ELSE 'mod.m' || context END ELSE 'Cls' || id END AS value FROM model, (VALUES ('module'), ('class')) v(c)", "model"))
def pro_13(spark, sf):
    links = parts(spark, sf).select(F.concat(F.lit("Arch"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.capabilities(promote.linked(src_08(spark, sf), links, False), ["module", "class"], ["model_id"])


@query("o_pro_14", with_roles("SELECT id AS model_id, CASE WHEN id % 2 = 0 THEN 'gguf' ELSE 'safetensors' END AS format, 1::BIGINT AS files FROM model WHERE id % 7 <> 0", "model"))
def pro_14(spark, sf):
    links = parts(spark, sf).select(F.concat(F.lit("r/"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(src_07(spark, sf), links, False).groupBy("model_id", "format").agg(F.count("*").alias("files"))


@query("o_pro_15", with_roles("SELECT id AS model_id, CAST(count(*) AS BIGINT) AS routes FROM model, (VALUES (0), (1)) v(i) WHERE id % 5 <> 0 GROUP BY 1", "model"))
def pro_15(spark, sf):
    links = parts(spark, sf).select(F.concat(F.lit("x/m"), "id").alias("source_model_id"), F.col("id").alias("model_id"))
    return promote.linked(src_03(spark, sf), links, False).groupBy("model_id").agg(F.count("*").alias("routes"))


@query("o_pro_16", with_roles("SELECT id, 'intro' AS tier, price * 0.5 AS amount, release_date AS valid_from, CAST(release_date + to_days(CAST(context AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS valid_to FROM model WHERE id % 2 = 0 UNION ALL SELECT id, 'standard', price, CASE WHEN id % 2 = 0 THEN CAST(release_date + to_days(CAST(context AS INTEGER)) AS DATE) ELSE release_date END, NULL FROM model", "model"))
def pro_16(spark, sf):
    m = parts(spark, sf).withColumn("intro", F.when(F.col("id") % 2 == 0, F.col("price") * 0.5))
    return promote.price_windows(m, "id", "release_date", "context", "intro", "price")


@query("o_pro_17", with_roles("SELECT id, b AS benchmark_id, CASE b WHEN 'p' THEN CAST(price AS DOUBLE) ELSE CAST(context AS DOUBLE) END AS score FROM model, (VALUES ('p'), ('c')) v(b) WHERE b = 'p' OR id % 2 = 0", "model"))
def pro_17(spark, sf):
    m = parts(spark, sf).select("id", F.array(F.col("price"), F.when(F.col("id") % 2 == 0, F.col("context").cast("double"))).alias("v"))
    return promote.matrix(m, "id", "v", ["p", "c"])


@query("o_pro_17_cells", with_roles("""WITH s AS (SELECT id, 's' || id AS set_id, context, price, id % 4 = 0 AS nocol, release_date FROM model),
 c AS (SELECT s.*, b, col FROM s, (VALUES ('p'), ('c'), ('x')) v(b), (VALUES ('own'), ('next'), ('rival')) w(col)),
 t AS (SELECT *, CASE WHEN b = 'c' AND id % 2 = 1 THEN NULL WHEN b = 'p' THEN CAST(price AS DOUBLE) ELSE CAST(context AS DOUBLE) END + CASE col WHEN 'own' THEN 0 WHEN 'next' THEN 1 ELSE 2 END AS v,
  CASE col WHEN 'own' THEN id WHEN 'next' THEN id + 100000 * (id % 3 // 2) + 1 END AS mid FROM c),
 k AS (SELECT *, CASE WHEN col = 'rival' OR v IS NULL THEN 'skipped' WHEN b = 'x' THEN 'unknown benchmark' WHEN mid NOT IN (SELECT id FROM model) THEN 'unresolved' ELSE 'taken' END AS status FROM t)
 SELECT set_id, b || '!' AS row_label, col AS column_label, status, CASE WHEN status = 'taken' THEN mid END AS model_id, CASE WHEN status = 'taken' THEN b END AS benchmark_id, CASE WHEN status = 'taken' THEN v END AS score, CASE WHEN status = 'taken' THEN '%' END AS metric,
  CASE WHEN status = 'taken' THEN CASE WHEN b = 'p' AND col = 'own' THEN '{"effort":"max","tools":"no"}' WHEN b = 'p' THEN '{"effort":"high","tools":"no"}' WHEN col = 'own' THEN '{"effort":"max"}' ELSE '{"effort":"low"}' END END AS condition, CASE WHEN status = 'taken' THEN release_date END AS measured_at FROM k""", "model"))
def pro_17_cells(spark, sf):
    """A table of three rows and three columns for each model: its own column, another model's (some unknown), and a comparison."""
    m = parts(spark, sf)
    kind = "map<string,string>"
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv]).cast(kind)
    column = lambda label, slug, condition: F.struct(F.lit(label).alias("label"), slug.alias("slug"), condition.alias("condition"))
    other = F.col("id") + 100000 * F.floor(F.col("id") % 3 / 2).cast("long") + 1
    columns = F.array(column("own", F.concat(F.lit("m"), "id"), pairs("effort", "max")), column("next", F.concat(F.lit("m"), other), F.lit(None).cast(kind)), column("rival", F.lit(None).cast("string"), F.lit(None).cast(kind)))
    row = lambda b, v, condition: F.struct(F.lit(b).alias("benchmark_id"), F.lit(f"{b}!").alias("label"), F.lit("%").alias("metric"), F.array(v, v + 1, v + 2).alias("values"), condition.alias("condition"))
    price, context = F.col("price").cast("double"), F.col("context").cast("double")
    rows = F.array(row("p", price, pairs("tools", "no", "effort", "high")), row("c", F.when(F.col("id") % 2 == 0, context), pairs()), row("x", context, F.lit(None).cast(kind)))
    sets = m.select(F.concat(F.lit("s"), "id").alias("set_id"), F.col("release_date").alias("published_at"), pairs("effort", "low").alias("condition"), columns.alias("columns"), rows.alias("rows"))
    return promote.launch_cells(sets, m.select("id", F.concat(F.lit("m"), "id").alias("slug")), spark.range(1).select(F.explode(F.array(F.lit("p"), F.lit("c"))).alias("id")))


# sinks


@query("o_snk_03", with_roles("SELECT '| ' || id || ' | ' || replace(developer, '#', '\\|') || ' | ' || replace(name, ' ', ' ') || ' |' AS line FROM model", "model"))
def snk_03(spark, sf):
    m = parts(spark, sf).select("id", F.replace("developer", F.lit("#"), F.lit("|")).alias("developer"), F.replace("name", F.lit(" "), F.lit("\n")).alias("name"))
    return documents.markdown_rows(m, ["id", "developer", "name"])


@query("o_snk_04", with_roles("SELECT id, strftime(fetched_at, '%Y%m%dT%H%M%S') || '_' || substr(sha256(source_id), 1, 8) || '.raw' AS file FROM snapshot", "snapshot"))
def snk_04(spark, sf):
    return R.snapshot(spark, sf).select("id", raw_name(F.col("fetched_at"), F.sha2("source_id", 256)).alias("file"))


@query("o_snk_05", with_roles("SELECT '{\"errors\":' || e || ',\"warnings\":' || w || ',\"blocked\":' || (e > 0) || '}' AS value FROM (SELECT count(*) FILTER (WHERE balance < 0) AS e, count(*) FILTER (WHERE balance >= 0) AS w FROM surface)", "surface"))
def snk_05(spark, sf):
    from factloom.operators.gates import summary

    found = R.surface(spark, sf).select(F.when(F.col("balance") < 0, "error").otherwise("warning").alias("severity"))
    return documents.as_json(summary(found))


@query("o_snk_07", with_roles("SELECT 'src' || id AS source, CASE WHEN balance < 0 THEN 'failed' ELSE 'ok' END AS status FROM surface", "surface"))
def snk_07(spark, sf):
    line = F.concat(F.lit("  src"), "id", F.lit(": "), F.when(F.col("balance") < 0, "FAILED timeout").otherwise("ok 12 records"))
    return documents.status_from_log(R.surface(spark, sf).select(line.alias("value"))).select("source", "status")
