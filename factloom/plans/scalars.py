"""Scalar functions over names, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import jsonx as J
from factloom.functions import text as X
from factloom.operators import gates
from factloom.plans import roles as R
from factloom.plans.registry import query
from factloom.plans.roles import with_roles
from factloom.session import table

ENDINGS = ["", "-thinking", " Preview", "-2024-05-01", "_high", ":free", "-q4_k_m.gguf", "-thinking-32k-20240501"]
STARTS = ["", "us.", "bedrock/", "azure-ai/", "Vertex_AI:"]


def _sql_list(v):
    return "[" + ", ".join("'" + x + "'" for x in v) + "]"


ALIAS = f"SELECT p_partkey AS id, {_sql_list(STARTS)}[p_partkey % 5 + 1] || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '_') || '-' || p_size || '.' || (p_partkey % 10) || {_sql_list(ENDINGS)}[p_partkey % 8 + 1] AS s FROM part"


def aliases(spark, sf):
    """Names as sources write them: prefixes, separators, versions, endings."""
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % n + 1).cast("int"))
    s = F.concat(pick(STARTS, 5), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 10, pick(ENDINGS, 8))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))


def with_alias(body: str) -> str:
    return f"WITH a AS ({ALIAS}) {body}"


def norm(s: str) -> str:
    dots = f"regexp_replace(regexp_replace(lower(trim({s})), '([0-9])\\.([0-9])', '\\1-\\2', 'g'), '([0-9])\\.([0-9])', '\\1-\\2', 'g')"
    return f"trim(regexp_replace({dots}, '[\\s_/-]+', '-', 'g'), '-')"


@query("o_str_01", with_alias(f"SELECT id, {norm('s')} AS n FROM a"))
def str_01(spark, sf):
    return aliases(spark, sf).select("id", X.normalize_alias(F.col("s")).alias("n"))


@query("o_str_02", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 AND o_orderdate <> TIMESTAMP '1996-07-04' THEN ',1996-07-04' ELSE '' END AS dates FROM orders")
def str_02(spark, sf):
    s = F.concat(F.lit("v1-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" x "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "_19960704").otherwise(""))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(X.date_tokens(s), ",").alias("dates"))


@query("o_str_03", with_alias("SELECT id, [NULL, 'us', 'bedrock', 'azure_ai', 'vertex_ai'][id % 5 + 1] AS prefix FROM a"))
def str_03(spark, sf):
    return aliases(spark, sf).select("id", X.surface_prefix(F.col("s")).alias("prefix"))


@query("o_str_04", with_alias("SELECT id, ['', 'thinking', 'preview', '', 'high', 'free', 'gguf,q4_k_m', 'thinking'][id % 8 + 1] AS marks FROM a"))
def str_04(spark, sf):
    return aliases(spark, sf).select("id", F.array_join(X.modifiers(F.col("s")), ",").alias("marks"))


@query("o_str_05", "SELECT p_partkey AS id, ['anthropic', 'openai', 'meta', 'zhipuai', 'acme-1'][p_partkey % 5 + 1] AS org FROM part")
def str_05(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["Anthropic AI", "Azure/OpenAI", "meta_llama", " z-ai ", "Acme.1"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 4, X.canonical_org(F.lit("Acme 1"))).otherwise(X.canonical_org(raw)).alias("org"))


@query("o_str_06", "SELECT p_partkey AS id, ['Opus 4.1', 'GPT 5 Mini', 'DeepSeek V3', 'GLM 4.5', 'Qwen 72B', 'Mixtral 7.2B'][p_partkey % 6 + 1] AS name FROM part")
def str_06(spark, sf):
    slug = F.element_at(F.array(*map(F.lit, ["anthropic/claude-4-1-opus-20250805", "openai/gpt-5-mini", "deepseek-v3-2024-12-26", "glm-4-5", "x/y/qwen-72b", "mixtral-7-2b"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.short_name(slug).alias("name"))


def peeled(of):
    return f"regexp_replace({of}, '^(.+?)(?:[-_](?:{X.RUN_SUFFIXES})|[-_]\\d{{4}}-\\d\\d-\\d\\d|-\\d\\d-\\d\\d)$', '\\1', 'i')"


@query("o_str_07", with_alias(f"SELECT id, concat_ws('|', CASE WHEN f1 <> s THEN f1 END, CASE WHEN f2 <> f1 THEN f2 END, CASE WHEN f3 <> f2 THEN f3 END) AS forms FROM (SELECT *, {peeled('f2')} AS f3 FROM (SELECT *, {peeled('f1')} AS f2 FROM (SELECT id, lower(s) AS s, {peeled('lower(s)')} AS f1 FROM a)))"))
def str_07(spark, sf):
    return aliases(spark, sf).select("id", F.array_join(X.suffix_reductions(F.lower("s")), "|").alias("forms"))


@query("o_str_08", with_alias(f"SELECT id, {norm('s')} AS whole, {norm(chr(39).join(['substr(s, strpos(s, ', '/', ') + 1)']))} AS bare FROM a"))
def str_08(spark, sf):
    v = X.norm_variants(F.col("s"), ascii_only=True)
    return aliases(spark, sf).select("id", F.get(v, F.lit(0)).alias("whole"), F.coalesce(F.get(v, F.lit(1)), F.get(v, F.lit(0))).alias("bare"))


@query("o_str_09", "SELECT id, array_to_string(list_filter([stem || suffix, CASE WHEN size < 10 THEN 'claude-opus-' || size || suffix END, CASE WHEN suffix <> '' THEN stem END], lambda x: x IS NOT NULL), '|') AS forms FROM (SELECT p_partkey AS id, p_size AS size, 'claude-' || p_size || '-opus' AS stem, ['', '-thinking', '-non-reasoning-low-effort', '-high'][p_partkey % 4 + 1] AS suffix FROM part)")
def str_09(spark, sf):
    from factloom.operators.resolve import identity_variants

    s = F.concat(F.lit("claude-"), F.col("p_size"), F.lit("-opus"), F.element_at(F.array(*map(F.lit, ["", "-thinking", "-non-reasoning-low-effort", "-high"])), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(identity_variants(s), "|").alias("forms"))


@query("o_str_10", with_alias("SELECT id, trim(regexp_replace(lower(trim(s)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM a"))
def str_10(spark, sf):
    return aliases(spark, sf).select("id", X.slugify(F.col("s")).alias("slug"))


@query("o_str_11", with_roles("SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE price END AS v FROM model", "model"))
def str_11(spark, sf):
    p = F.col("price")
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.format_number(p, 2), F.lit(" %"))).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), F.format_string("%.2f", p))).when(F.col("id") % 4 == 2, F.format_number(p, 2)).otherwise(F.lit("n/a"))
    return R.model(spark, sf).select("id", X.parse_float(raw).alias("v"))


@query("o_str_12", with_roles("SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE CAST(context AS BIGINT) END AS v FROM model", "model"))
def str_12(spark, sf):
    raw = F.when(F.col("id") % 3 == 0, "abc1").when(F.col("id") % 3 == 1, F.concat("context", F.lit("k tokens"))).otherwise(F.col("context").cast("string"))
    return R.model(spark, sf).select("id", X.prefix_int(raw).alias("v"))


@query("o_str_13", "SELECT event_id AS id, json_extract_string(props, '$.k') AS v FROM events")
def str_13(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.first_value(F.col("props"), ["missing", "k", "other"]).alias("v"))


@query("o_str_14", "SELECT event_id AS id, [TRUE, TRUE, FALSE, NULL][event_id % 4 + 1] AS v FROM events")
def str_14(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["TRUE", " supported", "0", "maybe"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.boolean_or_null(raw).alias("v"))


@query("o_str_15", with_alias("SELECT id, CASE WHEN id % 2 = 0 THEN 'anthropic/m-' || id ELSE 'acme/m-' || id END AS slug FROM a"))
def str_15(spark, sf):
    from factloom.operators.resolve import canonical_slug

    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("host/anthropic-ai/m-"), "id")).otherwise(F.concat(F.lit("acme/m-"), "id"))
    return aliases(spark, sf).select("id", canonical_slug(raw, ["anthropic"]).alias("slug"))


@query("o_str_16", with_alias("SELECT id, CASE WHEN id % 2 = 0 THEN 'qwen' ELSE '' END AS v FROM a"))
def str_16(spark, sf):
    return aliases(spark, sf).select("id", X.vendor_token(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Qwen3."), "id", F.lit("-max"))).otherwise(F.lit("2.0-x"))).alias("v"))


@query("o_str_17", with_alias("SELECT id, CASE WHEN id % 2 = 0 THEN 'openai/m-' || id END AS v FROM a"))
def str_17(spark, sf):
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("host/Open-AI/m-"), "id")).otherwise(F.concat(F.lit("acme/m-"), "id"))
    return aliases(spark, sf).select("id", X.clean_slug(raw).alias("v"))


@query("o_str_18", with_alias("SELECT id, ['m-7', 'unknown', 'x-m-8'][id % 3 + 1] AS v FROM a"))
def str_18(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["acme-m-7-reasoning-high", "acme-", "x-m-8-preview"])), (F.col("id") % 3 + 1).cast("int"))
    return aliases(spark, sf).select("id", X.family(F.lit("acme"), raw).alias("v"))


@query("o_str_19", with_alias("SELECT id, CASE WHEN id % 8 = 6 THEN 'gguf' END AS f, CASE WHEN id % 8 = 6 THEN 'gguf:q4_k_m' END AS q FROM a"))
def str_19(spark, sf):
    return aliases(spark, sf).select("id", X.file_format(F.col("s"), F.lit("")).alias("f"), X.quantization(F.col("s")).alias("q"))


@query("o_str_20", with_roles("SELECT id, format('{:,}', CAST(floor(price + 0.5) AS BIGINT)) AS elo, printf('%.1f', price) || '%' AS percent, CASE WHEN price = floor(price) THEN '$' || CAST(price AS BIGINT) ELSE '$' || printf('%.2f', price) END AS price, CASE WHEN id < 1000 THEN CAST(id AS VARCHAR) WHEN id < 1000000 THEN regexp_replace(printf('%.1f', id / 1000.0), '\\.?0+$', '') || 'K' ELSE regexp_replace(printf('%.2f', id / 1000000.0), '\\.?0+$', '') || 'M' END AS tokens, CASE WHEN id > 100 THEN '+' ELSE '' END || (id - 100) AS delta, strftime(release_date, '%b %-d, %Y') AS day FROM model", "model"))
def str_20(spark, sf):
    p = F.col("price")
    return R.model(spark, sf).select("id", X.format_elo(p).alias("elo"), X.format_percent(p).alias("percent"), X.format_price(p).alias("price"), X.format_tokens(F.col("id").cast("double")).alias("tokens"), X.format_delta((F.col("id") - 100).cast("double")).alias("delta"), X.format_date(F.col("release_date").cast("string")).alias("day"))


@query("o_str_21", "SELECT event_id AS id, ['elo', 'percent', 'percent', 'score'][event_id % 4 + 1] AS kind FROM events")
def str_21(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["Arena ELO", "pass-rate 2", "percent_of x", "points"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.metric_kind(raw).alias("kind"))


@query("o_str_22", with_roles("SELECT model_id, snapshot_id, rank, CASE WHEN ci * 10 >= 1 THEN 'Exact match' WHEN ci * 10 >= 0.75 THEN 'High confidence' WHEN ci * 10 >= 0.5 THEN 'Moderate confidence' ELSE 'Needs review' END AS label FROM result", "result"))
def str_22(spark, sf):
    return R.result(spark, sf).select("model_id", "snapshot_id", "rank", X.confidence_label(F.col("ci") * 10).alias("label"))


@query("o_str_23", "SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS n FROM conversations")
def str_23(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.token_count(F.col("text")).cast("long").alias("n"))


@query("o_str_24", "SELECT event_id AS id, ['GPQA Diamond', 'SWE Bench Pro', 'MMLU'][event_id % 3 + 1] AS label FROM events")
def str_24(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["gpqa_diamond", "swe_bench_pro", "mmlu"])), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.benchmark_label(raw).alias("label"))


@query("o_str_25", with_roles("SELECT m.id, coalesce(l.label, m.developer) AS label FROM model m LEFT JOIN (VALUES ('Brand#1', 'First'), ('Brand#2', 'Second')) l(k, label) ON l.k = m.developer", "model"))
def str_25(spark, sf):
    return R.model(spark, sf).select("id", X.lookup(F.col("developer"), {"Brand#1": "First", "Brand#2": "Second"}).alias("label"))


@query("o_str_26", "SELECT page_id, sha256(html) AS h FROM pages")
def str_26(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("h"))


@query("o_str_27", "SELECT p_partkey AS id, ['Open AI', 'small', 'unknown'][p_partkey % 3 + 1] AS vendor, ['GPT 5', 'thing', 'alone'][p_partkey % 3 + 1] AS model FROM part")
def str_27(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["Open AI GPT 5", "small thing", "alone"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.split_vendor(raw, ["Open AI", "Meta"]).alias("v")).select("id", "v.vendor", "v.model")


@query("o_date_01", with_roles("SELECT r.model_id, r.snapshot_id, r.rank, coalesce(CASE WHEN rank % 3 = 0 THEN r.measured_at END, CASE WHEN rank % 3 = 1 THEN s.fetched_at END, CAST(m.release_date AS TIMESTAMP)) AS effective, CASE WHEN rank % 3 = 0 THEN 'measured' WHEN rank % 3 = 1 AND s.id IS NOT NULL THEN 'snapshot' ELSE 'release' END AS origin FROM result r LEFT JOIN snapshot s ON s.id = r.snapshot_id LEFT JOIN model m ON m.id = r.model_id", "result", "snapshot", "model"))
def date_01(spark, sf):
    from factloom.operators.dates import effective_date

    r = R.result(spark, sf).join(R.snapshot(spark, sf).select(F.col("id").alias("snapshot_id"), "fetched_at"), "snapshot_id", "left").join(R.model(spark, sf).select(F.col("id").alias("model_id"), "release_date"), "model_id", "left")
    kind = F.col("rank") % 3
    dated = effective_date({"measured": F.when(kind == 0, F.col("measured_at")), "snapshot": F.when(kind == 1, F.col("fetched_at")), "release": F.col("release_date").cast("timestamp_ntz")})
    return r.select("model_id", "snapshot_id", "rank", dated.alias("d")).select("model_id", "snapshot_id", "rank", F.col("d.at").alias("effective"), F.col("d.origin").alias("origin"))


@query("o_date_02", "SELECT event_id AS id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 5 <> 0")
def date_02(spark, sf):
    from factloom.operators.dates import epoch_ms

    raw = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), epoch_ms(raw).alias("ms")).where("ms IS NOT NULL")


@query("o_date_03", "SELECT event_id AS id, CAST(date_trunc('month', ts) AS DATE) AS first_day, last_day(ts) AS last_day, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS next_month FROM events")
def date_03(spark, sf):
    first = F.trunc("ts", "month")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), first.alias("first_day"), F.last_day("ts").alias("last_day"), F.add_months(first, 1).alias("next_month"))


@query("o_date_04", "SELECT year(ts) || '-' || ((dayofyear(ts) - 1) // 7) AS week, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def date_04(spark, sf):
    from factloom.operators.dates import week_key

    return table(spark, sf, "events").groupBy(week_key(F.col("ts")).alias("week")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@query("o_date_05", with_roles("SELECT id, CAST(release_date - INTERVAL 1 DAY AS DATE) AS before, CAST(release_date + INTERVAL 30 DAY AS DATE) AS later FROM model", "model"))
def date_05(spark, sf):
    return R.model(spark, sf).select("id", F.date_add("release_date", -1).alias("before"), F.date_add("release_date", 30).alias("later"))


@query("o_date_06", with_roles("SELECT id, round(date_diff('day', release_date, DATE '2026-01-01') / 30.44, 3) AS months FROM model", "model"))
def date_06(spark, sf):
    return R.model(spark, sf).select("id", F.round(F.datediff(F.lit("2026-01-01").cast("date"), "release_date") / 30.44, 3).alias("months"))


@query("o_date_07", with_roles("SELECT id, CASE WHEN id % 2 = 0 THEN CAST(date_trunc('month', release_date) AS DATE) ELSE release_date END AS d FROM model", "model"))
def date_07(spark, sf):
    from factloom.operators.dates import partial_date

    raw = F.when(F.col("id") % 2 == 0, F.date_format("release_date", "yyyy-MM")).otherwise(F.date_format("release_date", "yyyy-MM-dd"))
    return R.model(spark, sf).select("id", partial_date(raw).alias("d"))


@query("o_date_08", "SELECT event_id AS id, [14, 21, 90, NULL, NULL][event_id % 5 + 1] AS days FROM events")
def date_08(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["hourly", " Weekly", "monthly", "on release", ""])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), gates.stale_days(raw).alias("days"))


@query("o_date_09", with_roles("SELECT id, CASE WHEN id % 3 = 0 THEN CAST(context AS DOUBLE) WHEN id % 3 = 1 THEN round(context / 60.0, 2) END AS h FROM model", "model"))
def date_09(spark, sf):
    raw = F.when(F.col("id") % 3 == 0, F.concat("context", F.lit("h"))).when(F.col("id") % 3 == 1, F.concat("context", F.lit("M"))).otherwise(F.lit("soon"))
    return R.model(spark, sf).select("id", X.duration_hours(raw).alias("h"))


@query("o_math_01", with_roles("SELECT model_id, snapshot_id, rank, CASE WHEN benchmark_id = 'R' THEN ci * 100 ELSE ci END AS v FROM result", "result"))
def math_01(spark, sf):
    metric = F.when(F.col("benchmark_id") == "R", "percent correct").otherwise("points")
    return R.result(spark, sf).select("model_id", "snapshot_id", "rank", X.fraction_to_percent(F.col("ci"), metric).alias("v"))


@query("o_math_02", with_roles("SELECT id, round(price / 1e6 * 1e6, 6) AS per_million FROM model", "model"))
def math_02(spark, sf):
    return R.model(spark, sf).select("id", F.round((F.col("price") / 1e6) * 1e6, 6).alias("per_million"))


@query("o_math_03", with_roles("SELECT model_id, snapshot_id, rank, round(score / nullif(ci, 0), 6) AS ratio FROM result", "result"))
def math_03(spark, sf):
    return R.result(spark, sf).select("model_id", "snapshot_id", "rank", F.round(F.col("score") / F.nullif("ci", F.lit(0.0)), 6).alias("ratio"))


@query("o_math_04", with_roles("SELECT model_id, kind, (max(elo) - min(elo)) / 2 AS half FROM series GROUP BY ALL", "series"))
def math_04(spark, sf):
    return R.series(spark, sf).groupBy("model_id", "kind").agg(((F.max("elo") - F.min("elo")) / 2).alias("half"))


@query("o_math_05", with_roles("SELECT id, round(0.9 * context + 0.1 * price, 6) AS effective, round(1 - (0.9 * context + 0.1 * price) / price, 6) AS discount FROM model", "model"))
def math_05(spark, sf):
    e = 0.9 * F.col("context") + 0.1 * F.col("price")
    return R.model(spark, sf).select("id", F.round(e, 6).alias("effective"), F.round(1 - e / F.col("price"), 6).alias("discount"))


@query("o_math_06", with_roles("SELECT id, round(least(22.0, greatest(6.0, 20 - 3 * ln(price / 900))), 9) AS size, CAST(ceil(price / 250) * 250 AS BIGINT) AS top FROM model", "model"))
def math_06(spark, sf):
    size = F.least(F.lit(22.0), F.greatest(F.lit(6.0), 20 - 3 * F.ln(F.col("price") / 900)))
    return R.model(spark, sf).select("id", F.round(size, 9).alias("size"), (F.ceil(F.col("price") / 250) * 250).alias("top"))


@query("o_math_07", with_roles("SELECT id, round(100.0 * date_diff('day', lo, release_date) / greatest(date_diff('day', lo, hi), 1), 6) AS percent FROM model, (SELECT min(release_date) AS lo, max(release_date) AS hi FROM model)", "model"))
def math_07(spark, sf):
    m = R.model(spark, sf).select("id", "release_date")
    ends = m.agg(F.min("release_date").alias("lo"), F.max("release_date").alias("hi"))
    return m.join(F.broadcast(ends)).select("id", F.round(100.0 * F.datediff("release_date", "lo") / F.greatest(F.datediff("hi", "lo"), F.lit(1)), 6).alias("percent"))


@query("o_arr_01", with_roles("SELECT family, string_agg(DISTINCT developer, ',' ORDER BY developer) AS developers FROM model GROUP BY 1", "model"))
def arr_01(spark, sf):
    return R.model(spark, sf).groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("developer")), ",").alias("developers"))


@query("o_arr_02", with_roles("SELECT model_id, i - 1 AS pos, ts[i] AS t, elos[i] AS elo FROM (SELECT model_id, list(t ORDER BY t, id) AS ts, list(elo ORDER BY t, id) AS elos FROM series GROUP BY 1), LATERAL (SELECT unnest(generate_series(1, len(ts))) AS i)", "series"))
def arr_02(spark, sf):
    from factloom.operators.nested import columnar_series

    s = columnar_series(R.series(spark, sf), ["model_id"], ["t", "id"], ["t", "elo"])
    return s.select("model_id", F.posexplode(F.arrays_zip("t", "elo")).alias("pos", "z")).select("model_id", F.col("pos").cast("long").alias("pos"), "z.t", "z.elo")


@query("o_arr_03", "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents")
def arr_03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line"))


@query("o_arr_04", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: contains(lower(x), 'licens'))) > 0 AS hit FROM documents")
def arr_04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.exists(F.split("text", " "), lambda x: F.lower(x).contains("licens")).alias("hit"))


@query("o_map_01", with_roles("SELECT model_id, max(score) FILTER (WHERE benchmark_id = 'R') AS r, CAST(count(DISTINCT benchmark_id) AS INTEGER) AS n FROM result GROUP BY 1", "result"))
def map_01(spark, sf):
    best = R.result(spark, sf).groupBy("model_id", "benchmark_id").agg(F.max("score").alias("s"))
    m = best.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("benchmark_id", "s"))).alias("m"))
    return m.select("model_id", F.try_element_at("m", F.lit("R")).alias("r"), F.size(F.map_filter("m", lambda k, v: v.isNotNull())).alias("n"))


@query("o_map_02", with_roles("SELECT id, developer AS a, family AS b, 'z' AS c FROM model", "model"))
def map_02(spark, sf):
    from factloom.operators.nested import merge_maps

    m = merge_maps(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("family")), F.create_map(F.lit("a"), F.col("developer"), F.lit("c"), F.lit("z")))
    return R.model(spark, sf).select("id", m.alias("m")).select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@query("o_json_01", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def json_01(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "[1, 2").otherwise(F.col("props"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.try_element_at(J.object_or_empty(raw), F.lit("k")).alias("k"))


@query("o_json_02", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def json_02(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), J.path_coalesce(F.col("props"), ["$.a.b", "$.list[0]", "$.k"]).alias("k"))


@query("o_json_03", "SELECT event_id AS id, '{\"inner\": {\"path\": null, \"value\": ' || value || '}}' AS public FROM events")
def json_03(spark, sf):
    raw = F.to_json(F.struct(F.lit("s3cr3t").alias("api_key"), F.struct(F.lit("/home/x").alias("path"), F.col("value")).alias("inner")))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), J.redact(raw).alias("public"))


@query("o_json_04", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def json_04(spark, sf):
    raw = F.concat(F.lit('{"a": [{"b": '), "props", F.lit("}]}"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), J.nested_lookup("k")(raw).alias("k"))


@query("o_json_05", with_roles("SELECT id, '{\"a\":\"' || family || '\",\"z\":\"' || developer || '\"}' AS j FROM model", "model"))
def json_05(spark, sf):
    return R.model(spark, sf).select("id", J.canonical(F.create_map(F.lit("z"), F.col("developer"), F.lit("a"), F.col("family"))).alias("j"))


@query("o_json_06", "SELECT event_id AS id, ['text,image', 'audio', '', 'video'][event_id % 4 + 1] AS m FROM events")
def json_06(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ['["text","image"]', '"audio"', "", "video"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(J.modalities(raw), ",").alias("m"))


@query("o_json_07", with_roles("SELECT id, name FROM model WHERE id IN (3, 5, 8)", "model"))
def json_07(spark, sf):
    wanted = F.from_json(F.lit("[3, 5, 8]"), "array<bigint>")
    return R.model(spark, sf).where(F.array_contains(wanted, F.col("id"))).select("id", "name")
