"""Payload parsers: a DataFrame with a text column ``body`` in, one row a record out.

Payloads are JSON, HTML, simple YAML, CSV or Python registries; every parser is a plan of built-in
functions but that of registries, which goes through Arrow batches. Columns of ``raw`` besides ``body`` (such as snapshot_id) are carried along.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from factloom.functions import text as X
from factloom.functions import variants
from factloom.session import durable

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str):
    def put(fn):
        PARSERS[name] = fn
        return fn

    return put


def _carry(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "body"]


def finite(x: Column) -> Column:
    """A number, or null for text that is none, NaN and infinities."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


@parser("models_dev")
def models_dev(raw: DataFrame) -> DataFrame:
    """provider -> models -> model, with prices, limits and release dates."""
    schema = "map<string,struct<models:map<string,struct<id:string,name:string,release_date:string,open_weights:string,cost:struct<input:string,output:string,cache_read:string,cache_write:string>,limit:struct<context:string,output:string>>>>>"
    p = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)).alias("provider", "p"))
    m = p.select(*_carry(raw), "provider", F.explode("p.models").alias("key", "m"))
    return m.select(
        *_carry(raw), F.concat("provider", F.lit("/"), F.coalesce("m.id", "key")).alias("source_model_id"), F.col("m.name").alias("name"), F.col("m.release_date").alias("release_date"), X.boolean_or_null(F.col("m.open_weights")).alias("open_weights"),
        *[finite(F.col(f"m.cost.{c}")).alias(f"{c}_price") for c in ("input", "output", "cache_read", "cache_write")], F.col("m.limit.context").try_cast("bigint").alias("context"),
    )


@parser("openrouter")
def openrouter(raw: DataFrame) -> DataFrame:
    """data[] with prices a token, as prices a million tokens."""
    schema = "struct<data:array<struct<id:string,name:string,context_length:string,pricing:struct<prompt:string,completion:string,request:string,image:string>>>>"
    d = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)["data"]).alias("d"))
    return d.select(*_carry(raw), F.col("d.id").alias("source_model_id"), F.col("d.name").alias("name"), (finite(F.col("d.pricing.prompt")) * 1e6).alias("input_price"), (finite(F.col("d.pricing.completion")) * 1e6).alias("output_price"), finite(F.col("d.pricing.request")).alias("request_price"), finite(F.col("d.pricing.image")).alias("image_price"))


@parser("openrouter_endpoints")
def openrouter_endpoints(raw: DataFrame) -> DataFrame:
    """One row an endpoint; its tag is provider, then region parts."""
    schema = "array<struct<model_id:string,status:int,endpoints:array<struct<tag:string,context_length:bigint,price:string>>>>"
    m = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)).alias("m")).where("m.status = 200")
    e = m.select(*_carry(raw), F.col("m.model_id").alias("source_model_id"), F.posexplode("m.endpoints").alias("pos", "e"))
    parts = F.split("e.tag", "/")
    region = F.nullif(F.array_join(F.slice(parts, 2, 100), "/"), F.lit(""))
    return e.select(*_carry(raw), "source_model_id", "pos", F.get(parts, F.lit(0)).alias("provider"), region.alias("region"), F.col("e.context_length").alias("context"), finite(F.col("e.price")).alias("price"))


#: Fields of a row that are looked for at any depth.
EVALUATIONS = (
    "artificial_analysis_intelligence_index", "artificial_analysis_coding_index", "artificial_analysis_math_index", "mmlu_pro", "gpqa", "hle", "livecodebench", "aime", "aime_25", "math_500", "ifbench", "lcr", "scicode", "tau2",
    "tau_banking", "terminalbench_hard", "terminalbench_v2_1",
)
PRICES = ("price_1m_input_tokens", "price_1m_output_tokens", "price_1m_blended_3_to_1")
CAPABILITIES = ("median_output_tokens_per_second", "median_time_to_first_token_seconds", "median_time_to_first_answer_token", "release_date")


def payload_rows(raw: DataFrame, under: Sequence[str]) -> DataFrame:
    """The objects of a JSON payload as ``row`` (a VARIANT): items of a list, else what lies under the first of ``under`` that holds anything, as list or object."""
    body = raw.select(*_carry(raw), F.try_parse_json("body").alias("_b"))
    parts = [F.try_variant_get("_b", f"$.{k}", "variant") for k in under]
    inner = F.coalesce(*[F.when(~F.array_contains(F.array(*[F.lit(x) for x in ("VOID", "ARRAY<VOID>", "OBJECT<>")]), F.schema_of_variant(p)), p) for p in parts])
    kind = variants.kind(F.col("_b"))
    held = body.select(*_carry(raw), F.when(kind == "ARRAY", F.col("_b")).when(kind == "OBJECT", inner).alias("_rows")).where(variants.kind(F.col("_rows")).isin("ARRAY", "OBJECT"))
    return variants.exploded(held, "_rows").where(variants.kind(F.col("value")) == "OBJECT").select(*_carry(raw), F.col("value").alias("row"))


def artificialanalysis_facts(raw: DataFrame) -> DataFrame:
    """(carried columns, source_model_id, name, creator, slug, model_version, kind, field, value): evaluations, prices and capabilities of each row.

    A row is known by its id, its slug, or its name made a slug; others are left out. Fields of ``EVALUATIONS`` and ``PRICES`` are
    taken from the object of that kind at any depth, else from the row itself, else from anywhere in it; other
    evaluations only as members of that object. Values that are no numbers are left out, but for the release date.
    """
    r = durable(payload_rows(raw, ("data", "models", "results", "items")).withColumn("_id", F.monotonically_increasing_id()))
    get = lambda path: variants.text(F.try_variant_get("row", path, "variant"))
    name = get("$.name")
    maker = F.coalesce(get("$.model_creator.slug"), get("$.model_creator_slug"))
    version = F.coalesce(F.concat(maker, F.lit("/"), name), name, get("$.slug"), get("$.id"))
    known = r.select("_id", *_carry(raw), F.coalesce(get("$.id"), get("$.slug"), X.slugify(name, None)).alias("source_model_id"), name.alias("name"), F.coalesce(get("$.model_creator.name"), get("$.model_creator_name")).alias("creator"), get("$.slug").alias("slug"), version.alias("model_version"))
    members = variants.walked(r, "_id", "row")
    out = None
    for kind, inside, keys in (("evaluation", "evaluations", EVALUATIONS), ("pricing", "pricing", PRICES), ("capability", None, CAPABILITIES)):
        wanted, scopes = members.where(F.col("key").isin(*keys)), []
        if inside:
            own = r.select("_id", F.try_variant_get("row", f"$.{inside}", "variant").alias("_own"))
            below = variants.walked(own, "_id", "_own")
            scopes.append(variants.first_of(below.where(F.col("key").isin(*keys) | (F.size("path") == 0)) if kind == "evaluation" else below.where(F.col("key").isin(*keys)), "_id").withColumn("_scope", F.lit(0)))
            scopes.append(variants.first_of(wanted, "_id", F.size("path") == 0).withColumn("_scope", F.lit(1)))
        scopes.append(variants.first_of(wanted, "_id").withColumn("_scope", F.lit(2)))
        every = scopes[0]
        for s in scopes[1:]:
            every = every.unionByName(s)
        good = (F.col("key") == "release_date") | X.parse_float(F.col("value")).isNotNull()
        best = every.where(good).groupBy("_id", "key").agg(F.min_by("value", "_scope").alias("value")).select("_id", F.lit(kind).alias("kind"), F.col("key").alias("field"), "value")
        out = best if out is None else out.unionByName(best)
    return known.join(out, "_id").where("source_model_id IS NOT NULL").drop("_id")


@parser("artificialanalysis")
def artificialanalysis(raw: DataFrame) -> DataFrame:
    """Evaluations of the payload's rows; one row an evaluation."""
    e = artificialanalysis_facts(raw).where("kind = 'evaluation'")
    return e.select(*_carry(raw), "source_model_id", F.col("field").alias("benchmark_id"), X.parse_float(F.col("value")).alias("score"))


@parser("huggingface")
def huggingface(raw: DataFrame) -> DataFrame:
    """One row a file of a repository that could be read, with its format and quantisation."""
    schema = "array<struct<repo_id:string,status:int,tags:array<string>,siblings:array<struct<rfilename:string,size:bigint>>>>"
    r = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)).alias("r")).where("r.status = 200")
    s = r.select(*_carry(raw), F.col("r.repo_id").alias("source_model_id"), F.array_join("r.tags", " ").alias("tags"), F.explode("r.siblings").alias("s"))
    name = F.col("s.rfilename")
    return s.select(*_carry(raw), "source_model_id", name.alias("file"), F.col("s.size").alias("size"), X.file_format(name, F.col("tags")).alias("format"), X.quantization(name).alias("quantization"))


#: The dictionaries of the registry that name models, and those whose models run on another backend.
REGISTRIES = (
    "_TEXT_GENERATION_MODELS", "_EMBEDDING_MODELS", "_LATE_INTERACTION_MODELS", "_REWARD_MODELS", "_TOKEN_CLASSIFICATION_MODELS", "_SEQUENCE_CLASSIFICATION_MODELS", "_MULTIMODAL_MODELS", "_SPECULATIVE_DECODING_MODELS",
    "_TRANSFORMERS_SUPPORTED_MODELS", "_TRANSFORMERS_BACKEND_MODELS",
)
ELSEWHERE = REGISTRIES[-2:]


def registry_entries(source: str) -> dict[str, tuple[str, str, str]]:
    """{name: (registry, module, class)} of "name": ("module", "class") in the named dictionaries; the source is read, never run.

    A later entry of a name wins. Text that is no Python has none.
    """
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {}
    word = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    found = {}
    for node in body:
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Dict) and len(node.targets) == 1 and getattr(node.targets[0], "id", None) in REGISTRIES:
            for key, value in zip(node.value.keys, node.value.values, strict=True):
                pair = [word(e) for e in value.elts] if isinstance(value, ast.Tuple) else []
                if word(key) and len(pair) == 2 and None not in pair:
                    found[word(key)] = (node.targets[0].id, *pair)
    return found


@parser("vllm")
def vllm(raw: DataFrame) -> DataFrame:
    """Models of a Python registry, one row each; a payload is parsed by itself."""

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            body, rows = batch.column(batch.num_columns - 1), []
            for i, source in enumerate(body.to_pylist()):
                rows += [(i, name, *entry) for name, entry in sorted(registry_entries(source or "").items())]
            at, *found = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]), *(pa.array(c, pa.string()) for c in found)], [*batch.schema.names[:-1], "source_model_id", "registry", "module", "class"])

    some = raw.select(*_carry(raw), "body")
    out = StructType([*some.schema.fields[:-1], *[StructField(n, StringType()) for n in ("source_model_id", "registry", "module", "class")]])
    backend = F.when(F.col("registry").isin(*ELSEWHERE) | (F.col("module") == "transformers"), "transformers").otherwise("native")
    return some.mapInArrow(parsed, out).withColumn("backend", backend)


@parser("swebench")
def swebench(raw: DataFrame) -> DataFrame:
    """leaderboards[].results[]; a resolve rate is a fraction, resolved is in percent already."""
    schema = "struct<leaderboards:array<struct<name:string,results:array<struct<name:string,date:string,resolved:string,resolve_rate:string>>>>>"
    b = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)["leaderboards"]).alias("b"))
    r = b.select(*_carry(raw), X.slugify(F.col("b.name")).alias("benchmark_id"), F.explode("b.results").alias("r"))
    return r.select(*_carry(raw), "benchmark_id", F.col("r.name").alias("source_model_id"), F.col("r.date").alias("measured_at"), F.coalesce(finite(F.col("r.resolved")), finite(F.col("r.resolve_rate")) * 100).alias("score")).where("score IS NOT NULL")


@parser("aider")
def aider(raw: DataFrame) -> DataFrame:
    """A list of flat YAML records: ``- key: value`` begins one. Long form (record, key, value)."""
    lines = raw.withColumn("_file", F.xxhash64(*raw.columns)).select(*_carry(raw), "_file", F.posexplode(F.split("body", "\n")).alias("_n", "line")).where("trim(line) <> ''")
    w = Window.partitionBy(*_carry(raw), "_file").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rec = lines.withColumn("record", F.sum(F.col("line").startswith("- ").cast("int")).over(w))
    body = F.regexp_replace("line", r"^(- |\s+)", "")
    return rec.select(*_carry(raw), "record", F.trim(F.split_part(body, F.lit(":"), F.lit(1))).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(body, "^[^:]*:", "")), "^['\"]|['\"]$", "").alias("value"))


@parser("deepswe")
def deepswe(raw: DataFrame) -> DataFrame:
    """Rows of leaderboard, rows or results; fractions become percent, the interval its half width."""
    row = "array<struct<model:string,score:string,ci:array<double>,mean_cost_usd:string>>"
    j = F.from_json("body", f"struct<leaderboard:{row},rows:{row},results:{row}>")
    r = raw.select(*_carry(raw), F.explode(F.coalesce(j["leaderboard"], j["rows"], j["results"])).alias("r"))
    s = finite(F.col("r.score"))
    out = r.select(*_carry(raw), F.col("r.model").alias("source_model_id"), F.when(F.abs(s) <= 1, s * 100).otherwise(s).alias("score"), ((F.get("r.ci", F.lit(1)) - F.get("r.ci", F.lit(0))) / 2).alias("ci"), finite(F.col("r.mean_cost_usd")).alias("cost"))
    return out.where("source_model_id IS NOT NULL AND score IS NOT NULL")


#: Vendors whose names have more than one word or are known.
VENDORS = ("Moonshot AI", "Thinking Machines", "Anthropic", "OpenAI", "Z.ai", "xAI", "Google", "Qwen", "DeepSeek", "Meta")


@parser("frontierswe")
def frontierswe(raw: DataFrame) -> DataFrame:
    """Rows of the page whose title is ``vendor model + harness: mean@5 x%, worst@5 y%, best@5 z%``.

    Rank, interval, cost and hours come from the row's own markup, which ends before the separator; where no
    row has such a separator, the titles alone are read.
    """
    whole = r'(?s)<div\s+title="([^"]+:\s*mean@5[^"]+)"[^>]*>(.*?)</div>\s*<div class="relative h-5'
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(whole), F.lit(1)).alias("title"), F.regexp_extract_all("body", F.lit(whole), F.lit(2)).alias("row"))
    titles = F.transform(F.regexp_extract_all("body", F.lit(r'title="([^"]+:\s*mean@5[^"]+)"'), F.lit(1)), lambda t: F.struct(t.alias("title"), F.lit("").alias("row")))
    z = raw.select(*_carry(raw), F.explode(F.when(F.size(both) > 0, both).otherwise(titles)).alias("z")).select(*_carry(raw), "z.*")
    name = r"^(.+?)\s*\+\s*(.+?):\s*mean@5\s*([\d.]+)%,\s*worst@5\s*([\d.]+)%,\s*best@5\s*([\d.]+)%"
    part = lambda i: F.regexp_extract("title", name, i)
    of_row = lambda p: F.nullif(F.regexp_extract("row", p, 1), F.lit(""))
    split = X.split_vendor(part(1), VENDORS)
    out = z.where(F.col("title").rlike(name)).select(
        *_carry(raw), F.concat(F.lit("frontierswe_v2::"), X.slugify(split["model"])).alias("source_model_id"), split["model"].alias("name"), split["vendor"].alias("vendor"), F.trim(part(2)).alias("harness"),
        *[part(i).try_cast("double").alias(c) for i, c in ((3, "mean"), (4, "worst"), (5, "best"))], of_row(r'class="[^"]*tabular-nums[^"]*">\s*(\d+)\s*</span>').try_cast("int").alias("rank"), of_row(r"±(?:<!-- -->)?\s*([\d.]+)").try_cast("double").alias("ci"),
        of_row(r"\$([\d.]+)").try_cast("double").alias("cost"), X.duration_hours(of_row(r">([\d.]+[hm])<")).alias("hours"),
    )
    return out.where("mean IS NOT NULL")


@parser("openvlm")
def openvlm(raw: DataFrame) -> DataFrame:
    """model -> benchmark -> value blocks."""
    m = raw.select(*_carry(raw), F.explode(F.from_json("body", "struct<results:map<string,map<string,map<string,string>>>>")["results"]).alias("source_model_id", "b"))
    b = m.select(*_carry(raw), "source_model_id", F.explode("b").alias("benchmark_id", "v")).where("benchmark_id <> 'META'")
    return b.select(*_carry(raw), "source_model_id", "benchmark_id", finite(F.coalesce(F.try_element_at("v", F.lit("Overall")), F.try_element_at("v", F.lit("Final Score")))).alias("score")).where("score IS NOT NULL")


@parser("bigcodebench")
def bigcodebench(raw: DataFrame) -> DataFrame:
    """Pages rows[].row; the model is the path of its link, one row a score column."""
    schema = "struct<rows:array<struct<row:struct<link:string,complete:string,instruct:string>>>>"
    r = raw.select(*_carry(raw), F.explode(F.from_json("body", schema)["rows"]).alias("r"))
    path = F.regexp_replace(F.regexp_extract("r.row.link", r"^https?://[^/]+/(.*)$", 1), "/+$", "")
    wide = r.select(*_carry(raw), path.alias("source_model_id"), finite(F.col("r.row.complete")).alias("complete"), finite(F.col("r.row.instruct")).alias("instruct"))
    return wide.unpivot([*_carry(raw), "source_model_id"], ["complete", "instruct"], "benchmark_id", "score").where("score IS NOT NULL")


#: One cell of a CSV text and what ends it. A cell that begins with a quote goes on to the closing one, line ends included.
CELL = r'("[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+)?|[^,\r\n]*+)(,|\r\n|\r|\n|\z)'
QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


def csv_records(text: Column) -> Column:
    """The records of a CSV text as arrays of cells; lines without any text are left out.

    Quotes count at a cell's beginning only. Commas and line ends inside of quotes belong to the cell, doubled quotes
    are one; a quote that isn't closed goes on to the end of the text.
    """
    unquoted = lambda c: F.when(c.startswith('"'), F.concat(F.replace(F.regexp_extract(c, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, QUOTED, 2))).otherwise(c)

    def cut(s: Column) -> Column:  # s: cells as they are, and the places of those that end a record
        before = lambda k: F.when(k > 0, F.get(s["lasts"], k - 1)).otherwise(F.lit(-1))
        places = F.transform(s["lasts"], lambda at, k: F.struct((before(k) + 2).alias("first"), (at - before(k)).alias("n")))
        some = F.filter(places, lambda r: (r["n"] > 1) | (F.get(s["raw"], r["first"] - 1) != ""))
        return F.transform(some, lambda r: F.transform(F.slice(s["raw"], r["first"], r["n"]), unquoted))

    cells = [F.regexp_extract_all(text, F.lit(CELL), F.lit(i)) for i in (1, 2)]
    lasts = F.filter(F.transform(cells[1], lambda e, i: F.when(e != ",", i)), lambda i: i.isNotNull())
    return F.get(F.transform(F.array(F.struct(cells[0].alias("raw"), lasts.alias("lasts"))), cut), F.lit(0))  # bound once, not for each record


def table_rows(raw: DataFrame) -> DataFrame:
    """JSON arrays of flat objects or CSV text, told apart by the first character, as maps.

    Of a CSV text the first record names the columns; of equal names the last column counts. Cells that a
    record lacks are null, cells beyond the header are left out.
    """
    text = F.regexp_replace(F.regexp_replace("body", "^\ufeff", ""), r"^\s+|\s+$", "")
    is_json = text.rlike(r"^[\[{]")
    j = raw.where(is_json).select(*_carry(raw), F.explode(F.from_json("body", "array<map<string,string>>")).alias("row"))
    c = raw.where(~is_json).select(*_carry(raw), csv_records(text).alias("_all")).select(*_carry(raw), F.get("_all", F.lit(0)).alias("_h"), F.explode(F.slice("_all", 2, 1 << 30)).alias("_v"))
    names = F.array_distinct("_h")
    made = F.map_from_arrays(names, F.transform(names, lambda h: F.get("_v", (F.size("_h") - F.array_position(F.reverse("_h"), h)).cast("int"))))
    return j.unionByName(c.select(*_carry(raw), made.alias("row")))


def wide_scores(rows: DataFrame, name_keys: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Long form of maps: the first present name, and every other column that holds a number."""
    rest = [c for c in rows.columns if c != "row"]
    name = F.coalesce(*[F.nullif(F.trim(F.try_element_at("row", F.lit(k))), F.lit("")) for k in name_keys])
    long = rows.select(*rest, name.alias("source_model_id"), F.explode("row").alias("benchmark_id", "v")).where(~F.col("benchmark_id").isin(*name_keys, *skip))
    return long.select(*rest, "source_model_id", "benchmark_id", X.parse_float(F.col("v")).alias("score")).where("score IS NOT NULL AND source_model_id IS NOT NULL")


@parser("open_llm_lb")
def open_llm_lb(raw: DataFrame) -> DataFrame:
    return wide_scores(table_rows(raw), ["fullname", "model", "Model"])


@parser("mteb")
def mteb(raw: DataFrame) -> DataFrame:
    return wide_scores(table_rows(raw), ["model_name", "Model", "model"], ["rank"])


@parser("omp_speedtest")
def omp_speedtest(raw: DataFrame) -> DataFrame:
    """Samples joined to their configuration by selector; only finished ones with a positive rate."""
    schema = "struct<models:array<struct<key:string,canonicalSlug:string,ompSelector:string>>,records:array<struct<model:string,status:string,tps:string>>>"
    j = raw.select(*_carry(raw), F.from_json("body", schema).alias("j"))
    conf = F.map_from_entries(F.transform("j.models", lambda m: F.struct(m["ompSelector"], m["canonicalSlug"])))
    r = j.select(*_carry(raw), conf.alias("_c"), F.explode("j.records").alias("r"))
    return r.select(*_carry(raw), F.try_element_at("_c", F.col("r.model")).alias("source_model_id"), F.col("r.status").alias("status"), finite(F.col("r.tps")).alias("tps")).where("status = 'ok' AND tps > 0 AND source_model_id IS NOT NULL").drop("status")


def lmarena(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Leaderboard rows of known categories with a rating."""
    return rows.where(F.col("category").isin(*categories) & F.col("rating").isNotNull() & ~F.isnan("rating"))


# the epoch archive: a ZIP of CSV files


def zip_csv(files: DataFrame) -> DataFrame:
    """(path, member, body) of the CSV members of ZIP files read as binaryFile."""

    def unzip(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    out += [{"path": path, "member": n, "body": z.read(n).decode("utf-8-sig")} for n in z.namelist() if n.endswith(".csv")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("member", pa.string()), ("body", pa.string())]))

    return files.select("path", "content").mapInArrow(unzip, "path string, member string, body string")


def zipped_csv(bodies: DataFrame, member: str) -> DataFrame:
    """(path, content): ZIP files, each with one CSV member, of ``bodies(path, body)``."""

    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, body)
                out.append({"path": path, "content": held.getvalue()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return bodies.select("path", "body").mapInArrow(pack, "path string, content binary")


def epoch(files: DataFrame) -> DataFrame:
    """Scores of all members: the model column by its header, the others where they hold numbers."""
    return wide_scores(table_rows(zip_csv(files)), ["Model version", "Model", "model", "Name"], ["Release date", "id"])
