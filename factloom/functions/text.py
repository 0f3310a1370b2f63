"""Text functions for names, aliases and labels, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How organisations are also called.
ORG_SYNONYMS = {
    "anthropic-ai": "anthropic", "azure-openai": "openai", "deepseek-ai": "deepseek", "google-ai": "google", "google-ai-studio": "google",
    "google-deepmind": "google", "meta-ai": "meta", "meta-llama": "meta", "mistralai": "mistral", "mistral-ai": "mistral", "moonshot-ai": "moonshotai",
    "moonshot": "moonshotai", "open-ai": "openai", "qwenlm": "qwen", "qwen-team": "qwen", "thinking-machines": "thinkingmachines",
    "x-ai": "xai", "z-ai": "zhipuai", "zhipu-ai": "zhipuai",
}
# Words that mark a variant; each stands between separators.
MODIFIERS = {
    "free": "free", "fp8": "fp8", "gguf": "gguf", "q4_k_m": "q4[-_]?k[-_]?m", "awq": "awq", "turbo": "turbo", "latest": "latest",
    "preview": "preview", "thinking": "thinking", "high": "high", "medium": "medium", "low": "low",
}
# Provider and region prefixes; the last three need a dot.
SURFACE_PREFIXES = {
    "bedrock": "bedrock[:/_.-]", "vertex_ai": "(vertex[_-]?ai|vertex)[:/_.-]", "azure_ai": "(azure[_-]?ai|azure)[:/_.-]", "groq": "groq[:/_.-]",
    "together_ai": "(together[_-]?ai|together)[:/_.-]", "us": "us[.]", "eu": "eu[.]", "global": "global[.]",
}
# Metrics that are percentages.
PERCENT_METRICS = ("accuracy", "f1", "pass_rate", "pass_rate_2", "percent", "percent_correct", "percent_resolved", "percentage")
# Endings of names that say how a model was run.
RUN_SUFFIXES = "thinking([-_][0-9]+k)?|max|xhigh|high|medium|low|min|[0-9]+k|latest|preview|exp|beta"
FAMILY_SUFFIXES = ("non-reasoning", "reasoning", "preview", "adaptive", "high", "medium", "low", "xhigh")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function."""
    return s.str.normalize("NFKC")


def normalize_alias(s: Column, ascii_only: bool = False) -> Column:
    """Lower case, dots between digits and runs of separators as one hyphen, none at the ends.

    Text outside ASCII is composed first; ``ascii_only`` says there is none, which keeps the plan free
    of Python.
    """
    s = s if ascii_only else F.when(s.rlike(r"[^\x00-\x7F]"), nfkc(s)).otherwise(s)
    s = F.regexp_replace(F.lower(F.trim(s)), r"(?<=[0-9])\.(?=[0-9])", "-")
    return F.regexp_replace(F.regexp_replace(s, r"[\s_\-/]+", "-"), "^-+|-+$", "")


def date_tokens(s: Column) -> Column:
    """Distinct dates in order of appearance, YYYYMMDD and YYYY-MM-DD alike, as YYYY-MM-DD."""
    found = F.regexp_extract_all(s, F.lit(r"(?<![0-9])([0-9]{4}-?[0-9]{2}-?[0-9]{2})(?![0-9])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, "-", ""), "(....)(..)(..)", "$1-$2-$3")))


def _first(cases: Mapping[str, Column]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in cases.items()])


def surface_prefix(s: Column) -> Column:
    """The first known prefix, or null."""
    low = F.lower(F.trim(s))
    return _first({name: low.rlike(f"^{p}") for name, p in SURFACE_PREFIXES.items()})


def modifiers(s: Column) -> Column:
    """All known modifiers, in the table's order."""
    low = F.lower(s)
    tests = {name: low.rlike(rf"(^|[-_./\s]){p}($|[-_./\s])" + ("|:free" if name == "free" else "")) for name, p in MODIFIERS.items()}
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def lookup(s: Column, table: Mapping[str, str]) -> Column:
    """``table``'s entry for s, or s itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s), s)


def canonical_org(s: Column, ascii_only: bool = False) -> Column:
    return lookup(normalize_alias(s, ascii_only), ORG_SYNONYMS)


def word_initials(s: Column) -> Column:
    """Words' first letters in upper case; other letters stay as they are (unlike initcap)."""
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


#: Brand names whose case is their own.
BRANDS = {"Glm": "GLM", "Deepseek": "DeepSeek", "Jt": "JT", "Mimo": "MiMo", "Qwq": "QwQ", "Palm": "PaLM"}


def short_name(slug: Column) -> Column:
    """A display name: the last path part without its date, versions with dots, words with capitals."""
    s = F.element_at(F.split(slug, "/"), -1)
    steps = [(r"-[0-9]{4}-?[0-9]{2}-?[0-9]{2}$", ""), (r"([0-9])-([0-9])(?![0-9])", "$1.$2"), (r"(?i)^claude-([0-9]+(?:\.[0-9]+)?)-(haiku|sonnet|opus)", "$2-$1"), ("^claude-", ""), ("^gpt-", "GPT-"), ("-", " ")]
    s = word_initials(reduce(lambda x, step: F.regexp_replace(x, *step), steps, s))
    brands = [(rf"\b{a}\b", b) for a, b in BRANDS.items()] + [(r"(?i)\b([0-9]+)m\b", "$1M"), (r"(?i)\b([0-9]+)b\b", "$1B")]
    return reduce(lambda x, step: F.regexp_replace(x, *step), brands, F.trim(s))


def suffix_reductions(name: Column) -> Column:
    """Every form on the way of peeling run suffixes and dates off a name, the longest first; null of null."""
    peel = rf"(?i)^(.+?)(?:[-_](?:{RUN_SUFFIXES})|[-_]\d{{4}}-\d\d-\d\d|-\d\d-\d\d)$"
    first = F.regexp_replace(name, "(?i)^chatgpt-", "gpt-")
    steps = F.sequence(F.lit(1), F.size(F.split(name, "[-_]")))  # every suffix begins with one of these
    peeled = F.aggregate(steps, F.array(name, first), lambda got, _: F.array_append(got, F.regexp_replace(F.element_at(got, -1), peel, "$1")))
    return F.array_except(F.array_distinct(peeled), F.array(name))


def norm_variants(s: Column, ascii_only: bool = False) -> Column:
    """The whole name and the part after its first slash, normalised."""
    return F.array_distinct(F.array(normalize_alias(s, ascii_only), normalize_alias(F.regexp_replace(s, "^[^/]*/", ""), ascii_only)))


def slugify(s: Column, empty: str | None = "unknown") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit(empty)).otherwise(out)


def parse_float(s: Column) -> Column:
    """A number with optional percent sign and thousands commas; null if it is none."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"\s*%$", ""), ",", "").try_cast("double")


def prefix_int(s: Column) -> Column:
    """The digits a text begins with; 0 without any."""
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, "^[0-9]+", 0).try_cast("bigint"), F.lit(0)))


def first_value(json: Column, keys: Sequence[str]) -> Column:
    """The first of several JSON keys that is neither missing, null nor empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys])


def boolean_or_null(s: Column) -> Column:
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "yes", "1", "supported"), True).when(low.isin("false", "no", "0", "unsupported"), False)


def vendor_token(s: Column) -> Column:
    """The first hyphen part in lower case, without the version it ends in."""
    return F.regexp_replace(F.lower(F.split_part(s, F.lit("-"), F.lit(1))), r"[0-9.]+$", "")


def clean_slug(slug: Column, ascii_only: bool = False) -> Column:
    """host/creator/model to creator/model; null without a third part."""
    parts = F.split(slug, "/", 3)
    return F.when(F.size(parts) == 3, F.concat(canonical_org(parts[1], ascii_only), F.lit("/"), parts[2]))


def family(provider: Column, candidate: Column) -> Column:
    """A candidate's name without its provider and without suffixes of how it was run."""
    bare = F.when((provider != "unknown") & F.startswith(candidate, F.concat(provider, F.lit("-"))), F.substr(candidate, F.length(provider) + 2)).otherwise(candidate)
    out = F.regexp_replace(bare, f"(-({'|'.join(FAMILY_SUFFIXES)}))+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("unknown")).otherwise(out)


def file_format(name: Column, tags: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", name, tags))
    return _first({k: hay.contains(k) for k in ("gguf", "safetensors", "awq", "fp8")})


def quantization(name: Column) -> Column:
    low = F.lower(name)
    q = F.nullif(F.regexp_extract(F.translate(low, "-", "_"), "(q[2-8](_[k01])?(_[sml])?|int[48])", 1), F.lit(""))
    return F.when(low.contains("awq"), F.lit("awq")).otherwise(F.coalesce(F.when(low.contains("gguf"), F.concat(F.lit("gguf:"), q)).otherwise(q), F.when(low.contains("f8"), F.lit("fp8"))))


def metric_kind(metric: Column) -> Column:
    m = F.regexp_replace(F.lower(F.trim(F.coalesce(metric, F.lit("")))), r"[-\s]+", "_")
    return F.when(m.contains("elo"), "elo").when(m.isin(*PERCENT_METRICS) | m.startswith("percent_"), "percent").otherwise("score")


def fraction_to_percent(score: Column, metric: Column) -> Column:
    return F.when((metric_kind(metric) == "percent") & (F.abs(score) <= 1), score * 100).otherwise(score)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 1, "Exact match").when(c >= 0.75, "High confidence").when(c >= 0.5, "Moderate confidence").otherwise("Needs review")


def token_count(s: Column) -> Column:
    """Words, numbers and single marks."""
    return F.regexp_count(s, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))


def benchmark_label(s: Column) -> Column:
    t = word_initials(F.translate(s, "_", " "))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("Gpqa", "GPQA"), ("Mmlu", "MMLU"), ("Swe", "SWE")), t)


def split_vendor(raw: Column, vendors: Sequence[str]) -> Column:
    """(vendor, model): a known vendor's name in front, else the first word."""
    s = F.trim(raw)
    known = F.coalesce(*[F.when(s.startswith(f"{v} "), F.lit(v)) for v in vendors], F.when(s.contains(" "), F.split_part(s, F.lit(" "), F.lit(1))))
    return F.struct(F.coalesce(known, F.lit("unknown")).alias("vendor"), F.when(known.isNull(), s).otherwise(F.trim(F.substr(s, F.length(known) + 2))).alias("model"))


def duration_hours(s: Column) -> Column:
    """20h or 45m (or bare hours) as hours; minutes are rounded to two places."""
    low = F.lower(F.trim(s))
    number = F.regexp_extract(low, r"^([0-9]*\.?[0-9]+)[hm]?$", 1).try_cast("double")
    return F.when(low.endswith("m"), F.round(number / 60, 2)).otherwise(number)


def _fixed(x: Column, digits: int) -> Column:
    """Digits after the point, rounded by the exact binary value (format_string rounds its decimal form)."""
    return F.translate(F.format_number(x, digits), ",", "")


def format_elo(x: Column) -> Column:
    return F.coalesce(F.format_number(F.floor(x + 0.5), 0), F.lit("—"))


def format_percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(_fixed(x, digits), F.lit("%")))


def format_price(x: Column) -> Column:
    return F.when(x.isNull(), "—").when(x == 0, "Free").when((x >= 1) & (x == F.floor(x)), F.concat(F.lit("$"), x.cast("bigint"))).otherwise(F.concat(F.lit("$"), _fixed(x, 2)))


def format_tokens(x: Column) -> Column:
    short = lambda v, digits: F.regexp_replace(_fixed(v, digits), r"\.?0+$", "")
    return F.when(x.isNull(), "—").when(x >= 1_000_000, F.concat(short(x / 1_000_000, 2), F.lit("M"))).when(x >= 1_000, F.concat(short(x / 1_000, 1), F.lit("K"))).otherwise(F.floor(x + 0.5).cast("string"))


def format_delta(x: Column) -> Column:
    r = F.floor(x + 0.5)
    return F.when(x.isNull(), "—").when(r > 0, F.concat(F.lit("+"), r)).otherwise(r.cast("string"))


def format_date(s: Column) -> Column:
    d = F.regexp_extract(s, "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).try_cast("date")
    return F.when(F.coalesce(s, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(d, "MMM d, yyyy"), s))
