"""Queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def tokenizer_paths() -> tuple[str, str]:
    """Paths of the byte-level vocabulary: as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op3_media_columns")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import media

    return media.media_columns(spark, table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths(), keep_ids=False).drop("ids")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import simhash

    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import linededup

    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import mixing

    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN a.ok AND b.ok THEN list_cosine_similarity(a.e, b.e) END >= 0.95),
r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
SELECT vec_id, (SELECT count(*) FROM l WHERE u = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(w) FROM r WHERE u = vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(w) FROM r WHERE u = vec_id), vec_id)) AS kept
FROM v
"""


@query("op8_embedding_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import embed

    return embed.links(table(spark, sf_dir, "embeddings"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import license

    found = license.scan(table(spark, sf_dir, "documents"))
    pairs = F.transform("matches", lambda m: F.concat(m["template"], F.lit(":"), F.format_number(m["containment"], 4)))
    names = F.transform("matches", lambda m: m["template"])
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), most.alias("containment"), F.array_join(pairs, ",").alias("containments"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm import align

    return align.alignment(table(spark, sf_dir, "documents"), *tokenizer_paths(), public_tokenizers.path("piece_bpe_32k.model"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op13_exact_top_k", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import search

    return search.top_k(table(spark, sf_dir, "embeddings"))
