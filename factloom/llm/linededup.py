"""Line dedup by a log-template tree.

A line's leaf in the tree is its number of tokens and its leading tokens, those with digits
generalised. Within a leaf, tokens that most of its documents share are a template and others become
fields; lines that are unlike the template are told apart by the commonest token that it doesn't have, and
have templates of their own below. Lines of templates that recur across documents are dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD, durable, fresh, hinted

FIELD = "<*>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))


def _count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _lead(line: Column, depth: int) -> Column:
    """The first ``depth`` tokens, those with a digit as fields."""
    lead = F.regexp_extract(line, rf"^[\x20\x09-\x0D]*((?:{WORD}[\x20\x09-\x0D]*){{0,{depth}}})", 1)
    return F.regexp_replace(F.rtrim(lead), r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)


def _leaf(line: Column, tokens: Column, depth: int) -> Column:
    """The leaf as a hash: token count and ``depth`` leading tokens, those with a digit as fields."""
    return F.xxhash64(tokens, _lead(line, depth))


def _hash(line: Column) -> Column:
    """A line's hash, its last three bits being 0."""
    return F.xxhash64(line).bitwiseAND(F.lit(-8))


def _key(line: Column, tokens: Column) -> Column:
    """A line's hash, its last three bits being its token count up to 7."""
    return _hash(line).bitwiseOR(F.least(tokens, F.lit(7)).cast("long"))


def _without_own(docs: DataFrame, depth: int) -> DataFrame:
    """(_same): hashes of the texts that have no line of their own.

    A line is a text's own if no different text has a line with its leading tokens, nor one with its
    last tokens: a line that a near copy changed by a word still has one of them.
    """
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("body"), F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where(_count(F.col("line")) > 0)
    ends = durable(texts.select("body", F.xxhash64(_lead(F.col("line"), depth)).alias("lead"), F.xxhash64(_lead(F.reverse("line"), depth)).alias("tail")))
    one = lambda name: ends.groupBy(name).agg(F.min("body").alias("body"), F.max("body").alias("_top")).where("body = _top").select(name, "body")
    tails = one("tail").select(F.col("tail").alias("_tail"), F.col("body").alias("_body"))
    own = one("lead").join(ends.withColumnsRenamed({"lead": "_lead", "body": "_of"}), (F.col("lead") == F.col("_lead")) & (F.col("body") == F.col("_of"))).join(tails, F.col("tail") == F.col("_tail"))
    return durable(ends.select("body").distinct().join(own.select("body").distinct(), "body", "left_anti").withColumnRenamed("body", "_same"))


def recurring(docs: DataFrame, depth: int = 3, min_documents: int = 3, similarity: float = 0.7, short_tokens: int = 5, short_documents: int = 20, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """(marked, dropped): arrays of line keys by document, and the keys of lines to drop.

    A template recurs if ``min_documents`` different documents have it, whatever the size of the
    table and however many copies they have. Equal texts are one document, and a text with a line of its
    own differs from all others. Texts without one are near copies of others, or made of shared lines
    only: they are told apart by the least and by the greatest leaf of their lines, whichever tells fewer
    apart. So what is common to copies of one document is left, and what is common to different
    documents is not. A line that recurs as it stands is its own template. In a leaf that recurs, tokens
    of over half its documents are the template and lines that agree with it in ``similarity`` of their
    tokens belong to it. The other lines are parted by the token, after the leading ones, that most
    of the leaf's documents have (of equal ones the first) and no more than half, and each part is
    treated like a leaf, for ``levels`` levels in all. Lines of fewer than ``short_tokens`` tokens need ``short_documents``
    documents, and no fields. Null texts have no lines.
    """
    docs = docs.select("doc_id", "text")
    counted = F.transform(_lines(F.col("text")), lambda v: F.struct(v.alias("line"), _count(v).alias("n")))
    lines = F.transform(counted, lambda v: F.struct(_key(v["line"], v["n"]).alias("key"), F.when(v["n"] > 0, _leaf(v["line"], v["n"], depth)).alias("leaf")))
    marked = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("body"), lines.alias("l"))
    marked = marked.join(hinted(_without_own(docs, depth)), F.col("body") == F.col("_same"), "left")
    low, high = (F.when(F.col("_same").isNull() & e.isNotNull(), F.col("body")).otherwise(e) for e in (F.array_min("l.leaf"), F.array_max("l.leaf")))
    marked = durable(marked.select("doc_id", "body", low.alias("low"), high.alias("high"), F.col("l.key").alias("keys"), F.col("l.leaf").alias("leaves")))

    def kinds(one: DataFrame, name: str) -> DataFrame:
        each = one.select(name, "low", "high").distinct()
        return each.groupBy(name).agg(F.count_distinct("low").alias("a"), F.count_distinct("high").alias("b")).select(name, F.least("a", "b").alias("kinds"))

    def exploded(name: str, column: str) -> DataFrame:
        return marked.where("low is not null").select("low", "high", F.explode(F.array_distinct(column)).alias(name)).where(f"{name} is not null")

    enough = F.col("kinds") >= min_documents
    tokens = F.col("key").bitwiseAND(F.lit(7))
    by_line = kinds(exploded("key", "keys"), "key").where(enough & (tokens > 0))
    whole = by_line.where((tokens >= short_tokens) | (F.col("kinds") >= short_documents)).select("key")
    busy = durable(kinds(exploded("leaf", "leaves"), "leaf").where(enough).select("leaf"))
    # the lines of busy leaves, each once: found by their keys first, so that only they are read as text
    each = marked.select(F.explode(F.arrays_zip("keys", "leaves")).alias("z")).select(F.col("z.keys").alias("key"), F.col("z.leaves").alias("leaf"))
    known = durable(each.where(F.col("key").bitwiseAND(F.lit(7)) >= min(short_tokens, 7)).join(hinted(busy), "leaf", "left_semi").distinct())
    held = exploded("key", "keys").join(hinted(known), "key").groupBy("leaf", "key").agg(F.count("*").alias("n"))
    texts = docs.where("text is not null").select(F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).withColumn("h", _hash(F.col("line")))
    wanted = known.select(F.col("key").bitwiseAND(F.lit(-8)).alias("h")).distinct()
    texts = texts.join(F.broadcast(wanted) if known.count() <= 200_000 else wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    found = durable(held.withColumn("h", F.col("key").bitwiseAND(F.lit(-8))).join(texts, "h").select(F.col("leaf").alias("part"), "key", "n", "line"))
    fit = None
    for _ in range(levels):
        spread = found.select("part", "key", "n", F.posexplode(_tokens(F.col("line"))).alias("pos", "token"))
        size = found.groupBy("part").agg(F.sum("n").alias("all"))
        common = 2 * F.col("have") > F.col("all")
        have = spread.groupBy("part", "pos", "token").agg(F.sum("n").alias("have")).join(size, "part")
        have = have.where(common | (F.col("pos") >= depth) & (F.col("have") >= min_documents))  # tokens that few lines have are most of all, and never matter
        pick = F.when(~common, F.struct("have", (-F.col("pos")).alias("at"), "token"))
        scored = durable(spread.join(have, ["part", "pos", "token"], "left").groupBy("part", "key").agg((F.count_if(common) / F.count("*")).alias("share"), F.max(pick).alias("pick")))
        member = scored.where(F.col("share") >= similarity).select("part", "key")
        fit = member if fit is None else fit.union(member)
        apart = scored.where((F.col("share") < similarity) & F.col("pick").isNotNull()).select("part", "key", F.xxhash64("part", "pick.at", "pick.token").alias("_next"))
        found = durable(found.join(apart, ["part", "key"]).select(F.col("_next").alias("part"), "key", "n", "line"))
        if found.isEmpty():
            break
    fit = durable(fit)
    # the template, too, must recur: its members are counted like the leaf
    live = kinds(exploded("key", "keys").join(hinted(fit), "key"), "part").where(enough).select("part")
    return marked, durable(whole.union(fit.join(live, "part", "left_semi").select("key")).distinct())


def _among(x: Column, keys: list[int]) -> Column:
    """Whether ``x`` is one of the ascending ``keys``, which are one literal of the plan: a binary search, bit by bit."""
    table = F.from_json(F.lit(json.dumps(keys)), "array<bigint>")
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(len(keys).bit_length()))])
    low = lambda x: F.aggregate(bits, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) < x, low + step).otherwise(low))
    return F.coalesce(F.get(F.transform(F.array(x), lambda y: F.get(table, low(y)) == y), F.lit(0)), F.lit(False))  # ``x`` is computed once


def dedup_lines(docs: DataFrame, most_keys: int = 200_000, **options) -> DataFrame:
    """``docs`` with recurring lines taken out of text, plus n_lines and n_dropped.

    Every row stays; n_chars, if there, follows the new text. Null text stays null with no lines, an
    empty text has one empty line, which never is dropped; equal rows are treated alike whatever
    their doc_id; columns of ``docs`` named n_lines or n_dropped are replaced, all others are carried along. Up to
    ``most_keys`` keys of recurring lines (1.6 MB) are part of the plan, and texts are filtered where they are;
    beyond that, the places of recurring lines are joined to the texts.
    """
    marked, drop = recurring(docs, **options)
    hit, of, body, own, kept = fresh(docs, "_drop", "_of", "_body", "_own", "_kept")
    lines = _lines(F.col("text"))
    rows = docs.drop("n_lines", "n_dropped")
    if drop.count() <= most_keys:
        keys = sorted(drop.select(F.col("key").bitwiseAND(F.lit(-8)).alias("h")).distinct().toArrow()["h"].to_pylist())  # a line's hash tells its number of tokens, too
        left = F.filter(lines, lambda v: ~_among(_hash(v), keys)) if keys else lines
    else:
        hits = marked.select("doc_id", "body", F.posexplode("keys").alias("pos", "key")).join(hinted(drop), "key", "left_semi")
        hits = hits.groupBy(F.col("doc_id").alias(of), F.col("body").alias(body)).agg(F.collect_set("pos").alias(hit))
        rows = rows.withColumn(own, F.xxhash64("text"))
        rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(body)), "left")
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(hit))
        # lines are split once a text, and not for each line that stays
        left = F.when(F.col(hit).isNull(), lines).otherwise(F.get(F.transform(F.array(lines), lambda every: F.transform(rest, lambda i: F.get(every, i))), F.lit(0)))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))).withColumn(kept, left)
    rows = rows.withColumn("n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size(kept)))
    rows = rows.withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
