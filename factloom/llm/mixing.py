"""Mixing sources to target weights, by blocks of words.

Every source's documents form one stream of words, cut into blocks of a fixed length. Output shards
draw how many blocks of each source they hold; the k-th block a source gives is found through a
pseudorandom permutation of its block numbers, one permutation for each pass over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import WORD, durable, fresh, hinted

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def targets(totals: DataFrame, share: float, limit: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds sid, weight and target to ``totals(source, source_size)``, one row a source.

    ``share`` of all words is dealt by weight; a target stops at ``limit`` times its source's size
    and what is over is dealt again to the others. That settles at one level: sources are capped in
    order of limit over weight, and the first that its level doesn't fill fixes the level.
    """
    ranked = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * limit)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    before, after, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level)
    fixed = F.first(F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.col("_level")), ignorenulls=True).over(all_rows)
    return ranked.withColumn("target", F.least(F.coalesce(fixed * F.col("weight"), F.col("_cap")), F.col("_cap"))).drop("_cap", "_level")


def running(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``key`` before this one, by (bucket, order).

    Sums of buckets come first, so that no window holds more than one bucket of a key.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(sums, (F.col(key) == F.col("_k")) & (F.col(bucket) == F.col("_b")))
    return rows.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_k", "_b", "_before")


def _step(x: Column, rows: Column, cols: Column, *seed: Column) -> Column:
    """A bijection of [0, rows * cols): the two coordinates of x are shifted by hashes of each other."""
    left, right = F.floor(x / cols), x % cols
    for k in range(3):
        left = F.pmod(left + F.pmod(F.xxhash64(right, *seed, F.lit(2 * k)), rows), rows)
        right = F.pmod(right + F.pmod(F.xxhash64(left, *seed, F.lit(2 * k + 1)), cols), cols)
    return left * cols + right


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """The place of x in a pseudorandom permutation of [0, n).

    Steps go over the least near-square grid that holds n numbers and are repeated until they land
    below n; fewer than sqrt(n) + 1 numbers lie above, so 64 repeats always are enough up to n = 4,096
    and fail with a chance below 64 ** -64 beyond.
    """
    rows = F.ceil(F.sqrt(n))
    cols = F.ceil(n / rows)
    once = _step(x, rows, cols, *seed)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda at, _: F.when(at < n, at).otherwise(_step(at, rows, cols, *seed)))
    return F.when(once < n, once).otherwise(again)


def slots(sources: DataFrame, block: int, shard_blocks: int, limit: float, seed: int) -> DataFrame:
    """(sid, shard, pass, idx): the blocks that the mix takes.

    The counts of each source in a shard of ``shard_blocks`` blocks are one draw from the multinomial
    distribution of the targets' shares. A source's blocks are numbered through the shards; what the
    draws have beyond its target is left out, and what they are short of is in closing shards after
    the drawn ones, so that every source gives exactly its target in blocks. Blocks after ``limit``
    passes over a source are left out.
    """
    spark = sources.sparkSession
    want = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    want = want.withColumn("want", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), (F.col("blocks") * limit).cast("long")))
    upto = F.sum("want").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    want = durable(want.select("sid", "blocks", "want", upto.alias("hi"), (upto - F.col("want")).alias("lo")).where("want > 0"))
    total = want.agg(F.max("hi")).first()[0] or 0
    shards = -(-total // shard_blocks)
    # a draw is a number below total; sources lie side by side there, and cells of equal width find them
    cells = 4096
    width = max(1, -(-total // cells))
    lookup = want.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    shard = spark.range(0, shards, 1, max(1, -(-shards // 256))).withColumnRenamed("id", "shard")
    last = F.least(F.lit(shard_blocks).cast("long"), F.lit(total) - F.col("shard") * shard_blocks)
    draw = shard.select("shard", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("k")).select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "k"), F.lit(max(1, total))).alias("at"))
    found = draw.withColumn("cell", F.floor(F.col("at") / width)).join(hinted(lookup), "cell").where("at >= lo and at < hi")
    counts = durable(found.groupBy("sid", "shard").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("shard") / 4096)))
    first = running(counts, "sid", "range", ["shard"], "n", "first").select("sid", "shard", "first", "n")
    drawn = counts.groupBy(F.col("sid").alias("_sid")).agg(F.sum("n").alias("_drawn"))
    short = want.join(drawn, F.col("sid") == F.col("_sid"), "left").select("sid", F.coalesce("_drawn", F.lit(0)).alias("first"), (F.col("want") - F.coalesce("_drawn", F.lit(0))).alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closing = short.select("sid", "first", "n", before.alias("_at"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / shard_blocks))).alias("_part"))
    start = F.col("_part") * shard_blocks
    closing = closing.select("sid", (F.lit(shards) + F.floor((F.col("_at") + start) / shard_blocks)).alias("shard"), (F.col("first") + start).alias("first"), F.least(F.lit(shard_blocks), F.col("n") - start).alias("n"))
    known = first.unionByName(closing).join(hinted(want.select(F.col("sid").alias("_sid"), "blocks", "want")), F.col("sid") == F.col("_sid"))
    every = known.select("sid", "blocks", "want", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k")).where(F.col("k") < F.col("want"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    return every.select("sid", "shard", turn.alias("pass"), permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), turn).alias("idx"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): key is a hash of the whole row, so rows of one key are copies of one another."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), _key(docs).alias("key"))


def _key(docs: DataFrame) -> Column:
    """A hash of the row, nulls told apart from other values."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain, *(c.isNull() for c in plain))


def mixture(docs: DataFrame, share: float = 1.5, limit: float = 2.0, block: int = 128, shard_blocks: int = 1024, seed: int = 42, bucket_rows: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, source, size, source_size, target, sid, key, copies, at; a row for all copies of
    one row (``copies`` of them), whose first word has place ``at`` in the source's stream, each
    copy's words following the one before. pieces: what the mix is made of, (shard, pass, sid, idx,
    at, copy, first, words): words [first, first + words) of that copy of the document at ``at``.
    documents is written to the shared folder. Null sources are one source, the last; null and
    repeated doc_ids and repeated rows each have their own place; an empty table gives no rows;
    other columns only help to tell rows apart.
    """
    rows = durable(_keyed(docs).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies")))
    totals = rows.groupBy("source").agg(F.sum("all").alias("source_size"), F.count("*").alias("_n"))
    sources = durable(targets(totals, share, limit))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_n") / bucket_rows))
    known = rows.join(hinted(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    placed = running(known.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "key"), buckets)), "sid", "_bucket", ["doc_id", "key", "size"], "all", "at")
    placed = durable(placed.select("doc_id", "source", "size", "source_size", "target", "sid", "key", "copies", "at"))
    one = placed.where("size > 0").select("sid", "at", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).withColumn("from", F.col("at") + F.col("copy") * F.col("size"))
    spread = one.select("*", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))).alias("idx"))
    first, end = F.greatest(F.col("idx") * block - F.col("from"), F.lit(0)), F.least((F.col("idx") + 1) * block - F.col("from"), F.col("size"))
    taken = slots(sources, block, shard_blocks, limit, seed).hint("merge").join(spread.select("sid", "idx", "at", "copy", first.alias("first"), (end - first).alias("words")), ["sid", "idx"])
    return placed, taken.select("shard", "pass", "sid", "idx", "at", "copy", "first", "words")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words the mix takes of each row, repeats counted."""
    placed, pieces = mixture(docs, **options)
    took = pieces.groupBy("sid", "at", "copy").agg(F.sum("words").alias("words")).select(F.col("sid").alias("_s"), F.col("at").alias("_a"), F.col("copy").alias("_c"), "words")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # rows without words would share a place with others, and none of theirs is taken
    some = each.where("size > 0").join(took.hint("merge"), (F.col("sid") == F.col("_s")) & (F.col("at") == F.col("_a")) & (F.col("copy") == F.col("_c")), "left")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    return some.select(*columns, F.coalesce("words", F.lit(0)).cast("long").alias("taken")).union(each.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows like those of ``docs``: a row for each piece of a block, in order of shards.

    text is the piece's words as they stand in the document, with the white space between them;
    n_chars, if there, follows it; the other columns are the document's. So a document comes as often
    as the mix takes its blocks, cut at the blocks' ends. Rows without words give none; null and
    repeated doc_ids and equal rows give their own pieces; an empty table gives no rows; columns of
    any other name are carried along.
    """
    placed, pieces = mixture(docs, **options)
    key, of, cut = fresh(docs, "_key", "_of", "_cut")
    cuts = pieces.groupBy("sid", "at").agg(F.collect_list(F.struct("shard", "pass", "idx", "copy", "first", "words")).alias(cut)).select(F.col("sid").alias("_s"), F.col("at").alias("_a"), cut)
    cuts = placed.where("size > 0").join(cuts, (F.col("sid") == F.col("_s")) & (F.col("at") == F.col("_a"))).select(F.col("key").alias(of), cut)
    rows = docs.where("text is not null").withColumn(key, _key(docs)).dropDuplicates([key]).join(cuts.hint("merge"), F.col(key) == F.col(of))
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    # the words are split once a document, then each piece is a slice of them
    texts = F.transform(F.array(words), lambda w: F.transform(cut, lambda p: F.struct(p["shard"].alias("shard"), p["idx"].alias("idx"), p["first"].alias("first"), F.rtrim(F.array_join(F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int")), ""), F.lit(BLANKS)).alias("text"))))[0]
    named = {"text": F.col(f"{cut}.text")} | ({"n_chars": F.length(F.col(f"{cut}.text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    out = rows.withColumn(cut, F.explode(texts))
    order = [F.col(f"{cut}.shard"), F.col(f"{cut}.idx"), F.col(f"{cut}.first")]
    return out.repartition(order[0]).sortWithinPartitions(*order).select(*[named.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
