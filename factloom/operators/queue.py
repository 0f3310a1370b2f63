"""Review of entities that could not be resolved: batches of approvals, new entities and organisations, and their effects.

A batch is a table with a ``position``. Its guards are joins over the whole batch; each row gets the first
guard that it breaks, as if the rows came one after the other. A batch with any such row changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import normalize_alias
from factloom.operators.joins import union_all
from factloom.operators.merge import insert_replace
from factloom.operators.ranges import ranked
from factloom.session import durable, kept


class Rejected(ValueError):
    """A batch that breaks a guard."""


@dataclass(frozen=True)
class Review:
    """The tables that a review reads and changes.

    models(id, slug, developer_id, display_name), organizations(id, display_name, aliases),
    aliases(source_id, alias, model_id, method), records(id, source_id, name, alias): ``alias`` is the one that a
    record is linked to; queue(id, record_id, model_id, status, resolved, candidates): status is pending,
    accepted or resolved, ``resolved`` whether its effects are in place, ``candidates`` the names that an
    accepted row gives its model; audit(queue_id, record_id, model_id, action).
    """

    models: DataFrame
    organizations: DataFrame
    aliases: DataFrame
    records: DataFrame
    queue: DataFrame
    audit: DataFrame

    def changed(self, **tables: DataFrame) -> Review:
        return replace(self, **{k: durable(v) for k, v in tables.items()})


def _first(*guards: tuple[Column, str]) -> Column:
    """The text of the first guard that is broken; null conditions aren't."""
    return F.coalesce(*[F.when(broken, F.lit(what)) for broken, what in guards])


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _there(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.select(F.col(key).alias(f"_{flag}")).where(F.col(f"_{flag}").isNotNull()).distinct().withColumn(flag, F.lit(True))


def _queued(batch: DataFrame, review: Review) -> DataFrame:
    """``batch`` with its queue rows: ``there``, ``waiting``, the record, and whether another row speaks for that record.

    A row that an earlier one of the batch has taken isn't waiting; a record of which the batch takes a row has one that speaks for it.
    """
    q = review.queue
    spoken = q.where(F.col("status").isin("accepted", "resolved")).groupBy(F.col("record_id").alias("_spoken")).agg(F.count("*").alias("_n"))
    rows = q.select(F.col("id").alias("_q"), "record_id", (~F.col("status").eqNullSafe("pending") | F.col("resolved") | F.col("model_id").isNotNull()).alias("_done"), F.col("status").isin("accepted", "resolved").cast("long").alias("_own"), F.lit(True).alias("there"))
    j = batch.join(rows, F.col("queue_id") == F.col("_q"), "left").join(spoken, F.col("record_id") == F.col("_spoken"), "left")
    taken = F.row_number().over(Window.partitionBy("queue_id").orderBy("position")) > 1
    beside = F.row_number().over(Window.partitionBy("record_id").orderBy("position")) > 1
    return j.withColumn("waiting", ~(F.col("_done") | taken)).withColumn("sibling", (F.coalesce("_n", F.lit(0)) - F.col("_own") > 0) | (F.col("record_id").isNotNull() & beside)).drop("_q", "_done", "_own", "_spoken", "_n")


def _queue_guards() -> list[tuple[Column, str]]:
    return [(F.col("there").isNull(), "queue row not found"), (~F.col("waiting"), "queue row is not pending without a candidate"), (F.col("sibling"), "record has another authoritative row")]


def _problems(j: DataFrame, item: Column, *guards: tuple[Column, str]) -> DataFrame:
    return j.select("position", item.cast("string").alias("item"), _first(*guards).alias("problem")).where("problem IS NOT NULL")


def accept_problems(review: Review, approvals: DataFrame) -> DataFrame:
    """(position, item, problem) of ``approvals(position, queue_id, model_id)``."""
    j = _queued(approvals.withColumnRenamed("model_id", "target"), review).join(_there(review.models, "id", "known"), F.col("target") == F.col("_known"), "left")
    missing = F.col("queue_id").isNull() | F.col("target").isNull()
    return _problems(j, F.col("queue_id"), (missing, "a number is missing"), (F.col("known").isNull(), "model not found"), *_queue_guards())


def new_model_problems(review: Review, reviews: DataFrame) -> DataFrame:
    """(position, item, problem) of ``reviews(position, queue_id, slug, developer_id, display_name, aliases)``."""
    j = _queued(reviews, review)
    j = j.join(_there(review.models, "slug", "taken"), F.col("slug") == F.col("_taken"), "left").join(_there(review.organizations, "id", "made"), F.col("developer_id") == F.col("_made"), "left")
    j = j.join(review.records.select(F.col("id").alias("_r"), "source_id", F.col("alias").isNotNull().alias("linked")), F.col("record_id") == F.col("_r"), "left")
    again = F.row_number().over(Window.partitionBy("slug").orderBy("position")) > 1
    j = j.withColumn("again", again)
    names = j.select("position", "source_id", F.explode("aliases").alias("alias"))
    held = review.aliases.where("model_id IS NOT NULL").select(F.col("source_id").alias("_s"), F.col("alias").alias("_a")).distinct().withColumn("held", F.lit(True))
    before = F.min("position").over(Window.partitionBy("source_id", "alias")) < F.col("position")
    clash = names.withColumn("before", before).join(held, (F.col("source_id") == F.col("_s")) & (F.col("alias") == F.col("_a")), "left")
    clash = clash.groupBy(F.col("position").alias("_p")).agg(F.max(F.coalesce("held", F.lit(False)) | F.col("before")).alias("owned"), (F.count("*") > F.count_distinct(normalize_alias(F.col("alias")))).alias("twice"))
    j = j.join(clash, F.col("position") == F.col("_p"), "left")
    empty = F.coalesce(F.size("aliases") <= 0, F.lit(True)) | F.exists("aliases", lambda a: F.trim(F.coalesce(a, F.lit(""))) == "")
    return _problems(
        j, F.col("slug"), (F.col("queue_id").isNull(), "a number is missing"), (_blank("slug") | _blank("developer_id") | empty, "a text is missing"),
        (~F.startswith(F.col("slug"), F.concat("developer_id", F.lit("/"))), "slug doesn't begin with the developer"), (F.size(F.split("slug", "/")) > 2, "slug has more than two parts"),
        (F.col("taken") | F.col("again"), "model exists"), (F.col("made").isNull(), "organization not found"), *_queue_guards(), (F.col("linked"), "record is linked"),
        (F.col("twice"), "an alias is named twice"), (F.col("owned"), "alias is linked to a model"),
    )


def _identities(organizations: DataFrame) -> DataFrame:
    """A row for each id and each alias, normalised: ``name``."""
    named = organizations.withColumn("_given", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("aliases", F.array().cast("array<string>")))))
    return named.withColumn("name", F.coalesce(normalize_alias(F.col("_given")), "id")).drop("_given")


def organization_problems(review: Review, reviews: DataFrame) -> DataFrame:
    """(position, item, problem) of ``reviews(position, id, display_name, aliases)``; an identity is an id or a normalised alias."""
    known = _identities(review.organizations).select(F.col("name").alias("_name")).distinct().withColumn("known", F.lit(True))
    mine = _identities(reviews.select("position", "id", "aliases")).distinct().withColumn("before", F.min("position").over(Window.partitionBy("name")) < F.col("position"))
    mine = mine.join(known, F.col("name") == F.col("_name"), "left")
    seen = mine.groupBy(F.col("position").alias("_p")).agg(F.max(F.col("known") & (F.col("name") == F.col("id"))).alias("made"), F.max("known").alias("clash"), F.max("before").alias("before"), F.count("*").alias("names"))
    j = reviews.join(seen, F.col("position") == F.col("_p"), "left")
    given = 1 + F.greatest(F.size("aliases"), F.lit(0))
    blank = F.coalesce(F.exists("aliases", lambda a: F.trim(F.coalesce(a, F.lit(""))) == ""), F.lit(False))
    return _problems(
        j, F.col("id"), (_blank("id") | blank, "a text is missing"), (normalize_alias(F.col("id")) != F.col("id"), "id isn't normalized"), (F.col("names") < given, "an identity is named twice"),
        (F.col("made"), "organization exists"), (F.col("clash"), "identity exists"), (F.col("before"), "identity is in the batch already"), (_blank("display_name"), "a text is missing"),
    )


def _whole(problems: DataFrame) -> None:
    if found := problems.orderBy("position").limit(5).collect():
        raise Rejected("; ".join(f"{r['item']}: {r['problem']}" for r in found))


def accept_batch(review: Review, approvals: DataFrame) -> Review:
    """Pending rows accepted with the models that a reviewer names; raises ``Rejected`` and changes nothing if any can't be."""
    _whole(accept_problems(review, approvals))
    a = approvals.select(F.col("queue_id").alias("_q"), F.col("model_id").alias("_m"))
    j = review.queue.join(a, F.col("id") == F.col("_q"), "left")
    hit = F.col("_q").isNotNull()
    queue = j.withColumns({"model_id": F.when(hit, F.col("_m")).otherwise(F.col("model_id")), "status": F.when(hit, F.lit("accepted")).otherwise(F.col("status"))})
    audit = j.where(hit).select(F.col("id").alias("queue_id"), "record_id", F.col("_m").alias("model_id"), F.lit("accept").alias("action"))
    return review.changed(queue=queue.select(*review.queue.columns), audit=review.audit.unionByName(audit))


def accept_new_models(review: Review, reviews: DataFrame) -> Review:
    """Models minted in the order of the batch, their names linked, and their rows resolved; all of them or none."""
    _whole(new_model_problems(review, reviews))
    last = F.broadcast(review.models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")))  # one row
    r = ranked(reviews, [], "position").join(last).withColumn("_m", F.col("_last") + F.col("_i") + 1)
    j = durable(review.queue.select(F.col("id").alias("queue_id"), "record_id").join(r, "queue_id").join(review.records.select(F.col("id").alias("record_id"), "source_id"), "record_id"))
    models = review.models.unionByName(j.select(F.col("_m").alias("id"), "slug", "developer_id", "display_name"))
    names = j.select("source_id", F.posexplode("aliases").alias("_pos", "alias"), F.col("_m").alias("model_id"), F.lit("manual_review").alias("method"), "queue_id")
    done = j.select(F.col("queue_id").alias("_q"), F.col("_m").alias("_model"), F.col("record_id").alias("_record"), F.get("aliases", F.lit(0)).alias("_alias"))
    q = review.queue.join(done, F.col("id") == F.col("_q"), "left")
    hit = F.col("_q").isNotNull()
    queue = q.withColumns({"model_id": F.when(hit, F.col("_model")).otherwise(F.col("model_id")), "status": F.when(hit, F.lit("resolved")).otherwise(F.col("status")), "resolved": F.col("resolved") | hit})
    records = review.records.join(done, F.col("id") == F.col("_record"), "left").withColumn("alias", F.coalesce("_alias", "alias"))
    audit = j.select("queue_id", "record_id", F.col("_m").alias("model_id"), F.lit("new_model").alias("action"))
    aliases = insert_replace(review.aliases.withColumn("queue_id", F.lit(None).cast("long")), names, ["source_id", "alias"], [F.desc("queue_id")])
    return review.changed(models=models, aliases=aliases.select(*review.aliases.columns), queue=queue.select(*review.queue.columns), records=records.select(*review.records.columns), audit=review.audit.unionByName(audit))


def accept_organizations(review: Review, reviews: DataFrame) -> Review:
    """Organisations added; all of them or none."""
    _whole(organization_problems(review, reviews))
    return review.changed(organizations=review.organizations.unionByName(reviews.select(*review.organizations.columns)))


def _names() -> Column:
    return F.filter(F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")


def _applied(review: Review, rows: DataFrame, action: str, new: DataFrame) -> Review:
    """Queue rows put in place, of ``rows(queue_id, record_id, model, link)``: the record is linked to ``link``, the row is done.

    ``new(source_id, alias, model_id, queue_id)`` become aliases of their models; of rows that give one name in a source, the last one's model holds.
    """
    old = review.aliases.withColumn("queue_id", F.lit(None).cast("long"))
    aliases = insert_replace(old, new.withColumn("method", F.lit("manual_review")), ["source_id", "alias"], [F.desc("queue_id")]).select(*review.aliases.columns)
    done = rows.select(F.col("queue_id").alias("_q"), F.col("model").alias("_m"))
    hit, q = F.col("_q").isNotNull(), review.queue.join(done, F.col("id") == F.col("_q"), "left")
    queue = q.withColumns({"model_id": F.when(hit, F.col("_m")).otherwise(F.col("model_id")), "status": F.when(hit, F.lit("accepted")).otherwise(F.col("status")), "resolved": F.col("resolved") | hit})
    link = rows.groupBy(F.col("record_id").alias("_r")).agg(F.max_by("link", "queue_id").alias("_link"))
    records = review.records.join(link, F.col("id") == F.col("_r"), "left").withColumn("alias", F.coalesce("_link", "alias"))
    audit = rows.select("queue_id", "record_id", F.col("model").alias("model_id"), F.lit(action).alias("action"))
    return review.changed(aliases=aliases, queue=queue.select(*review.queue.columns), records=records.select(*review.records.columns), audit=review.audit.unionByName(audit))


def drain(review: Review, only: Sequence[int] | None = None) -> tuple[Review, DataFrame]:
    """Effects of accepted rows: their candidates become aliases of their model, their record is linked to the first.

    Rows without a name to give stay as they are. Also returns (processed, aliases, skipped); with a dry run in mind, that and
    no more is to be read. ``only`` names the queue rows to take; a row is taken once.
    """
    ready = (F.col("status") == "accepted") & ~F.col("resolved") & F.col("model_id").isNotNull()
    if only is not None:
        ready = ready & F.col("id").isin(list(only))
    queued = review.queue.where(ready).select(F.col("id").alias("queue_id"), "record_id", F.col("model_id").alias("model"), _names().alias("names"))
    rows = durable(queued.join(review.records.select(F.col("id").alias("record_id"), "source_id"), "record_id").withColumn("link", F.get("names", F.lit(0))))
    given = F.size("names") > 0
    summary = rows.agg(F.count(F.when(given, 1)).alias("processed"), F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("aliases"), F.count(F.when(~given, 1)).alias("skipped"))
    new = rows.select("source_id", F.explode("names").alias("alias"), F.col("model").alias("model_id"), "queue_id")
    return _applied(review, rows.where(given), "drain", new), summary


#: Up to so many names, those of a round are broadcast.
FEW = 500_000


def _reached(pending: DataFrame, known: DataFrame, max_rounds: int) -> DataFrame:
    """(source_id, alias, model, queue_id): ``known(source_id, alias, model)`` and all names that pending rows add to them, round by round.

    All rows of one name are accepted in one round, so rounds go over names: ``pending(queue_id, source_id, link, names)`` becomes
    a table of which name gives which, written once. A round meets it with the names that the last one added, and no table is written again.
    """
    others = F.filter("names", lambda n: n != F.col("link"))
    edges = kept(pending.select("source_id", "link", F.explode_outer(others).alias("name"), "queue_id").groupBy("source_id", "link", "name").agg(F.max("queue_id").alias("queue_id")))
    held = [kept(known.withColumn("queue_id", F.lit(None).cast("long")))]
    for _ in range(max_rounds):
        last = held[-1].select(F.col("source_id").alias("_s"), F.col("alias").alias("_a"), "model")
        last = F.broadcast(last) if last.count() <= FEW else last
        met = edges.join(last, (F.col("source_id") == F.col("_s")) & (F.col("link") == F.col("_a")))
        given = kept(met.groupBy("source_id", F.col("name").alias("alias")).agg(F.max_by("model", "queue_id").alias("model"), F.max("queue_id").alias("queue_id")))
        every = union_all(held)
        if given.isEmpty():
            return every
        before = every.select(F.col("source_id").alias("_s"), F.col("alias").alias("_a"))
        held.append(kept(given.where("alias IS NOT NULL").join(before, (F.col("source_id") == F.col("_s")) & (F.col("alias") == F.col("_a")), "left_anti")))
    raise RuntimeError(f"did not settle in {max_rounds} rounds")


def settle(review: Review, max_rounds: int = 100) -> Review:
    """Drains, then accepts what the new aliases make resolvable, until a round changes nothing.

    A pending row is resolvable if its record's name is an alias of a model in its source; it is linked to that, and
    gives its own candidates as names of the model, but never takes a name from another one. There are as many rounds as the longest
    chain of names; raises after ``max_rounds``.
    """
    review, _ = drain(review)
    known = review.aliases.where("model_id IS NOT NULL").select("source_id", "alias", F.col("model_id").alias("model"))
    names = review.records.select(F.col("id").alias("record_id"), "source_id", F.col("name").alias("link"))
    waiting = (F.col("status") == "pending") & ~F.col("resolved") & F.col("model_id").isNull()
    pending = kept(review.queue.where(waiting).select(F.col("id").alias("queue_id"), "record_id", _names().alias("names")).join(names, "record_id"))
    reached = _reached(pending, known, max_rounds)
    at = reached.select(F.col("source_id").alias("_s"), F.col("alias").alias("_a"), "model")
    rows = kept(pending.join(at, (F.col("source_id") == F.col("_s")) & (F.col("link") == F.col("_a"))).select("queue_id", "record_id", "model", "link"))
    if rows.isEmpty():
        return review
    return _applied(review, rows, "settle", reached.where("queue_id IS NOT NULL").select("source_id", "alias", F.col("model").alias("model_id"), "queue_id"))
