"""Views over entities: frames of a race, gaps, alternatives, timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import ranges
from factloom.operators.asof import asof_grid
from factloom.operators.dates import week_key
from factloom.operators.stats import rank_quantile_desc
from factloom.session import durable


def envelope(series: DataFrame, key: str, time: str, value: str, ties: Sequence[str], grid: Column, out: str = "g") -> DataFrame:
    """(grid time, top, middle, quarter): of all keys' last values at each grid time."""
    at = asof_grid(series, key, time, grid, value, list(ties), out)
    both = at.groupBy(out).agg(F.max(value).alias("top"), F.count("*").alias("n"))
    return both.join(ranges.median(at, [out], value, "middle"), out).join(rank_quantile_desc(at, [out], value, 0.75, "quarter", few_keys=True), out)


def race_frames(series: DataFrame, key: str, time: str, value: str, ties: Sequence[str], grid: Column, top: int, least: int, out: str = "g") -> DataFrame:
    """The ``top`` keys at each grid time from the first time that has ``least`` keys."""
    at = asof_grid(series, key, time, grid, value, list(ties), out)
    enough = at.groupBy(F.col(out).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_g")
    w = Window.partitionBy(out).orderBy(F.desc(value), F.asc(key))
    return at.join(enough, F.col(out) == F.col("_g"), "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def month_end(t: Column) -> Column:
    """The last millisecond of a time's month."""
    return F.date_trunc("MONTH", t).cast("timestamp_ntz") + F.expr("INTERVAL '1' MONTH") - F.expr("INTERVAL '0.001' SECOND")


def standing(series: DataFrame, key: str, time: str, value: str, ties: Sequence[str]) -> DataFrame:
    """(key, month, value): each key's last value as of the end of each month, from its first to the series' last month.

    A key's months are summed up first, so no more rows than keys times months are made.
    """
    month = F.date_trunc("MONTH", time).cast("timestamp_ntz")
    last = series.where(F.col(time).isNotNull()).groupBy(key, month.alias("month")).agg(F.max_by(value, F.struct(time, *ties)).alias(value))
    until = F.broadcast(series.agg(F.max(month).alias("_last")))  # one row
    own = Window.partitionBy(key).orderBy("month")
    upto = F.coalesce(F.lead("month").over(own) - F.expr("INTERVAL '1' MONTH"), F.col("_last"))
    return last.join(until).withColumn("_upto", upto).select(key, F.explode(F.sequence("month", "_upto", F.expr("INTERVAL '1' MONTH"))).alias("month"), value)


def window_prices(prices: DataFrame, key: str, amount: str, start: str, end: str, wanted: DataFrame) -> DataFrame:
    """(key, month, price): the most frequent positive price of those in force at the ends of ``wanted(key, month)``, of equally frequent ones the lowest.

    A price meets the wanted months of its own key that lie in its window; no other months are made. All steps go by the key, so both
    sides are moved once.
    """
    first, to = F.date_trunc("MONTH", start).cast("timestamp_ntz"), F.date_trunc("MONTH", end).cast("timestamp_ntz")
    whole = F.when(F.col(end) >= month_end(F.col(end)), to).otherwise(to - F.expr("INTERVAL '1' MONTH"))
    p = prices.where((F.col(amount) > 0) & F.col(start).isNotNull()).select(F.col(key).alias("_key"), F.col(amount).alias("price"), first.alias("_first"), whole.alias("_to"))
    p = p.where("_to IS NULL OR _first <= _to")
    met = wanted.select(key, "month").join(p, (F.col(key) == F.col("_key")) & (F.col("month") >= F.col("_first")) & (F.col("_to").isNull() | (F.col("month") <= F.col("_to"))))
    each = met.groupBy(key, "month", "price").agg(F.count("*").alias("_n"))
    return each.groupBy(key, "month").agg(F.min_by("price", F.struct((-F.col("_n")).alias("n"), "price")).alias("price"))


def price_trend(series: DataFrame, prices: DataFrame, current: DataFrame, thresholds: Sequence[float], key: str = "model_id", share: float = 0.6) -> DataFrame:
    """(threshold, month, key, price, current): the cheapest key that stands at or above each threshold, month by month.

    ``series(key, t, value, id)``, ``prices(key, amount, valid_from, valid_to)``, ``current(key, price)``. The price is
    that in force at the month's end; if over all thresholds that gives fewer than ``share`` of the points that current prices
    would, all points take current prices. Of equal prices the least key counts; months without one are left out.
    """
    at = standing(series, key, "t", "value", ["id"])
    levels = F.array(*[F.lit(float(x)) for x in thresholds])
    good = at.where(F.col("value") >= min(thresholds))
    passed = lambda df, is_now: df.select(F.explode(F.filter(levels, lambda x: F.col("value") >= x)).alias("threshold"), "month", F.struct("price", key).alias("_best"), F.lit(is_now).alias("current"))
    priced = passed(good.join(window_prices(prices, key, "amount", "valid_from", "valid_to", good), [key, "month"]), False)
    now = current.where("price > 0").select(F.col(key).alias("_key"), "price")
    by_now = passed(good.join(now, F.col(key) == F.col("_key")), True)
    points = durable(priced.union(by_now).groupBy("threshold", "month", "current").agg(F.min("_best").alias("_best")))  # a few a month
    n = F.broadcast(points.agg(F.count_if("current").alias("_now"), F.count_if(~F.col("current")).alias("_then")))
    use = (F.col("_now") > 0) & (F.col("_then") < F.lit(share) * F.col("_now"))
    return points.join(n).where(F.col("current") == use).select("threshold", "month", F.col(f"_best.{key}").alias(key), F.col("_best.price").alias("price"), "current")


def most_frames(series: DataFrame, dataset: str, time: str, order: Sequence[str]) -> DataFrame:
    """(dataset, frames, chosen): how many weeks each of the datasets in ``order`` has; the one with most is chosen, of equals the first."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(dataset))
    frames = series.where(F.col(dataset).isin(*order) & F.col(time).isNotNull()).groupBy(dataset).agg(F.count_distinct(week_key(F.col(time))).alias("frames"))
    first = F.row_number().over(Window.orderBy(F.desc("frames"), place)) == 1  # a row a dataset
    return frames.withColumn("chosen", first)


def nearest(rows: DataFrame, target: DataFrame, on: Column, order: Sequence[Column], label: str) -> DataFrame:
    """(label, id): the first row by ``order`` that fits the one-row ``target`` (its columns begin with t_)."""
    return rows.join(F.broadcast(target.limit(1)), on).orderBy(*order).limit(1).select(F.lit(label).alias("label"), "id")


def first_per_id(parts: Sequence[DataFrame]) -> DataFrame:
    """Labelled picks in order; an id that was picked before is left out."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_i", F.lit(i))
        out = p if out is None else out.union(p)
    best = out.groupBy("id").agg(F.min_by("label", "_i").alias("label"))
    return best.select("label", "id")


def timeline(rows: DataFrame, seen: DataFrame, as_of: Column, active_days: int = 90) -> DataFrame:
    """Life spans: rows(id, release_date, stability) with the last date seen(id, last_seen).

    Retired ones end where they were last seen, active ones (marked current, or released within
    ``active_days``) at ``as_of``; rows of the future are left out.
    """
    s = seen.select(F.col("id").alias("_id"), F.least("last_seen", as_of).alias("last_seen"))
    j = rows.where(F.col("release_date") <= as_of).join(s, F.col("id") == F.col("_id"), "left").drop("_id")
    stability = F.lower(F.coalesce("stability", F.lit("")))
    retired = stability.isin("deprecated", "retired")
    active = ~retired & (stability.isin("latest_alias", "latest", "preview", "stable", "canonical") | (F.col("release_date") >= F.date_sub(as_of, active_days)))
    return j.withColumn("retired", retired).withColumn("active", active).withColumn("display_end", F.when(active, as_of).otherwise(F.coalesce("last_seen", "release_date")))


def relation(peer: Column, own: Column) -> Column:
    """How a family peer's release date stands to one's own."""
    return F.when(peer.isNull() | own.isNull() | (peer == own), "undated").when(peer < own, "predecessor").otherwise("successor")


def relatives(rows: DataFrame, keys: Sequence[str], id_col: str, date: str) -> DataFrame:
    """(id, predecessors, successors, undated, predecessor, successor): a row's peers by release date.

    Peers of the same date are undated. The nearest on either side is named (of equal dates the least
    id). Counted over the distinct dates of a family, so no two rows are paired.
    """
    names = [f"_{k}" for k in keys]
    days = rows.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(date).alias("_d")).agg(F.count("*").alias("_n"), F.min(id_col).alias("_first"))
    w = Window.partitionBy(*names).orderBy("_d")
    upto, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    days = days.where(F.col("_d").isNotNull()).select(*names, "_d", (F.col("_n") - 1).alias("undated"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("predecessors"), F.coalesce(F.sum("_n").over(rest), F.lit(0)).alias("successors"), F.lag("_first").over(w).alias("predecessor"), F.lead("_first").over(w).alias("successor"))
    on = [F.col(k) == F.col(a) for k, a in zip(keys, names, strict=True)] + [F.col(date) == F.col("_d")]
    return rows.join(days, on).select(F.col(id_col).alias("id"), "predecessors", "successors", "undated", "predecessor", "successor")


def suggested_pairs(rows: DataFrame, key: str, score: str, lab: str, family: str, opened: str, most: int) -> DataFrame:
    """(label, a, b): pairs worth comparing, by six rules in order, each unordered pair once, at most ``most``.

    The two leaders; the first of two labs; the first open and the first closed; the first lab and the
    first family with two; then neighbours in the ranking. Every rule needs only the first rows of
    the whole table or of each group, so nothing is ranked whole.
    """
    s = rows.where(F.col(score).isNotNull()).select(F.struct((-F.col(score)).alias("s"), F.col(key).alias("id")).alias("at"), F.col(lab).alias("lab"), F.col(family).alias("family"), F.col(opened).alias("open"))
    head = s.orderBy("at").limit(most + 6).select(F.row_number().over(Window.orderBy("at")).alias("n"), F.col("at.id").alias("id"))  # few rows
    following = head.select((F.col("n") - 1).alias("_n"), F.col("id").alias("b"))
    popular = head.join(F.broadcast(following), F.col("n") == F.col("_n")).select((F.col("n") + 4).alias("ord"), F.lit("Popular matchup").alias("label"), F.col("id").alias("a"), "b")
    leaders = popular.where("ord = 5").select(F.lit(0).alias("ord"), F.lit("Top Arena leaders").alias("label"), "a", "b")

    def firsts(group: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(group).orderBy("at"))
        two = s.where(F.col(group).isNotNull()).withColumn("n", place).where("n <= 2")
        return two.groupBy(group).agg(F.min("at").alias("first"), F.max(F.when(F.col("n") == 2, F.col("at"))).alias("second"))

    def best(group: str, ord_: int, label: str) -> DataFrame:
        return firsts(group).where("second is not null").orderBy("first").limit(1).select(F.lit(ord_).alias("ord"), F.lit(label).alias("label"), F.col("first.id").alias("a"), F.col("second.id").alias("b"))

    labs = s.where("lab is not null").groupBy("lab").agg(F.min("at").alias("at")).orderBy("at").limit(2).agg(F.sort_array(F.collect_list("at")).alias("x"))
    cross = labs.select(F.lit(1).alias("ord"), F.lit("Best cross-lab matchup").alias("label"), F.get("x", F.lit(0))["id"].alias("a"), F.get("x", F.lit(1))["id"].alias("b"))
    kinds = s.agg(F.min(F.when(F.col("open"), F.col("at"))).alias("o"), F.min(F.when(~F.col("open"), F.col("at"))).alias("c"))
    matched = kinds.select(F.lit(2).alias("ord"), F.lit("Open vs closed").alias("label"), F.col("o.id").alias("a"), F.col("c.id").alias("b"))
    every = leaders.union(cross).union(matched).union(best("lab", 3, "Same-lab faceoff")).union(best("family", 4, "Family matchup")).union(popular)
    once = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("ord")
    return every.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").withColumn("_rn", F.row_number().over(once)).where("_rn = 1").orderBy("ord").limit(most).select("label", "a", "b")


def winner(left: Column, right: Column, higher: bool) -> Column:
    """Which side wins a comparison: left, right or tie; null unless both have a value."""
    better = left > right if higher else left < right
    return F.when(left.isNull() | right.isNull(), F.lit(None)).when(left == right, "tie").when(better, "left").otherwise("right")


def cohort(rows: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Rows of an ordered list of keys with their place; a missing or repeated key is an error."""
    if len(set(wanted)) != len(wanted):
        raise ValueError("the cohort names a key twice")
    places = F.create_map(*[F.lit(x) for kv in enumerate(wanted) for x in reversed(kv)])
    out = rows.where(F.col(key).isin(*wanted)).withColumn("place", F.try_element_at(places, F.col(key)))
    n = out.agg(F.count_distinct(key), F.count("*")).first()
    if tuple(n) != (len(wanted), len(wanted)):
        raise ValueError(f"the cohort has {n[1]} rows of {n[0]} of {len(wanted)} keys")
    return out


def declutter(rows: DataFrame, group: str, position: str, gap: float, ties: Sequence[str]) -> DataFrame:
    """Moves labels up so that neighbours are ``gap`` apart: the running maximum of position - i * gap, plus i * gap."""
    w = Window.partitionBy(group).orderBy(position, *ties)
    i = (F.row_number().over(w) - 1) * F.lit(gap)
    base = rows.withColumn("_i", i).withColumn("_p", F.col(position) - F.col("_i"))
    return base.withColumn("placed", F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).drop("_i", "_p")
