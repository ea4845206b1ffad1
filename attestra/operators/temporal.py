"""Dated joins, graph hops and three-valued conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.runtime import cut, cut_path

#: Rows of a rule table up to this number are broadcast to a dated join, more are joined by key.
BROADCAST_RULES = 200_000


def in_force(start: Column, end: Column, on: Column) -> Column:
    """Whether a closed period, open where an end is null, holds a date."""
    return F.coalesce(start <= on, F.lit(True)) & F.coalesce(on <= end, F.lit(True))


def applies(listed: Column, value: Column) -> Column:
    """Whether a list names a value; an empty or null list names all, an unknown value passes."""
    return (F.coalesce(F.size(listed), F.lit(0)) <= 0) | value.isNull() | F.array_contains(listed, value)


def dated_join(facts: DataFrame, rules: DataFrame, key: str, on: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Facts with each rule of their key in force on their date."""
    small = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    return facts.join(small, key).where(in_force(F.col(start), F.col(end), F.col(on)))


def as_of(facts: DataFrame, history: DataFrame, by: list[str], at: str, since: str, keep: list[str]) -> DataFrame:
    """Facts with the latest row of ``history`` of their key at or before their time; nulls where there is none.

    One sort of both tables together, no pairs: each fact takes the last history row before it.
    """
    f = facts.withColumns({"_t": F.col(at), "_side": F.lit(1), "_h": F.lit(None).cast(history.select(F.struct(since, *keep)).schema[0].dataType)})
    h = history.where(F.col(since).isNotNull()).select(*by, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(since, *keep).alias("_h"))
    both = f.unionByName(h, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_h").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_h", F.last("_h", ignorenulls=True).over(w)).where("_side = 1")
    return last.select(*facts.columns, *(F.col("_h")[c].alias(f"{c}_as_of" if c in facts.columns else c) for c in [since, *keep]))


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hop): nodes reached from each start along (src, dst) edges, with the fewest hops, start itself at 0."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct())
    front = seen
    for k in range(1, depth + 1):
        reach = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = cut(reach.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(k)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new), drop=cut_path(seen) if k > 1 else None)
        front = new
    return seen


def combine(status: str = "status") -> Column:
    """The outcome of a rule's conditions, each SATISFIED, NOT_SATISFIED or UNKNOWN: silence is not failure."""
    has = lambda s: F.coalesce(F.bool_or(F.col(status) == s), F.lit(False))
    return (
        F.when(has("NOT_SATISFIED"), "NOT_MATCH")
        .when(has("SATISFIED") & ~has("UNKNOWN"), "MATCH")
        .when(has("SATISFIED"), "PARTIAL")
        .otherwise("INSUFFICIENT")
    )


def three_valued(test: Column) -> Column:
    return F.when(test.isNull(), "UNKNOWN").when(test, "SATISFIED").otherwise("NOT_SATISFIED")


def missing_years(years: Column) -> Column:
    """Years between the first and the last of a set that the set lacks."""
    return F.array_except(F.sequence(F.array_min(years), F.array_max(years)), years)


def change(rows: DataFrame, key: list[str], year: str, value: str, base: int, current: int) -> DataFrame:
    """Value in two years and its change as a share of the first; null where a year is missing or the base is 0."""
    at = lambda y: F.sum(F.when(F.col(year) == y, F.col(value)))
    out = rows.groupBy(*key).agg(at(base).alias("base_value"), at(current).alias("current_value"))
    return out.withColumn("change", F.when(F.col("base_value") != 0, F.col("current_value") / F.col("base_value") - 1))


def nearest_year(s: Column, pos: Column) -> Column:
    """The last year written before a position of a text."""
    found = F.regexp_extract_all(F.substring(s, F.lit(1), pos), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
