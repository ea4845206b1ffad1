"""Corpus-level views: profiles, entity names, held-out groups, paired runs, differences between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx

# Words that come before the name of a legal person.
LEGAL_FORMS = ("Công ty", "Tập đoàn", "Tổng công ty", "Company", "Group", "Corporation")
MOST_CLASSES = 10_000


def profile(docs: DataFrame, role: str, kind: str, text: str, top: int = 6) -> DataFrame:
    """One row: texts, texts by role and kind as sorted ``name:count`` lists, the most mentioned years.

    A role or kind with more than ``MOST_CLASSES`` classes is no class and raises.
    """
    one = docs.agg(F.count("*").alias("n_texts"), F.count_if(F.col(text).isNull()).alias("n_missing"))

    def tally(c: str) -> str:
        counts = docs.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
        if len(counts) > MOST_CLASSES:
            raise ValueError(f"{c} has more than {MOST_CLASSES} classes")
        return ",".join(sorted(f"{r[c]}:{r['n']}" for r in counts))

    y = docs.select(F.explode(tx.years(F.col(text))).alias("y")).groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(top).collect()
    return one.withColumns({"roles": F.lit(tally(role)), "kinds": F.lit(tally(kind)), "top_years": F.lit(",".join(r["y"] for r in y))})


def entity_names(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, name, n): the name after a legal form that a key's texts mention most, if ``least`` times; ties by name."""
    forms = "|".join(LEGAL_FORMS)
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?:{forms})((?:\s+\p{{Lu}}[\p{{L}}]+){{1,4}})"), F.lit(1))
    names = docs.where(F.col(key).isNotNull()).select(key, F.explode(F.transform(found, lambda n: F.regexp_replace(F.trim(n), r"\s+", " "))).alias("name"))
    counts = names.groupBy(key, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy(key).agg(F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("name"))).alias("x")).select(key, "x.*")


def held_out(groups: DataFrame, group: str, size: str, share: float) -> DataFrame:
    """Groups taken out whole: largest first, each if it still fits into ``share`` of the total; of equal size those of the smallest names.

    The fit is sequential by nature, but all groups of one size fit alike: as many of them as the room
    holds. So it runs over the distinct sizes, whose sum is no more than the total, and the driver
    holds one number for each of them.
    """
    g = groups.groupBy(group).agg(F.sum(size).cast("long").alias("n")).where(F.col(group).isNotNull())
    sizes = g.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()
    room, take = sum(r["n"] * r["c"] for r in sizes) * share, []
    for r in sizes:
        fits = min(r["c"], int(room // r["n"])) if r["n"] > 0 else r["c"]
        room -= fits * r["n"]
        take.append((r["n"], fits))
    kept = groups.sparkSession.createDataFrame([t for t in take if t[1]], "n long, fits long")
    # only a size that fits in part needs an order; the others pass whole
    place = F.row_number().over(Window.partitionBy("n").orderBy(group))
    return g.join(kept, "n").withColumn("place", place).where(F.col("place") <= F.col("fits")).select(group, "n")


def leave_group_out(rows: DataFrame, cell: list[str], group: str, hit: Column) -> DataFrame:
    """Hits of n of each cell and group without the group's own rows: totals less own."""
    own = rows.groupBy(*cell, group).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy(*cell)
    return own.select(*cell, group, (F.sum("k").over(w) - F.col("k")).alias("k_others"), (F.sum("n").over(w) - F.col("n")).alias("n_others"))


def first_term(x: Column, classes: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first class of which a term stands in a folded name, underscores, hyphens and dots being blanks."""
    t = F.regexp_replace(tx.fold(F.coalesce(x, F.lit(""))), r"[_.\-]+", " ")
    return F.coalesce(*(F.when(tx.any_of(F.contains(t, F.lit(w)) for w in words), name) for name, words in classes.items()), F.lit(other))


def labelled(x: Column, labels: dict[str, str]) -> Column:
    """A code's label, the code itself without one."""
    return F.coalesce(F.create_map(*(F.lit(v) for kv in labels.items() for v in kv))[x], x)


def qualifiers(meta: dict[str, Column]) -> Column:
    """``key: value`` of the values that are neither null nor blank, in the given order."""
    return F.array_compact(F.array(*(F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in meta.items())))


def figure_place(x: Column, text: Column) -> Column:
    """Where a figure stands in a text on digit boundaries, from 0, in plain, dotted or comma spelling; null where it doesn't."""
    plain = F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"\.?0+$", "")
    grouped = F.format_number(F.floor(x), 0)
    spellings = [plain, F.replace(plain, F.lit("."), F.lit(",")), grouped, F.replace(grouped, F.lit(","), F.lit("."))]
    at = [F.regexp_instr(F.concat(F.lit(" "), text), F.concat(F.lit("[^0-9.,]"), F.regexp_replace(s, r"\.", "[.]"), F.lit(r"([.,]?[^0-9.,]|[.,]?$)"))) for s in spellings]
    return F.coalesce(*(F.when(p > 0, p - 1) for p in at))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two runs by id: the change, and which of the runs lack the id."""
    x, y = a.select(key, F.col(value).alias("before"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("after"), F.lit(True).alias("in_b"))
    both = x.join(y, key, "full")
    state = F.when(F.col("in_b").isNull(), "gone").when(F.col("in_a").isNull(), "new").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return both.select(key, "before", "after", state.alias("state"))


def elapsed_minutes(begin: Column, end: Column) -> Column:
    """Minutes from one clock time to the next, across midnight."""
    m = lambda c: F.hour(c) * 60 + F.minute(c)
    return F.pmod(m(end) - m(begin), F.lit(1440))


def error_field(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The first field in which two records differ, nulls being equal to each other; null where none does."""
    return F.coalesce(*(F.when(~a[k].eqNullSafe(b[k]), k) for k in a))


def contained_ngrams(part: Column, whole: Column, n: int = 6) -> Column:
    """Share of a text's word n-grams that another has; null for a text of fewer words."""

    def grams(x: Column) -> Column:
        words = F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != "")
        # the words are bound once: an expression inside a lambda is computed for each of its elements
        one = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))))
        return one[0]

    g = grams(part)
    return F.size(F.array_intersect(g, F.coalesce(grams(whole), F.array().cast("array<string>")))) / F.size(g)


def ranked_merge(parts: list[DataFrame], key: str, status: str, order: dict[str, int], tie: str) -> DataFrame:
    """One row a key of several tables: the best status first, of equal ones the smallest ``tie``."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    rank = F.coalesce(F.create_map(*(F.lit(v) for kv in order.items() for v in kv))[F.col(status)], F.lit(len(order)))
    return both.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*both.columns), F.struct(rank, F.col(tie))).alias("r")).select("r.*")
