"""Records: first occurrences, canonical rows, upserts, logs, samples, splits, checks of a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx


def first_occurrence(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows whose key is null are all kept.

    Aggregated before the shuffle, so a key that many rows share costs one row a task.
    """
    cols = rows.columns
    keyed = rows.withColumn("_k", key)
    best = keyed.where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")
    return best.unionByName(keyed.where("_k is null").select(*cols))


def canonical(rows: DataFrame, key: str, id_col: str, order: list[Column]) -> DataFrame:
    """(key, canonical id, n): of the rows of one key the id that comes first in the order."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(id_col, F.struct(*order)).alias("canonical_id"), F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_unless: dict[str, str] | None = None) -> DataFrame:
    """Old rows with the non-null values of new rows of their key, and the rows of new keys.

    A column in ``keep_unless`` keeps its old value unless that is null or the given word. Columns are
    those of ``old``; of several new rows of a key any one may win, so make keys unique first.
    """
    keep = keep_unless or {}
    o, n = old.alias("o"), new.alias("n")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            kept = F.when(F.col(f"o.{c}").isNotNull() & (F.col(f"o.{c}") != keep[c]), F.col(f"o.{c}"))
            cols.append(F.coalesce(kept, F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def by_precedence(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables, of each key those of the first table that has it; one row a key."""
    ranked = None
    for i, p in enumerate(parts):
        one = p.withColumn("_p", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    cols = [c for c in ranked.columns if c != "_p"]
    return ranked.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*cols), F.struct("_p", F.xxhash64(*(F.col(c).cast("string") for c in cols)))).alias("r")).select("r.*")


def latest(log: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The last entry of an append-only log for each key."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"), F.count("*").alias("n_entries")).select(*key, "r.*", "n_entries")


def transitions(log: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Log entries with the state before them, null for the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("previous", F.lag(state).over(w))


def hashed_order(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), id_col.cast("string")))


def capped_sample(rows: DataFrame, group: str, id_col: str, cap: int, seed: str = "s") -> DataFrame:
    """At most ``cap`` rows of each group, those first in the order of a hash of their id."""
    w = Window.partitionBy(group).orderBy(hashed_order(F.col(id_col), seed), id_col)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def round_robin(rows: DataFrame, group: str, id_col: str, n: int, seed: str = "s") -> DataFrame:
    """n rows taken in turns from the groups; within a group by hash of the id, within a turn by group.

    Only the first n of each group can be taken, which bounds what is ranked over all groups.
    """
    turn = capped_sample(rows, group, id_col, n, seed)
    w = Window.orderBy("place", group, id_col)
    return turn.orderBy("place", group, id_col).limit(n).withColumn("pick", F.row_number().over(w))


def year_split(year: Column) -> Column:
    return F.when(year.isin(2021, 2022), "train").when(year == 2023, "dev").when(year == 2024, "test").when(year == 2025, "future_holdout").otherwise("review")


def hash_split(key: Column, train: int = 800, validation: int = 100) -> Column:
    """A split by the key's hash in thousandths; equal keys share one."""
    h = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test")


def leakage(rows: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys that stand in more than one split, with the splits."""
    pairs = rows.select(key.alias("leak_key"), split).where(f"leak_key is not null and {split} is not null").distinct()
    return pairs.groupBy("leak_key").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n_splits")).where("n_splits > 1")


def coverage(rows: DataFrame, entity: str, year: str, kind: str, kinds: dict[str, tuple[str, ...]], first: int, last: int) -> DataFrame:
    """Entity x year grid with a flag for each kind, the share of kinds present and the missing ones."""
    have = rows.where(F.col(entity).isNotNull()).groupBy(entity, year).agg(*(F.max(F.when(F.col(kind).isin(*v), 1).otherwise(0)).alias(k) for k, v in kinds.items()))
    grid = rows.where(F.col(entity).isNotNull()).select(entity).distinct().withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = grid.join(have, [entity, year], "left").fillna(0, list(kinds))
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return out.withColumn("score_pct", F.round(total / len(kinds) * 100, 1)).withColumn("missing", F.concat_ws(";", *(F.when(F.col(k) == 0, k) for k in kinds)))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_null, n_rows), one row a column: what is incomplete."""
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null"), F.col("n").alias("n_rows")) for c in columns))).alias("r")).select("r.*")


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails; a check that is null counts as failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())))


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows that refer to no parent; null references are not counted."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def perturbations(rows: DataFrame, value: str, year: str) -> DataFrame:
    """Families of altered figures with the label they must get: unchanged S, other value C, other year N."""
    v, y = F.col(value), F.col(year)
    make = lambda fam, lab, val, yr: F.struct(F.lit(fam).alias("family"), F.lit(lab).alias("label"), val.alias("new_value"), yr.alias("new_year"))
    families = F.array_compact(F.array(
        make("S0", "S", v, y), F.when(v != 0, make("C1", "C", v * 2, y)), F.when(v != 0, make("C2", "C", v * 0.5, y)), make("N1", "N", v, y + 1), F.when(v >= 10, make("S1", "S", F.round(v, 0), y)),
    ))
    return rows.withColumn("p", F.explode(families)).select(*rows.columns, "p.*")


def new_numbers(before: Column, after: Column) -> Column:
    """Numbers of an edited text that the text before lacks."""
    n = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    return F.array_except(n(after), n(before))


def profile(docs: DataFrame, group: str) -> DataFrame:
    """Texts of a group: count, distinct texts, lengths (median, and p95 as the value at int(n * 0.95) of the sorted ones)."""
    own = docs.select(group, F.length(F.coalesce("text", F.lit(""))).alias("len"), F.md5(F.lower(F.trim("text"))).alias("h"))
    whole = own.groupBy(group).agg(F.count("*").alias("n_texts"), F.count_distinct("h").alias("n_distinct"), F.median("len").alias("len_median"))
    # a group's texts are reduced to a count for each length before they are put in order
    by_len = own.groupBy(group, "len").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    ordered = by_len.withColumns({"n": F.sum("c").over(w), "end": F.sum("c").over(w.orderBy("len"))})
    p95 = ordered.where(F.col("end") > F.floor(F.col("n") * 0.95)).groupBy(group).agg(F.min("len").alias("len_p95"))
    return whole.alias("w").join(p95.alias("p"), F.col(f"w.{group}").eqNullSafe(F.col(f"p.{group}"))).select("w.*", "len_p95")


def concentration(rows: DataFrame, key: str) -> DataFrame:
    """One row: Herfindahl index of the keys' shares and the effective number of keys."""
    c = rows.groupBy(key).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("n_keys"))
    return t.select("n_keys", (F.col("n2") / F.col("n") / F.col("n")).alias("hhi"), (F.col("n") * F.col("n") / F.col("n2")).alias("effective_n"))


def snapshot(x: Column, preview: int = 280) -> Column:
    return F.struct(F.sha2(x, 256).alias("text_hash"), F.substring(x, 1, preview).alias("preview"))


def stable_key(rows: DataFrame, parts: list[str], name: str = "id") -> DataFrame:
    return rows.withColumn(name, tx.stable_id(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))


def numbered_repeats(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids made unique: the second and later ones of an id get ``#n``."""
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("unique_id", F.when(k > 1, F.concat(F.col(id_col), F.lit("#"), k.cast("string"))).otherwise(F.col(id_col)))
