"""Measures of rankings, labels and agreement; all by aggregation, confidence by resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.numbers import wilson


def ranking_measures(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: mean recall at each cutoff, MRR and nDCG@10 over the queries that have gold rows.

    ``ranked``: query_id, doc_id, rank from 1. ``gold``: query_id, doc_id and optionally gain (default 1).
    """
    g = gold.withColumn("gain", F.coalesce("gain", F.lit(1.0)) if "gain" in gold.columns else F.lit(1.0)).where("gain > 0")
    g = g.groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))
    best = g.withColumn("p", place).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") <= 10, F.col("gain") / F.log2(F.col("p") + 1.0))).alias("ideal"))
    hit = g.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    per = best.join(
        hit.groupBy("query_id").agg(
            *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cutoffs), F.min("rank").alias("first"),
            F.sum(F.when(F.col("rank") <= 10, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        ), "query_id", "left",
    )
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return per.agg(
        F.count("*").alias("n_queries"), *(mean(F.col(f"h{k}") / F.col("n")).alias(f"recall_at_{k}") for k in cutoffs),
        mean(1.0 / F.col("first")).alias("mrr"), mean(F.col("dcg") / F.col("ideal")).alias("ndcg_at_10"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred) to counts; rows with a null on a side are left out."""
    return pairs.where("gold is not null and pred is not null").groupBy("gold", "pred").agg(F.count("*").alias("n"))


def class_measures(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class that occurs; 0 where undefined."""
    c = confusion(pairs)
    long = c.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col("gold") == F.col("pred")).alias("same"), "n")
    t = long.groupBy("x.label").agg(F.sum(F.col("n") * F.col("x.g")).alias("n_gold"), F.sum(F.col("n") * F.col("x.p")).alias("n_pred"), F.sum(F.when(F.col("same") & (F.col("x.g") == 1), F.col("n")).otherwise(0)).alias("n_right"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio("n_right", F.col("n_pred")), ratio("n_right", F.col("n_gold"))
    return t.select("label", "n_gold", "n_pred", "n_right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))


def cohen_kappa(pairs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row: n, observed and expected agreement, kappa; with ``weights`` (label to place) quadratic weighted.

    kappa is null where no disagreement is expected.
    """
    cells = {(r["gold"], r["pred"]): r["n"] for r in confusion(pairs).collect()}  # classes squared, at most
    total = sum(cells.values())
    gold, pred = ({c: sum(n for k, n in cells.items() if k[i] == c) for c in {k[i] for k in cells}} for i in (0, 1))
    span = max(1, max(weights.values()) - min(weights.values())) if weights else 1
    cost = (lambda x, y: ((weights[x] - weights[y]) / span) ** 2) if weights else (lambda x, y: float(x != y))
    off = sum(cost(*k) * n for k, n in sorted(cells.items())) / max(total, 1)
    chance = sum(cost(x, y) * m * n for x, m in sorted(gold.items()) for y, n in sorted(pred.items())) / max(total, 1) ** 2
    row = (total, round(1 - off, 6), round(1 - chance, 6), round(1 - off / chance, 6) if chance > 0 else None)
    return pairs.sparkSession.createDataFrame([row], "n long, observed double, expected double, kappa double")


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row of agreement over (item_id, label) with two ratings or more an item; items may have different numbers."""
    cell = ratings.where("item_id is not null and label is not null").groupBy("item_id", "label").agg(F.count("*").alias("c"))
    item = cell.groupBy("item_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    share = cell.join(item.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    by_chance = share.agg((F.sum(F.col("c") * F.col("c")) / F.sum("c") / F.sum("c")).alias("e")).first()["e"]
    o = item.agg(F.count("*").alias("n_items"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("o"))
    return o.withColumn("e", F.lit(by_chance).cast("double")).select("n_items", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") < 1, (F.col("o") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation of two columns in each group, ties with their mean rank."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def mean_rank(c: str) -> Column:
        low = F.rank().over(Window.partitionBy(by).orderBy(c))
        return low + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    ranked = own.select(by, mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def proportion(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """k of n of each group with the Wilson interval."""
    out = rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"low": F.round(w["low"], 6), "high": F.round(w["high"], 6)})


def majority(votes: DataFrame, item: str, label: str) -> DataFrame:
    """The most frequent label of an item, of equally frequent ones the first by name, and its share."""
    c = votes.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("c"))
    return c.groupBy(item).agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("label"), (F.max("c") / F.sum("c")).alias("agreement"), F.sum("c").alias("n_votes"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """b and c of paired correctness (a_right, b_right) with the exact two-sided binomial p."""
    t = pairs.agg(F.count_if(F.col("a_right") & ~F.col("b_right")).alias("b"), F.count_if(~F.col("a_right") & F.col("b_right")).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    step = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")), F.struct(F.lit(0.0).alias("s"), (-n * math.log(2)).alias("l")),
        lambda a, i: F.struct((a["s"] + F.exp(a["l"])).alias("s"), (a["l"] + F.log((n - i) / (i + 1.0))).alias("l")), lambda a: a["s"],
    )
    return t.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * step)))


def bootstrap(rows: DataFrame, value: str, cluster: str | None = None, replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: mean and its percentile interval by Poisson resampling of rows, or of whole clusters.

    Each unit is drawn Poisson(1) times in each replicate, from a hash of its name, so no row is
    collected: a task adds up sums for every replicate, and the driver gets ``replicates`` pairs. Without
    a cluster equal rows are drawn together, n of them Poisson(n) times, so that neither the order nor
    the number of partitions changes a draw.
    """
    own = rows.where(F.col(value).isNotNull())
    if cluster:
        own = own.select(F.xxhash64(F.coalesce(F.col(cluster).cast("string"), F.lit(""))).alias("u"), F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    else:
        own = own.select(F.xxhash64(*own.columns).alias("u"), F.col(value).cast("double").alias("v")).groupBy("u", "v").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros(replicates), np.zeros(replicates)
        cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        for b in batches:
            many = b["n"].to_numpy() > 1
            for u, v, size in zip(b["u"][many], b["v"][many], b["n"][many]):
                k = np.random.Generator(np.random.Philox(key=[int(u) % (1 << 64), seed])).poisson(size, replicates)
                s += k * v
                n += k
            u, v = b["u"].to_numpy()[~many].astype(np.uint64), b["v"].to_numpy()[~many]
            for r in range(replicates):
                h = (u ^ np.uint64((seed * 1_000_003 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                k = np.searchsorted(cdf, (h >> np.uint64(11)) / float(1 << 53))
                s[r] += (k * v).sum()
                n[r] += k.sum()
        yield pd.DataFrame({"r": np.arange(replicates), "s": s, "n": n})

    sums = own.mapInPandas(run, "r int, s double, n double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ends = sums.agg(F.percentile("m", lo).alias("low"), F.percentile("m", hi).alias("high")).first()
    whole = own.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return whole.withColumns({"low": F.lit(ends["low"]).cast("double"), "high": F.lit(ends["high"]).cast("double")})


def weighted_share(sample: DataFrame, population: DataFrame, stratum: str, hit: Column) -> DataFrame:
    """One row: the share of hits in a stratified sample, weighed by the strata's population."""
    s = sample.groupBy(stratum).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("m"))
    n = population.groupBy(stratum).agg(F.count("*").alias("n"))
    both = s.join(n, stratum)
    return both.agg(F.count("*").alias("n_strata"), F.sum("m").alias("n_sample"), F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("weighted_share"))


def pooled(runs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id) of the union of all systems' first k with the rank each system gave."""
    top = runs.where(F.col("rank") <= k)
    ranks = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "system", F.col("rank").cast("string")))), ",")
    return top.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_systems"), F.min("rank").alias("best_rank"), ranks.alias("ranks"))
