"""Labels, runs and packs under review: merging passes, checking rows, sampling by strata, scoring by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_passes(first: DataFrame, second: DataFrame, decided: DataFrame, key: str = "item_id", label: str = "label") -> DataFrame:
    """Labels of two passes and of an adjudicator: key, label, source (agreed, adjudicated, single, open).

    An adjudicated label stands whatever the passes say; two equal labels agree, a lone one is single,
    and unequal ones are open with a null label. Repeated rows of a pass count once, the smallest label first.
    """
    one = lambda t, n: t.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(n))
    both = one(first, "a").join(one(second, "b"), key, "full").join(one(decided, "c"), key, "full")
    source = F.when(F.col("c").isNotNull(), "adjudicated").when(F.col("a") == F.col("b"), "agreed").when(F.col("a").isNull() | F.col("b").isNull(), "single").otherwise("open")
    return both.select(key, F.when(source == "open", None).otherwise(F.coalesce("c", "a", "b")).alias(label), source.alias("source"))


def label_problems(rows: DataFrame, key: str = "item_id", verdict: str = "verdict", relation: str = "relation") -> DataFrame:
    """Verdicts that their relations of evidence contradict: key, verdict, problems (array, never empty).

    Supported needs a supporting relation and no refuting one, contradicted a refuting one, insufficient neither.
    """
    has = lambda r: F.bool_or(F.coalesce(F.upper(relation) == r, F.lit(False)))
    g = rows.groupBy(key, verdict).agg(has("SUPPORTS").alias("s"), has("REFUTES").alias("r"))
    v = F.upper(verdict)
    tests = {
        "supported_without_support": (v == "SUPPORTED") & ~F.col("s"), "supported_despite_refutation": (v == "SUPPORTED") & F.col("r"),
        "contradicted_without_refutation": (v == "CONTRADICTED") & ~F.col("r"), "insufficient_despite_evidence": (v == "INSUFFICIENT_EVIDENCE") & (F.col("s") | F.col("r")),
    }
    problems = F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    return g.select(key, verdict, problems.alias("problems")).where(F.size("problems") > 0)


def stratified(rows: DataFrame, stratum: Column, group: str, key: str, quota: dict[str, int], per_group: int) -> DataFrame:
    """Up to a quota of rows from each stratum, at most ``per_group`` of them from one group, in the order of a hash of the key.

    A row's place among its group's is found first, so that a large group is cut before the rows of a
    stratum come together. Rows without a key are left out; a stratum without quota gives none.
    """
    own = rows.withColumn("stratum", stratum).where(F.col(key).isNotNull() & F.col("stratum").isin(*quota))
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("stratum", group).orderBy(*order))).where(F.col("place") <= per_group)
    most = F.coalesce(*(F.when(F.col("stratum") == s, n) for s, n in quota.items()))
    own = own.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy("place", *order)))
    # the head of a window is cut before the sort where its bound is a number
    return own.where(F.col("turn") <= max(quota.values())).where(F.col("turn") <= most).drop("place")


def layer_scores(cases: DataFrame, group: list[str], gold: str = "gold", said: str = "said", abstain: str = "N") -> DataFrame:
    """Of each group: n, decided, right, coverage, precision of what was decided, false_s and false_c (decided S or C against the gold label)."""
    decided = F.coalesce(F.col(said) != abstain, F.lit(False))
    right = F.coalesce(F.col(said) == F.col(gold), F.lit(False))
    false = lambda x: F.count_if(F.coalesce((F.col(said) == x) & (F.col(gold) != x), F.lit(False)))
    g = cases.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(decided).alias("decided"), F.count_if(decided & right).alias("decided_right"), F.count_if(right).alias("right"), false("S").alias("false_s"), false("C").alias("false_c"))
    return g.withColumns({"coverage": F.col("decided") / F.col("n"), "precision": F.col("decided_right") / F.nullif(F.col("decided"), F.lit(0))}).drop("decided_right")


def selective(pairs: DataFrame, gold: str = "gold", said: str = "pred", abstain: str = "INSUFFICIENT_EVIDENCE", refuted: str = "CONTRADICTED") -> DataFrame:
    """One row: n, accuracy, macro_f1 over gold classes, false_contradiction (refuted though not so), coverage, selective_accuracy, majority_baseline.

    The classes are counted where the rows are; only their counts come together.
    """
    counts = pairs.where(F.col(gold).isNotNull() & F.col(said).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(said).alias("p")).agg(F.count("*").alias("n"))
    by_gold, by_said = counts.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("ng")), counts.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    hit = counts.where("g = p").select(F.col("g").alias("c"), F.col("n").alias("tp"))
    f1 = by_gold.join(by_said, "c", "left").join(hit, "c", "left").select((2.0 * F.coalesce("tp", F.lit(0)) / (F.col("ng") + F.coalesce("np", F.lit(0)))).alias("f1"), "ng")
    macro = f1.agg(F.avg("f1").alias("macro_f1"), F.max("ng").alias("largest")).withColumn("one", F.lit(1))
    right, decided = F.col("g") == F.col("p"), F.col("p") != abstain
    of = lambda t: F.sum(F.when(t, F.col("n")).otherwise(0))
    whole = counts.agg(
        F.sum("n").alias("n"), of(right).alias("right"), of(decided).alias("decided"), of(decided & right).alias("decided_right"), of((F.col("p") == refuted) & ~right).alias("fc"), of(F.col("g") != refuted).alias("not_refuted"),
    ).withColumn("one", F.lit(1))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return whole.join(macro, "one").select(
        F.coalesce("n", F.lit(0)).alias("n"), share("right", "n").alias("accuracy"), "macro_f1", share("fc", "not_refuted").alias("false_contradiction"), share("decided", "n").alias("coverage"),
        share("decided_right", "decided").alias("selective_accuracy"), share("largest", "n").alias("majority_baseline"),
    )


def stance_measures(judged: DataFrame, method: str = "method", gold: str = "gold", said: str = "said") -> DataFrame:
    """Of each method and stance that it gave: n, right and precision."""
    g = judged.where(F.col(said).isNotNull()).groupBy(method, F.col(said).alias("stance")).agg(F.count("*").alias("n"), F.count_if(F.col(said) == F.col(gold)).alias("right"))
    return g.withColumn("precision", F.col("right") / F.col("n"))


def decisive(labels: Column, abstain: str = "N") -> Column:
    """The one label other than ``abstain`` that several paths agree on, else ``abstain``."""
    named = F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != abstain)))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(abstain)


def graded_ranking(ranked: DataFrame, relevant: DataFrame, system: str = "system", cut: int = 5) -> DataFrame:
    """Of each system: n_queries, recall at 1, 3 and ``cut``, hit, mrr and ndcg at ``cut`` with gains 2^rel - 1, means over the queries that have a relevant document.

    ``ranked``: system, query_id, doc_id, rank; ``relevant``: query_id, doc_id, rel. A query that a system
    doesn't rank counts as zero for it.
    """
    rel = relevant.where(F.col("rel") > 0).groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    gain = lambda r: (F.pow(F.lit(2.0), "rel") - 1) / F.log2(r + 1)
    placed = rel.withColumn("place", F.row_number().over(order))
    ideal = placed.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("place") <= cut, gain(F.col("place"))).otherwise(0.0)).alias("ideal"))
    top = ranked.where(F.col("rank") <= cut).groupBy(system, "query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = top.join(rel, ["query_id", "doc_id"]).groupBy(system, "query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in sorted({1, 3, cut})), F.min("rank").alias("best"), F.sum(gain(F.col("rank"))).alias("dcg"))
    total = ideal.count()
    both = ranked.select(system).distinct().join(hits.join(ideal, "query_id"), system, "left")
    mean = lambda x, n: (F.coalesce(F.sum(x), F.lit(0.0)) / F.nullif(F.lit(total), F.lit(0))).alias(n)
    recall = [mean(F.col(f"h{k}") / F.col("n_rel"), f"recall_{k}") for k in sorted({1, 3, cut})]
    return both.groupBy(system).agg(F.lit(total).alias("n_queries"), *recall, mean((F.col(f"h{cut}") > 0).cast("double"), "hit"), mean(1 / F.col("best"), "mrr"), mean(F.col("dcg") / F.col("ideal"), "ndcg"))


def latest_outputs(runs: DataFrame, key: Column, stamp: str) -> DataFrame:
    """The latest row of each key over all runs."""
    names = [c for c in runs.columns if c != "key"]
    return runs.withColumn("key", key).where(F.col("key").isNotNull() & F.col(stamp).isNotNull()).groupBy("key").agg(F.max_by(F.struct(*names), F.struct(stamp, *(c for c in names if c != stamp))).alias("x")).select("key", "x.*")


def conditions(rows: DataFrame) -> DataFrame:
    """(rule_id, check, any_of_terms, operator, threshold, evidence) with ``status``: SATISFIED, NOT_SATISFIED or UNKNOWN.

    ``terms_present``: one of the terms is in the evidence. ``numeric_threshold``: a number of the evidence
    passes the comparison. Manual and unsupported checks, and missing evidence, are UNKNOWN.
    """
    from attestra.functions import numbers
    from attestra.functions import text as tx

    t = tx.match_form(F.col("evidence"))
    present = F.exists("any_of_terms", lambda w: F.contains(t, tx.match_form(w)))
    read = F.transform(F.regexp_extract_all("evidence", F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), numbers.locale_number)
    passes = lambda n: (F.when(F.col("operator") == ">=", n >= F.col("threshold")).when(F.col("operator") == ">", n > F.col("threshold")).when(F.col("operator") == "<=", n <= F.col("threshold")).when(F.col("operator") == "<", n < F.col("threshold")).when(F.col("operator") == "==", n == F.col("threshold")))
    tested = F.when(F.col("check") == "terms_present", present).when((F.col("check") == "numeric_threshold") & (F.size(read) > 0), F.exists(read, passes))
    return rows.withColumn("status", F.when(tested, "SATISFIED").when(~tested, "NOT_SATISFIED").otherwise("UNKNOWN"))


def amendment_chain(instruments: DataFrame, as_of: Column, issue: Column | None = None) -> DataFrame:
    """(base_id, amendment_id) of instruments in force with the amendments in force at a date, each of the issue asked for.

    ``instruments``: id, effective_from, effective_to, legal_issues, amended_by (array of ids). An open end
    is in force for ever; an instrument without a start never is. A name that no instrument has is left out.
    """
    live = instruments.where((F.col("effective_from") <= as_of) & (F.col("effective_to").isNull() | (F.col("effective_to") >= as_of)))
    about = live if issue is None else live.where(F.array_contains("legal_issues", issue))
    edges = about.select(F.col("id").alias("base_id"), F.explode("amended_by").alias("amendment_id")).distinct()
    return edges.join(live.select(F.col("id").alias("amendment_id")).distinct(), "amendment_id").select("base_id", "amendment_id")


def as_of_date(mode: Column, year: Column, today: Column) -> Column:
    """The day at which rules are looked up: the last of the claim's year (historical), or today (current); null where the mode or its year is missing."""
    return F.when(mode == "historical", F.make_date(year, F.lit(12), F.lit(31))).when(mode == "current", today)


def unbound_clauses(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """(rule_id, clause_id, ready): every clause that a rule cites, and whether it exists."""
    cited = rules.select("rule_id", F.explode_outer("clause_ids").alias("clause_id")).distinct()
    known = clauses.select("clause_id").distinct().withColumn("known", F.lit(True))
    return cited.join(known, "clause_id", "left").select("rule_id", "clause_id", F.coalesce("known", F.lit(False)).alias("ready"))


def rerank(candidates: DataFrame, model_score: Column, k: int) -> DataFrame:
    """The k candidates of each query with the best model score, a missing score last, ties in their old order."""
    own = candidates.withColumn("model_score", model_score).withColumnRenamed("rank", "old_rank")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("model_score"), "old_rank", "doc_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def find_document(store: DataFrame, sha256: str, name: str) -> DataFrame:
    """The stored document with a hash: that of the same name if there is one, else the earliest stored; no row for an unknown hash."""
    own = store.where(F.col("sha256") == sha256)
    order = F.struct((F.col("name") != name).cast("int"), "stored_at", "id")
    return own.groupBy("sha256").agg(F.min_by(F.struct(*store.columns), order).alias("x")).select("x.*")


def listed_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs that can be read (those with an id and a time), the newest first."""
    return runs.where(F.col("run_id").isNotNull() & F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), "run_id").limit(n)


def rationale_checks(rows: DataFrame) -> DataFrame:
    """(rationale, must_mention, evidence) with mentioned (share of the words to be mentioned), covers (half or more) and ungrounded (numbers that the evidence lacks)."""
    from attestra.functions import text as tx

    words = F.array_distinct(tx.tokens(F.coalesce("must_mention", F.lit(""))))
    there = F.array_intersect(words, tx.tokens(F.coalesce("rationale", F.lit(""))))
    share = F.when(F.size(words) > 0, F.size(there) / F.size(words)).otherwise(1.0)
    figures = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return rows.withColumns({"mentioned": share, "covers": share >= 0.5, "ungrounded": F.array_sort(F.array_except(figures("rationale"), figures("evidence")))})


def golden_measures(expected: DataFrame, got: DataFrame) -> DataFrame:
    """One row: n_cases, claim_recall, status_accuracy (of the claims found), citation_coverage (found claims with a citation).

    ``expected``: case_id, claim_key, status; ``got``: case_id, claim_key, status, citations (array).
    """
    found = got.groupBy("case_id", "claim_key").agg(F.min("status").alias("said"), F.max(F.size(F.coalesce("citations", F.array().cast("array<string>")))).alias("cited"))
    both = expected.join(found, ["case_id", "claim_key"], "left")
    there = F.col("said").isNotNull()
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    return both.agg(F.count("*").alias("n_claims"), share(there, F.lit(True)).alias("claim_recall"), share(there & (F.col("said") == F.col("status")), there).alias("status_accuracy"), share(there & (F.col("cited") > 0), there).alias("citation_coverage"))


def run_audit(before: DataFrame, after: DataFrame, key: Column, watched: list[str]) -> DataFrame:
    """Claims of two runs side by side on a normalised key: key, place (both, before, after), changed (watched columns that differ)."""
    one = lambda t, n: t.withColumn("key", key).where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(*watched)).alias(n))
    both = one(before, "a").join(one(after, "b"), "key", "full")
    place = F.when(F.col("a").isNull(), "after").when(F.col("b").isNull(), "before").otherwise("both")
    changed = F.array_compact(F.array(*(F.when((place == "both") & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in watched)))
    return both.select("key", place.alias("place"), changed.alias("changed"))
