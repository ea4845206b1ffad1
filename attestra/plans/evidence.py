"""Documents to claims with their evidence: passages, claim sentences, figures, retrieval, comparison of figures.

Each stage is a lazy DataFrame; lexicons are given as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import lexicon, passages, quantities, ranking, retrieval
from attestra.runtime import cut


#: Passages of the fused ranking that the threshold is put to.
POOL = 30


def claims(docs: DataFrame, types: list[lexicon.Bucket]) -> DataFrame:
    """Claim sentences of (doc_id, text): claim_id, doc_id, passage_id, pos, text, claim_type, n_figures, period, baseline, reject_reason.

    A sentence that no lexicon term hits isn't kept. Headings and fragments are kept with their reason,
    as are repeats of an earlier claim (``repeat``); the rest have a null reason.
    """
    cut_docs = passages.passages(docs)
    rows = cut_docs.select("doc_id", "passage_id", "block", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "text"))
    # one element of an array binds the matching form, which each term would compute anew otherwise
    typed = lambda m: F.struct(m.alias("m"), lexicon.best_bucket(m, types).alias("claim_type"))
    rows = rows.select("*", F.inline(F.filter(F.transform(F.array(tx.match_form(F.col("text"))), typed), lambda x: x["claim_type"].isNotNull())))
    y = tx.years(F.col("text"))
    rows = rows.select(
        tx.stable_id(F.col("passage_id"), F.col("text")).alias("claim_id"), "doc_id", "passage_id", "block", "pos", "text", "claim_type",
        F.size(F.regexp_extract_all("text", F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))).alias("n_figures"), F.get(y, F.lit(0)).alias("period"),
        F.when(F.size(y) > 1, F.try_element_at(y, F.lit(-1))).alias("baseline"), tx.heading_reason(F.col("text")).alias("reason"), F.regexp_replace("m", r"\s+", " ").alias("m"),
    )
    # only statements take part in the search for repeats; the key of others is their own id
    keyed = rows.withColumn("key", F.when(F.col("reason").isNull(), F.md5("m")).otherwise(F.concat(F.lit("-"), "claim_id", F.col("pos").cast("string"))))
    at = F.struct("doc_id", "block", "pos")
    first = keyed.groupBy("key").agg(F.min(at).alias("first"))
    repeat = (F.col("first") < at) & F.col("reason").isNull()
    return keyed.join(first, "key").withColumn("reject_reason", F.when(repeat, "repeat").otherwise(F.col("reason"))).drop("key", "reason", "m", "first")


def evidence(docs: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.12) -> DataFrame:
    """The k passages of the documents that fused ranking puts first for each (query_id, text): query_id, doc_id (of the passage), rank, score, text."""
    corpus = passages.passages(docs).select(F.col("passage_id").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    fused, corpus = ranking.text_fusion(corpus, queries, max(k, POOL))
    fused = fused.withColumn("score", 0.55 * F.col("lexical") + 0.45 * F.col("semantic"))
    top = retrieval.admissible(fused, least).where(F.col("rank") <= k)
    return cut(top.select("query_id", "doc_id", "rank", "score", "below_threshold")).join(corpus, "doc_id")


def compared(queries: DataFrame, found: DataFrame) -> DataFrame:
    """For each query and passage the closest pair of their figures of one kind: label S (equal as printed), C (apart) or N (none to compare)."""
    q = queries.select("query_id", F.explode(quantities.quantities(F.col("text"))).alias("q")).select("query_id", F.col("q.value").alias("qv"), F.col("q.half").alias("qh"), F.col("q.kind").alias("kind"))
    e = found.select("query_id", "doc_id", "rank", F.explode_outer(quantities.quantities(F.col("text"))).alias("e")).select("query_id", "doc_id", "rank", F.col("e.value").alias("ev"), F.col("e.half").alias("eh"), F.col("e.kind").alias("kind"))
    both = e.join(q.where("kind is not null"), ["query_id", "kind"], "left")
    error = F.abs(F.col("ev") - F.col("qv")) / F.greatest(F.abs("qv"), F.lit(1.0))
    tol = F.least(F.greatest("qh", "eh"), 0.1 * F.abs("qv"))
    one = F.when(F.col("qv").isNull() | F.col("ev").isNull(), "N").when(F.abs(F.col("ev") - F.col("qv")) <= tol, "S").otherwise("C")
    return both.withColumns({"error": error, "one": one}).groupBy("query_id", "doc_id", "rank").agg(
        F.coalesce(F.min_by("one", F.coalesce("error", F.lit(float("inf")))), F.lit("N")).alias("label"), F.round(F.min("error"), 6).alias("error")
    )


def stances(queries: DataFrame, found: DataFrame, refuting: tuple[str, ...], supporting: tuple[str, ...], negations: tuple[str, ...] = (), close: float = 0.5) -> DataFrame:
    """(query_id, doc_id, rank, stance, method): figures first, then cues, then closeness of the words; else CONTEXT.

    A figure equal as printed SUPPORTS, one apart REFUTES; a refuting cue comes before a supporting one.
    Closeness alone supports nothing: it only tells RELATED from CONTEXT.
    """
    n = compared(queries, found).select("query_id", "doc_id", "label")
    both = found.join(n, ["query_id", "doc_id"], "left")
    cue = lambda terms: tx.any_of(lexicon.cue_present(F.col("text"), t, negations) for t in terms)
    pick = lambda s, m: F.struct(F.lit(s).alias("stance"), F.lit(m).alias("method"))
    out = (
        F.when(F.col("label") == "S", pick("SUPPORTS", "figure")).when(F.col("label") == "C", pick("REFUTES", "figure"))
        .when(cue(refuting), pick("REFUTES", "cue")).when(cue(supporting), pick("SUPPORTS", "cue"))
        .when(F.col("score") >= close, pick("RELATED", "words")).otherwise(pick("CONTEXT", "none"))
    )
    return both.select("query_id", "doc_id", "rank", out.alias("x")).select("query_id", "doc_id", "rank", "x.*")


def verdicts(judged: DataFrame) -> DataFrame:
    """(query_id, verdict, n_passages): CONTRADICTED by any refuting passage, else SUPPORTED by any supporting one, else INSUFFICIENT_EVIDENCE."""
    has = lambda s: F.bool_or(F.col("stance") == s)
    v = F.when(has("REFUTES"), "CONTRADICTED").when(has("SUPPORTS"), "SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")
    return judged.groupBy("query_id").agg(v.alias("verdict"), F.count("*").alias("n_passages"))
