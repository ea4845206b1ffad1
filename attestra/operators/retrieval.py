"""Ranked retrieval: lexical, character n-gram, set and dense scores, fusion and admissibility.

Scores come from an inverted index, never from all pairs of texts: the corpus is reduced to the tokens
that the queries have before anything is shuffled, and the partial sums of a (query, text) pair are
added where the text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.runtime import cut

K1, B, SQUASH = 1.5, 0.75, 3.0
#: Distinct query terms up to this number are broadcast, more are joined.
BROADCAST_TERMS = 1_000_000
#: A term that no tokeniser gives.
EVERY = "\x00"


def _terms(queries: DataFrame, words: Column) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query_id with their rank; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, words=tx.tokens) -> DataFrame:
    """(query_id, doc_id, score) of each pair with a common token; scores squashed to 0..1.

    ``corpus``: doc_id, text; ``queries``: query_id, text. Null texts count as documents without tokens.
    """
    terms = _small(_terms(queries, words(F.col("text"))))
    docs = corpus.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").alias("len"), F.explode(F.array_append("t", F.lit(EVERY))).alias("term"))
    asked = _small(terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(EVERY,)], "term string")))
    # the texts are read once: a term that every text has carries their number and lengths
    tf = cut(docs.join(asked, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")))
    whole = tf.where(F.col("term") == EVERY).agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("avg")).first()
    n, avg = max(1, whole["n"] or 0), max(1.0, whole["avg"] or 0.0)
    tf = tf.where(F.col("term") != EVERY)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    both = tf.join(_small(df), "term").select("doc_id", "term", part.alias("part")).join(terms, "term")
    total = both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("s"))
    return total.select("query_id", "doc_id", (F.col("s") / (F.col("s") + SQUASH)).alias("score"))


def char_ngrams(x: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each lower-case word padded by a blank on both sides; a word no longer than n gives itself once."""
    words = F.transform(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        size = F.length(w)
        one = lambda n: F.when(size > n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
        parts = [one(n).otherwise(F.when(size > n - 1, F.array(w)).otherwise(F.array().cast("array<string>")) if n > low else F.array(w)) for n in range(low, high + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(words, grams))


def tfidf_cosine(corpus: DataFrame, queries: DataFrame, grams=char_ngrams) -> DataFrame:
    """(query_id, doc_id, score): cosine of tf-idf vectors of character n-grams, fitted on the corpus.

    Raw counts, smooth idf ln((1+N)/(1+df))+1. Query n-grams that the corpus lacks are dropped.
    """
    # written once: document frequencies, norms and products are all taken from it
    tf = cut(corpus.select("doc_id", F.explode_outer(grams(F.coalesce("text", F.lit("")))).alias("term")).where("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    n = corpus.count()
    df = tf.groupBy("term").agg((F.log((1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = queries.select("query_id", F.explode(grams(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = q.join(df, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("v"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("qnorm"))
    dots = weighed.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    return dots.join(norm, "doc_id").join(qn, "query_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm") / F.col("qnorm")).alias("score"))


def jaccard(corpus: DataFrame, queries: DataFrame, words=tx.tokens) -> DataFrame:
    """(query_id, doc_id, score): shared tokens over all tokens of both, of pairs that share one."""
    d = corpus.select("doc_id", F.array_distinct(words(F.coalesce("text", F.lit("")))).alias("t")).select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    q = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("m"), F.explode("t").alias("term"))
    both = d.join(_small(q), "term").groupBy("query_id", "doc_id", "n", "m").agg(F.count("*").alias("c"))
    return both.select("query_id", "doc_id", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score"))


def dense_cosine(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """The k most similar of all (vec_id, embedding) for each (query_id, embedding), itself left out.

    A stated query set against all rows: queries are broadcast in blocks of ``block``.
    """
    q = queries.select("query_id", F.transform("embedding", lambda v: v.cast("double")).alias("q"))
    own = vectors.select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    blocks = max(1, -(-q.count() // block))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = own.withColumn("vn", F.sqrt(dot("v", "v")))
    out = None
    for i in range(blocks):
        part = F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).withColumn("qn", F.sqrt(dot("q", "q"))))
        one = own.join(part, F.col("doc_id") != F.col("query_id"))
        one = one.select("query_id", "doc_id", F.when((F.col("vn") > 0) & (F.col("qn") > 0), dot("v", "q") / F.col("vn") / F.col("qn")).otherwise(0.0).alias("score"))
        one = top_k(one, k)
        out = one if out is None else out.unionByName(one)
    return out


def fused_top(lists: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, lexical, semantic) to the ``k`` rows of each query with the largest sum of 1 / (constant + rank) over both orders.

    Ties in an order go to the smaller doc_id; the fused order is by the sum and then doc_id. No window
    sorts all matches of a query: a row outside the first ``constant + 2 * k`` of both orders can't be
    among the first k of the sum, so only those rows are ranked. A rank beyond that depth is counted:
    each row of the list adds one to the place of its query's candidates that it comes before.
    """
    depth = constant + 2 * k
    by = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c), "doc_id")
    own = lists.select("query_id", "doc_id", "lexical", "semantic")
    tops = [own.withColumn("place", F.row_number().over(by(c))).where(F.col("place") <= depth).drop("place") for c in ("lexical", "semantic")]
    # at most 2 * depth rows a query
    pool = cut(tops[0].unionByName(tops[1]).distinct())
    for c in ("lexical", "semantic"):
        pool = _counted_rank(own, pool, c)
    fused = pool.withColumn("rrf", 1 / (constant + F.col("lexical_rank")) + 1 / (constant + F.col("semantic_rank")))
    return fused.withColumn("rank", F.row_number().over(by("rrf"))).where(F.col("rank") <= k)


def _counted_rank(rows: DataFrame, pool: DataFrame, score: str) -> DataFrame:
    """The rank of the pool's rows among all rows of their query, from counts between them."""
    key = F.struct((-F.col(score)).alias("s"), F.col("doc_id").alias("d"))
    marks = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(key)).alias("marks"))
    # of each row the first mark that doesn't come before it
    found = rows.select("query_id", key.alias("own")).join(_small(marks), "query_id")
    found = found.select("query_id", (F.size(F.filter("marks", lambda m: m < F.col("own"))) + 1).alias("at")).groupBy("query_id", "at").agg(F.count("*").alias("n"))
    before = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    place = pool.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")))
    ahead = found.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the row itself is the first that its mark stops
    return place.join(ahead.select("query_id", "at", "ahead", "n"), ["query_id", "at"]).withColumn(f"{score}_rank", F.col("ahead") + F.col("n")).drop("at", "ahead", "n")


def admissible(ranked: DataFrame, least: float = 0.12, floor_k: int = 3) -> DataFrame:
    """Rows of (query_id, rank, score) that reach ``least``, and of the others the best that fill up to ``floor_k``."""
    w = Window.partitionBy("query_id")
    passing = F.col("score") >= least
    marked = ranked.withColumns({"passing": passing, "n_passing": F.count_if(passing).over(w)})
    marked = marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "passing").orderBy("rank")))
    return marked.where(F.col("passing") | (F.col("place") <= floor_k - F.col("n_passing"))).drop("n_passing", "place").withColumn("below_threshold", ~F.col("passing")).drop("passing")
