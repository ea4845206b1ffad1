"""Rankings in the scan give the rows of the scores that joins give, ties and rare texts included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.operators import ranking, retrieval


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = ["a", "đến", "Water", "water", "năm", "2024", "x" * 9, "𝔸b", "re-use", "ít", "lò hơi", "of"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(120)] + [(500, None), (501, ""), (502, "zz qq"), (503, "  water")]
    rows += [(600 + i, "water năm 2024") for i in range(20)]
    queries = [(1, "water năm 2024"), (2, "Đến lò hơi ít"), (3, ""), (4, None), (5, "nothing here alike"), (6, "𝔸b xxxxxxxxx a of")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


def same(got, want):
    pick = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert pick(got) == pick(want) and want.count()


def test_tfidf(texts, monkeypatch):
    want = retrieval.top_k(retrieval.tfidf_cosine(*texts).withColumn("score", F.round("score", 6)), 5)
    same(ranking.tfidf_top(*texts, 5, 6), want)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ranking, "BLOCK", 7)
    monkeypatch.setattr(ranking, "GRAMS", 50)
    same(ranking.tfidf_top(*texts, 5, 6), want)
    monkeypatch.setattr(ranking, "MOST_GRAMS", 3)
    same(ranking.tfidf_top(*texts, 5, 6), want)


def test_jaccard(texts):
    same(ranking.jaccard_top(*texts, 5, 6), retrieval.top_k(retrieval.jaccard(*texts).withColumn("score", F.round("score", 6)), 5))


def fused(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["lexical_rank"], r["semantic_rank"]) for r in df.collect())


def test_token_fusion(texts, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 16)
    got = fused(ranking.token_fusion(*texts, 7, 6))
    monkeypatch.setattr(ranking, "MOST_QUERIES", 0)
    assert got == fused(ranking.token_fusion(*texts, 7, 6)) and len(got) == 21


def test_bm25(texts):
    same(ranking.bm25_top(*texts, 5, 6), retrieval.top_k(retrieval.bm25(*texts).withColumn("score", F.round("score", 6)), 5))


@pytest.mark.parametrize("name", ["tfidf_char_topk", "jaccard_topk", "passages_topk"])
def test_no_rows_of_pairs(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_graded_systems_without_joined_pairs(spark, sf, monkeypatch):
    for name in ("bm25", "jaccard", "tfidf_cosine"):
        monkeypatch.setattr(retrieval, name, None)
    assert entry.queries()["graded_systems"](spark, sf).count() == 2


def test_claim_evidence_without_joined_pairs(spark, sf, monkeypatch):
    for name in ("bm25", "tfidf_cosine", "fused_top"):
        monkeypatch.setattr(retrieval, name, None)
    assert entry.queries()["claim_evidence"](spark, sf).count() > 0


def test_text_fusion(texts, monkeypatch):
    distinct = texts[0].where("doc_id < 600"), texts[1]
    got = fused(ranking.text_fusion(*distinct, 9)[0])
    monkeypatch.setattr(ranking, "MOST_QUERIES", 0)
    want = fused(ranking.text_fusion(*distinct, 9)[0])
    # ranks of texts with equal scores hang on the order of sums where pairs are joined
    assert [r[:2] for r in got] == [r[:2] for r in want] and sum(a != b for a, b in zip(got, want)) <= len(want) // 3


def test_claim_verdicts_without_joined_pairs(spark, sf, monkeypatch):
    for name in ("bm25", "tfidf_cosine", "fused_top"):
        monkeypatch.setattr(retrieval, name, None)
    assert entry.queries()["claim_verdicts"](spark, sf).count() > 0


def test_tfidf_sends_texts_and_takes_products_by_word(spark, monkeypatch):
    import pyarrow as pa

    words = [f"word{i}" for i in range(40)]
    rows = [(i, "  " + "\x0b \n".join(random.Random(i).choices(words, k=30)) + " x\t") for i in range(200)]
    corpus, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "Word1 word2 word39"), (2, " x")], "query_id long, text string")
    same(ranking.tfidf_top(corpus, queries, 5, 6), retrieval.top_k(retrieval.tfidf_cosine(corpus, queries).withColumn("score", F.round("score", 6)), 5))
    assert dict(ranking._columns(corpus, {"w"}).dtypes)["w"] == "string"
    own = ranking.Queries.of(queries)
    score = ranking.Tfidf.of(own, corpus).fitted(own.blocks()[0])
    products, taken = ranking._product, []
    monkeypatch.setattr(ranking, "_product", lambda text, *rest: taken.append(len(text)) or products(text, *rest))
    block = {"w": pa.array([t.lower() for _, t in rows])}
    first, again = ([s for _, _, s in score(block)][0] for _ in range(2))
    # of a word 12 n-grams or more would be summed in each text
    assert (first == again).all() and sum(taken[1:]) <= 2 * 200 * 32


def test_a_task_gives_only_its_first_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    own = ranking.Queries.of(texts[1])
    index = ranking.indexed(texts[0].coalesce(1), own)
    rows = ranking._tops(index, [ranking.Bm25(own, index), ranking.Jaccard(own)], own.blocks()[0], 3, 6)
    assert rows.groupBy("q", "by").count().agg(F.max("count")).first()[0] == 3
