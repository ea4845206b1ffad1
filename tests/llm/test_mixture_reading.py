from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import mixture as m
from attestra.llm import reading as r
from attestra.llm import sentences as s

TARGETS = "source string, target_share double, max_repeats int, rate double"


def counted(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, n_tokens long")


def test_shares_and_caps(spark):
    rows = [(i, "big", 100) for i in range(6000)] + [(10_000 + i, "small", 50) for i in range(400)] + [(20_000 + i, "other", 9) for i in range(50)] + [(30_000, None, 5), (30_001, "big", 0)]
    t = spark.createDataFrame([("big", 0.5, 1, 0.0), ("Small ", 0.3, 4, 0.0), ("none", 0.2, 3, 0.0)], TARGETS)
    out = m.mix(counted(spark, rows), t)
    shares = {x["source"]: x for x in out.shares.collect()}
    assert abs(shares["big"]["reached_share"] - 0.625) < 0.02 and abs(shares["small"]["reached_share"] - 0.375) < 0.02
    assert shares["small"]["most_copies"] == 4 and shares["none"]["reached_tokens"] == 0 and shares["none"]["rate"] == 0
    assert out.documents.where("copies > 4 or (source = 'big' and copies > 1)").count() == 0
    assert {x["source"] for x in out.documents.select("source").distinct().collect()} == {"big", "small"}
    again = m.mix(counted(spark, rows[::-1]), t)
    assert sorted(map(tuple, again.documents.collect())) == sorted(map(tuple, out.documents.collect()))
    assert m.emit(out.documents).count() == out.documents.agg(F.sum("copies")).first()[0]


def test_asked_total_and_cap(spark):
    rows = [(i, "a", 10) for i in range(2000)] + [(5000 + i, "b", 10) for i in range(100)]
    t = spark.createDataFrame([("a", 0.5, 2, 0.0), ("b", 0.5, 3, 0.0)], TARGETS)
    got = {x["source"]: x for x in m.mix(counted(spark, rows), t, total_tokens=20_000).shares.collect()}
    assert got["b"]["reached_tokens"] == 3000 and abs(got["a"]["reached_tokens"] - 10_000) < 800


def test_empty_mixture(spark):
    t = spark.createDataFrame([("a", 1.0, 2, 0.0)], TARGETS)
    out = m.mix(counted(spark, []), t)
    assert out.documents.count() == 0 and out.shares.first()["reached_tokens"] == 0
    assert m.mix(counted(spark, [(1, "a", 1)]), t.limit(0)).documents.count() == 0


@pytest.mark.skipif(not os.path.isdir(m.TOKENIZERS), reason="no tokenizers here")
def test_token_counts_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello world, it's 2024.", "Nhà máy Dốc Bần 87 còn thiếu 3,2% số ngày đo", "", None, "<|endoftext|>  \n\n x"]
    t = tokenizers.Tokenizer.from_file(f"{m.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, "s", x, 7) for i, x in enumerate(texts)], "doc_id long, source string, text string, n_tokens int")
    got = {x["id"]: x["n_tokens"] for x in m.token_counts(df, vocabulary="byte_bpe_50k.tiktoken").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for i, x in enumerate(texts)}


@pytest.mark.parametrize(
    "text,words,n",
    [
        ("One two three. Four five!", 5, 2), ("Heading\n\nOne two\nthree.", 4, 2), ("It rose 3.5 percent in 2024. Then fell.", 8, 2), ("Approx. values, see no. 4 here.", 6, 1),
        ("(TP. Khe Sậu, tr. 4). Hết.", 6, 2), ("Really?! Yes… no", 3, 3), ("1. First item\n\n2. Second item", 6, 2), ("e.g. this one. And that.", 5, 2), ("A\r\n\r\nB", 2, 2), ("in the year\n2034. Next one.", 6, 2), ("", 0, 0), ("  \n ", 0, 0),
        ("said “it is so.” Then", 5, 1), ("﻿One two.", 2, 1),
    ],
)
def test_sentences(text, words, n):
    assert s.count(text) == (words, n)


def test_levels_on_held_out_texts(spark):
    rng = np.random.default_rng(0)
    easy = ["the sun is warm today", "we like the pond", "mum walks home"]
    rows = []
    for i in range(300):
        n = int(rng.integers(1, 6)) * 5
        one = " ".join(rng.choice(["alpha", "beta", "because", "gamma", "consequently", "delta"], n)) + ". "
        rows.append((i, one * 6 if i % 3 else ". ".join(easy) + ".", "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "12 34. 5", "x"), (1003, "x" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, level string")
    train, test = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1 and doc_id < 1000")
    model = r.fit(r.features(train))
    got = r.graded(r.reading_levels(test, model=model)).collect()
    assert np.mean([abs(x["level"] - x["grade"]) <= 1 for x in got]) > 0.95 and np.mean([x["level"] == x["grade"] for x in got]) > 0.7
    out = r.reading_levels(df)
    assert {x["id"] for x in out.select("id").collect()} == {i for i, t, _ in rows if t and any(map(str.isalpha, t))}
    want = {i for i, t, _ in rows if t and any(map(str.isalpha, t)) and s.count(t)[0] / s.count(t)[1] < 10}
    assert {x["id"] for x in r.easy_texts(out).collect()} == want
    assert r.reading_levels(df.limit(0)).count() == 0


def test_gradient_of_the_regression():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    o = r.Ordinal(4)
    p = np.array([0.3, -0.2, 0.1, -1.0, 0.1, -0.3])

    def loss(p):
        cuts = np.concatenate([[-np.inf], o._cuts(p[3:]), [np.inf]])
        z = x @ p[:3]
        f = lambda c: 1 / (1 + np.exp(z - c))
        return -np.log(f(cuts[y + 1]) - f(cuts[y])).mean() + o.penalty * (p[:3] ** 2).sum() / 2 / len(x)

    got = o._gradient(p, x, y, len(x))
    num = np.array([(loss(p + e) - loss(p - e)) / 2e-6 for e in np.eye(6) * 1e-6])
    assert np.allclose(got, num, atol=1e-5)
