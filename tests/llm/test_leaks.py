from __future__ import annotations

import random

from attestra.llm import leaks as k
from attestra.llm.words import words_of


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = words_of(t)
        for j, u in items:
            v = words_of(u)
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            out[i, j] = best
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(j, " ".join(rng.choices(vocab, k=40))) for j in range(6)] + [(6, "too short"), (7, None)]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 120))
        if i % 2:
            v = words_of(items[i % 6][1])
            a = rng.randrange(0, 30)
            part = v[a : a + rng.randrange(8, 30)]
            if i % 4 == 1 and len(part) > 3:
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [p.upper() if i % 3 else p for p in part] + w[at:]
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, "")]
    d = spark.createDataFrame([(*x, "x") for x in docs + docs[:5]], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(*x, "x") for x in items + items[:2]], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["run_words"] for r in k.leaks(d, t).collect()}
    want = {p: n for p, n in brute(docs, items).items() if n >= k.SPAN}
    assert {p: n for p, n in got.items() if n >= k.SPAN} == want and len(want) > 10


def test_one_substitution_in_twelve_words_is_found(spark):
    v = [f"v{i}" for i in range(30)]
    docs = []
    for p in range(12):
        w = v[5:17]
        w[p] = "zz"
        docs.append((p, "before " + " ".join(w) + " after"))
    got = k.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(v))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(12))
    assert all(r["same_words"] >= 5 for r in got)
    mid = next(r for r in got if r["doc_id"] == 6)
    assert (mid["overlap_words"], mid["same_words"]) == (12, 11)


def test_blocks_give_the_same(spark, monkeypatch, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "gold_claims"))
    whole = {tuple(r) for r in k.leaks(docs, items).collect()}
    monkeypatch.setattr(k, "BLOCK_WORDS", 2000)
    assert {tuple(r) for r in k.leaks(docs, items).collect()} == whole and whole


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert k.leaks(e, i).count() == 0
