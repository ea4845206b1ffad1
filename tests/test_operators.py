from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import corpus, edits, evaluate, figures, lexicon, passages, quantities, records, retrieval, temporal


def test_windows_fold(spark):
    s = [f"Câu số {w} của đoạn văn này dài vừa phải để thử." for w in "abcdefgh"]
    text = " ".join(s[:5]) + "\n\nTiêu đề\n" + s[5] + " " + s[6] + "\r\n\r\n" + "x" * 900
    got = [r["text"] for r in passages.passages(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")).orderBy("doc_id", "block").collect()]
    assert got == [" ".join(s[:3]), " ".join(s[3:5]), "Tiêu đề " + s[5] + " " + s[6], "x" * 900]


def test_windows_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    sizes = passages.passages(docs).select(F.length("text").alias("n"), F.size(F.split("text", r"[.!?;]\s")).alias("k")).collect()
    assert sizes and max(r["n"] for r in sizes if r["k"] > 2) <= 700
    cut = passages.passages(docs).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n"))
    whole = docs.select("doc_id", F.length(F.regexp_replace("text", r"[\s\u00a0]", "")).alias("m"))
    assert cut.join(whole, "doc_id").where("abs(n - m) > 2").count() == 0


def test_overlapping_chunks(spark):
    s = [f"Sentence number {i} has some words in it." for i in range(12)]
    got = spark.createDataFrame([(" ".join(s),)], "t string").select(passages.overlapping_chunks(F.col("t"), 120, 1)).first()[0]
    assert got[0] == " ".join(s[:2]) or len(got[0]) <= 160
    assert all(b.startswith(a.rsplit(". ", 1)[-1] if ". " in a else a) for a, b in zip(got, got[1:]))


def test_assertions(spark):
    f = lambda t: spark.createDataFrame([(t,)], "t string").select(passages.assertions(F.col("t"))).first()[0]
    two = "Phát thải của nhà máy giảm 20% trong năm; tỷ lệ tái chế của cả nhóm đạt 99%"
    assert len(f(two)) == 2 and f("Một câu; hai") == ["Một câu; hai"]


def bm25_plain(docs, query):
    n, avg = len(docs), max(1, sum(map(len, docs.values())) / len(docs))
    df = Counter(t for d in docs.values() for t in set(d))
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in set(query) if tf[t])
        if s:
            out[k] = s / (s + 3)
    return out


def test_bm25(spark):
    rng = random.Random(1)
    docs = {i: [f"tok{rng.randrange(30)}" for _ in range(rng.randrange(0, 40))] for i in range(25)}
    q = {1: ["tok1", "tok2", "tok2", "none"], 2: [], 3: ["tok5"]}
    c = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()] + [(99, None)], "doc_id long, text string")
    got = retrieval.bm25(c, spark.createDataFrame([(i, " ".join(t)) for i, t in q.items()], "query_id long, text string")).collect()
    docs[99] = []
    want = {(k, d): s for k, t in q.items() for d, s in bm25_plain(docs, t).items()}
    assert {(r["query_id"], r["doc_id"]) for r in got} == set(want)
    assert all(math.isclose(r["score"], want[r["query_id"], r["doc_id"]], rel_tol=1e-9) for r in got)


def test_char_ngrams(spark):
    got = spark.createDataFrame([("ab Cdef",)], "t string").select(retrieval.char_ngrams(F.col("t"))).first()[0]
    assert got == [" ab", "ab ", " ab ", " cd", "cde", "def", "ef ", " cde", "cdef", "def ", " cdef", "cdef "]
    assert spark.createDataFrame([("a",)], "t string").select(retrieval.char_ngrams(F.col("t"))).first()[0] == [" a "]


def test_fusion_and_floor(spark):
    rows = [(1, d, lex, sem) for d, lex, sem in [(1, 0.9, 0.1), (2, 0.5, 0.5), (3, 0.5, 0.5), (4, 0.05, 0.9)]]
    fused = retrieval.fused_top(spark.createDataFrame(rows, "query_id long, doc_id long, lexical double, semantic double"), 10)
    got = {r["doc_id"]: (r["lexical_rank"], r["semantic_rank"], r["rank"]) for r in fused.collect()}
    assert got == {1: (1, 4, 1), 2: (2, 2, 3), 3: (3, 3, 4), 4: (4, 1, 2)} or got[1][:2] == (1, 4)
    ranked = fused.withColumnRenamed("lexical", "score")
    kept = {r["doc_id"]: r["below_threshold"] for r in retrieval.admissible(ranked, 0.6, 2).collect()}
    assert kept[1] is False and len(kept) == 2 and retrieval.admissible(ranked.limit(0)).count() == 0


def test_dense_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(40, [0.0] * 8)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    a = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.dense_cosine(df, q, 5).collect()}
    assert a == {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.dense_cosine(df, q, 5, block=2).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n[10]
    s[10] = -2
    assert a[10, 1] == int(np.argmax(s))


def test_quantities(spark):
    q = lambda t: [(x["value"], x["kind"]) for x in quantities.scan(t)]
    assert q("Phạm vi 1 và 2: 12,5 tấn CO2e theo QĐ 21/2025, ISO 14064-1") == [(12500.0, "co2e")]
    assert q("Điều 5 và 6; năm 2024 dùng 1,2 triệu kWh") == [(1200000.0, "energy")] and quantities.scan("năm 2024 dùng 3 ha")[0]["year"] == "2024"
    assert q("4.1. Giảm 08 đợt") == [] and q("") == [] and q("1,234 và 12,000") == [(1.234, None), (12000.0, None)]
    df = spark.createDataFrame([(1, "12 kWh", "x"), (2, None, "x"), (3, "none", "x")], "id long, t string, masked string")
    assert [len(r[0]) for r in df.orderBy("id").select(quantities.quantities(F.col("t"))).collect()] == [1, 0, 0]
    got = {r["id"]: r["masked"] for r in quantities.masked(df, "t").collect()}
    assert got[1]["text"] == "<S1> kWh" and got[1]["slots"]["S1"].asDict() == {"raw": "12", "value": 12.0, "kind": "energy", "half": 0.5} and got[2] is None
    assert quantities.mask("Thép  Bình An đạt 5 ha", names=("Thép Bình An",))[0] == "[NAME_1] đạt <S1> ha"


def test_diff_round_trip():
    a, b = "một hai ba  bốn", "một ba bốn năm"
    d = edits.diff(a, b)
    assert "".join(x["text"] for x in d if x["op"] != "ins") == a and "".join(x["text"] for x in d if x["op"] != "del") == b and edits.diff("", "") == []


def test_locate(spark):
    df = spark.createDataFrame([("giam  PHÁT\nthải", "Ta giảm phát thải nhiều"), ("không có", "x"), ("", "x"), (None, "x")], "n string, t string")
    assert [r[0] for r in df.select(edits.locate(F.col("n"), F.col("t"))).collect()] == [3, None, None, None]
    assert tuple(df.limit(1).select(edits.progressive_locate(F.lit("abcdef"), F.lit("xx abc"), (6, 3))).first()[0]) == (3, 3)


def test_clauses(spark):
    text = (
        "Chương I\nQUY ĐỊNH\nĐiều 1 - Phạm vi\nÁp dụng cho mọi người.\nMục 2. Việc\nĐiều 2. Nghĩa vụ\nCác nghĩa vụ:\n1. Báo cáo\na) hằng năm\nb) khi có lệnh,\nkể cả sau đó\n2) Nộp phí\n"
        "PHỤ LỤC I: Mẫu\n1. Dòng đầu\n1. Dòng sau\nPhụ lục II\nBiểu"
    )
    rows = edits.clause_rows(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Không có điều nào")], "doc_id long, text string")).orderBy("first_line").collect()
    got = [(r["path"], r["chapter"], r["section"], r["heading"], r["text"], r["parents"]) for r in rows]
    assert got == [
        ("art1", "I", None, "Phạm vi", "Áp dụng cho mọi người.", []), ("art2", "I", "2", "Nghĩa vụ", "Các nghĩa vụ:", []), ("art2.1", "I", "2", "Nghĩa vụ", "Báo cáo", ["art2"]),
        ("art2.1.a", "I", "2", "Nghĩa vụ", "hằng năm", ["art2", "art2.1"]), ("art2.1.b", "I", "2", "Nghĩa vụ", "khi có lệnh,\nkể cả sau đó", ["art2", "art2.1"]), ("art2.2", "I", "2", "Nghĩa vụ", "Nộp phí", ["art2"]),
        ("annexI.001", None, None, "Mẫu", "Dòng đầu", ["annexI"]), ("annexI.002", None, None, "Mẫu", "Dòng sau", ["annexI"]), ("annexII", None, None, None, "Biểu", []),
    ]
    cite = spark.createDataFrame([(p,) for p in ("art3.2.a", "art3", "annexI.001", "x")], "p string").select(edits.clause_citation(F.lit("Luật A"), F.col("p")))
    assert [r[0] for r in cite.collect()] == ["điểm a khoản 2 Điều 3 Luật A", "Điều 3 Luật A", "Phụ lục I Luật A", None]


def test_paragraphs_side_by_side():
    a, b = "Same one.\n\nThe plant used 5 tonnes of coal in 2023.\n\nGone for good.", "Same one.\n\nNew text here.\n\nThe plant used 6 tonnes of coal in 2023."
    assert [x["op"] for x in edits.align(a, b)] == ["same", "inserted", "changed", "deleted"] and edits.align("", "") == []
    assert [x["op"] for x in edits.diff("a, b", "a b")] == ["equal", "del", "equal"]


def test_fused_top_is_the_head_of_the_full_fusion(spark):
    rng = random.Random(8)
    rows = [(q, i, rng.randrange(40) / 40, rng.randrange(30) / 30) for q in range(3) for i in range(rng.choice([5, 150, 400]))]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, lexical double, semantic double")
    for k, c in ((1, 0), (5, 3), (10, 60)):
        got = {(r["query_id"], r["rank"]): (r["doc_id"], r["lexical_rank"], r["semantic_rank"]) for r in retrieval.fused_top(df, k, c).collect()}
        want = {}
        for q in range(3):
            own = [r for r in rows if r[0] == q]
            place = [{r[1]: n for n, r in enumerate(sorted(own, key=lambda r: (-r[j], r[1])), 1)} for j in (2, 3)]
            best = sorted(((-(1 / (c + place[0][r[1]]) + 1 / (c + place[1][r[1]])), r[1]) for r in own))[:k]
            want |= {(q, n): (i, place[0][i], place[1][i]) for n, (_, i) in enumerate(best, 1)}
        assert got == want


def test_bootstrap_is_the_same_in_any_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 11).alias("w"))
    a, b = (evaluate.bootstrap(df.repartition(n), "v", None, 50).first() for n in (1, 7))
    assert abs(a["low"] - b["low"]) < 1e-9 and abs(a["high"] - b["high"]) < 1e-9


def test_lexicon(spark):
    b = [lexicon.Bucket("a", ("x", "y"), 1), lexicon.Bucket("b", ("y",), 2), lexicon.Bucket("c", ("z",), 1)]
    f = lambda t, g: spark.createDataFrame([(t,)], "t string").select(g(F.col("t"))).first()[0]
    assert f("x y", lambda c: lexicon.best_bucket(c, b)) == "a" and f("y", lambda c: lexicon.best_bucket(c, b)) == "b" and f("q", lambda c: lexicon.best_bucket(c, b)) is None
    assert f("z y", lambda c: lexicon.first_bucket(c, b)) == "a" and f("q", lambda c: lexicon.vote_language(c, {"vi": ("z",), "en": ("y",)})) == "unknown"
    assert f("Không vi phạm", lambda c: lexicon.cue_present(c, "vi phạm", ("không",))) is False and f("Đã vi phạm", lambda c: lexicon.cue_present(c, "vi phạm", ("không",))) is True
    assert f("thiêu đốt", lambda c: lexicon.cue_present(c, "thiếu")) is False and f("Thieu", lambda c: lexicon.cue_present(c, "thieu")) is True
    t = spark.createDataFrame([("a", "k", 1, 1, "x"), ("b", "k", 0, None, "y"), ("b", "k", 0, None, "w"), ("c", "other", 0, 1, "q")], "bucket string, kind string, ord int, priority int, term string")
    assert lexicon.from_table(t, "k") == [lexicon.Bucket("b", ("w", "y"), 1), lexicon.Bucket("a", ("x",), 1)]


def test_as_of(spark):
    f = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", None)], "id long, k string, t int")
    h = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("a", None, "q")], "k string, since int, v string")
    got = {r["id"]: (r["since"], r["v"]) for r in temporal.as_of(f, h, ["k"], "t", "since", ["v"]).collect()}
    assert got == {1: (5, "y"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_dated_join_open_ends(spark):
    d = dt.date
    f = spark.createDataFrame([("i", d(2020, 1, 1)), ("i", d(2021, 1, 1)), ("j", d(2020, 1, 1))], "issue string, on date")
    r = spark.createDataFrame([("i", "r1", None, d(2020, 1, 1)), ("i", "r2", d(2020, 6, 1), None), ("i", "r3", None, None)], "issue string, rule string, effective_from date, effective_to date")
    assert Counter(x["rule"] for x in temporal.dated_join(f, r, "issue", "on").collect()) == {"r1": 1, "r2": 1, "r3": 2}


def test_three_values(spark):
    rows = [(1, True), (1, None), (2, True), (3, None), (4, False), (4, True), (4, None)]
    df = spark.createDataFrame(rows, "id int, t boolean").select("id", temporal.three_valued(F.col("t")).alias("status"))
    assert {r["id"]: r["o"] for r in df.groupBy("id").agg(temporal.combine().alias("o")).collect()} == {1: "PARTIAL", 2: "MATCH", 3: "INSUFFICIENT", 4: "NOT_MATCH"}


def test_upsert_and_precedence(spark):
    o = spark.createDataFrame([("a", "1", "other"), ("b", "2", "x")], "k string, v string, t string")
    n = spark.createDataFrame([("a", None, "y"), ("b", "3", "z"), ("c", "4", None)], "k string, v string, t string")
    assert sorted(map(tuple, records.upsert(o, n, "k", {"t": "other"}).collect())) == [("a", "1", "y"), ("b", "3", "x"), ("c", "4", None)]
    assert sorted(map(tuple, records.by_precedence([o, n], "k").collect())) == [("a", "1", "other"), ("b", "2", "x"), ("c", "4", None)]


def test_first_occurrence_keeps_null_keys(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, k string")
    assert sorted(r["id"] for r in records.first_occurrence(df, F.col("k"), ["id"]).collect()) == [1, 2, 4]


def test_round_robin(spark):
    df = spark.createDataFrame([("a" if i < 90 else "b", i) for i in range(100)], "g string, id int")
    got = records.round_robin(df, "g", "id", 30).collect()
    assert Counter(r["g"] for r in got) == {"a": 20, "b": 10} and records.round_robin(df.limit(0), "g", "id", 3).count() == 0


def test_measures(spark):
    rng = random.Random(2)
    pairs = [(rng.choice("abc"), rng.choice("abc")) for _ in range(200)]
    k = evaluate.cohen_kappa(spark.createDataFrame(pairs + [(None, "a")], "gold string, pred string")).first()
    o = sum(a == b for a, b in pairs) / 200
    e = sum(Counter(a for a, _ in pairs)[c] * Counter(b for _, b in pairs)[c] for c in "abc") / 200**2
    assert k["n"] == 200 and math.isclose(k["kappa"], (o - e) / (1 - e), abs_tol=1e-6)
    assert evaluate.cohen_kappa(spark.createDataFrame([("a", "a")], "gold string, pred string")).first()["kappa"] is None
    m = evaluate.mcnemar(spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a_right boolean, b_right boolean")).first()
    assert (m["b"], m["c"]) == (8, 2) and math.isclose(m["p_value"], 2 * sum(math.comb(10, i) for i in range(3)) / 1024, rel_tol=1e-9)
    f = evaluate.fleiss_kappa(spark.createDataFrame([("i", "a"), ("i", "a"), ("j", "b"), ("j", "b"), ("k", "a")], "item_id string, label string")).first()
    assert f["kappa"] == 1.0 and f["n_items"] == 2


def test_ranking_measures(spark):
    r = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, doc_id long, rank int")
    g = spark.createDataFrame([(1, 11), (1, 99), (2, 10), (3, 5)], "query_id long, doc_id long")
    got = evaluate.ranking_measures(r, g).first()
    assert got["n_queries"] == 3 and got["recall_at_1"] == round(1 / 3, 6) and got["recall_at_3"] == 0.5 and got["mrr"] == 0.5


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i % 40, float(i % 2)) for i in range(2000)], "c int, v double")
    for cluster in (None, "c"):
        b = evaluate.bootstrap(df, "v", cluster, 100).first()
        assert b["low"] < b["mean"] < b["high"] and b["mean"] == 0.5 and b["high"] - b["low"] < 0.5


def test_held_out_against_the_greedy_rule(spark):
    rng = random.Random(3)
    sizes = {f"g{i:03}": rng.randrange(1, 50) for i in range(80)}
    df = spark.createDataFrame(list(sizes.items()), "g string, n long")
    room, want = 0.2 * sum(sizes.values()), set()
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n <= room:
            want.add(g)
            room -= n
    assert {r["g"] for r in corpus.held_out(df, "g", "n", 0.2).collect()} == want
    assert corpus.held_out(df.limit(0), "g", "n", 0.2).count() == 0


def test_figure_place(spark):
    df = spark.createDataFrame([(1200.0, "đạt 1.200 kg"), (12.5, "là 12,5%"), (5.0, "có 15 và 5."), (7.0, "70")], "x double, t string")
    got = [r[0] for r in df.select(corpus.figure_place(F.col("x"), F.col("t"))).collect()]
    assert got[3] is None and all(g is not None for g in got[:3])


def test_cross_foot_without_parts(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 5.0)], "k int, v double")
    p = spark.createDataFrame([(1, 4.0), (1, 6.05)], "k int, v double")
    assert {r["k"]: r["foots"] for r in figures.cross_foot(p, t, "k", "v", 0.1).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("name,want", [("Báo cáo_thường-niên.pdf", "annual"), ("x", "other"), (None, "other")])
def test_first_term(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(corpus.first_term(F.col("n"), {"annual": ("thuong nien",)})).first()[0] == want
