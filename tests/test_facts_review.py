"""Edges of the figure facts and of the operators for labels, runs and packs: nulls, ties, empty tables, clashing columns."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from attestra.operators import facts, review

SIDE = "value double, unit string, basis string, boundary string, technology string, variant array<string>, scopes array<string>, is_target boolean"


def fact(value=10.0, unit="kg", basis="absolute", boundary="group", technology=None, variant=(), scopes=(), is_target=False):
    return (value, unit, basis, boundary, technology, list(variant), list(scopes), is_target)


def test_every_reason_of_eligibility(spark):
    cases = [
        (fact(), fact(), None), (fact(unit=None), fact(unit=None), "different_unit"), (fact(), fact(unit="t"), "different_unit"), (fact(), fact(basis="intensity"), "different_basis"), (fact(), fact(basis="unknown"), None),
        (fact(), fact(boundary="facility"), "different_boundary"), (fact(technology="wind"), fact(technology="solar"), "different_technology"), (fact(technology="wind"), fact(), None), (fact(variant=["a"]), fact(variant=["b"]), "different_variant"),
        (fact(variant=["a", "b"]), fact(variant=["b", "a"]), None), (fact(scopes=["1"]), fact(scopes=["1", "2"]), "different_scope"), (fact(is_target=True), fact(), "target_vs_actual"), (fact(is_target=None), fact(), None),
        (fact(), fact(value=200.0), None), (fact(basis="unknown"), fact(value=200.0), "magnitude_gap"), (fact(), fact(value=1000.0), "magnitude_gap"), (fact(value=None), fact(), "magnitude_gap"), (fact(value=0.0), fact(value=0.0), None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a struct<{SIDE.replace(', ', ',').replace(' ', ':')}>, b struct<{SIDE.replace(', ', ',').replace(' ', ':')}>")
    side = lambda s: {f: F.col(f"{s}.{f}") for f in ("value", "unit", "basis", "boundary", "technology", "variant", "scopes", "is_target")}
    got = {r["i"]: r["x"]["reason"] for r in df.select("i", facts.eligibility(side("a"), side("b")).alias("x")).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(cases)}


def test_decisions_over_several_figures(spark):
    rows = [("a", "S", None, False), ("a", "N", "unit", False), ("b", "S", None, False), ("b", "C", None, False), ("c", "C", None, True), ("d", "C", "direction", True), ("e", "N", None, None), ("f", "C", None, None)]
    df = spark.createDataFrame(rows, "k string, label string, reason string, written boolean")
    got = {r["k"]: r["label"] for r in facts.decide(df, ["k"], F.col("written")).collect()}
    assert got == {"a": "S", "b": "N", "c": "N", "d": "C", "e": "N", "f": "C"} and facts.decide(df.limit(0), ["k"]).count() == 0


def test_facts_of_odd_sentences(spark):
    long = "x " * 50_000 + "giảm 5 tấn"
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, long, "k"), (4, "năm 2024", "k"), (4, "7 kWh", "k"), (4, "7 kWh", "k")], "id int, text string, kind string")
    got = [(r["id"], r["value"], r["kind"]) for r in facts.facts(df).orderBy("id").collect()]
    assert got == [(3, 5000.0, "mass"), (4, 7.0, "energy"), (4, 7.0, "energy")] and facts.facts(df.limit(0)).count() == 0


def test_page_frame_and_scope_parts_on_nothing(spark):
    lines = spark.createDataFrame([("p", 0, "Tiêu thụ (GJ) 2022 2023"), ("p", 1, "(kWh) 2022"), ("q", 0, "không"), ("r", 0, None)], "page string, n int, line string")
    got = {r["page"]: (r["page_unit"], r["page_period"]) for r in facts.page_frame(lines, ["page"], "n").collect()}
    assert got == {"p": ("gj", "2022"), "q": (None, None), "r": (None, None)}
    assert facts.scope_parts(spark.createDataFrame([], "page string, value double, scopes array<int>, is_total boolean"), ["page"], 1.0).count() == 0


def test_stratified_against_plain_rules(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(40)}", rng.choice("abc")) for i in range(900)] + [(None, "g1", "a")]
    df = spark.createDataFrame(rows, "id int, g string, s string")
    got = review.stratified(df, F.col("s"), "g", "id", {"a": 25, "b": 5000}, 4).collect()
    by = {}
    for r in got:
        by.setdefault((r["s"], r["g"]), []).append(r["id"])
    assert {s for s, _ in by} == {"a", "b"} and all(len(v) <= 4 for v in by.values()) and sum(len(v) for (s, _), v in by.items() if s == "a") == 25
    most = {}
    for i, g, s in rows:
        if s == "b" and i is not None:
            most[g] = most.get(g, 0) + 1
    assert sum(len(v) for (s, _), v in by.items() if s == "b") == sum(min(4, n) for n in most.values())
    assert {r["id"] for r in review.stratified(df.repartition(7), F.col("s"), "g", "id", {"a": 25, "b": 5000}, 4).collect()} == {r["id"] for r in got}


def test_graded_ranking_by_hand(spark):
    ranked = spark.createDataFrame([("x", 1, 10, 1), ("x", 1, 11, 2), ("x", 2, 20, 3), ("y", 1, 12, 1)], "system string, query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(1, 11, 2), (1, 13, 1), (2, 20, 1), (2, 21, 0)], "query_id int, doc_id int, rel int")
    got = {r["system"]: r for r in review.graded_ranking(ranked, rel).collect()}
    ideal = 3 + 1 / math.log2(3)
    assert got["x"]["n_queries"] == 2 and abs(got["x"]["ndcg"] - (3 / math.log2(3) / ideal + 1 / math.log2(4)) / 2) < 1e-12
    assert (got["x"]["recall_1"], got["x"]["recall_3"], got["x"]["hit"], round(got["x"]["mrr"], 9)) == (0.0, 0.75, 1.0, round((1 / 2 + 1 / 3) / 2, 9)) and got["y"]["ndcg"] == 0.0


def test_passes_and_empty_tables(spark):
    t = lambda rows: spark.createDataFrame(rows, "item_id string, label string")
    got = {r["item_id"]: (r["label"], r["source"]) for r in review.merge_passes(t([("a", "x"), ("b", "x"), ("c", None), ("d", "y"), ("a", "x")]), t([("a", "x"), ("b", "y"), ("c", "z")]), t([("d", "q")])).collect()}
    assert got == {"a": ("x", "agreed"), "b": (None, "open"), "c": ("z", "single"), "d": ("q", "adjudicated")}
    none = t([])
    assert review.merge_passes(none, none, none).count() == 0
    assert review.selective(spark.createDataFrame([], "gold string, pred string")).first()["n"] == 0
    store = spark.createDataFrame([(1, "h", "b.pdf", 2), (2, "h", "a.pdf", 1), (3, "g", "a.pdf", 0)], "id int, sha256 string, name string, stored_at int")
    assert [review.find_document(store, h, n).select("id").collect() for h, n in (("h", "b.pdf"), ("h", "z"), ("q", "a"))] == [[(1,)], [(2,)], []]


def test_direction(spark):
    texts = ["Phát thải giảm mạnh", "Chi phí tăng", "giảm rồi tăng", "không đổi", None, "Emissions decreased"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(facts.direction(F.col("t"))).collect()]
    assert got == ["decrease", "increase", None, None, None, "decrease"]
