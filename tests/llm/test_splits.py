from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from attestra.llm import splits as s

SCHEMA = "row_id string, company_id string, ticker string, node string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(str(i), *r, "x", 1) for i, r in enumerate(rows)], SCHEMA)


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize(
    "text,want",
    [
        ("QXVN", "QXVN"), (" qxvn ", "QXVN"), ("ＱＸＶＮ", "QXVN"), ("HNX: qxvn", "QXVN"), ("QXVN.UPCOM", "QXVN"), ("QXVN-HNX", "QXVN"), ("QXVN (HOSE)", "QXVN"), ("$QXVN", "QXVN"), ("UPCOM:ABC", "ABC"),
        ("HOSE", None), ("upcom", None), ("N/A", None), ("--", None), ("not listed", None), ("chưa niêm yết", None), ("", None), (None, None), ("AB", None), ("ABCDEF", None), ("A1C", None), ("NONE", None),
    ],
)
def test_ticker_key(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(s.ticker_key(F.col("t"))).first()[0] == want


def test_components_against_union_find(spark):
    rng = random.Random(3)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(40)]
    loose = [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    edges = chain + star + loose + [("alone", "alone"), ("n3", None)]
    got = defaultdict(set)
    for r in s.components(spark.createDataFrame(edges, "a string, b string")).collect():
        got[r["component"]].add(r["node"])
    assert {frozenset(g) for g in got.values()} == brute([e for e in edges if None not in e])
    assert all(c in g for c, g in got.items())


def test_tied_companies(spark):
    rows = [("c1", "AAA"), ("c2", "hnx: aaa"), ("c2", "BBB"), ("c3", "BBB.HOSE"), ("c4", "N/A"), ("c5", "n/a"), ("c6", None), (None, "BBB"), ("c1", "AAA"), (" c3 ", "ZZZ")]
    got = {tuple(r) for r in s.tied_companies(frame(spark, rows[:5]), frame(spark, rows[5:])).collect()}
    assert got == set(itertools.combinations(["c1", "c2", "c3"], 2))


def test_empty(spark):
    e = frame(spark, [])
    assert s.tied_companies(e, e).count() == 0 and s.split_rows({"t": (e, "row_id")}).count() == 0


def test_split_rows_keeps_ties_and_shares(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(150)}", f"T{chr(65 + rng.randrange(26))}{chr(65 + rng.randrange(26))}" if rng.random() < 0.1 else None) for _ in range(3000)]
    rows += [(None, None)] * 300 + [(None, "HNX")] * 10 + [("big", "BIG")] * 400
    df = frame(spark, rows)
    out = s.split_rows({"t": (df, "row_id")}).collect()
    assert len(out) == len(rows)
    by = defaultdict(set)
    for r in out:
        by[r["component"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    counts = {k: sum(r["split"] == k for r in out) / len(out) for k in ("train", "validation", "test")}
    largest = max(sum(r["component"] == c for r in out) for c in by) / len(out)
    assert abs(counts["validation"] - 0.1) <= largest and abs(counts["test"] - 0.1) <= largest and counts["train"] > 0.6
    pairs = {tuple(r) for r in s.tied_companies(df).collect()}
    split = {r["company_id"]: r["split"] for r in out if r["company_id"]}
    assert all(split[a] == split[b] for a, b in pairs)
