from __future__ import annotations

import itertools
import unicodedata

import pytest

from attestra.llm import lookalike as l
from attestra.llm.look import fold

GROUPS = [
    ["Tổng 12 kWh", "Tổng 12 kWh", "Ｔổng 12 kＷh", "Tổng​ 1­2 kWh", "Тổng 12 kWh", "Tổng 12 kWh", "Tổng 12 kWh", "Т‍ổng　１２ kWh"],
    ["tổng 12 kWh"], ["Tông 12 kWh"], ["Tổng 13 kWh"], ["m² µg", "m² μg"], ["m2 µg"], ["ガ", "ｶﾞ", "ガ"], ["a\nb", "a\r\nb"], ["а̣ b", "ạ b", "a‌̣ b"],
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "cache_id long, text string, one_form string")


def test_pairs_against_the_groups(spark):
    texts = [t for g in GROUPS for t in g] + [None, "", "​", " "]
    place = {}
    for i, t in enumerate(texts):
        place.setdefault(t, i)
    want, i = set(), 0
    for g in GROUPS:
        ids = range(i, i + len(g))
        want |= {(a, b) for a, b in itertools.combinations(ids, 2) if texts[a] != texts[b]}
        i += len(g)
    assert {tuple(r) for r in l.same_look(frame(spark, texts)).collect()} == want


def test_one_form_agrees_with_the_rule(spark):
    texts = [t for g in GROUPS for t in g] + ["plain", "ĐẶNG", "Ωμέγα"]
    forms = {r["cache_id"]: r["one_form"] for r in l.one_form(frame(spark, texts)).collect()}
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert (forms[a] == forms[b]) == (fold(texts[a]) == fold(texts[b]))
    assert forms[0] == "Tổng 12 kWh"


def test_representative_is_the_most_frequent(spark):
    got = {r["text"]: r["one_form"] for r in l.one_form(frame(spark, ["оооо", "о", "o"])).collect()}
    assert got["o"] == "о" and got["о"] == "о"


def test_new_texts_follow_the_table(spark):
    table = l.unit_rewrites(frame(spark, ["Tổng", "Tổng", "Тổng"]))
    new = l.one_form(frame(spark, ["Tổng", "Ｔổng", "мир"]), table=table)
    forms = [r["one_form"] for r in new.orderBy("cache_id").collect()]
    assert forms[:2] == ["Tổng", "Tổng"] and forms[2] is not None


def test_empty_and_long(spark):
    assert l.same_look(frame(spark, [])).count() == 0
    long = "а" * 200_000
    assert {tuple(r) for r in l.same_look(frame(spark, [long, "a" * 200_000, long])).collect()} == {(0, 1), (1, 2)}


@pytest.mark.parametrize("text", ["", "a", "é", "x̣́", "á̂̃̄̅̆̇̈", "á̂", "é́ a\r\nb"])
def test_units_cover_the_text(text):
    assert fold("".join(l.units(text))) == fold(text)
    assert all(len(u) == 1 or len(fold(u)) == 1 for u in l.units(text))


def test_many_marks_and_rare_units_follow_the_same_classes(spark):
    texts = ["x" + "\u0301" * 9, "х" + "\u0301" * 9, "á̂", "á̂", "ạ́", "á̩̣", "ạ̩́", "a\u200b\u0301", "á"]
    forms = {r["cache_id"]: r["one_form"] for r in l.one_form(frame(spark, texts)).collect()}
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert (forms[a] == forms[b]) == (fold(texts[a]) == fold(texts[b])), (texts[a], texts[b])


# public confusables that are drawn with a visible difference: (Latin, other)
VISIBLE = {("a", "α"), ("i", "ı"), ("i", "ɩ"), ("i", "ι"), ("i", "ӏ"), ("o", "σ"), ("p", "ρ"), ("p", "ϱ"), ("y", "ɣ"), ("y", "γ"), ("y", "ү"), ("s", "ƽ"), ("e", "ҽ"), ("v", "υ"), ("Y", "ϒ"), ("M", "Ϻ"), ("J", "Ɉ")}


def test_the_relation_has_the_capitals_of_the_public_confusables(spark):
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = {checker.getSkeleton(c): c for c in "ABCEHIJKMNOPSTXYZĐaceijopsxyv" if c != "I"} | {checker.getSkeleton("l"): None}
    kind = lambda c: (unicodedata.category(c), len(unicodedata.normalize("NFD", c)))
    missing = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530))):
        base = latin.get(checker.getSkeleton(c))
        if base and unicodedata.category(c) == unicodedata.category(base) and kind(c)[1] == 1 and fold(c) != fold(base) and (base, c) not in VISIBLE:
            missing.append((base, c))
    assert not missing


def test_stroked_d(spark):
    got = {tuple(r) for r in l.same_look(frame(spark, ["Đồng", "Ðồng", "Ɖồng", "Dồng", "đồng"])).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}
