"""Edges of the operators for review and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import datasets as ds

TERMS = ("phat thai", "chat thai")


def test_labels_are_trimmed_to_the_longest_tail(spark):
    raw = ["Báo cáo nêu rõ. Tổng lượng chất thải nguy hại", "Cộng", "không có gì", "", None, "một hai ba bốn năm sáu bảy tám chất thải", "phạm vi 1"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(raw)), "i int, t string").orderBy("i").select(ds.trimmed_label(F.col("t"), TERMS)).collect()]
    assert got == ["Tổng lượng chất thải nguy hại", "Cộng", None, None, None, "bốn năm sáu bảy tám chất thải", "phạm vi 1"]


def test_disclosed_without_a_page_and_on_nothing(spark):
    lines = spark.createDataFrame([(1, "Phát thải 1.200 tCO2e năm 2023", "x"), (1, "Phát thải 1.200", "x"), (2, None, "x")], "doc_id int, line string, value string")
    got = [(r["label"], r["value"], r["unit"], r["period"]) for r in ds.disclosed(lines, ["doc_id"], TERMS).collect()]
    assert got == [("Phát thải", 1200.0, "tco2e", "2023")] and ds.disclosed(lines.limit(0), ["doc_id"], TERMS).count() == 0


def test_prose_and_usable(spark):
    texts = ["Nhà máy đã giảm phát thải khí nhà kính trong năm vừa qua", "NHÀ MÁY ĐÃ GIẢM PHÁT THẢI KHÍ NHÀ KÍNH TRONG NĂM VỪA QUA", "ngắn", None]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(ds.prose(F.col("t"))).collect()] == [True, False, False, False]
    rows = [("Claim A", 2020, "says claim  a again", 2019), ("Claim A", 2020, "other", 2021), ("Claim A", 2020, "other", None), ("", 2020, "other", 2020), (None, None, "other", 2020), ("x", 2020, None, 2020)]
    df = spark.createDataFrame(rows, "claim_text string, claim_year int, evidence_text string, evidence_year int")
    assert ds.usable(df).count() == 3


def test_families_keep_what_they_do_not_alter(spark):
    df = spark.createDataFrame([(4, 20000.0, "", None, 2020, "actual", "s1", "facility", "absolute", "kWh", "ghg_emissions"), (None, 1.0, "", None, 1, "actual", None, None, None, None, None), (5, None, "", None, 1, "actual", None, None, None, None, None)],
                               "quantity_id long, value double, multiplier_text string, change_direction string, period int, status string, scope string, boundary string, value_kind string, unit_text string, metric string")
    got = {r["family"]: r for r in ds.figure_variants(df, {"ghg_emissions": "energy"}).collect()}
    assert set(got) == {"S0", "S1", "C1", "C2", "N1", "N2", "N3", "N4", "N5", "N6"} and all(r["label"] == f[0] for f, r in got.items())
    assert (got["S1"]["value"], got["S1"]["multiplier_text"], got["C1"]["value"], got["N1"]["period"], got["N2"]["period"], got["N2"]["status"]) == (20.0, "nghìn", 14000.0, 2019, 2030, "target")
    assert (got["N3"]["scope"], got["N4"]["boundary"], got["N5"]["unit_text"], got["N6"]["metric"], got["C2"]["value"]) == ("s1+s2", "group", "kWh/tấn sản phẩm", "energy", 20000.0)


def test_defects_and_years(spark):
    rows = [("Năm 2020 dùng 5", 2020, "nước", "m3"), ("dùng 5 (2020)", 2020, "nước", "m3"), ("x", None, "nước 2", "m3"), ("x", None, None, " Đơn vị "), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, p int, m string, u string").orderBy("i")
    got = [r[0] for r in df.select(ds.defect(F.col("s"), F.lit("water_use"), F.col("p"), F.col("m"), F.col("u"))).collect()]
    assert got == [None, "period_not_dated", "metric_has_digit", "unit_placeholder", None]
    years = df.select(ds.other_year(F.col("s"), F.lit(2019), F.lit(None).cast("int"))).collect()
    assert [r[0] for r in years] == ["2020", "2020", None, None, None]
    assert ds.codebook_version("a") == ds.codebook_version("a") != ds.codebook_version("b")
