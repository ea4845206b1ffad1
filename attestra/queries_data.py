"""Queries of the operators for review and training sets, with their SQL; registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import datasets, facts, passages
from attestra.queries import BEST_SQL, HEADING_SQL, TYPES, match_sql, query, sentences_sql, table
from attestra.queries_review import INSTRUMENTS

INDICATORS = ("phat thai", "nang luong", "nuoc", "chat thai", "emission", "energy", "water", "waste")
LINES = [
    ("p1", 0, "Bảng 2 (tCO2e) năm 2023"), ("p1", 1, "Phạm vi 1 22.540.603"), ("p1", 2, "Tổng cộng | 23.474.480 100%"), ("p1", 3, "Nước thải xử lý: 1.200 m3 năm 2022"), ("p1", 4, "Nhân sự 1.234"), ("p2", 0, "Chất thải 5.600"),
    ("p2", 1, "Báo cáo nêu rõ. Tổng lượng chất thải nguy hại 5,60 nghìn tấn"), ("p2", 2, None), ("p2", 3, "Năng lượng 2024"),
]


@query(
    """SELECT * FROM (VALUES ('p1', 'Phạm vi 1', 22540603.0, 'tco2e', '2023', FALSE), ('p1', 'Tổng cộng', 23474480.0, 'tco2e', '2023', TRUE), ('p1', 'Nước thải xử lý', 1200.0, 'm3', '2022', FALSE), ('p2', 'Tổng lượng chất thải nguy hại', 5600.0, 'tấn', '2024', FALSE))
AS x(page, label, value, unit, period, is_total)"""
)
def disclosed_figures(spark: SparkSession, d: str) -> DataFrame:
    """Labels, values, units and periods of table lines; the page gives what a line lacks."""
    lines = spark.createDataFrame(LINES, "page string, n int, line string")
    return datasets.disclosed(lines, ["page"], INDICATORS, facts.page_frame(lines, ["page"], "n")).drop("line")


@query()
def unit_figures(spark: SparkSession, d: str) -> DataFrame:
    """The disclosed figures of all units."""
    lines = passages.lines(table(spark, d, "units").where("text is not null").select(F.col("unit_id").alias("doc_id"), "text"))
    return datasets.disclosed(lines, ["doc_id"], INDICATORS, facts.page_frame(lines, ["doc_id"], "line_no")).drop("line")


@query(
    rf"""WITH d AS (SELECT doc_id, {sentences_sql(12)} AS s FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d), n AS (SELECT doc_id, i, trim(regexp_replace(s[i], '\s+', ' ', 'g')) AS text FROM r),
k AS (SELECT left(sha1({match_sql('text')}), 16) AS id, min({{'d': doc_id, 'i': i, 't': text}}) AS x FROM n WHERE length(text) BETWEEN 25 AND 500 GROUP BY 1),
o AS (SELECT id, x.d AS doc_id, x.t AS text, trim(x.t) AS t, len(regexp_extract_all(trim(x.t), '\p{{L}}+')) AS w, regexp_extract(trim(x.t), '(\p{{L}})', 1) AS f, {match_sql('x.t')} AS m FROM k),
z AS (SELECT id, doc_id, text, coalesce({HEADING_SQL}, '') AS rule_reason, ({BEST_SQL} IS NOT NULL)::INT AS lexicon_hit FROM o)
SELECT id, doc_id, text, CASE WHEN lexicon_hit = 1 AND rule_reason = '' THEN 1 ELSE 0 END AS rule_label, rule_reason, lexicon_hit, regexp_matches(regexp_replace(text, '\b(?:19|20)\d{{2}}\b', '', 'g'), '\d')::INT AS has_figure FROM z"""
)
def claim_sentence_set(spark: SparkSession, d: str) -> DataFrame:
    return datasets.claim_sentences(table(spark, d, "documents").where("text is not null"), TYPES)


NEIGHBOURS = {"water_use": "waste_recycled", "electricity_consumption": "water_use", "ghg_emissions": "electricity_consumption"}
_VARIANT = "quantity_id, '{f}' AS family, '{l}' AS label, {value} AS value, {multiplier_text} AS multiplier_text, {change_direction} AS change_direction, {period} AS period, {status} AS status, {scope} AS scope, {boundary} AS boundary, {value_kind} AS value_kind, {unit_text} AS unit_text, {metric} AS metric"


def _variant_sql(family: str, when: str = "TRUE", **new: str) -> str:
    cols = {c: new.get(c, c) for c in datasets.ALTERED}
    return f"SELECT {_VARIANT.format(f=family, l=family[0], **cols)} FROM f WHERE {when}"


_TIMES = "lower(coalesce(multiplier_text, ''))"
_KIND = "coalesce(value_kind, 'absolute')"
_PERCENT = "trim(coalesce(unit_text, '')) = '%'"
_MAP = lambda x, t: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"


@query(
    "WITH f AS (SELECT DISTINCT quantity_id, value, '' AS multiplier_text, CASE WHEN quantity_id % 2 = 0 THEN 'decrease' END AS change_direction, period, CASE WHEN is_target THEN 'target' ELSE 'actual' END AS status, CASE WHEN scopes = '1' THEN 's1' WHEN scopes IS NOT NULL THEN 's1+s2' END AS scope, boundary, CASE WHEN quantity_id % 5 = 0 THEN 'change' ELSE basis END AS value_kind, unit AS unit_text, metric FROM numeric_facts WHERE value IS NOT NULL) "
    + " UNION ALL ".join((
        _variant_sql("S0"), _variant_sql("S1", f"({_KIND} IN ('absolute', 'count') OR {_KIND} = 'intensity') AND {_TIMES} = '' AND value >= 10000", value="round(value / CASE WHEN value >= 1e6 THEN 1e6 ELSE 1e3 END, 1)", multiplier_text="CASE WHEN value >= 1e6 THEN 'triệu' ELSE 'nghìn' END"),
        _variant_sql("C1", value=f"CASE WHEN {_PERCENT} THEN CASE WHEN value <= 80 THEN value + 15 ELSE value - 15 END ELSE value * ([0.7, 0.8, 1.25, 1.4]::DOUBLE[])[quantity_id % 4 + 1] END"),
        _variant_sql("C2", f"{_KIND} IN ('absolute', 'count') AND value <> 0 AND NOT {_PERCENT}", multiplier_text="'nghìn'"),
        _variant_sql("C3", f"{_KIND} = 'change' AND change_direction IN ('decrease', 'increase')", change_direction="CASE WHEN change_direction = 'decrease' THEN 'increase' ELSE 'decrease' END"),
        _variant_sql("N1", "period IS NOT NULL", period="period - 1"),
        _variant_sql("N2", status="CASE WHEN status = 'target' THEN 'actual' ELSE 'target' END", period="CASE WHEN status = 'target' THEN NULL WHEN coalesce(period, 0) < 2026 THEN 2030 ELSE period END"),
        _variant_sql("N3", "metric = 'ghg_emissions' AND scope IS NOT NULL", scope=_MAP("scope", datasets.OTHER_SCOPE)), _variant_sql("N4", "boundary = 'facility'", boundary="'group'"),
        _variant_sql("N5", f"{_KIND} = 'absolute' AND trim(unit_text) <> '' AND NOT contains(unit_text, '/') AND NOT {_PERCENT}", value_kind="'intensity'", unit_text="unit_text || '/tấn sản phẩm'"),
        _variant_sql("N6", "metric IN ('water_use', 'electricity_consumption', 'ghg_emissions')", metric=_MAP("metric", NEIGHBOURS)),
    ))
)
def figure_variants(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quantity_id")
    own = table(spark, d, "numeric_facts").where("value is not null").select(
        "quantity_id", "value", F.lit("").alias("multiplier_text"), F.when(q % 2 == 0, "decrease").alias("change_direction"), "period", F.when(F.col("is_target"), "target").otherwise("actual").alias("status"),
        F.when(F.col("scopes") == "1", "s1").when(F.col("scopes").isNotNull(), "s1+s2").alias("scope"), "boundary", F.when(q % 5 == 0, "change").otherwise(F.col("basis")).alias("value_kind"), F.col("unit").alias("unit_text"), "metric",
    ).distinct()
    return datasets.figure_variants(own, NEIGHBOURS)


_WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), w -> w <> '')"


@query(rf"SELECT DISTINCT candidate_id, length(t) >= 45 AND len({_WORDS}) >= 8 AND len(list_filter({_WORDS}, w -> regexp_matches(w, '^\p{{Lu}}'))) <= 0.6 * len({_WORDS}) AS prose, regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:recycl|phát thải|energy)') AS on_topic FROM (SELECT candidate_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM candidates WHERE text IS NOT NULL)")
def worth_labelling(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null")
    return own.select("candidate_id", datasets.prose(F.col("text")).alias("prose"), datasets.on_topic(F.col("text"), ("recycl", "phát thải", "energy")).alias("on_topic")).distinct()


_FLAT = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@query(
    f"""WITH g AS (SELECT item_id, company_id, text AS c, 2021 AS y FROM gold_claims), e AS (SELECT DISTINCT candidate_id, company_id, text AS e, publication_year AS z FROM candidates WHERE text IS NOT NULL)
SELECT item_id, count(*) AS n FROM g JOIN e USING (company_id) WHERE NOT coalesce(contains({_FLAT('e')}, nullif(left({_FLAT('c')}, 80), '')), FALSE) AND NOT coalesce(z > y, FALSE) GROUP BY item_id"""
)
def usable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a held-out claim's company that can be held against it: a stated query set, met on the company."""
    g = table(spark, d, "gold_claims").select("item_id", "company_id", F.col("text").alias("claim_text"), F.lit(2021).alias("claim_year"))
    e = table(spark, d, "candidates").where("text is not null").select("candidate_id", "company_id", F.col("text").alias("evidence_text"), F.col("publication_year").alias("evidence_year")).distinct()
    small = F.broadcast(g) if g.count() <= 10_000 else g
    return datasets.usable(e.join(small, "company_id")).groupBy("item_id").agg(F.count("*").alias("n"))


@query(
    r"SELECT quantity_id, CASE WHEN period IS NOT NULL AND len(y) > 0 AND NOT list_contains(y, period::VARCHAR) AND NOT coalesce(list_contains(y, baseline_year::VARCHAR), FALSE) THEN array_to_string(y, '/') END AS other_year FROM "
    r"(SELECT DISTINCT quantity_id, period, baseline_year, list_sort(list_distinct(regexp_extract_all(sentence, '\b(?:19|20)\d{2}\b'))) AS y FROM ir_figures WHERE sentence IS NOT NULL)"
)
def other_years(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "ir_figures").where("sentence is not null")
    return own.select("quantity_id", datasets.other_year(F.col("sentence"), F.col("period"), F.col("baseline_year")).alias("other_year")).distinct()


@query(
    rf"SELECT DISTINCT quantity_id, CASE WHEN metric = 'other_env' THEN 'other_env' WHEN period IS NOT NULL AND NOT regexp_matches(lower(coalesce(sentence, '')), '{datasets.DATED}' || period::VARCHAR) THEN 'period_not_dated' WHEN regexp_matches(coalesce(metric_text, ''), '\d') THEN 'metric_has_digit' "
    "WHEN lower(trim(unit_text)) = 'đơn vị' THEN 'unit_placeholder' END AS defect FROM ir_figures"
)
def case_defects(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(n) for n in ("sentence", "metric", "period", "metric_text", "unit_text")]
    return table(spark, d, "ir_figures").select("quantity_id", datasets.defect(*c).alias("defect")).distinct()


@query("SELECT * FROM (VALUES ('a', 'S', 2), ('b', 'C', 2), ('c', 'N', 2), ('d', 'S', 1), ('e', 'C', 1), ('f', 'N', 1)) AS x(claim_id, label, n_slots)")
def slot_verdicts(spark: SparkSession, d: str) -> DataFrame:
    slots = [
        ("a", "S1", 10.0, 0.5, "kg", 0), ("a", "S2", 7.0, 0.5, "kg", 0), ("b", "S1", 10.0, 0.5, "kg", 0), ("b", "S2", 1.0, 0.5, "kg", 0), ("c", "S1", 5.0, 0.5, "kg", 0), ("c", "S2", 5.0, 0.5, "kg", 0), ("d", "S1", 20.0, 0.5, "%", -1),
        ("e", "S1", 20.0, 0.5, "%", 1), ("f", "S1", 5.0, 0.5, "kg", 0),
    ]
    maps = [
        ("a", "S1", "direct", 1, 10.2, 0.05, "kg"), ("a", "S2", "sum", 1, 3.0, 0.5, "kg"), ("a", "S2", "sum", 2, 4.0, 0.5, "kg"), ("b", "S1", "direct", 1, 10.0, 0.5, "kg"), ("b", "S2", "direct", 1, 9.0, 0.5, "kg"),
        ("c", "S1", "direct", 1, 5.0, 0.5, "kg"), ("c", "S2", "direct", 1, 5.0, 0.5, "m3"), ("d", "S1", "change", 1, 100.0, 0.5, "kg"), ("d", "S1", "change", 2, 80.0, 0.5, "kg"), ("e", "S1", "change", 1, 100.0, 0.5, "kg"),
        ("e", "S1", "change", 2, 80.0, 0.5, "kg"), ("f", "S1", "direct", 1, None, None, "kg"),
    ]
    own = spark.createDataFrame(slots, "claim_id string, slot string, value double, half double, kind string, sign int")
    to = spark.createDataFrame(maps, "claim_id string, slot string, type string, part int, value double, half double, kind string")
    return datasets.slot_verdicts(own, to).withColumn("n_slots", F.col("n_slots").cast("int"))


@query("SELECT unit_id, CASE WHEN unit_index IS NULL THEN 0.5 WHEN unit_index <= 20 THEN 1.0 ELSE 0.5 END::DOUBLE AS prominence FROM units")
def prominence_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("unit_id", datasets.prominence(F.col("unit_index")).alias("prominence"))


CASE_TYPES = ("supported", "partial", "contradicted", "insufficient", "not_a_claim", "unit", "period", "scope", "boundary")


@query("SELECT DISTINCT company_id, unnest(" + str(list(CASE_TYPES)) + ") AS case_type FROM crawl_documents WHERE company_id IS NOT NULL")
def case_grid(spark: SparkSession, d: str) -> DataFrame:
    return datasets.case_grid(table(spark, d, "crawl_documents"), CASE_TYPES)


@query("SELECT document_id, document_type, n AS n_roles FROM (SELECT document_id, document_type, count(*) OVER (PARTITION BY document_id) AS n, row_number() OVER (PARTITION BY document_id ORDER BY document_type NULLS FIRST, crawl_id) AS r FROM crawl_documents WHERE document_id IS NOT NULL) WHERE r = 1")
def instrument_sources(spark: SparkSession, d: str) -> DataFrame:
    """One row of each document, that of the first type, with the number of all."""
    own = table(spark, d, "crawl_documents").select("document_id", "document_type", "crawl_id")
    return datasets.first_roles(own, "document_id", F.struct("document_type", "crawl_id")).select("document_id", "document_type", "n_roles")


@query("SELECT * FROM (VALUES ('A2'), ('A3')) AS x(id)")
def newest_instruments(spark: SparkSession, d: str) -> DataFrame:
    return datasets.newest_instruments(spark.sql(f"SELECT id, effective_from FROM {INSTRUMENTS}"), 2).select("id")


@query(f"SELECT doc_id, len(list_filter(s, t -> contains({match_sql('t')}, 'phat thai')))::BIGINT AS n_sentences FROM (SELECT doc_id, [text] AS s FROM documents WHERE text IS NOT NULL AND length(text) < 12)")
def short_metric_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts too short for a sentence are one sentence of their own."""
    own = table(spark, d, "documents").where("text is not null and length(text) < 12")
    return own.select("doc_id", F.size(datasets.metric_sentences(F.col("text"), ("phat thai",))).cast("long").alias("n_sentences"))
