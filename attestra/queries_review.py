"""Queries of figure facts and of labels, runs and packs under review, with their SQL; registered beside those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import numbers
from attestra.functions import text as tx
from attestra.operators import facts, passages, review
from attestra.queries import DECIMALS_SQL, MAJORITY_SQL, NUMBER_SQL, ORACLES, VOTES_SQL, match_sql, query, table, verdict_votes, voted_majority
from attestra.runtime import own_dir
from attestra.streaming import streams

# --- facts ----------------------------------------------------------------------------------------

SENTENCES = [
    (1, "Tập đoàn giảm 12% phát thải phạm vi 1 và 2 năm 2023 so với 2022"), (2, "Nhà máy đặt mục tiêu 50 MWh điện mặt trời đến năm 2030"), (3, "BF-BOF: 2,32 tCO2e/tấn"), (4, None),
    (5, "Năng lượng tái tạo chiếm 30% tổng tiêu thụ; tái chế 5 tấn chất thải nguy hại"), (6, "Không có số"),
]


@query(
    """SELECT * FROM (VALUES (1, 12.0, 'share', 'percentage_change', FALSE, 'group', NULL, '', '1+2'), (2, 50000.0, 'energy', 'absolute', TRUE, 'facility', 'solar', '', ''), (3, 2320.0, 'co2e/mass', 'intensity', FALSE, 'unknown', 'bf_bof', '', ''),
(5, 30.0, 'share', 'percentage_share', FALSE, 'unknown', NULL, 'recovered+renewable', ''), (5, 5000.0, 'mass', 'absolute', FALSE, 'unknown', NULL, 'hazardous+recovered', '')) AS x(id, value, kind, basis, is_target, boundary, technology, variant, scopes)"""
)
def figure_facts(spark: SparkSession, d: str) -> DataFrame:
    own = facts.facts(spark.createDataFrame(SENTENCES, "id int, text string"))
    return own.select("id", "value", "kind", "basis", "is_target", "boundary", "technology", F.array_join("variant", "+").alias("variant"), F.array_join(F.transform("scopes", lambda x: x.cast("string")), "+").alias("scopes"))


@query()
def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """The figures of all sentences of the numeric facts, with their dimensions."""
    return facts.facts(table(spark, d, "numeric_facts").where("sentence is not null").select("quantity_id", "sentence").distinct(), "sentence").drop("sentence")


_FACT = ("value", "unit", "basis", "boundary", "technology", "scopes", "is_target")
_APART = lambda c, r: f"WHEN nullif(a.{c}, 'unknown') <> nullif(b.{c}, 'unknown') THEN '{r}'"


@query(
    f"""WITH f AS (SELECT DISTINCT quantity_id, company_id, subject_text, metric, period, {', '.join(_FACT)} FROM numeric_facts WHERE company_id IS NOT NULL AND subject_text IS NOT NULL AND metric IS NOT NULL AND period IS NOT NULL),
p AS (SELECT a.quantity_id AS a_id, b.quantity_id AS b_id, CASE WHEN coalesce(lower(a.unit) <> lower(b.unit), TRUE) THEN 'different_unit' {_APART('basis', 'different_basis')} {_APART('boundary', 'different_boundary')} {_APART('technology', 'different_technology')}
{_APART('scopes', 'different_scope')} WHEN coalesce(a.is_target, FALSE) <> coalesce(b.is_target, FALSE) THEN 'target_vs_actual'
WHEN coalesce(greatest(abs(a.value), abs(b.value)) / greatest(least(abs(a.value), abs(b.value)), 1e-9) >= 100 OR (greatest(abs(a.value), abs(b.value)) / greatest(least(abs(a.value), abs(b.value)), 1e-9) >= 20
AND (coalesce(a.basis, 'unknown') = 'unknown' OR coalesce(b.basis, 'unknown') = 'unknown' OR coalesce(a.boundary, 'unknown') = 'unknown' OR coalesce(b.boundary, 'unknown') = 'unknown')), TRUE) THEN 'magnitude_gap' END AS reason
FROM f a JOIN f b USING (company_id, subject_text, metric, period) WHERE a.quantity_id < b.quantity_id)
SELECT a_id, b_id, CASE WHEN reason IS NULL THEN 'COMPARABLE' WHEN reason IN ('target_vs_actual', 'magnitude_gap') THEN 'AMBIGUOUS' ELSE 'NOT_COMPARABLE' END AS status, reason FROM p"""
)
def numeric_eligibility(spark: SparkSession, d: str) -> DataFrame:
    key = ["company_id", "subject_text", "metric", "period"]
    own = table(spark, d, "numeric_facts").dropna(subset=key).select("quantity_id", *key, *_FACT).distinct()
    own = own.withColumn("unit", F.lower("unit")).withColumn("scopes", F.split("scopes", r"\+")).withColumn("variant", F.array().cast("array<string>"))
    names = ("quantity_id", *_FACT, "variant")
    a, b = (own.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in names)) for s in "ab")
    both = a.join(b, key).where("a_quantity_id < b_quantity_id")
    side = lambda s: {c: F.col(f"{s}_{c}") for c in names}
    return both.select(F.col("a_quantity_id").alias("a_id"), F.col("b_quantity_id").alias("b_id"), facts.eligibility(side("a"), side("b")).alias("x")).select("a_id", "b_id", "x.*")


_READ = ("value_kind", "status", "period", "scope", "baseline_year", "boundary", "change_direction")
_READ_SQL = f"""(SELECT DISTINCT quantity_id, company_id, subject_text, metric, {', '.join(_READ)}, lower(trim(unit_text)) AS unit, {NUMBER_SQL} AS value, 0.5 * power(10.0, CASE WHEN ({DECIMALS_SQL}) > 0 THEN -({DECIMALS_SQL}) ELSE length(regexp_replace(t, '[.,]', '', 'g')) - length(regexp_replace(regexp_replace(t, '[.,]', '', 'g'), '0+$', '')) END) AS half
FROM (SELECT *, length(t) - length(replace(t, '.', '')) AS d, length(t) - length(replace(t, ',', '')) AS c FROM (SELECT *, regexp_replace(trim(value_text), '[.,]+$', '') AS t FROM ir_figures)) WHERE company_id IS NOT NULL AND subject_text IS NOT NULL AND metric IS NOT NULL)"""
_COMPARED_SQL = f"""SELECT a.quantity_id AS a_id, b.quantity_id AS b_id, CASE WHEN coalesce(nullif(a.value_kind, 'count'), 'absolute') <> coalesce(nullif(b.value_kind, 'count'), 'absolute') THEN 'value_kind' WHEN coalesce(a.status, 'actual') <> coalesce(b.status, 'actual') THEN 'status'
WHEN a.period IS DISTINCT FROM b.period THEN 'period' WHEN a.scope IS DISTINCT FROM b.scope THEN 'scope' WHEN coalesce(nullif(a.value_kind, 'count'), 'absolute') = 'change' AND a.baseline_year IS DISTINCT FROM b.baseline_year THEN 'baseline_year'
WHEN coalesce(a.boundary, 'unspecified') <> 'unspecified' AND coalesce(b.boundary, 'unspecified') <> 'unspecified' AND a.boundary <> b.boundary THEN 'boundary' WHEN a.value IS NULL OR b.value IS NULL THEN 'number' WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit'
WHEN coalesce(nullif(a.value_kind, 'count'), 'absolute') = 'change' AND a.change_direction IS DISTINCT FROM b.change_direction THEN 'direction' END AS reason, abs(a.value - b.value) <= a.half + b.half AS near
FROM {_READ_SQL} a JOIN {_READ_SQL} b USING (company_id, subject_text, metric) WHERE a.quantity_id < b.quantity_id"""
_LABEL_SQL = "CASE WHEN reason = 'direction' THEN 'C' WHEN reason IS NOT NULL THEN 'N' WHEN near THEN 'S' ELSE 'C' END"


@query(f"SELECT a_id, b_id, {_LABEL_SQL} AS label, reason FROM ({_COMPARED_SQL})")
def figures_compared(spark: SparkSession, d: str) -> DataFrame:
    """Read figures of one company, site and metric, pair by pair."""
    key = ["company_id", "subject_text", "metric"]
    own = table(spark, d, "ir_figures").dropna(subset=key).select("quantity_id", *key, *_READ, F.lower(F.trim("unit_text")).alias("unit"), numbers.locale_number(F.col("value_text")).alias("value"), numbers.half_unit(F.col("value_text")).alias("half")).distinct()
    names = ("quantity_id", *_READ, "unit", "value", "half")
    a, b = (own.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in names)) for s in "ab")
    both = a.join(b, key).where("a_quantity_id < b_quantity_id")
    side = lambda s: {c: F.col(f"{s}_{c}") for c in names} | {"metric": F.col("metric")}
    return both.select(F.col("a_quantity_id").alias("a_id"), F.col("b_quantity_id").alias("b_id"), facts.compare(side("a"), side("b")).alias("x")).select("a_id", "b_id", "x.*")


@query(f"SELECT a_id, CASE WHEN count(DISTINCT nullif(label, 'N')) = 1 THEN max(nullif(label, 'N')) ELSE 'N' END AS label, count(*) AS n_pairs FROM (SELECT a_id, {_LABEL_SQL} AS label FROM ({_COMPARED_SQL})) GROUP BY a_id")
def figures_decided(spark: SparkSession, d: str) -> DataFrame:
    return facts.decide(figures_compared(spark, d), ["a_id"])


@query(
    """SELECT * FROM (VALUES (1, '23,5', 'triệu', 2023, NULL), (2, '10.730', '', NULL, NULL), (4, '12', '', 2020, 2019)) AS x(id, value_text, multiplier_text, period, baseline_year)"""
)
def grounded_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a reader held to their sentences: the third isn't written, the fifth's multiplier is unclear."""
    rows = [
        (1, "23,5 triệu tCO2e", None, 2023, None, "Năm 2023 phát thải 23,5 triệu tCO2e"), (2, "10.730", "", 2022, None, "Dùng 10.730 m3 nước"), (3, "99", "", None, None, "Dùng 10.730 m3 nước"),
        (4, "12", None, 2020, 2019, "giảm 12% năm 2020 so với 2019"), (5, "5", "tỷ", None, None, "5 nghìn cây và 5 triệu cây"), (6, None, None, None, None, "không"),
    ]
    own = spark.createDataFrame(rows, "id int, value_text string, multiplier_text string, period int, baseline_year int, sentence string")
    x = facts.ground(F.col("value_text"), F.col("multiplier_text"), {"period": F.col("period"), "baseline_year": F.col("baseline_year")}, F.col("sentence"))
    return own.select("id", x.alias("x")).where("x is not null").select("id", "x.*")


def _direction_sql(x: str) -> str:
    down, up = (f"regexp_matches({match_sql(x)}, '{tx.whole_words(w)}')" for w in (facts.DOWN, facts.UP))
    return f"CASE WHEN {down} AND NOT {up} THEN 'decrease' WHEN {up} AND NOT {down} THEN 'increase' END"


@query(f"SELECT DISTINCT candidate_id, {_direction_sql('text')} AS direction FROM candidates WHERE text IS NOT NULL")
def sentence_directions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").where("text is not null").select("candidate_id", facts.direction(F.col("text")).alias("direction")).distinct()


@query(
    f"""WITH c AS (SELECT DISTINCT candidate_id, chunk_id, sentence_index, text FROM candidates WHERE text IS NOT NULL), n AS (SELECT candidate_id, {_direction_sql('text')} AS x, {_direction_sql('b')} AS y FROM (SELECT *, lag(text) OVER (PARTITION BY chunk_id ORDER BY sentence_index, candidate_id, text) AS b FROM c))
SELECT candidate_id, coalesce(x <> y, FALSE) AS reversed FROM n"""
)
def direction_reversals(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that turn the direction of the one before them."""
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", "chunk_id", "sentence_index", "text").distinct()
    own = passages.neighbours(own, ["chunk_id"], ["sentence_index", "candidate_id", "text"])
    return own.select("candidate_id", facts.reversed_direction(F.col("text"), F.col("before")).alias("reversed"))


@query(
    r"""WITH l AS (SELECT unit_id, i, s[i] AS line FROM (SELECT unit_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT unit_id, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM units WHERE text IS NOT NULL))),
h AS (SELECT unit_id, i, nullif(lower(regexp_replace(regexp_extract(line, '(?i)[(（]\s*(?:đơn vị(?: tính)?\s*[:：]\s*)?(tco2e?|tấn\s*co2e?|co2e|gj|mj|tj|kwh|mwh|gwh|m3|m³|tấn|kg|%)\s*[)）]|đơn vị(?: tính)?\s*[:：]\s*(tco2e?|gj|mj|tj|kwh|mwh|gwh|m3|m³|tấn|kg|%)', 0), '(?i)đơn vị(?: tính)?|[()（）:：\s]', '', 'g')), '') AS hint FROM l),
y AS (SELECT unit_id, year, count(*) AS n FROM (SELECT unit_id, unnest(regexp_extract_all(line, '\b(?:19|20)\d{2}\b')) AS year FROM l) GROUP BY ALL)
SELECT unit_id, page_unit, page_period FROM (SELECT unit_id, arg_min(hint, i) FILTER (hint IS NOT NULL) AS page_unit FROM h GROUP BY 1) LEFT JOIN (SELECT unit_id, arg_max(year, {'n': n, 'y': year}) AS page_period FROM y GROUP BY 1) USING (unit_id)"""
)
def page_frames(spark: SparkSession, d: str) -> DataFrame:
    lines = passages.lines(table(spark, d, "units").where("text is not null").select(F.col("unit_id").alias("doc_id"), "text"))
    return facts.page_frame(lines, ["doc_id"], "line_no").withColumnRenamed("doc_id", "unit_id")


@query("SELECT * FROM (VALUES ('p1', 100.0, 100.0, 2, TRUE), ('p2', 90.0, 80.0, 2, FALSE)) AS x(page, total, parts_sum, parts, foots)")
def scope_cross_foot(spark: SparkSession, d: str) -> DataFrame:
    """Totals against parts of disjoint scopes: the sum of scopes 1 and 2 isn't counted beside its parts."""
    rows = [
        ("p1", 100.0, [], True), ("p1", 40.0, [], True), ("p1", 70.0, [1], False), ("p1", 30.0, [2], False), ("p1", 100.0, [1, 2], False), ("p2", 90.0, [], True), ("p2", 50.0, [1], False), ("p2", 20.0, [1], False),
        ("p2", 30.0, [2, 3], False), ("p3", 9.0, [], True), ("p3", 9.0, [1], False), ("p4", 5.0, [1], False),
    ]
    return facts.scope_parts(spark.createDataFrame(rows, "page string, value double, scopes array<int>, is_total boolean"), ["page"], 0.5)


# --- labels ---------------------------------------------------------------------------------------


@query(
    f"""WITH v AS (SELECT item_id, labeler, min(label) AS label FROM {VOTES_SQL} WHERE label IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL), a AS (SELECT item_id, min(label) AS a FROM v WHERE labeler = 'rv-01' GROUP BY 1), b AS (SELECT item_id, min(label) AS b FROM v WHERE labeler = 'rv-02' GROUP BY 1),
c AS (SELECT item_id, label AS c FROM {MAJORITY_SQL} WHERE agreement >= 0.9 AND n_votes >= 4), j AS (SELECT item_id, a, b, c FROM a FULL JOIN b USING (item_id) FULL JOIN c USING (item_id)),
s AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'adjudicated' WHEN a = b THEN 'agreed' WHEN a IS NULL OR b IS NULL THEN 'single' ELSE 'open' END AS source FROM j)
SELECT item_id, CASE WHEN source <> 'open' THEN coalesce(c, a, b) END AS label, source FROM s WHERE item_id IS NOT NULL"""
)
def two_pass_labels(spark: SparkSession, d: str) -> DataFrame:
    """The two busiest labelers as passes, items of near unanimity as adjudicated."""
    v = verdict_votes(spark, d).where("label is not null and item_id is not null")
    sure = voted_majority(spark, d).where("agreement >= 0.9 and n_votes >= 4 and item_id is not null")
    return review.merge_passes(v.where("labeler = 'rv-01'"), v.where("labeler = 'rv-02'"), sure)


RELATIONS = "(VALUES (1, 'SUPPORTED', 'supports'), (1, 'SUPPORTED', 'CONTEXT'), (2, 'SUPPORTED', 'refutes'), (3, 'CONTRADICTED', 'supports'), (4, 'INSUFFICIENT_EVIDENCE', NULL), (5, 'INSUFFICIENT_EVIDENCE', 'REFUTES'), (6, 'CONTRADICTED', 'REFUTES')) AS r(item_id, verdict, relation)"


@query("SELECT * FROM (VALUES (2, 'SUPPORTED', 'supported_without_support,supported_despite_refutation'), (3, 'CONTRADICTED', 'contradicted_without_refutation'), (5, 'INSUFFICIENT_EVIDENCE', 'insufficient_despite_evidence')) AS x(item_id, verdict, problems)")
def inconsistent_labels(spark: SparkSession, d: str) -> DataFrame:
    return review.label_problems(spark.sql(f"SELECT * FROM {RELATIONS}")).withColumn("problems", F.array_join("problems", ","))


@query()
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by type and figure, up to a quota each and three of a company."""
    own = table(spark, d, "candidates").select("candidate_id", "company_id", "candidate_type", "has_number").distinct()
    stratum = F.concat_ws("_", F.col("candidate_type"), F.when(F.col("has_number"), "figure").otherwise("words"))
    return review.stratified(own, stratum, "company_id", "candidate_id", {"claim_figure": 40, "claim_words": 20, "evidence_figure": 40, "evidence_words": 20}, 3)


@query(
    f"""WITH g AS (SELECT m.label AS g, v.label AS p FROM {VOTES_SQL} v JOIN {MAJORITY_SQL} m USING (item_id) WHERE v.labeler = 'rv-01' AND v.label IS NOT NULL), k AS (SELECT g AS c, count(*) AS ng FROM g GROUP BY 1), q AS (SELECT p AS c, count(*) AS np FROM g GROUP BY 1), h AS (SELECT g AS c, count(*) AS tp FROM g WHERE g = p GROUP BY 1),
f AS (SELECT avg(2.0 * coalesce(tp, 0) / (ng + coalesce(np, 0))) AS macro_f1, max(ng) AS big FROM k LEFT JOIN q USING (c) LEFT JOIN h USING (c))
SELECT n, round(acc, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(fc, 9) AS false_contradiction, round(cov, 9) AS coverage, round(sel, 9) AS selective_accuracy, round(big / n, 9) AS majority_baseline FROM (SELECT count(*) AS n, count(*) FILTER (g = p) / count(*) AS acc,
count(*) FILTER (p = 'CONTRADICTED' AND g <> p) / count(*) FILTER (g <> 'CONTRADICTED') AS fc, count(*) FILTER (p <> 'INSUFFICIENT_EVIDENCE') / count(*) AS cov, count(*) FILTER (p <> 'INSUFFICIENT_EVIDENCE' AND g = p) / nullif(count(*) FILTER (p <> 'INSUFFICIENT_EVIDENCE'), 0) AS sel FROM g), f"""
)
def selective_measures(spark: SparkSession, d: str) -> DataFrame:
    """One labeler against the majority."""
    gold = voted_majority(spark, d).select("item_id", F.col("label").alias("gold"))
    pairs = verdict_votes(spark, d).where("labeler = 'rv-01' and label is not null").select("item_id", F.col("label").alias("pred")).join(gold, "item_id")
    out = review.selective(pairs)
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"SELECT labeler AS method, v.label AS stance, count(*) AS n, count(*) FILTER (v.label = m.label) AS \"right\", round(count(*) FILTER (v.label = m.label) / count(*), 9) AS precision FROM {VOTES_SQL} v JOIN {MAJORITY_SQL} m USING (item_id) WHERE v.label IS NOT NULL AND labeler IS NOT NULL GROUP BY ALL")
def stance_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Each labeler as a method, the majority as gold."""
    gold = voted_majority(spark, d).select("item_id", F.col("label").alias("gold"))
    own = verdict_votes(spark, d).where("label is not null and labeler is not null").select("item_id", F.col("labeler").alias("method"), F.col("label").alias("said"))
    return review.stance_measures(own.join(gold, "item_id")).withColumn("precision", F.round("precision", 9))


@query(
    """WITH f AS (SELECT DISTINCT quantity_id, metric, CASE WHEN is_target THEN 'N' WHEN quantity_id % 2 = 0 THEN 'S' ELSE 'C' END AS gold, CASE WHEN basis = 'unknown' THEN 'N' WHEN quantity_id % 3 = 0 THEN 'S' ELSE 'C' END AS said FROM numeric_facts)
SELECT metric, count(*) AS n, count(*) FILTER (said <> 'N') AS decided, count(*) FILTER (said = gold) AS "right", count(*) FILTER (said = 'S' AND gold <> 'S') AS false_s, count(*) FILTER (said = 'C' AND gold <> 'C') AS false_c,
round(count(*) FILTER (said <> 'N') / count(*), 9) AS coverage, round(count(*) FILTER (said <> 'N' AND said = gold) / nullif(count(*) FILTER (said <> 'N'), 0), 9) AS precision FROM f GROUP BY metric"""
)
def layer_scores(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quantity_id")
    own = table(spark, d, "numeric_facts").select(
        "quantity_id", "metric", F.when(F.col("is_target"), "N").when(q % 2 == 0, "S").otherwise("C").alias("gold"), F.when(F.col("basis") == "unknown", "N").when(q % 3 == 0, "S").otherwise("C").alias("said")
    ).distinct()
    out = review.layer_scores(own, ["metric"])
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "precision")})


@query(f"SELECT item_id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'N' END AS label FROM {VOTES_SQL} WHERE item_id IS NOT NULL AND label IS NOT NULL GROUP BY item_id")
def decisive_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of items whose votes all agree; only the distinct labels of an item come together."""
    v = verdict_votes(spark, d).where("item_id is not null and label is not null")
    return v.groupBy("item_id").agg(F.collect_set("label").alias("x")).select("item_id", review.decisive(F.col("x")).alias("label"))


_SYSTEMS = "(SELECT 'bm25' AS system, query_id, doc_id, rank FROM ({b}) UNION ALL SELECT 'jaccard', query_id, doc_id, rank FROM ({j}))"
_REL = "(SELECT query_id, doc_id, 3 - rank AS rel FROM ({t}) WHERE rank <= 2)".format(t=ORACLES["tfidf_char_topk"])


@query(
    f"""WITH r AS {_SYSTEMS.format(b=f"SELECT query_id, doc_id, rank FROM ({ORACLES['rrf_fusion']})", j=ORACLES['jaccard_topk'])}, l AS {_REL}, i AS (SELECT query_id, count(*) AS nr, sum((power(2.0, rel) - 1) / log2(p + 1)) FILTER (p <= 5) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS p FROM l) GROUP BY 1),
h AS (SELECT system, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) AS h5, min(rank) AS best, sum((power(2.0, rel) - 1) / log2(rank + 1)) AS dcg FROM r JOIN l USING (query_id, doc_id) WHERE rank <= 5 GROUP BY ALL)
SELECT system, (SELECT count(*) FROM i) AS n_queries, round(coalesce(sum(h1 / nr), 0) / (SELECT count(*) FROM i), 6) AS recall_1, round(coalesce(sum(h3 / nr), 0) / (SELECT count(*) FROM i), 6) AS recall_3, round(coalesce(sum(h5 / nr), 0) / (SELECT count(*) FROM i), 6) AS recall_5,
round(count(h5) / (SELECT count(*) FROM i), 6) AS hit, round(coalesce(sum(1 / best), 0) / (SELECT count(*) FROM i), 6) AS mrr, round(coalesce(sum(dcg / ideal), 0) / (SELECT count(*) FROM i), 6) AS ndcg FROM (SELECT DISTINCT system FROM r) LEFT JOIN h USING (system) LEFT JOIN i USING (query_id) GROUP BY system"""
)
def graded_systems(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings against the two best passages by character n-grams as graded relevance."""
    from attestra import queries as core

    one = lambda q, n: q(spark, d).select(F.lit(n).alias("system"), "query_id", "doc_id", "rank")
    ranked = one(core.rrf_fusion, "bm25").unionByName(one(core.jaccard_topk, "jaccard"))
    rel = core.tfidf_char_topk(spark, d).where("rank <= 2").select("query_id", "doc_id", (3 - F.col("rank")).alias("rel"))
    out = review.graded_ranking(ranked, rel)
    return out.select("system", F.col("n_queries").cast("long").alias("n_queries"), *(F.round(c, 6).alias(c) for c in out.columns[2:]))


# --- runs and packs -------------------------------------------------------------------------------


@query("SELECT document_id, crawl_id, status FROM (SELECT document_id, crawl_id, status, row_number() OVER (PARTITION BY document_id ORDER BY batch_no DESC NULLS LAST, crawl_id DESC) AS r FROM crawl_documents WHERE document_id IS NOT NULL AND batch_no IS NOT NULL) WHERE r = 1")
def latest_crawls(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each document over all batches."""
    own = table(spark, d, "crawl_documents").select("document_id", "crawl_id", "status", "batch_no")
    return review.latest_outputs(own, F.col("document_id"), "batch_no").select("document_id", "crawl_id", "status")


@query(
    """SELECT * FROM (VALUES (1, 'SATISFIED'), (2, 'NOT_SATISFIED'), (3, 'SATISFIED'), (4, 'NOT_SATISFIED'), (5, 'UNKNOWN'), (6, 'UNKNOWN'), (7, 'UNKNOWN')) AS x(rule_id, status)"""
)
def condition_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        (1, "terms_present", ["giấy phép", "permit"], None, None, "Đã có GIAY PHEP môi trường"), (2, "terms_present", ["permit"], None, None, "không có"), (3, "numeric_threshold", None, ">=", 50.0, "đạt 12 và 1.200 tấn"),
        (4, "numeric_threshold", None, "<", 10.0, "đạt 12"), (5, "numeric_threshold", None, ">", 1.0, "không số"), (6, "manual", None, None, None, "12"), (7, "terms_present", ["x"], None, None, None),
    ]
    own = spark.createDataFrame(rows, "rule_id int, check string, any_of_terms array<string>, operator string, threshold double, evidence string")
    return review.conditions(own).select("rule_id", "status")


INSTRUMENTS = "(VALUES ('L1', DATE '2020-01-01', NULL, array('green', 'waste'), array('A1', 'A2', 'A9')), ('A1', DATE '2021-01-01', DATE '2022-12-31', array('green'), array('A3')), ('A2', DATE '2023-06-01', NULL, array('green'), array()), ('A3', DATE '2021-02-01', NULL, array('waste'), array()), ('L2', NULL, NULL, array('green'), array('A3'))) AS i(id, effective_from, effective_to, legal_issues, amended_by)"


@query("SELECT * FROM (VALUES ('2022-06-30', 'L1', 'A1'), ('2022-06-30', 'A1', 'A3'), ('2024-01-01', 'L1', 'A2')) AS x(as_of, base_id, amendment_id)")
def amendment_chain(spark: SparkSession, d: str) -> DataFrame:
    own = spark.sql(f"SELECT id, effective_from, effective_to, legal_issues, CAST(amended_by AS array<string>) AS amended_by FROM {INSTRUMENTS}")
    one = lambda day: review.amendment_chain(own, F.lit(day).cast("date"), F.lit("green")).select(F.lit(day).alias("as_of"), "base_id", "amendment_id")
    return one("2022-06-30").unionByName(one("2024-01-01"))


@query("SELECT crawl_id, CASE WHEN status = 'downloaded' AND publication_year IS NOT NULL THEN make_date(publication_year, 12, 31) WHEN status <> 'downloaded' THEN DATE '2026-01-01' END AS as_of FROM crawl_documents")
def as_of_dates(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents")
    mode = F.when(F.col("status") == "downloaded", "historical").when(F.col("status") != "downloaded", "current")
    return own.select("crawl_id", review.as_of_date(mode, F.col("publication_year"), F.lit("2026-01-01").cast("date")).alias("as_of"))


@query("SELECT * FROM (VALUES ('R1', 'art1', TRUE), ('R1', 'art9', FALSE), ('R2', NULL, FALSE), ('R3', 'annexI.001', TRUE)) AS x(rule_id, clause_id, ready)")
def clause_binding(spark: SparkSession, d: str) -> DataFrame:
    from attestra.queries import statute_clauses

    rules = spark.createDataFrame([("R1", ["art1", "art9"]), ("R2", []), ("R3", ["annexI.001"])], "rule_id string, clause_ids array<string>")
    return review.unbound_clauses(rules, statute_clauses(spark, d).select(F.col("path").alias("clause_id")))


@query(f"WITH c AS ({ORACLES['bm25_topk']}), m AS (SELECT query_id, doc_id, rank AS old_rank, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3)::DOUBLE END AS model_score FROM c) SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC NULLS LAST, old_rank, doc_id)::INT AS rank FROM m) WHERE rank <= 3")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """A ranking put into the order of a given model score."""
    from attestra.queries import bm25_topk

    score = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("double"))
    return review.rerank(bm25_topk(spark, d), score, 3).select("query_id", "doc_id", "rank")


@query(r"SELECT crawl_id, nullif(regexp_extract(title, '\b([A-Z]{3})\b', 1), '') AS ticker_found FROM crawl_documents WHERE title IS NOT NULL")
def title_tickers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_documents").where("title is not null").select("crawl_id", tx.ticker_in(F.col("title")).alias("ticker_found"))


@query("SELECT * FROM (VALUES (1, 1.0, TRUE, ''), (2, 0.5, TRUE, '99'), (3, 0.0, FALSE, ''), (4, 1.0, TRUE, '')) AS x(id, mentioned, covers, ungrounded)")
def rationale_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "Phát thải giảm 12%", "phat thai", "giảm 12% năm 2023"), (2, "phát 99", "phát thải", "12"), (3, None, "abc def", None), (4, "gì đó", None, None)]
    own = review.rationale_checks(spark.createDataFrame(rows, "id int, rationale string, must_mention string, evidence string"))
    return own.select("id", F.col("mentioned").cast("double").alias("mentioned"), "covers", F.array_join("ungrounded", ",").alias("ungrounded"))


@query("SELECT 4::BIGINT AS n_claims, 0.75 AS claim_recall, round(2 / 3, 9) AS status_accuracy, round(1 / 3, 9) AS citation_coverage")
def golden_set(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("a", "k1", "SUPPORTED"), ("a", "k2", "CONTRADICTED"), ("b", "k1", "SUPPORTED"), ("b", "k9", "SUPPORTED")], "case_id string, claim_key string, status string")
    got = spark.createDataFrame([("a", "k1", "SUPPORTED", ["p1"]), ("a", "k2", "SUPPORTED", None), ("b", "k1", "SUPPORTED", []), ("c", "k1", "SUPPORTED", ["p"])], "case_id string, claim_key string, status string, citations array<string>")
    one = review.golden_measures(want, got)
    return one.select("n_claims", *(F.round(c, 9).alias(c) for c in one.columns[1:]))


@query(
    f"""WITH a AS (SELECT k, min({{'d': document_type, 's': status}}) AS a FROM (SELECT {match_sql('title')} AS k, document_type, status FROM crawl_documents WHERE batch_no <= 6 AND title IS NOT NULL) GROUP BY k), b AS (SELECT k, min({{'d': document_type, 's': status}}) AS b FROM (SELECT {match_sql('title')} AS k, document_type, status FROM crawl_documents WHERE batch_no > 6 AND title IS NOT NULL) GROUP BY k)
SELECT k AS key, CASE WHEN a IS NULL THEN 'after' WHEN b IS NULL THEN 'before' ELSE 'both' END AS place FROM a FULL JOIN b USING (k)"""
)
def run_audit(spark: SparkSession, d: str) -> DataFrame:
    """Titles of earlier batches against those of later ones."""
    own = table(spark, d, "crawl_documents").where("title is not null")
    return review.run_audit(own.where("batch_no <= 6"), own.where("batch_no > 6"), tx.match_form(F.col("title")), ["document_type", "status"]).select("key", "place")


@query("SELECT c.crawl_id, CASE WHEN l.company_id IS NULL THEN 'no_company' WHEN c.extension IS NULL THEN 'no_extension' END AS problem FROM (SELECT DISTINCT crawl_id, company_id, extension FROM crawl_documents) c LEFT JOIN (SELECT DISTINCT company_id FROM candidates WHERE company_id IS NOT NULL) l USING (company_id) WHERE l.company_id IS NULL OR c.extension IS NULL")
def pack_problems(spark: SparkSession, d: str) -> DataFrame:
    """Records whose company no candidate names, or that have no extension."""
    own = table(spark, d, "crawl_documents").select("crawl_id", "company_id", "extension").distinct()
    known = table(spark, d, "candidates").where("company_id is not null").select("company_id").distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("known").isNull(), "no_company").when(F.col("extension").isNull(), "no_extension")
    return own.join(known, "company_id", "left").select("crawl_id", problem.alias("problem")).where("problem is not null")


@query("SELECT crawl_id, batch_no FROM crawl_documents WHERE downloaded_at IS NOT NULL ORDER BY downloaded_at DESC, crawl_id LIMIT 20")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The 20 newest records: the listing is the feature."""
    own = table(spark, d, "crawl_documents").select(F.col("crawl_id").alias("run_id"), "batch_no", F.col("downloaded_at").alias("created_at"))
    return review.listed_runs(own, 20).select(F.col("run_id").alias("crawl_id"), "batch_no")


# --- streams --------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS total, time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '2024-01-01') AS window_start FROM events GROUP BY event_type, window_start")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windowed counts of the events read as a stream, all files that are there in one go."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    where = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the whole result of each trigger takes the place of the one before
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{where}/result")
    query = streams.windowed_counts(stream).writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{where}/result")
    return out.select("event_type", "n_events", "total", F.col("window_start").cast("timestamp_ntz").alias("window_start"))
