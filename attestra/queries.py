"""Queries of the core operators, by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra import runtime
from attestra.functions import address, numbers
from attestra.functions import text as tx
from attestra.operators import corpus, edits, evaluate, figures, lexicon, passages, quantities, ranking, records, retrieval, temporal, units
from attestra.plans import evidence
from attestra.runtime import cut
from attestra.sources import readers


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return runtime.spread(runtime.table(spark, d, name))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"\b(\w+) -> ", r"lambda \1: ", sql)
        return f

    return register


# --- quantities in different units ----------------------------------------------------------------


@query()
def p3_amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.amounts(runtime.table(spark, d, "ir_figures"), runtime.table(spark, d, "numeric_facts"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_amounts(p3_amounts(spark, d))


# --- SQL shared by several queries ----------------------------------------------------------------

SQ = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\x{{A0}}', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g'), ' '||chr(10)||chr(13)||chr(9)||chr(11)||chr(12))"


def sq(x: str) -> str:
    return SQ.format(x=x)


_NARROW = tx.NARROW.replace("'", "''")


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"


def match_sql(x: str) -> str:
    """The matching form as the survey has it: plain forms, blanks, lower case, accents off, đ as d."""
    return "replace(lower(strip_accents(" + sq(f"translate({x}, '{tx.WIDE}', '{_NARROW}')") + ")), 'đ', 'd')"


_SENTENCES = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace("
    + sq("text")
    + r", '([a-zà-ỹ0-9,%)\]])[ \t]*\n+[ \t]*([a-zà-ỹ])', '\1 \2', 'g'), '([.!?;])\s+', '\1'||chr(1), 'g'), '\x01|\n+'), p -> regexp_replace(p, '^[ •\t]+|[ •\t]+$', '', 'g')), p -> length(p) >= @LEAST@)"
)


def sentences_sql(least: int) -> str:
    return _SENTENCES.replace("@LEAST@", str(least))




def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all({match_sql(x)}, '{tx.TOKEN}'), t -> length(t) > 1)"


STOP = "[" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
CONTENT = f"regexp_extract_all(lower(nfc_normalize(translate(text, '{tx.WIDE}', '{_NARROW}'))), " + r"'[\p{L}\p{N}_%]+')"

# --- sentences, passages, tokens ------------------------------------------------------------------


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, list_sum(list_transform(s, x -> length(x)))::BIGINT AS n_chars FROM (SELECT doc_id, {sentences_sql(12)} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = tx.split_sentences(F.col("text"))
    own = table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.when(F.size("s") > 0, total).alias("n_chars"))


@query(f"SELECT doc_id, (i - 1)::INT AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {sentences_sql(12)} AS s FROM documents WHERE text IS NOT NULL))")
def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return passages.sentences(table(spark, d, "documents"))


@query()
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "documents"))


@query()
def overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(passages.overlapping_chunks(F.col("text"))).alias("chunk_no", "text"))


@query(
    f"WITH s AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, s FROM (SELECT doc_id, {sentences_sql(20)} AS s FROM documents WHERE text IS NOT NULL)), "
    "c AS (SELECT doc_id, i, s[i] AS text, lower(s[i]) AS low FROM s), "
    "k AS (SELECT doc_id, i::INT AS sentence_index, 'claim' AS kind, regexp_matches(low, '[0-9]') AS has_number, text FROM c WHERE "
    + " OR ".join(f"contains(low, '{t}')" for t in passages.CLAIM_TERMS)
    + " UNION ALL SELECT doc_id, i::INT, 'evidence', TRUE, text FROM c WHERE regexp_matches(low, '[0-9]') AND ("
    + " OR ".join(f"contains(low, '{t}')" for t in passages.EVIDENCE_TERMS)
    + ")) SELECT * FROM k"
)
def claim_evidence_candidates(spark: SparkSession, d: str) -> DataFrame:
    return passages.candidates(table(spark, d, "documents"))


@query(f"SELECT candidate_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_types FROM (SELECT candidate_id, {tokens_sql('text')} AS t FROM candidates WHERE text IS NOT NULL)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", tx.tokens(F.col("text")).alias("t"))
    return own.select("candidate_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query(
    f"SELECT candidate_id, array_to_string(list_sort(list_distinct(list_filter({CONTENT}, t -> length(t) > 1 AND NOT regexp_full_match(t, '(?:19|20)[0-9]{{2}}') AND NOT list_contains({STOP}, t)))), ' ') AS content FROM candidates WHERE text IS NOT NULL"
)
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null")
    return own.select("candidate_id", F.array_join(F.array_sort(tx.content_tokens(F.col("text"))), " ").alias("content"))


@query(
    f"SELECT candidate_id, len(list_distinct(list_filter(list_transform(range(1, len(t)), i -> {{'a': t[i], 'b': t[i + 1]}}), p -> NOT (list_contains({STOP}, p.a) AND list_contains({STOP}, p.b)) AND NOT regexp_full_match(p.a, '(?:19|20)[0-9]{{2}}') AND NOT regexp_full_match(p.b, '(?:19|20)[0-9]{{2}}'))))::BIGINT AS n_bigrams FROM (SELECT candidate_id, {CONTENT} AS t FROM candidates WHERE text IS NOT NULL)"
)
def content_bigrams(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null")
    return own.select("candidate_id", F.size(tx.content_bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


@query(f"SELECT doc_id, md5({match_sql('text')}) AS folded FROM documents WHERE text IS NOT NULL")
def match_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.match_form(F.col("text"))).alias("folded"))


@query()
def match_form_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.match_form_exact(F.col("text"))).alias("folded"))


@query("SELECT candidate_id, chunk_id, left(sha256(concat_ws('||', document_id, unit_type, unit_index::VARCHAR)), 16) AS stable_id FROM candidates")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_id", "chunk_id", tx.stable_id(F.col("document_id"), F.col("unit_type"), F.col("unit_index").cast("string")).alias("stable_id"))


@query(r"SELECT doc_id, y[1] AS first_year, y[-1] AS last_year, len(y)::BIGINT AS n_years FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:19|20)\d{2}\b') AS y FROM documents WHERE text IS NOT NULL)")
def year_mentions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("text is not null")
    return own.select("doc_id", tx.first_year(F.col("text")).alias("first_year"), tx.last_year(F.col("text")).alias("last_year"), F.size(tx.years(F.col("text"))).cast("long").alias("n_years"))


HEADING_SQL = f"""
CASE WHEN regexp_matches(t, '{tx.CONTENTS_DOTS}') THEN 'table_of_contents'
 WHEN regexp_matches(t, '{tx.INDEX_CODE}') OR regexp_matches({match_sql('t')}, '{tx.UNIT_FIRST}') THEN 'table_row'
 WHEN contains(t, ' | ') OR regexp_matches(t, '{tx.ITEM_LABEL}') OR regexp_matches(t, '{tx.NUMBERED_CAPITALS}') THEN 'section_label'
 WHEN regexp_matches(t, '{tx.CAPITALS_RUN}') THEN 'caps_run'
 WHEN regexp_matches(t, '{tx.PAGE_LAST}') AND w < 10 AND NOT regexp_matches(lower(t), '{tx.MEASURED}') THEN 'table_of_contents'
 WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 3 AND length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) >= length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) * 0.7 THEN 'all_caps'
 WHEN w < 6 AND NOT regexp_matches(t, '\\d') THEN 'too_short'
 WHEN f <> '' AND regexp_matches(f, '^\\p{{Ll}}') AND w < 15 THEN 'fragment'
 WHEN NOT CASE WHEN {fold_sql('t')} <> lower(t) THEN regexp_matches(lower(t), '{tx.whole_words(tx.PREDICATES_VI)}') ELSE regexp_matches(lower(t), '{tx.whole_words(tx.PREDICATES_EN)}') END THEN 'no_predicate' END"""


@query(
    r"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents WHERE text IS NOT NULL), "
    r"x AS (SELECT doc_id, t, len(regexp_extract_all(t, '\p{L}+')) AS w, regexp_extract(t, '(\p{L})', 1) AS f FROM (SELECT doc_id, trim(line) AS t FROM l) WHERE t <> '') "
    f"SELECT doc_id, coalesce({HEADING_SQL}, 'statement') AS reason, count(*) AS n FROM x GROUP BY ALL"
)
def heading_reasons(spark: SparkSession, d: str) -> DataFrame:
    own = passages.lines(table(spark, d, "documents").where("text is not null")).where(F.trim("line") != "")
    reason = F.coalesce(tx.heading_reason(F.col("line")), F.lit("statement"))
    return own.groupBy("doc_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(r"SELECT unit_id, len(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), l -> contains(l, ' | ')))::BIGINT AS n_table_rows FROM units WHERE text IS NOT NULL")
def pipe_table_rows(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "units").where("text is not null")
    return own.select("unit_id", F.size(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.contains(x, F.lit(" | ")))).cast("long").alias("n_table_rows"))


@query(
    r"WITH l AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM documents WHERE text IS NOT NULL)), "
    r"c AS (SELECT doc_id, (i - 1)::INT AS line_no, list_transform(regexp_split_to_array(s[i], '\|'), x -> trim(x)) AS c FROM l WHERE contains(s[i], ' | ')), "
    "x AS (SELECT doc_id, line_no, c, unnest(range(1, len(c) + 1)) AS j FROM c) SELECT doc_id, line_no, (j - 1)::INT AS col_no, c[1] AS label, c[j] AS value FROM x WHERE j > 1 AND c[j] <> ''"
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return passages.table_cells(table(spark, d, "documents")).select("doc_id", "line_no", "col_no", "label", "value")


@query(r"SELECT doc_id, (i - 1)::INT AS line_no, CASE WHEN regexp_matches(s[i], '(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*\S{6,}') THEN 'credential' WHEN regexp_matches(s[i], '[\w.+-]+@[\w-]+\.[\w.]+') THEN 'email' WHEN regexp_matches(s[i], '\+84[\s\d.]{6,}') THEN 'phone' ELSE 'number' END AS kind FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(s[i], '[0-9]')")
def pattern_lines(spark: SparkSession, d: str) -> DataFrame:
    own = passages.lines(table(spark, d, "documents").where("text is not null")).where(F.col("line").rlike("[0-9]"))
    return own.select("doc_id", "line_no", F.coalesce(tx.secret_kind(F.col("line")), F.lit("number")).alias("kind"))


@query("SELECT doc_id, " + " OR ".join(f"contains({match_sql('text')}, '{p}')" for p in tx.INJECTIONS) + " AS injected FROM documents WHERE text IS NOT NULL")
def injection_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.injected(F.col("text")).alias("injected"))


@query(
    "SELECT candidate_id, sentence_index, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM (SELECT DISTINCT candidate_id, chunk_id, sentence_index, text FROM candidates) WINDOW w AS (PARTITION BY chunk_id ORDER BY sentence_index, candidate_id, text)"
)
def neighbour_sentences(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").select("candidate_id", "chunk_id", "sentence_index", "text").distinct()
    return passages.neighbours(own, ["chunk_id"], ["sentence_index", "candidate_id", "text"]).drop("chunk_id")


@query(
    r"WITH l AS (SELECT doc_id, i::INT - 1 AS line_no, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM documents WHERE text IS NOT NULL))) "
    r"SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^\d+(\.\d+)*\s+\p{Lu}{2,}') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS context FROM l"
)
def heading_context(spark: SparkSession, d: str) -> DataFrame:
    own = passages.lines(table(spark, d, "documents").where("text is not null"))
    marker = F.when(F.col("line").rlike(r"^\d+(\.\d+)*\s+\p{Lu}{2,}"), F.col("line"))
    return passages.with_context(own, ["doc_id"], "line_no", marker).select("doc_id", "line_no", "context")


# --- lexicons -------------------------------------------------------------------------------------

TYPES = [
    lexicon.Bucket("energy", ("dien nang", "nang luong", "electricity", "solar", "fuel", "nhien lieu"), 2),
    lexicon.Bucket("emissions", ("phat thai", "khi nha kinh", "greenhouse", "exhaust", "khi thai"), 3),
    lexicon.Bucket("waste", ("chat thai", "bun thai", "waste", "residue", "scrap", "phe pham"), 2),
    lexicon.Bucket("water", ("nuoc", "water", "effluent"), 1),
]
LANGUAGES = {"vi": ("nam", "va", "cua", "tai", "theo", "voi"), "en": ("the", "and", "of", "with", "for", "in")}


def _hits_sql(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{t}')::INT" for t in terms) + ")"


BEST_SQL = "list_max(list_filter([" + ", ".join(f"{{'hits': {_hits_sql('m', b.terms)}, 'priority': {b.priority}, 'name': '{b.name}'}}" for b in TYPES) + "], s -> s.hits > 0)).name"


@query(f"SELECT candidate_id, {BEST_SQL} AS claim_type FROM (SELECT candidate_id, {match_sql('text')} AS m FROM candidates WHERE text IS NOT NULL)")
def lexicon_claim_type(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", tx.match_form(F.col("text")).alias("m"))
    return own.select("candidate_id", lexicon.best_bucket(F.col("m"), TYPES).alias("claim_type"))


@query(
    f"SELECT candidate_id, CASE WHEN greatest(v, e) = 0 THEN 'unknown' WHEN v >= e THEN 'vi' ELSE 'en' END AS language FROM (SELECT candidate_id, {_hits_sql('m', LANGUAGES['vi'])} AS v, {_hits_sql('m', LANGUAGES['en'])} AS e FROM (SELECT candidate_id, {match_sql('text')} AS m FROM candidates WHERE text IS NOT NULL))"
)
def lexicon_language(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", tx.match_form(F.col("text")).alias("m"))
    return own.select("candidate_id", lexicon.vote_language(F.col("m"), LANGUAGES).alias("language"))


@query("SELECT candidate_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(m, '{t}')" for t in b.terms) + f" THEN '{b.name}'" for b in TYPES) + f" END AS bucket FROM (SELECT candidate_id, {match_sql('text')} AS m FROM candidates WHERE text IS NOT NULL)")
def lexicon_first_bucket(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", tx.match_form(F.col("text")).alias("m"))
    return own.select("candidate_id", lexicon.first_bucket(F.col("m"), TYPES).alias("bucket"))


VERBS, NAVIGATION, CUES = ("đã", "được", "sẽ", "is ", "was ", "were ", "has "), ("home", "contact", "search", "login", "trang chủ"), ("cam kết", "mục tiêu", "target", "pledge", "expects")
RATIO_SQL = "(CASE WHEN len(w) > 0 THEN len(list_filter(w, t -> left(t, 1) <> lower(left(t, 1)))) / len(w) ELSE 0.0 END)"


@query(
    r"WITH x AS (SELECT candidate_id, text, lower(trim(text)) AS low, list_filter(regexp_extract_all(text, '[A-Za-zÀ-ỹ]+'), t -> length(t) > 2) AS w FROM candidates WHERE text IS NOT NULL) "
    "SELECT candidate_id, concat_ws(',', CASE WHEN length(trim(text)) < 40 THEN 'too_short' END, "
    f"CASE WHEN {_hits_sql('low', NAVIGATION)} >= 3 OR ({_hits_sql('low', NAVIGATION)} >= 2 AND {RATIO_SQL} > 0.45) THEN 'navigation_menu' END, "
    f"CASE WHEN NOT ({' OR '.join(f'contains(low, {v!r})' for v in VERBS)}) THEN 'no_predicate' END, "
    f"CASE WHEN {RATIO_SQL} > 0.6 AND NOT contains(left(text, length(text) - 1), '.') THEN 'title_case_fragment' END, "
    r"CASE WHEN len(list_distinct(regexp_extract_all(low, '[\p{L}\p{N}_%]+'))) < 6 THEN 'too_few_unique_tokens' END) AS reasons FROM x"
)
def boilerplate_reasons(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null")
    return own.select("candidate_id", F.array_join(lexicon.boilerplate_reasons(F.col("text"), VERBS, NAVIGATION), ",").alias("reasons"))


@query(
    f"SELECT candidate_id, (CASE WHEN has_number THEN 2.0 ELSE 0.0 END + least({_hits_sql('low', CUES)}, 3) * 1.0 + CASE WHEN regexp_matches(low, "
    r"'\d+([.,]\d+)?\s*(%|tco2e|co2e|mwh|gwh|tấn|kwh)') THEN 1.5 ELSE 0.0 END + CASE WHEN regexp_matches(low, '\b20\d{2}\b') THEN 1.0 ELSE 0.0 END - CASE WHEN length(text) > 1200 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM (SELECT *, lower(text) AS low FROM candidates WHERE text IS NOT NULL)"
)
def informativeness(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null")
    return own.select("candidate_id", lexicon.informativeness(F.col("text"), F.col("has_number"), CUES).alias("score"))


# --- numbers and addresses ------------------------------------------------------------------------

NUMBER_SQL = r"""CASE WHEN regexp_matches(t, '^\d[\d.,]*$') THEN TRY_CAST(CASE WHEN d > 0 AND c > 0 THEN CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
 WHEN d > 1 OR regexp_matches(t, '^\d{1,3}\.\d{3}$') THEN replace(t, '.', '') WHEN c > 1 OR regexp_matches(t, '^\d{2,3},\d{3}$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS DOUBLE) END"""
DECIMALS_SQL = r"""CASE WHEN d > 0 AND c > 0 THEN CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN length(split_part(t, ',', -1)) ELSE length(split_part(t, '.', -1)) END
 WHEN c = 1 AND NOT regexp_matches(t, '^\d{1,3},\d{3}$') THEN length(split_part(t, ',', -1)) WHEN d = 1 AND NOT regexp_matches(t, '^\d{1,3}\.\d{3}$') THEN length(split_part(t, '.', -1)) ELSE 0 END"""
T_SQL = r"(SELECT *, length(t) - length(replace(t, '.', '')) AS d, length(t) - length(replace(t, ',', '')) AS c FROM (SELECT *, regexp_replace(trim(value_text), '[.,]+$', '') AS t FROM ir_figures WHERE value_text IS NOT NULL))"


@query(
    f"SELECT quantity_id, value, CASE WHEN regexp_matches(t, '^\\d[\\d.,]*$') THEN 0.5 * power(10.0, CASE WHEN dec > 0 THEN -dec ELSE z END) END AS half FROM (SELECT quantity_id, t, {NUMBER_SQL} AS value, {DECIMALS_SQL} AS dec, length(regexp_replace(t, '[.,]', '', 'g')) - length(regexp_replace(regexp_replace(t, '[.,]', '', 'g'), '0+$', '')) AS z FROM {T_SQL})"
)
def locale_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "ir_figures").where("value_text is not null")
    return own.select("quantity_id", numbers.locale_number(F.col("value_text")).alias("value"), numbers.half_unit(F.col("value_text")).alias("half"))


@query(
    r"WITH a AS (SELECT quantity_id, regexp_replace(value_text, '[\s\x{A0}]', '', 'g') AS t FROM ir_figures WHERE value_text IS NOT NULL), "
    r"b AS (SELECT *, length(t) - length(replace(t, '.', '')) AS d, length(t) - length(replace(t, ',', '')) AS c, regexp_replace(t, '[.,]', '', 'g') AS w FROM a WHERE regexp_matches(t, '^[\d.,]*\d[\d.,]*$')), "
    r"e AS (SELECT *, CASE WHEN d > 0 AND c > 0 THEN CASE WHEN instr(reverse(t), ',') < instr(reverse(t), '.') THEN split_part(t, ',', -1) ELSE split_part(t, '.', -1) END WHEN d + c = 1 AND NOT regexp_matches(t, '[.,]\d{3}$') THEN regexp_extract(t, '[.,](\d*)$', 1) ELSE '' END AS tail FROM b) "
    "SELECT quantity_id, TRY_CAST((CASE WHEN length(w) = length(tail) THEN '0' ELSE left(w, length(w) - length(tail)) END) || '.' || (CASE WHEN tail = '' THEN '0' ELSE tail END) AS DOUBLE) AS value, 0.5 * power(10.0, -length(tail)) AS half FROM e"
)
def figure_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "ir_figures").where("value_text is not null").select("quantity_id", numbers.figure_number(F.col("value_text")).alias("x"))
    return own.where("x is not null").select("quantity_id", "x.value", "x.half")


URL_RE = address.PARTS


@query(
    f"WITH p AS (SELECT crawl_id, url, lower(regexp_extract(url, '{URL_RE}', 1)) AS s, regexp_extract(url, '{URL_RE}', 2) AS h, regexp_extract(url, '{URL_RE}', 3) AS p, array_to_string(list_filter(string_split(regexp_extract(url, '{URL_RE}', 4), '&'), x -> x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term')), '&') AS q FROM crawl_documents WHERE url IS NOT NULL) "
    "SELECT crawl_id, s || '://' || lower(h) || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical, nullif(regexp_replace(regexp_replace(lower(h), '^[^@]*@', ''), ':\\d*$', ''), '') AS host, CASE WHEN regexp_extract(p, '([^/]*)/?$', 1) = '' THEN 'document' ELSE regexp_extract(p, '([^/]*)/?$', 1) END AS filename FROM p"
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("url is not null")
    u = F.col("url")
    return own.select("crawl_id", address.canonical_url(u).alias("canonical"), address.host(u).alias("host"), address.filename(u).alias("filename"))


# --- retrieval ------------------------------------------------------------------------------------


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_claims").select(F.col("item_id").alias("query_id"), "text")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_cache").select(F.col("cache_id").alias("doc_id"), "text")


def _bm25_sql(corpus: str, key: str) -> str:
    return f"""WITH docs AS (SELECT {key} AS doc_id, {tokens_sql("coalesce(text, '')")} AS t FROM {corpus}),
stat AS (SELECT count(*) AS n, greatest(1.0, avg(len(t))) AS av FROM docs),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens_sql("text")})) AS term FROM gold_claims),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))) AS s FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN stat GROUP BY ALL)
SELECT query_id, doc_id, s / (s + 3.0) AS score FROM s"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM ({_bm25_sql('documents', 'doc_id')}) QUALIFY rank <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieval.bm25(table(spark, d, "documents"), _claims(spark, d)).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 5)


@query()
def passages_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best passages of all documents for each held-out claim."""
    own = passages.passages(table(spark, d, "documents")).select(F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("block").cast("string"), 6, "0")).alias("doc_id"), "text")
    return ranking.bm25_top(own, _claims(spark, d), 5, 6)


def _grams_sql(x: str) -> str:
    w = f"list_transform(list_filter(regexp_split_to_array(lower({x}), '\\s+'), w -> w <> ''), w -> ' ' || w || ' ')"
    parts = [f"CASE WHEN length(w) > {n} THEN list_transform(range(1, length(w) - {n} + 2), i -> substring(w, i, {n})) " + (f"WHEN length(w) > {n - 1} THEN [w] ELSE [] END" if n > 3 else "ELSE [w] END") for n in (3, 4, 5)]
    return f"flatten(list_transform({w}, w -> flatten([{', '.join(parts)}])))"


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT cache_id AS doc_id, unnest({_grams_sql("coalesce(text, '')")}) AS term FROM text_cache) GROUP BY ALL),
df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM text_cache)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_grams_sql("text")}) AS term FROM gold_claims) GROUP BY ALL),
q AS (SELECT query_id, term, tf * idf AS v FROM qt JOIN df USING (term)), nq AS (SELECT query_id, sqrt(sum(v * v)) AS qnorm FROM q GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(w * v) AS dot FROM w JOIN q USING (term) GROUP BY ALL)
SELECT query_id, doc_id, round(dot / norm / qnorm, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / norm / qnorm, 6) DESC, doc_id)::INT AS rank FROM s JOIN nd USING (doc_id) JOIN nq USING (query_id) QUALIFY rank <= 5""")
def tfidf_char_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tfidf_top(_cache(spark, d), _claims(spark, d), 5, 6)


JACCARD_SQL = f"""SELECT query_id, doc_id, count(*) / (any_value(n) + any_value(m) - count(*)) AS score FROM
(SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT cache_id AS doc_id, list_distinct({tokens_sql("coalesce(text, '')")}) AS t FROM text_cache)) JOIN
(SELECT query_id, len(t) AS m, unnest(t) AS term FROM (SELECT item_id AS query_id, list_distinct({tokens_sql("text")}) AS t FROM gold_claims)) USING (term) GROUP BY query_id, doc_id"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM ({JACCARD_SQL}) QUALIFY rank <= 5")
def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.jaccard_top(_cache(spark, d), _claims(spark, d), 5, 6)


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, x -> x::DOUBLE) AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS doc_id, list_transform(embedding, x -> x::DOUBLE) AS v FROM embeddings)
SELECT query_id, doc_id, round(list_cosine_similarity(v, q), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, q), 6) DESC, doc_id)::INT AS rank FROM v JOIN q ON doc_id <> query_id QUALIFY rank <= 10""")
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(retrieval.dense_cosine(v, q, 15).drop("rank").withColumn("score", F.round("score", 6)), 10)


RRF_SQL = f"""SELECT *, 1 / (60 + lexical_rank) + 1 / (60 + semantic_rank) AS rrf FROM (SELECT query_id, doc_id, lexical, semantic, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS lexical_rank, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, doc_id) AS semantic_rank FROM
(SELECT query_id, doc_id, round(score, 6) AS lexical FROM ({_bm25_sql("text_cache", "cache_id")})) JOIN (SELECT query_id, doc_id, round(score, 6) AS semantic FROM ({JACCARD_SQL})) USING (query_id, doc_id))"""


@query(f"SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id)::INT AS rank FROM ({RRF_SQL})) WHERE rank <= 10")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.token_fusion(_cache(spark, d), _claims(spark, d), 10, 6).select("query_id", "doc_id", "rank")


@query(f"""WITH r AS (SELECT query_id, doc_id, lexical AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM ({RRF_SQL}) QUALIFY rank <= 30),
m AS (SELECT *, score >= 0.93 AS passing, count(*) FILTER (score >= 0.93) OVER (PARTITION BY query_id) AS np FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, passing ORDER BY rank) AS place FROM m)
SELECT query_id, doc_id, rank::INT AS rank, NOT passing AS below_threshold FROM p WHERE passing OR place <= 3 - np""")
def admissible_floor(spark: SparkSession, d: str) -> DataFrame:
    """Of the 30 passages that fused ranking puts first those that reach the threshold, and what fills up to three."""
    ranked = ranking.token_fusion(_cache(spark, d), _claims(spark, d), 30, 6).withColumnRenamed("lexical", "score")
    return retrieval.admissible(ranked, 0.93, 3).select("query_id", "doc_id", "rank", "below_threshold")


PAIR_SQL = f"""WITH c AS (SELECT item_id, company_id, list_distinct({tokens_sql("text")}) AS q FROM gold_claims), e AS (SELECT DISTINCT candidate_id, company_id, text FROM candidates WHERE candidate_type = 'evidence' AND text IS NOT NULL),
t AS (SELECT candidate_id, company_id, list_distinct({tokens_sql("text")}) AS t FROM e)
SELECT item_id, candidate_id, len(list_intersect(q, t))::INT AS shared, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(q, t)) DESC, candidate_id)::INT AS rank FROM c JOIN t USING (company_id) QUALIFY rank <= 5"""


@query(PAIR_SQL)
def pair_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five evidence sentences of a claim's company that share most tokens with it: stated queries against all rows."""
    c = table(spark, d, "gold_claims").select(F.col("item_id").alias("query_id"), "company_id", F.array_distinct(tx.tokens(F.col("text"))).alias("q"))
    e = table(spark, d, "candidates").where("candidate_type = 'evidence' and text is not null").select("candidate_id", "company_id", "text").distinct()
    e = e.select(F.col("candidate_id").alias("doc_id"), "company_id", F.array_distinct(tx.tokens(F.col("text"))).alias("t"))
    small = F.broadcast(c) if c.count() <= 100_000 else c
    scored = e.join(small, "company_id").select("query_id", "doc_id", F.size(F.array_intersect("q", "t")).alias("score"))
    return retrieval.top_k(scored, 5).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("candidate_id"), F.col("score").alias("shared"), "rank")


# --- records --------------------------------------------------------------------------------------


@query("SELECT any_value(md5(lower(trim(text)))) AS text_hash, min(candidate_id) AS first_id, count(*) AS n FROM candidates WHERE text IS NOT NULL GROUP BY lower(trim(text))")
def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select(F.md5(F.lower(F.trim("text"))).alias("text_hash"), "candidate_id")
    return own.groupBy("text_hash").agg(F.min("candidate_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT crawl_id, document_id, title FROM crawl_documents WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(title)), company_id ORDER BY batch_no, crawl_id) = 1")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("title is not null").select("crawl_id", "document_id", "title", "batch_no", "company_id")
    key = F.struct(F.lower(F.trim("title")), "company_id")
    return records.first_occurrence(own, key, ["batch_no", "crawl_id"]).select("crawl_id", "document_id", "title")


@query("SELECT sha256, arg_min(crawl_id, a * 1e15 + crawl_id) AS canonical_id, count(*) AS n FROM (SELECT *, CASE source_authority WHEN 'government' THEN 0 WHEN 'regulated_disclosure' THEN 1 WHEN 'company' THEN 2 ELSE 3 END AS a FROM crawl_documents WHERE sha256 IS NOT NULL) GROUP BY sha256")
def canonical_source(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("source_authority") == "government", 0).when(F.col("source_authority") == "regulated_disclosure", 1).when(F.col("source_authority") == "company", 2).otherwise(3)
    own = table(spark, d, "crawl_documents").select("sha256", "crawl_id", rank.alias("a"))
    return records.canonical(own, "sha256", "crawl_id", [F.col("a"), F.col("crawl_id")])


UPSERT_COLS = ("status", "title", "document_type")


@query(
    "WITH o AS (SELECT url, status, title, document_type FROM crawl_documents WHERE url IS NOT NULL AND batch_no <= 6 QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_id DESC) = 1), "
    "n AS (SELECT url, status, title, document_type FROM crawl_documents WHERE url IS NOT NULL AND batch_no > 6 QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_id DESC) = 1) "
    "SELECT coalesce(o.url, n.url) AS url, coalesce(n.status, o.status) AS status, coalesce(n.title, o.title) AS title, coalesce(CASE WHEN o.document_type <> 'other' THEN o.document_type END, n.document_type, o.document_type) AS document_type FROM o FULL JOIN n ON o.url = n.url"
)
def crawl_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_documents").where("url is not null").select("url", *UPSERT_COLS, "crawl_id", "batch_no")
    last = lambda x: records.latest(x, ["url"], ["crawl_id"], list(UPSERT_COLS)).drop("n_entries")
    return records.upsert(last(rows.where("batch_no <= 6")), last(rows.where("batch_no > 6")), "url", {"document_type": "other"})


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def log_latest_state(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return records.latest(own, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]).drop("n_entries")


@query("SELECT previous, event_type, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type FROM events) GROUP BY ALL")
def log_transitions(spark: SparkSession, d: str) -> DataFrame:
    own = records.transitions(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return own.groupBy("previous", "event_type").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, place::INT AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('s:' || doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 20")
def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return records.capped_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 20)


@query("SELECT company_id, doc_id, row_number() OVER (ORDER BY place, company_id NULLS FIRST, doc_id)::INT AS pick FROM (SELECT company_id, doc_id, row_number() OVER (PARTITION BY company_id ORDER BY md5('s:' || doc_id::VARCHAR), doc_id) AS place FROM documents) QUALIFY pick <= 200")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return records.round_robin(table(spark, d, "documents").select("company_id", "doc_id"), "company_id", "doc_id", 200).select("company_id", "doc_id", "pick")


@query("SELECT crawl_id, CASE WHEN publication_year IN (2021, 2022) THEN 'train' WHEN publication_year = 2023 THEN 'dev' WHEN publication_year = 2024 THEN 'test' WHEN publication_year = 2025 THEN 'future_holdout' ELSE 'review' END AS split FROM crawl_documents")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_documents").select("crawl_id", records.year_split(F.col("publication_year")).alias("split"))


@query("SELECT crawl_id, CASE WHEN h < 800 THEN 'train' WHEN h < 900 THEN 'validation' ELSE 'test' END AS split FROM (SELECT crawl_id, ('0x' || left(md5(company_id), 8))::BIGINT % 1000 AS h FROM crawl_documents WHERE company_id IS NOT NULL)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("company_id is not null")
    return own.select("crawl_id", records.hash_split(F.col("company_id")).alias("split"))


@query("SELECT company_id AS leak_key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT split) AS n_splits FROM candidates WHERE company_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    return records.leakage(table(spark, d, "candidates"), F.col("company_id"), "split")


KINDS = {"annual": ("annual_report",), "sustainability": ("sustainability_report",), "financial": ("financial_statement",), "assurance": ("assurance_statement",)}


@query(
    "WITH h AS (SELECT company_id, publication_year, " + ", ".join(f"max((document_type = '{v[0]}')::INT) AS {k}" for k, v in KINDS.items()) + " FROM crawl_documents WHERE company_id IS NOT NULL GROUP BY ALL), "
    "g AS (SELECT company_id, y::INT AS publication_year FROM (SELECT DISTINCT company_id FROM crawl_documents WHERE company_id IS NOT NULL), range(2021, 2026) AS r(y)), "
    "x AS (SELECT g.company_id, g.publication_year, " + ", ".join(f"coalesce({k}, 0)::INT AS {k}" for k in KINDS) + " FROM g LEFT JOIN h ON g.company_id = h.company_id AND g.publication_year = h.publication_year) "
    "SELECT *, round((" + " + ".join(KINDS) + ") / 4 * 100, 1) AS score_pct, concat_ws(';', " + ", ".join(f"CASE WHEN {k} = 0 THEN '{k}' END" for k in KINDS) + ") AS missing FROM x"
)
def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    return records.coverage(table(spark, d, "crawl_documents"), "company_id", "publication_year", "document_type", KINDS, 2021, 2025)


CONTRACT = ("document_id", "company_id", "ticker", "final_url", "sha256", "publication_year", "downloaded_at", "error_code")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS n_null, count(*) AS n_rows FROM crawl_documents" for c in CONTRACT))
def contract_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return records.null_counts(table(spark, d, "crawl_documents"), list(CONTRACT))


@query("SELECT crawl_id, concat_ws(',', CASE WHEN NOT coalesce(status IN ('downloaded', 'failed', 'discovered', 'skipped'), FALSE) THEN 'status' END, CASE WHEN NOT coalesce(publication_year BETWEEN 1990 AND 2030, FALSE) THEN 'year' END, CASE WHEN NOT coalesce(status <> 'downloaded' OR sha256 IS NOT NULL, FALSE) THEN 'hash' END, CASE WHEN NOT coalesce(discovered_at <= downloaded_at, FALSE) THEN 'times' END) AS problems FROM crawl_documents")
def contract_invalid(spark: SparkSession, d: str) -> DataFrame:
    checks = {
        "status": F.col("status").isin("downloaded", "failed", "discovered", "skipped"), "year": F.col("publication_year").between(1990, 2030),
        "hash": (F.col("status") != "downloaded") | F.col("sha256").isNotNull(), "times": F.col("discovered_at") <= F.col("downloaded_at"),
    }
    return table(spark, d, "crawl_documents").select("crawl_id", F.array_join(records.problems(checks), ",").alias("problems"))


@query("SELECT DISTINCT candidate_id, document_id FROM candidates WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM crawl_documents WHERE status = 'downloaded' AND document_id IS NOT NULL)")
def dangling_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "crawl_documents").where("status = 'downloaded'")
    return records.dangling(table(spark, d, "candidates").select("candidate_id", "document_id"), "document_id", got, "document_id").distinct()


@query("SELECT source, count(*) AS n_texts, count(DISTINCT md5(lower(trim(text)))) AS n_distinct, median(l)::DOUBLE AS len_median, max(CASE WHEN p = floor(n * 0.95) + 1 THEN l END)::INT AS len_p95 FROM (SELECT source, text, length(coalesce(text, '')) AS l, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, ''))) AS p FROM documents) GROUP BY source")
def describe_stats(spark: SparkSession, d: str) -> DataFrame:
    return records.profile(table(spark, d, "documents"), "source")


@query("SELECT count(*) AS n_keys, round(sum(n * n) / (sum(n) * sum(n)), 9)::DOUBLE AS hhi, round(sum(n) * sum(n) / sum(n * n), 6)::DOUBLE AS effective_n FROM (SELECT company_id, count(*)::DOUBLE AS n FROM candidates GROUP BY company_id)")
def hhi_concentration(spark: SparkSession, d: str) -> DataFrame:
    one = records.concentration(table(spark, d, "candidates"), "company_id")
    return one.select("n_keys", F.round("hhi", 9).alias("hhi"), F.round("effective_n", 6).alias("effective_n"))


@query("SELECT company_id, coalesce(g, c) AS title FROM (SELECT company_id, min(company_id || ':' || split) AS g FROM gold_claims WHERE company_id IS NOT NULL GROUP BY 1) FULL JOIN (SELECT company_id, min(title) AS c FROM documents WHERE company_id IS NOT NULL GROUP BY 1) USING (company_id)")
def precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    """One row a company: that of the held-out claims if they have one, else that of the documents."""
    gold = table(spark, d, "gold_claims").where("company_id is not null").groupBy("company_id").agg(F.min(F.concat_ws(":", "company_id", "split")).alias("title"))
    docs = table(spark, d, "documents").where("company_id is not null").groupBy("company_id").agg(F.min("title").alias("title"))
    return records.by_precedence([gold, docs], "company_id")


@query(
    "WITH f AS (SELECT DISTINCT quantity_id, value, period FROM numeric_facts WHERE value IS NOT NULL AND period IS NOT NULL) SELECT quantity_id, 'S0' AS family, 'S' AS label, value AS new_value, period AS new_year FROM f "
    "UNION ALL SELECT quantity_id, 'C1', 'C', value * 2, period FROM f WHERE value <> 0 UNION ALL SELECT quantity_id, 'C2', 'C', value * 0.5, period FROM f WHERE value <> 0 UNION ALL SELECT quantity_id, 'N1', 'N', value, period + 1 FROM f UNION ALL SELECT quantity_id, 'S1', 'S', round(value, 0), period FROM f WHERE value >= 10"
)
def perturb_families(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "numeric_facts").where("value is not null and period is not null").select("quantity_id", "value", "period").distinct()
    return records.perturbations(own, "value", "period").select("quantity_id", "family", "label", "new_value", "new_year")


@query("SELECT candidate_id, CASE WHEN k = 1 THEN candidate_id ELSE candidate_id || '#' || k::VARCHAR END AS unique_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY batch_no, sentence_index) AS k FROM candidates)")
def numbered_repeats(spark: SparkSession, d: str) -> DataFrame:
    return records.numbered_repeats(table(spark, d, "candidates").select("candidate_id", "batch_no", "sentence_index"), "candidate_id", ["batch_no", "sentence_index"]).select("candidate_id", "unique_id")


@query("SELECT sha256(text) AS text_hash, left(text, 280) AS preview, cache_id FROM text_cache WHERE text IS NOT NULL")
def evidence_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_cache").where("text is not null").select("cache_id", records.snapshot(F.col("text")).alias("s")).select("cache_id", "s.*")


@query(r"SELECT quantity_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(sentence, '\d+(?:[.,]\d+)*')), n -> NOT list_contains(regexp_extract_all(value_text, '\d+(?:[.,]\d+)*'), n))), ' ') AS added FROM ir_figures WHERE sentence IS NOT NULL AND value_text IS NOT NULL")
def added_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "ir_figures").where("sentence is not null and value_text is not null")
    return own.select("quantity_id", F.array_join(F.array_sort(records.new_numbers(F.col("value_text"), F.col("sentence"))), " ").alias("added"))


# --- dated joins, graphs, conditions --------------------------------------------------------------

RULES = "(VALUES ('1-URGENT', 'R1', DATE '1992-01-01', DATE '1995-06-30'), ('1-URGENT', 'R2', DATE '1995-07-01', NULL), ('2-HIGH', 'R3', NULL, DATE '1996-12-31'), ('5-LOW', 'R4', NULL, NULL)) AS r(issue, rule_id, effective_from, effective_to)"


@query(f"SELECT rule_id, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN {RULES} ON issue = o_orderpriority AND coalesce(effective_from <= o_orderdate::DATE, TRUE) AND coalesce(o_orderdate::DATE <= effective_to, TRUE) GROUP BY rule_id")
def temporal_rule_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("issue"), F.to_date("o_orderdate").alias("on"))
    rules = spark.sql(f"SELECT * FROM {RULES}")
    return temporal.dated_join(orders, rules, "issue", "on").groupBy("rule_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


EDGES = "(VALUES ('L1', 'D1'), ('D1', 'C1'), ('C1', 'C2'), ('L1', 'D2'), ('D2', 'C2'), ('C2', 'L1'), ('L9', 'D9')) AS e(src, dst)"


@query(f"WITH RECURSIVE h AS (SELECT x AS start, x AS node, 0 AS hop FROM (VALUES ('L1'), ('D2'), ('L9')) AS s(x) UNION SELECT start, dst, hop + 1 FROM h JOIN {EDGES} ON src = node WHERE hop < 2) SELECT start, node, min(hop)::INT AS hop FROM h GROUP BY ALL")
def related_hops(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.sql("SELECT * FROM VALUES ('L1'), ('D2'), ('L9') AS s(start)")
    return temporal.hops(spark.sql(f"SELECT * FROM {EDGES}"), starts, 2)


@query("SELECT c.candidate_id, b.at_year FROM (SELECT DISTINCT candidate_id, company_id, publication_year FROM candidates WHERE company_id IS NOT NULL AND publication_year IS NOT NULL) c ASOF LEFT JOIN (SELECT DISTINCT company_id, publication_year AS at_year FROM crawl_documents WHERE company_id IS NOT NULL AND publication_year IS NOT NULL AND document_type = 'annual_report') b ON c.company_id = b.company_id AND c.publication_year >= b.at_year")
def as_of_report(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "candidates").select("candidate_id", "company_id", "publication_year").where("company_id is not null and publication_year is not null").distinct()
    reports = table(spark, d, "crawl_documents").where("document_type = 'annual_report' and company_id is not null").select("company_id", F.col("publication_year").alias("at_year")).distinct()
    return temporal.as_of(facts, reports, ["company_id"], "publication_year", "at_year", []).select("candidate_id", "at_year")


@query(
    "SELECT o_custkey, CASE WHEN bool_or(s = 'N') THEN 'NOT_MATCH' WHEN bool_or(s = 'S') AND NOT bool_or(s = 'U') THEN 'MATCH' WHEN bool_or(s = 'S') THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS outcome FROM "
    "(SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'U' WHEN o_totalprice < 300000 THEN 'S' ELSE 'N' END AS s FROM orders) GROUP BY o_custkey"
)
def condition_combine(spark: SparkSession, d: str) -> DataFrame:
    test = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") < 300000)
    return table(spark, d, "orders").select("o_custkey", temporal.three_valued(test).alias("status")).groupBy("o_custkey").agg(temporal.combine().alias("outcome"))


@query(
    "WITH y AS (SELECT company_id, metric, list_sort(list(DISTINCT period)) AS ys FROM numeric_facts WHERE company_id IS NOT NULL AND period IS NOT NULL GROUP BY ALL) "
    "SELECT company_id, metric, array_to_string(list_filter(range(ys[1], ys[-1] + 1), v -> NOT list_contains(ys, v::INT)), ',') AS missing FROM y"
)
def continuity_gap(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "numeric_facts").where("company_id is not null and period is not null").groupBy("company_id", "metric").agg(F.collect_set("period").alias("ys"))
    return own.select("company_id", "metric", F.array_join(temporal.missing_years(F.col("ys")).cast("array<string>"), ",").alias("missing"))


@query("SELECT c_mktsegment, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 2) AS base_value, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS current_value, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996) / sum(o_totalprice) FILTER (year(o_orderdate) = 1995) - 1, 6) AS change FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def recompute_change(spark: SparkSession, d: str) -> DataFrame:
    # customers grow with the data: Spark decides by their size whether they are broadcast
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.year("o_orderdate").alias("y"), "o_totalprice")
    out = temporal.change(own, ["c_mktsegment"], "y", "o_totalprice", 1995, 1996)
    return out.select("c_mktsegment", F.round("base_value", 2).alias("base_value"), F.round("current_value", 2).alias("current_value"), F.round("change", 6).alias("change"))


# --- figures --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, n AS n_parts, round(o_totalprice - s, 2) AS difference, coalesce(abs(o_totalprice - s) <= 100000, FALSE) AS foots FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def cross_foot(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    out = figures.cross_foot(parts, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100000.0)
    return out.select("o_orderkey", "n_parts", F.round("difference", 2).alias("difference"), "foots")


@query("SELECT company_id, metric, period, unit, count(DISTINCT subject_text) AS n_sources, min(value) AS low, max(value) AS high, max(value) - min(value) <= 0.05 * abs(max(value)) AS agree FROM numeric_facts WHERE company_id IS NOT NULL AND metric IS NOT NULL AND period IS NOT NULL AND unit IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT subject_text) > 1")
def corroborate(spark: SparkSession, d: str) -> DataFrame:
    return figures.corroborate(table(spark, d, "numeric_facts"), ["company_id", "metric", "period", "unit"], "subject_text", "value", 0.05)


COMPARE_COLS = "quantity_id, company_id, subject_text, metric, period, value, unit, half, is_target"


@query(
    f"WITH f AS (SELECT DISTINCT {COMPARE_COLS} FROM numeric_facts WHERE company_id IS NOT NULL AND subject_text IS NOT NULL AND metric IS NOT NULL AND period IS NOT NULL) "
    "SELECT a.quantity_id AS a_id, b.quantity_id AS b_id, CASE WHEN coalesce(a.unit <> b.unit, FALSE) THEN 'unit' WHEN coalesce(a.is_target <> b.is_target, FALSE) THEN 'target' WHEN coalesce(a.value > 20 * b.value OR b.value > 20 * a.value, FALSE) THEN 'scale' END AS reason, "
    "CASE WHEN NOT coalesce(a.unit = b.unit, FALSE) OR a.value IS NULL OR b.value IS NULL THEN 'N' WHEN abs(a.value - b.value) <= greatest(a.half, b.half) THEN 'S' ELSE 'C' END AS label FROM f a JOIN f b USING (company_id, subject_text, metric, period) WHERE a.quantity_id < b.quantity_id"
)
def figure_comparison(spark: SparkSession, d: str) -> DataFrame:
    key = ["company_id", "subject_text", "metric", "period"]
    own = table(spark, d, "numeric_facts").select("quantity_id", *key, "value", "unit", "half", "is_target").dropna(subset=key).distinct()
    a, b = (own.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in ("quantity_id", "value", "unit", "half", "is_target"))) for s in "ab")
    both = a.join(b, key).where("a_quantity_id < b_quantity_id")
    tests = {
        "unit": F.col("a_unit") != F.col("b_unit"), "target": F.col("a_is_target") != F.col("b_is_target"),
        "scale": (F.col("a_value") > 20 * F.col("b_value")) | (F.col("b_value") > 20 * F.col("a_value")),
    }
    label = figures.comparison(F.col("a_value"), F.col("b_value"), F.col("a_half"), F.col("b_half"), F.col("a_unit") == F.col("b_unit"))
    return both.select(F.col("a_quantity_id").alias("a_id"), F.col("b_quantity_id").alias("b_id"), figures.mismatch(tests).alias("reason"), label.alias("label"))


@query("SELECT quantity_id, CASE WHEN count(value) OVER (PARTITION BY unit) < 3 THEN 0.5 ELSE round(cume_dist() OVER (PARTITION BY unit ORDER BY value NULLS FIRST), 9) END AS magnitude FROM (SELECT DISTINCT quantity_id, unit, value FROM numeric_facts)")
def magnitude_cume_dist(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "numeric_facts").select("quantity_id", "unit", "value").distinct()
    return figures.magnitude(own, "unit", "value").select("quantity_id", F.round("magnitude", 9).alias("magnitude"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= least(greatest((SELECT count(*) FROM orders WHERE o_totalprice >= 490000), 5), 25)")
def queue_cut(spark: SparkSession, d: str) -> DataFrame:
    return figures.queue(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 490000.0, 5, 25)


WORDS = "(VALUES (1, 10, 100, 40, 110, 'Điện'), (1, 45, 100, 80, 110, 'năng'), (1, 200, 101, 240, 111, '1.200'), (1, 300, 100, 340, 110, '1.100'), (1, 10, 120, 60, 130, 'Nước'), (1, 200, 121, 240, 131, '85'), (2, 10, 50, 60, 60, 'Tổng'), (2, 62, 52, 90, 62, 'cộng')) AS w(page, x0, y0, x1, y1, text)"


@query(
    f"WITH a AS (SELECT *, (y0 + y1) / 2 AS mid, y1 - y0 AS tall FROM {WORDS}), b AS (SELECT *, coalesce((mid - lag(mid) OVER (PARTITION BY page ORDER BY mid, x0) > 0.45 * tall)::INT, 1) AS nr FROM a), "
    "c AS (SELECT *, sum(nr) OVER (PARTITION BY page ORDER BY mid, x0 ROWS UNBOUNDED PRECEDING) AS row_no FROM b), e AS (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY page, row_no ORDER BY x0) > 2.5 * tall)::INT, 1) AS ns FROM c), "
    "g AS (SELECT *, sum(ns) OVER (PARTITION BY page, row_no ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS segment_no FROM e) SELECT page, row_no::BIGINT AS row_no, segment_no::BIGINT AS segment_no, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0) AS text FROM g GROUP BY ALL"
)
def table_rows_islands(spark: SparkSession, d: str) -> DataFrame:
    return figures.table_rows(spark.sql(f"SELECT * FROM {WORDS}"))


@query(
    "WITH c AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ord, l_quantity AS v, (l_linenumber = 7)::INT AS t FROM lineitem), b AS (SELECT *, sum(t) OVER (PARTITION BY l_suppkey ORDER BY ord, v ROWS UNBOUNDED PRECEDING) - t AS block FROM c), "
    "g AS (SELECT l_suppkey, block, max(CASE WHEN t = 1 THEN v END) AS total, sum(CASE WHEN t = 0 THEN v END) AS parts_sum, count(*) FILTER (t = 0) AS n_parts, sum(0.5) AS tolerance FROM b GROUP BY ALL) "
    "SELECT l_suppkey, block::BIGINT AS block, total, parts_sum, n_parts, abs(total - parts_sum) <= tolerance AS foots FROM g WHERE total IS NOT NULL AND n_parts > 0"
)
def column_cross_foot(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").select("l_suppkey", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_quantity").alias("ord"), "l_quantity", "l_linenumber")
    return figures.column_cross_foot(cells, "l_suppkey", "ord", "l_quantity", F.col("l_linenumber") == 7, F.lit(0.5)).drop("tolerance")


# --- measures -------------------------------------------------------------------------------------

VOTE = r"nullif(regexp_replace(upper(trim(resolved.holistic_verdict.value)), '[\s_-]+', '_', 'g'), '')"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace(F.upper(F.trim("resolved.holistic_verdict.value")), r"[\s_-]+", "_")
    return table(spark, d, "adjudicated_b03").select("annotation_id", "item_id", F.lower(F.trim("labeler")).alias("labeler"), F.when(v != "", v).alias("label"))


VOTES_SQL = f"(SELECT annotation_id, item_id, lower(trim(labeler)) AS labeler, {VOTE} AS label FROM adjudicated_b03)"
MAJORITY_SQL = f"(SELECT item_id, arg_min(label, {{'c': -c, 'l': label}}) AS label, max(c) / sum(c) AS agreement, sum(c)::BIGINT AS n_votes FROM (SELECT item_id, label, count(*) AS c FROM {VOTES_SQL} WHERE label IS NOT NULL GROUP BY ALL) GROUP BY item_id)"


@query(f"SELECT item_id, label, round(agreement, 6) AS agreement, n_votes FROM {MAJORITY_SQL}")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.majority(_votes(spark, d), "item_id", "label").withColumn("agreement", F.round("agreement", 6))


def verdict_votes(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, labeler, label) as ``VOTES_SQL``."""
    return _votes(spark, d)


def voted_majority(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, label, agreement, n_votes) as ``MAJORITY_SQL``."""
    return evaluate.majority(_votes(spark, d), "item_id", "label")


def _gold_pred(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d)
    return v.where("labeler = 'rv-01'").select("item_id", F.col("label").alias("pred")).join(evaluate.majority(v, "item_id", "label").select("item_id", F.col("label").alias("gold")), "item_id")


GP_SQL = f"(SELECT m.label AS gold, v.label AS pred FROM {VOTES_SQL} v JOIN {MAJORITY_SQL} m USING (item_id) WHERE v.labeler = 'rv-01' AND v.label IS NOT NULL)"


@query(f"SELECT gold, pred, count(*) AS n FROM {GP_SQL} GROUP BY ALL")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_gold_pred(spark, d))


@query(
    f"WITH l AS (SELECT gold AS label FROM {GP_SQL} UNION SELECT pred FROM {GP_SQL}), x AS (SELECT label, (SELECT count(*) FROM {GP_SQL} WHERE gold = label) AS n_gold, (SELECT count(*) FROM {GP_SQL} WHERE pred = label) AS n_pred, (SELECT count(*) FROM {GP_SQL} WHERE pred = label AND gold = label) AS n_right FROM l) "
    "SELECT label, n_gold, n_pred, n_right, round(coalesce(n_right / nullif(n_pred, 0), 0), 6)::DOUBLE AS precision, round(coalesce(n_right / nullif(n_gold, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * n_right / nullif(n_pred + n_gold, 0), 0), 6)::DOUBLE AS f1 FROM x"
)
def class_measures(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_measures(_gold_pred(spark, d))


KAPPA_SQL = "WITH p AS (SELECT * FROM {gp}), t AS (SELECT count(*) AS t FROM p), g AS (SELECT gold, count(*) AS ng FROM p GROUP BY 1), q AS (SELECT pred, count(*) AS np FROM p GROUP BY 1), c AS (SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT sum({w} * coalesce(n, 0) / t) AS o, sum({w} * ng * np / t / t) AS e, any_value(t) AS t FROM g CROSS JOIN q LEFT JOIN c USING (gold, pred) CROSS JOIN t) SELECT t AS n, round(1 - o, 6) AS observed, round(1 - e, 6) AS expected, round(1 - o / e, 6) AS kappa FROM s"


@query(KAPPA_SQL.format(gp=GP_SQL, w="(CASE WHEN gold = pred THEN 0.0 ELSE 1.0 END)::DOUBLE"))
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cohen_kappa(_gold_pred(spark, d))


ORDER = {"CONTRADICTED": 0, "INSUFFICIENT_EVIDENCE": 1, "PARTIALLY_SUPPORTED": 2, "SUPPORTED": 3}
_PLACE = "(CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDER.items()) + " END)"


@query(KAPPA_SQL.format(gp=f"(SELECT * FROM {GP_SQL} WHERE gold IN {tuple(ORDER)} AND pred IN {tuple(ORDER)})", w=f"pow(({_PLACE.format('gold')} - {_PLACE.format('pred')}) / 3.0, 2)::DOUBLE"))
def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    gp = _gold_pred(spark, d).where(F.col("gold").isin(*ORDER) & F.col("pred").isin(*ORDER))
    return evaluate.cohen_kappa(gp, ORDER)


@query(
    f"WITH c AS (SELECT item_id, label, count(*) AS c FROM {VOTES_SQL} WHERE label IS NOT NULL GROUP BY ALL), i AS (SELECT item_id, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1 HAVING sum(c) > 1), s AS (SELECT label, sum(c) AS c FROM c WHERE item_id IN (SELECT item_id FROM i) GROUP BY 1), "
    "e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS e FROM s), o AS (SELECT count(*) AS n_items, avg(same / (n * (n - 1))) AS o FROM i) SELECT n_items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM o CROSS JOIN e"
)
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.fleiss_kappa(_votes(spark, d))


@query(
    "WITH r AS (SELECT c_mktsegment AS g, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS ry FROM customer) "
    "SELECT g AS c_mktsegment, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY g"
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.spearman(table(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_mktsegment")


WILSON_SQL = "(k / n + 1.9208 / n {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@query(f"SELECT document_type, k, n, round({WILSON_SQL.format(s='-')}, 6) AS low, round({WILSON_SQL.format(s='+')}, 6) AS high FROM (SELECT document_type, count(*) FILTER (has_number) AS k, count(*) AS n FROM candidates GROUP BY 1)")
def wilson_share(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.proportion(table(spark, d, "candidates"), ["document_type"], F.col("has_number"))


RANKED_SQL = "(SELECT query_id, doc_id, rank FROM ({r}) WHERE rank <= 10)".format(r=ORACLES["rrf_fusion"])


@query(f"""WITH g AS (SELECT query_id, doc_id FROM ({JACCARD_SQL}) WHERE score >= 0.12), r AS {RANKED_SQL}, b AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT query_id, n, (SELECT sum(1 / log2(x + 1)) FROM range(1, 11) AS t(x) WHERE x <= n) AS ideal FROM b),
h AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS f, sum(1 / log2(rank + 1)) AS dcg FROM g JOIN r USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(h1 / n, 0)), 6) AS recall_at_1, round(avg(coalesce(h3 / n, 0)), 6) AS recall_at_3, round(avg(coalesce(h5 / n, 0)), 6) AS recall_at_5, round(avg(coalesce(h10 / n, 0)), 6) AS recall_at_10, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg_at_10 FROM i LEFT JOIN h USING (query_id)""")
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    gold = retrieval.jaccard(_cache(spark, d), _claims(spark, d)).where("score >= 0.12").select("query_id", "doc_id")
    return evaluate.ranking_measures(rrf_fusion(spark, d), gold)


@query(f"WITH a AS (SELECT 'lexical' AS system, query_id, doc_id, rank FROM ({ORACLES['jaccard_topk']}) UNION ALL SELECT 'fused', query_id, doc_id, rank FROM ({ORACLES['rrf_fusion']})) SELECT query_id, doc_id, count(*) AS n_systems, min(rank) AS best_rank, string_agg(system || ':' || rank::VARCHAR, ',' ORDER BY system || ':' || rank::VARCHAR) AS ranks FROM a WHERE rank <= 3 GROUP BY ALL")
def pooled_rankings(spark: SparkSession, d: str) -> DataFrame:
    a = jaccard_topk(spark, d).select(F.lit("lexical").alias("system"), "query_id", "doc_id", "rank")
    b = rrf_fusion(spark, d).select(F.lit("fused").alias("system"), "query_id", "doc_id", "rank")
    return evaluate.pooled(a.unionByName(b), 3)


@query(
    f"WITH x AS (SELECT item_id, bool_or(v.labeler = 'rv-02' AND v.label = m.label) AS a, bool_or(v.labeler = 'rv-03' AND v.label = m.label) AS b FROM {VOTES_SQL} v JOIN {MAJORITY_SQL} m USING (item_id) WHERE v.labeler IN ('rv-02', 'rv-03') AND v.label IS NOT NULL GROUP BY item_id HAVING count(DISTINCT v.labeler) = 2) "
    "SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM x"
)
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return _mcnemar(spark, d).select("b", "c")


def _mcnemar(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d).where("label is not null")
    m = evaluate.majority(v, "item_id", "label").select("item_id", F.col("label").alias("gold"))
    two = v.where("labeler in ('rv-02', 'rv-03')").join(m, "item_id")
    right = lambda who: F.bool_or((F.col("labeler") == who) & (F.col("label") == F.col("gold")))
    pairs = two.groupBy("item_id").agg(right("rv-02").alias("a_right"), right("rv-03").alias("b_right"), F.count_distinct("labeler").alias("n")).where("n = 2")
    return evaluate.mcnemar(pairs)


@query()
def mcnemar_test(spark: SparkSession, d: str) -> DataFrame:
    return _mcnemar(spark, d)


@query("WITH c AS (SELECT document_type, candidate_id, bool_or(has_number) AS has_number FROM candidates GROUP BY ALL), p AS (SELECT document_type, count(*) AS n FROM c GROUP BY 1), s AS (SELECT document_type, avg(coalesce(has_number, FALSE)::INT) AS p, count(*) AS m FROM (SELECT document_type, has_number FROM c QUALIFY row_number() OVER (PARTITION BY document_type ORDER BY md5('s:' || candidate_id), candidate_id) <= 50) GROUP BY 1) SELECT count(*) AS n_strata, sum(m)::BIGINT AS n_sample, round(sum(p * n) / sum(n), 6) AS weighted_share FROM s JOIN p USING (document_type)")
def population_weights(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").groupBy("document_type", "candidate_id").agg(F.bool_or("has_number").alias("has_number"))
    return evaluate.weighted_share(records.capped_sample(own, "document_type", "candidate_id", 50), own, "document_type", F.col("has_number"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap(table(spark, d, "candidates").select(F.col("has_number").cast("int").alias("v")), "v")


@query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap(table(spark, d, "candidates").select("company_id", F.col("has_number").cast("int").alias("v")), "v", "company_id")


# --- embeddings against labels, event windows -----------------------------------------------------


@query("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total, time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '2024-01-01') AS window_start FROM events GROUP BY event_type, window_start")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "6 hours")
    g = table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", "n_events", "n_users", "total", F.col("w.start").alias("window_start"))


# --- scans with state, files, plans ---------------------------------------------------------------


@query()
def quantities_parse(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", "text").distinct()
    q = own.select("candidate_id", F.posexplode(quantities.quantities(F.col("text"))).alias("pos", "q"))
    return q.select("candidate_id", "pos", "q.*")


@query()
def mask_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "text_cache").where("text is not null").select("cache_id", "text")
    return quantities.masked(own, "text").select("cache_id", F.col("masked.text").alias("masked"), F.size("masked.slots").alias("n_slots"))


@query()
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("text is not null").select("candidate_id", "chunk_id", "sentence_index", "text").distinct()
    pairs = passages.neighbours(own, ["chunk_id"], ["sentence_index", "candidate_id", "text"]).where("before is not null")
    return pairs.select("candidate_id", F.posexplode(edits.word_diff(F.col("before"), F.col("text"))).alias("pos", "x")).select("candidate_id", "pos", "x.*")


STATUTE = (
    "Chương I\nQUY ĐỊNH CHUNG\nĐiều 1 - Phạm vi\nÁp dụng cho mọi cơ sở.\nMục 2. Báo cáo\nĐiều 2. Nghĩa vụ\nCác nghĩa vụ:\n1. Báo cáo\na) hằng năm\nb) khi có lệnh\n2) Nộp phí\n"
    "PHỤ LỤC I: Mẫu\n1. Dòng đầu\n1. Dòng sau"
)


@query(
    """SELECT * FROM (VALUES (1, 'art1', 'I', NULL, 'Phạm vi', 'Áp dụng cho mọi cơ sở.'), (1, 'art2', 'I', '2', 'Nghĩa vụ', 'Các nghĩa vụ:'), (1, 'art2.1', 'I', '2', 'Nghĩa vụ', 'Báo cáo'), (1, 'art2.1.a', 'I', '2', 'Nghĩa vụ', 'hằng năm'),
(1, 'art2.1.b', 'I', '2', 'Nghĩa vụ', 'khi có lệnh'), (1, 'art2.2', 'I', '2', 'Nghĩa vụ', 'Nộp phí'), (1, 'annexI.001', NULL, NULL, 'Mẫu', 'Dòng đầu'), (1, 'annexI.002', NULL, NULL, 'Mẫu', 'Dòng sau')) AS x(doc_id, path, chapter, section, heading, text)"""
)
def statute_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of a small statute; the tables hold none."""
    own = spark.createDataFrame([(1, STATUTE), (2, None), (3, "Không có điều nào.")], "doc_id int, text string")
    return edits.clause_rows(own).select("doc_id", "path", "chapter", "section", "heading", "text")


@query(
    """SELECT * FROM (VALUES ('art1', 'Điều 1 Luật A'), ('art2', 'Điều 2 Luật A'), ('art2.1', 'khoản 1 Điều 2 Luật A'), ('art2.1.a', 'điểm a khoản 1 Điều 2 Luật A'), ('art2.1.b', 'điểm b khoản 1 Điều 2 Luật A'), ('art2.2', 'khoản 2 Điều 2 Luật A'),
('annexI.001', 'Phụ lục I Luật A'), ('annexI.002', 'Phụ lục I Luật A')) AS x(path, citation)"""
)
def clause_citations(spark: SparkSession, d: str) -> DataFrame:
    return statute_clauses(spark, d).select("path", edits.clause_citation(F.lit("Luật A"), F.col("path")).alias("citation"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "units").where("text is not null and unit_type = 'html'")
    return own.select("unit_id", readers.html_to_text(F.col("text")).alias("text"))


@query()
def claim_extraction(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claims(table(spark, d, "documents"), TYPES)


@query()
def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Fused evidence for each held-out claim, with the comparison of their figures."""
    q = _claims(spark, d)
    return evidence.compared(q, evidence.evidence(table(spark, d, "documents"), q))


@query()
def inferred_units(spark: SparkSession, d: str) -> DataFrame:
    """The factor that each unit spelling of the numeric facts stands for, from their values against amounts that other records state for the same quantity.

    The spelling itself is not read: recorded value x factor = amount is the identity, and all factors of the unit table compete.
    """
    key = ["company_id", "subject_text", "metric", "period"]
    read = units.amounts(table(spark, d, "ir_figures"), table(spark, d, "numeric_facts").limit(0)).where("amount > 0 and is_unique").select(*key, "amount")
    own = table(spark, d, "numeric_facts").where("unit is not null and value > 0").select(F.lower(F.trim("unit")).alias("spelling"), *key, "value").distinct()
    factors = sorted({f for _, by in units.UNITS.values() for f in by})
    out = units.infer_units(own.join(read, key), "spelling", {"value": {f"{f:.6g}": f for f in factors}, "amount": {"common": 1.0}}, {"value": 1.0, "amount": -1.0})
    return out.select("spelling", F.col("value_unit").cast("double").alias("factor"), F.round("residual", 6).alias("residual"), "is_unique", "n_rows")


# --- corpus views ---------------------------------------------------------------------------------

TOP_YEARS = r"(SELECT string_agg(y, ',' ORDER BY n DESC, y) FROM (SELECT y, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b(?:19|20)\d{2}\b')) AS y FROM candidates) GROUP BY y ORDER BY n DESC, y LIMIT 6))"


@query(f"SELECT (SELECT count(*) FROM candidates) AS n_texts, (SELECT count(*) FROM candidates WHERE text IS NULL) AS n_missing, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT candidate_type || ':' || count(*)::VARCHAR AS x FROM candidates WHERE candidate_type IS NOT NULL GROUP BY candidate_type)) AS roles, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT source_kind || ':' || count(*)::VARCHAR AS x FROM candidates WHERE source_kind IS NOT NULL GROUP BY source_kind)) AS kinds, {TOP_YEARS} AS top_years")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return corpus.profile(table(spark, d, "candidates"), "candidate_type", "source_kind", "text")


@query(
    r"WITH n AS (SELECT source, regexp_replace(trim(unnest(regexp_extract_all(text, '(?:Công ty|Tập đoàn|Tổng công ty|Company|Group|Corporation)((?:\s+\p{Lu}[\p{L}]+){1,4})', 1))), '\s+', ' ', 'g') AS name FROM documents WHERE source IS NOT NULL), c AS (SELECT source, name, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 3) "
    "SELECT source, name, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, name) = 1"
)
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    return corpus.entity_names(table(spark, d, "documents"), "source", "text")


@query(
    """WITH RECURSIVE o AS (SELECT company_id, n, row_number() OVER (ORDER BY n DESC, company_id) AS r FROM (SELECT company_id, count(*) AS n FROM candidates WHERE company_id IS NOT NULL GROUP BY 1)),
w AS (SELECT 0::BIGINT AS r, NULL::VARCHAR AS company_id, 0::BIGINT AS n, FALSE AS taken, (SELECT sum(n) FROM o)::DOUBLE * 0.2 AS room UNION ALL SELECT o.r, o.company_id, o.n, o.n <= w.room, CASE WHEN o.n <= w.room THEN w.room - o.n ELSE w.room END FROM w JOIN o ON o.r = w.r + 1)
SELECT company_id, n FROM w WHERE taken"""
)
def held_out_companies(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "candidates").where("company_id is not null").groupBy("company_id").agg(F.count("*").alias("size"))
    return corpus.held_out(own, "company_id", "size", 0.2)


@query("SELECT document_type, company_id, sum(k) OVER (PARTITION BY document_type)::BIGINT - k AS k_others, sum(n) OVER (PARTITION BY document_type)::BIGINT - n AS n_others FROM (SELECT document_type, company_id, count(*) FILTER (has_number) AS k, count(*) AS n FROM candidates GROUP BY ALL)")
def leave_company_out(spark: SparkSession, d: str) -> DataFrame:
    return corpus.leave_group_out(table(spark, d, "candidates"), ["document_type"], "company_id", F.col("has_number"))


TITLE_CLASSES = {"energy": ("dien nang", "nang luong", "nhien lieu", "electricity", "fuel", "solar"), "waste": ("chat thai", "waste", "residue", "bun"), "water": ("nuoc", "water", "effluent"), "air": ("bui", "khi", "dust", "exhaust")}


@query("SELECT crawl_id, coalesce(" + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in TITLE_CLASSES.items()) + f", 'other') AS topic FROM (SELECT crawl_id, regexp_replace({fold_sql(chr(99) + 'oalesce(title, ' + repr('') + ')')}, '[_.\\-]+', ' ', 'g') AS t FROM crawl_documents)")
def title_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_documents").select("crawl_id", corpus.first_term(F.col("title"), TITLE_CLASSES).alias("topic"))


@query("SELECT crawl_id, concat_ws('; ', CASE WHEN trim(source_kind) <> '' THEN 'kind: ' || source_kind END, CASE WHEN trim(ticker) <> '' THEN 'ticker: ' || ticker END, CASE WHEN trim(publication_year::VARCHAR) <> '' THEN 'year: ' || publication_year::VARCHAR END) AS qualifiers, CASE status WHEN 'downloaded' THEN 'đã tải' WHEN 'failed' THEN 'lỗi' ELSE status END AS label FROM crawl_documents")
def record_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    q = corpus.qualifiers({"kind": F.col("source_kind"), "ticker": F.col("ticker"), "year": F.col("publication_year")})
    return table(spark, d, "crawl_documents").select("crawl_id", F.array_join(q, "; ").alias("qualifiers"), corpus.labelled(F.col("status"), {"downloaded": "đã tải", "failed": "lỗi"}).alias("label"))


@query("WITH a AS (SELECT url, max(status) AS v FROM crawl_documents WHERE batch_no <= 6 AND url IS NOT NULL GROUP BY url), b AS (SELECT url, max(status) AS v FROM crawl_documents WHERE batch_no > 6 AND url IS NOT NULL GROUP BY url) SELECT coalesce(a.url, b.url) AS url, a.v AS before, b.v AS after, CASE WHEN b.url IS NULL THEN 'gone' WHEN a.url IS NULL THEN 'new' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.url = b.url")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("url is not null")
    part = lambda c: own.where(c).groupBy("url").agg(F.max("status").alias("v"))
    return corpus.paired(part("batch_no <= 6"), part("batch_no > 6"), "url", "v")


@query("SELECT crawl_id, ((hour(downloaded_at) * 60 + minute(downloaded_at) - hour(discovered_at) * 60 - minute(discovered_at)) % 1440 + 1440) % 1440 AS minutes FROM crawl_documents WHERE downloaded_at IS NOT NULL AND discovered_at IS NOT NULL")
def elapsed_minutes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("downloaded_at is not null and discovered_at is not null")
    return own.select("crawl_id", corpus.elapsed_minutes(F.col("discovered_at"), F.col("downloaded_at")).cast("long").alias("minutes"))


@query("SELECT document_id, crawl_id, status FROM crawl_documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY CASE status WHEN 'downloaded' THEN 0 WHEN 'failed' THEN 1 WHEN 'skipped' THEN 2 ELSE 3 END, crawl_id) = 1")
def best_status_merge(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "crawl_documents").where("document_id is not null").select("document_id", "crawl_id", "status", "batch_no")
    return corpus.ranked_merge([own.where("batch_no <= 6").drop("batch_no"), own.where("batch_no > 6").drop("batch_no")], "document_id", "status", {"downloaded": 0, "failed": 1, "skipped": 2}, "crawl_id")


@query(
    f"WITH f AS (SELECT DISTINCT {COMPARE_COLS} FROM numeric_facts WHERE company_id IS NOT NULL AND subject_text IS NOT NULL AND metric IS NOT NULL AND period IS NOT NULL) SELECT a.quantity_id AS a_id, b.quantity_id AS b_id, "
    "CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit' WHEN a.value IS DISTINCT FROM b.value THEN 'value' WHEN a.half IS DISTINCT FROM b.half THEN 'half' WHEN a.is_target IS DISTINCT FROM b.is_target THEN 'is_target' END AS field FROM f a JOIN f b USING (company_id, subject_text, metric, period) WHERE a.quantity_id < b.quantity_id"
)
def error_first_field(spark: SparkSession, d: str) -> DataFrame:
    key, rest = ["company_id", "subject_text", "metric", "period"], ("unit", "value", "half", "is_target")
    own = table(spark, d, "numeric_facts").select("quantity_id", *key, *rest).dropna(subset=key).distinct()
    a, b = (own.select(*key, *(F.col(c).alias(f"{s}_{c}") for c in ("quantity_id", *rest))) for s in "ab")
    both = a.join(b, key).where("a_quantity_id < b_quantity_id")
    field = corpus.error_field({c: F.col(f"a_{c}") for c in rest}, {c: F.col(f"b_{c}") for c in rest})
    return both.select(F.col("a_quantity_id").alias("a_id"), F.col("b_quantity_id").alias("b_id"), field.alias("field"))


@query(
    "SELECT doc_id, n_words, CASE WHEN n_words >= 6 THEN round(len(list_intersect(g, h)) / len(g), 6) END AS share FROM (SELECT doc_id, len(w) AS n_words, list_distinct(list_transform(range(1, len(w) - 4), i -> array_to_string(w[i:i + 5], ' '))) AS g, list_distinct(list_transform(range(1, len(v) - 4), i -> array_to_string(v[i:i + 5], ' '))) AS h FROM "
    r"(SELECT doc_id, list_filter(regexp_split_to_array(lower(title), '\s+'), t -> t <> '') AS w, list_filter(regexp_split_to_array(lower(text), '\s+'), t -> t <> '') AS v FROM documents WHERE title IS NOT NULL AND text IS NOT NULL))"
)
def title_containment(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("title is not null and text is not null")
    words = F.size(F.filter(F.split(F.lower("title"), r"\s+"), lambda t: t != "")).cast("long")
    return own.select("doc_id", words.alias("n_words"), F.round(corpus.contained_ngrams(F.col("title"), F.col("text")), 6).alias("share"))


@query()
def figure_places(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "numeric_facts").where("value is not null and sentence is not null").select("quantity_id", "value", "sentence").distinct()
    return own.select("quantity_id", corpus.figure_place(F.col("value"), F.col("sentence")).alias("place"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all({match_sql('text')}, '(?:scope|pham vi)\\s*((?:[123]\\b\\s*(?:,|va\\b|and\\b|&|\\+|-|to\\b|den\\b)?\\s*)+)', 1), r -> regexp_extract_all(r, '[123]'))))), ',') AS scopes FROM documents WHERE text IS NOT NULL")
def emission_scopes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("text is not null")
    return own.select("doc_id", F.array_join(tx.emission_scopes(F.col("text")).cast("array<string>"), ",").alias("scopes"))


@query("SELECT source_kind, document_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY source_kind)::BIGINT AS n_kind FROM crawl_documents GROUP BY source_kind, document_type")
def tallies(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "crawl_documents").groupBy("source_kind", "document_type").agg(F.count("*").alias("n"))
    return g.withColumn("n_kind", F.sum("n").over(Window.partitionBy("source_kind")))


@query("SELECT company_id, count(*) FILTER (unit_type = 'pdf_page' AND length(coalesce(text, '')) < 80) AS n_scanned, count(*) AS n_units, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM units GROUP BY company_id")
def unit_inspection(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, d, "units").groupBy("company_id").agg(F.count_if((F.col("unit_type") == "pdf_page") & (n < 80)).alias("n_scanned"), F.count("*").alias("n_units"), F.sum(n).cast("long").alias("n_chars"))


# --- more views of records and tables -------------------------------------------------------------


@query(
    f"WITH c AS ({ORACLES['table_cells']}), y AS (SELECT *, regexp_full_match(value, '(?:19|20)\\d{{2}}') AS is_year, last_value(CASE WHEN regexp_full_match(value, '(?:19|20)\\d{{2}}') THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, col_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS year FROM c), "
    "v AS (SELECT doc_id, line_no, label, year::INT AS year, regexp_replace(trim(value), '[.,]+$', '') AS t FROM y WHERE NOT is_year AND year IS NOT NULL), w AS (SELECT *, length(t) - length(replace(t, '.', '')) AS d, length(t) - length(replace(t, ',', '')) AS c FROM v) "
    f"SELECT doc_id, line_no, label, year, {NUMBER_SQL} AS value FROM w WHERE {NUMBER_SQL} IS NOT NULL"
)
def disclosed_figures(spark: SparkSession, d: str) -> DataFrame:
    return figures.year_columns(passages.table_cells(table(spark, d, "documents")))


@query("SELECT source_kind, count(*) AS n, round(avg((status = 'failed')::INT), 6) AS failed_share, median(epoch(downloaded_at - discovered_at))::DOUBLE AS latency_s FROM (SELECT source_kind, status, CASE WHEN status = 'downloaded' THEN downloaded_at END AS downloaded_at, discovered_at FROM crawl_documents) GROUP BY source_kind")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("downloaded_at").cast("timestamp")) - F.unix_micros(F.col("discovered_at").cast("timestamp"))) / 1e6
    own = table(spark, d, "crawl_documents")
    return own.groupBy("source_kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "failed").cast("int")), 6).alias("failed_share"), F.median(F.when(F.col("status") == "downloaded", seconds)).alias("latency_s"))


@query(r"SELECT crawl_id, coalesce(publication_year, TRY_CAST(nullif(regexp_extract(title, '\b(?:19|20)\d{2}\b'), '') AS INT), TRY_CAST(nullif(regexp_extract(url, '\b(?:19|20)\d{2}\b'), '') AS INT)) AS year FROM crawl_documents")
def year_resolution(spark: SparkSession, d: str) -> DataFrame:
    y = lambda c: tx.first_year(F.col(c)).cast("int")
    return table(spark, d, "crawl_documents").select("crawl_id", F.coalesce("publication_year", y("title"), y("url")).alias("year"))


@query(
    "WITH c AS (SELECT DISTINCT document_id, candidate_id, candidate_type FROM candidates WHERE document_id IS NOT NULL), e AS (SELECT document_id, string_agg(candidate_id, ',' ORDER BY candidate_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY candidate_id) AS r FROM c WHERE candidate_type = 'evidence') WHERE r <= 5 GROUP BY document_id) "
    "SELECT candidate_id, evidence FROM c LEFT JOIN e ON c.document_id = e.document_id WHERE candidate_type = 'claim'"
)
def training_view(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the first five evidence sentences of their document."""
    own = table(spark, d, "candidates").where("document_id is not null").select("document_id", "candidate_id", "candidate_type").distinct()
    w = Window.partitionBy("document_id").orderBy("candidate_id")
    first = own.where("candidate_type = 'evidence'").withColumn("r", F.row_number().over(w)).where("r <= 5")
    e = first.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias("evidence"))
    return own.where("candidate_type = 'claim'").join(e, "document_id", "left").select("candidate_id", "evidence")


@query(
    "SELECT 'raw' AS layer, crawl_id::VARCHAR AS record_id, document_id, company_id, publication_year FROM crawl_documents UNION ALL SELECT 'clean', unit_id, document_id, company_id, publication_year FROM units UNION ALL SELECT 'extract', candidate_id, document_id, company_id, publication_year FROM candidates"
)
def contract_layers(spark: SparkSession, d: str) -> DataFrame:
    shared = ("document_id", "company_id", "publication_year")
    layer = lambda name, t, key: table(spark, d, t).select(F.lit(name).alias("layer"), F.col(key).cast("string").alias("record_id"), *shared)
    return temporal.union_all([layer("raw", "crawl_documents", "crawl_id"), layer("clean", "units", "unit_id"), layer("extract", "candidates", "candidate_id")])


@query("SELECT (u.document_id IS NOT NULL) AS has_clean, (r.document_id IS NOT NULL) AS has_raw, count(*) AS n FROM candidates c LEFT JOIN (SELECT DISTINCT document_id FROM units) u ON c.document_id = u.document_id LEFT JOIN (SELECT DISTINCT document_id FROM crawl_documents) r ON c.document_id = r.document_id GROUP BY ALL")
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, n: table(spark, d, t).where("document_id is not null").select("document_id").distinct().withColumn(n, F.lit(True))
    # candidates of one document are counted before they meet the other layers
    c = table(spark, d, "candidates").groupBy("document_id").agg(F.count("*").alias("n"))
    both = c.join(ids("units", "u"), "document_id", "left").join(ids("crawl_documents", "r"), "document_id", "left")
    return both.groupBy(F.col("u").isNotNull().alias("has_clean"), F.col("r").isNotNull().alias("has_raw")).agg(F.sum("n").alias("n"))


@query("SELECT company_id FROM candidates WHERE split = 'train' INTERSECT SELECT company_id FROM candidates WHERE split = 'test'")
def split_intersection(spark: SparkSession, d: str) -> DataFrame:
    part = lambda s: table(spark, d, "candidates").where(F.col("split") == s).select("company_id")
    return part("train").intersect(part("test"))


@query("SELECT company_id, publication_year FROM crawl_documents EXCEPT SELECT company_id, publication_year FROM units")
def unparsed_company_years(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t: table(spark, d, t).select("company_id", "publication_year")
    return pair("crawl_documents").subtract(pair("units"))


_RUN_SQL = (
    f"list_max(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(regexp_replace(t, '{tx.QUOTED}', ' , ', 'g'), '\\s+'), w -> (CASE WHEN regexp_matches(regexp_replace(w, '{tx.AROUND}', '', 'g'), '"
    + tx.CAPITALISED.replace("'", "''")
    + f"') THEN 'C' WHEN regexp_replace(w, '{tx.AROUND}', '', 'g') = '' THEN '' ELSE '|' END) || (CASE WHEN regexp_matches(w, '[,;.:]$') THEN '|' ELSE '' END)), ''), '|'), r -> length(r)))"
)


@query(
    f"""SELECT candidate_id, CASE WHEN i >= 3 OR g >= 2 OR (g >= 1 AND i >= 2) OR regexp_matches(t, '{tx.YEARS_IN_A_ROW}') OR gas >= 4 OR run >= CASE WHEN {fold_sql('t')} <> lower(t) THEN 8 ELSE 6 END THEN 'layout_glue'
WHEN (regexp_matches(t, '{tx.MAIL_OR_PHONE}') OR regexp_matches(lower(t), '{tx.CONTACT_WORD}')) AND len(regexp_split_to_array(t, '\\s+')) < 20 THEN 'contact_line'
WHEN regexp_matches(lower(t), '{tx.STANDARD_TITLE}') THEN 'standard_title' WHEN l >= 2 AND NOT regexp_matches(lower(t), '{tx.whole_words(tx.ACTORS)}') THEN 'legal_text' END AS reason
FROM (SELECT candidate_id, t, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(t), '{tx._LABELLED}', ' ', 'g'), '{tx._MEASURE}', ' ', 'g'), '\\s+'), w -> regexp_full_match(w, '[0-9]{{1,3}}'))) AS i,
len(regexp_extract_all(t, '{tx.GRI_CODE}')) AS g, len(regexp_extract_all(t, '{tx.GASES}', 1)) AS gas, {_RUN_SQL} AS run,
len(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}-]+'), w -> w IN ('luật', 'nđ-cp', 'tt-btc', 'qđ-ttg'))) + len(regexp_extract_all(lower(t), 'nghị định|thông tư|quyết định')) AS l
FROM (SELECT candidate_id, trim(text) AS t FROM candidates WHERE text IS NOT NULL))"""
)
def suspect_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").where("text is not null").select("candidate_id", tx.suspect_reason(F.col("text")).alias("reason"))


@query("SELECT company_id, avg(score_pct)::DOUBLE AS mean_score, count(*) FILTER (missing = '') AS complete_years FROM (" + ORACLES["coverage_grid"] + ") GROUP BY company_id")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return coverage_grid(spark, d).groupBy("company_id").agg(F.avg("score_pct").alias("mean_score"), F.count_if(F.col("missing") == "").alias("complete_years"))


@query()
def share_lower_bounds(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "candidates").groupBy("document_type").agg(F.count_if("has_number").alias("k"), F.count("*").alias("n"))
    return figures.beta_lower(counts, "k", "n").withColumn("lower", F.round("lower", 6))


@query("SELECT event_id, event_type, json_extract_string(props, '$.' || k) AS value, k AS key FROM events, unnest(json_keys(props)) AS t(k) WHERE props IS NOT NULL")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").where("props is not null").select("event_id", "event_type", F.explode(props).alias("key", "value"))


CASES = "(VALUES ('R1', array('energy', 'water'), DATE '1992-01-01', NULL), ('R2', array(), NULL, DATE '2021-12-31'), ('R3', array('waste'), NULL, NULL)) AS r(rule_id, kinds, effective_from, effective_to)"


@query(
    f"SELECT rule_id, claim_type, count(*) AS n FROM (SELECT candidate_id, publication_year, {BEST_SQL} AS claim_type FROM (SELECT candidate_id, publication_year, {match_sql('text')} AS m FROM candidates WHERE text IS NOT NULL AND publication_year IS NOT NULL)) "
    "JOIN (VALUES ('R1', ['energy', 'water'], DATE '1992-01-01', NULL::DATE), ('R2', []::VARCHAR[], NULL, DATE '2021-12-31'), ('R3', ['waste'], NULL, NULL)) AS r(rule_id, kinds, f, t) ON (len(kinds) = 0 OR claim_type IS NULL OR list_contains(kinds, claim_type)) AND coalesce(f <= make_date(publication_year, 12, 31), TRUE) AND coalesce(make_date(publication_year, 12, 31) <= t, TRUE) GROUP BY ALL"
)
def rule_applicability(spark: SparkSession, d: str) -> DataFrame:
    """Rules that name a claim's type, or none, and are in force at the end of its year: claims are counted by type and year first."""
    own = table(spark, d, "candidates").where("text is not null and publication_year is not null")
    typed = own.select("publication_year", tx.match_form(F.col("text")).alias("m")).select("publication_year", lexicon.best_bucket(F.col("m"), TYPES).alias("claim_type"))
    counted = typed.groupBy("publication_year", "claim_type").agg(F.count("*").alias("n")).withColumn("on", F.make_date("publication_year", F.lit(12), F.lit(31)))
    rules = F.broadcast(spark.sql(f"SELECT rule_id, cast(kinds AS array<string>) AS kinds, effective_from, effective_to FROM {CASES}"))
    fits = temporal.applies(F.col("kinds"), F.col("claim_type")) & temporal.in_force(F.col("effective_from"), F.col("effective_to"), F.col("on"))
    return counted.join(rules, fits).groupBy("rule_id", "claim_type").agg(F.sum("n").alias("n"))


REFUTING, SUPPORTING, NEGATIONS = ("thiếu", "vi phạm", "lack", "found no"), ("đã đối chiếu", "checked", "confirmed"), ("không", "not", "no")


@query()
def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the held-out claims from their five best passages."""
    q = _claims(spark, d)
    found = cut(evidence.evidence(table(spark, d, "documents"), q))
    return evidence.verdicts(evidence.stances(q, found, REFUTING, SUPPORTING, NEGATIONS))
