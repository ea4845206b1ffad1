"""Queries of this subpackage, by name, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import chunker, consensus, history, leaks, look, lookalike, mixture, reading, splits
from attestra.runtime import own_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_companies(table(spark, d, "crawl_documents"), table(spark, d, "candidates"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_rows({"crawl_documents": (table(spark, d, "crawl_documents"), "crawl_id"), "candidates": (table(spark, d, "candidates"), "candidate_id")})


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunker.cut_units(table(spark, d, "units"), table(spark, d, "intake_settings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("n_pieces > 1").select("unit_id").distinct()


def p4_repeats(spark: SparkSession, d: str) -> DataFrame:
    return history.batch_repeats(table(spark, d, "crawl_documents"), table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_repeats(spark, d).select(F.col("earliest").alias("crawl_id_a"), F.col("record").alias("crawl_id_b"))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    return history.deliveries(table(spark, d, "crawl_documents"), table(spark, d, "documents"), f"{own_dir(spark)}/history-{uuid.uuid4().hex}")


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.consensus(consensus.votes(table(spark, d, "adjudicated_b03")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.majority(_consensus(spark, d).start)


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.withColumn("posterior", F.round("posterior", 4)).drop("probabilities")


def p5_labelers(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).labelers.select("labeler", "n_votes", F.round("reliability", 4).alias("reliability"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    one = _consensus(spark, d).agreement
    return one.select("n_items", "n_pairable", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(table(spark, d, "text_cache"))


def p6_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "text_cache").select("cache_id", "text")).select("cache_id", "one_form")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "gold_claims"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where(F.col("run_words") >= leaks.SPAN).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.emit(mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.easy_texts(p9_levels(spark, d)).select(F.col("id").alias("doc_id")).distinct()


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), mixture.source_key(F.col("source")).alias("source"), F.lower("lang").alias("lang"))
    return p9_levels(spark, d).join(docs, "id").groupBy("source", "lang", "level").agg(F.count("*").alias("n_texts"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        p1_found, p1_splits, p2_found, p2_pieces, p4_found, p4_repeats, p4_history, p5_found, p5_items, p5_labelers, p5_agreement, p6_found, p6_one_form,
        p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_levels, p9_profile,
    )
}
# --- SQL ------------------------------------------------------------------------------------------

_WIDE, _NARROW = splits.WIDE
_PLAIN = f"trim(regexp_replace(regexp_replace(upper(translate(ticker, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}')), '[\\p{{Cf}}\\p{{Cc}}]+', '', 'g'), '[\\p{{Z}}\\s]+', ' ', 'g'))"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '^(?:HOSE|HNX|UPCOM) ?[:./|_ -] ?([A-Z])', '\\1'), '([A-Z]) ?[:./|_ -] ?(?:HOSE|HNX|UPCOM)$', '\\1'), '([A-Z]) ?[(\\[](?:HOSE|HNX|UPCOM)[)\\]]$', '\\1'), '^[$(\\[] ?', ''), ' ?[)\\]]$', '')"
_VERDICT = "CASE regexp_replace(upper(resolved.holistic_verdict.value), '[\\s\\p{Z}_-]+', '', 'g') " + " ".join(f"WHEN '{v.replace('_', '')}' THEN '{v}'" for v in consensus.VERDICTS) + " END"
_VOTES = f"""SELECT item_id, labeler, arg_max(verdict, {{'t': labeled_at, 'i': annotation_id}}) AS verdict FROM (SELECT item_id, nullif(lower(trim(labeler)), '') AS labeler, {_VERDICT} AS verdict, labeled_at, annotation_id FROM adjudicated_b03
WHERE lower(trim(coalesce(review_status, ''))) <> 'withdrawn') WHERE item_id IS NOT NULL AND labeler IS NOT NULL AND verdict IS NOT NULL GROUP BY item_id, labeler"""

_STEPS = [(b, a) for a, b in look.relations() if len(b) == 1 and len(a) == 1]
_FROM, _TO = "".join(b for b, _ in _STEPS).replace("'", "''"), "".join(a for _, a in _STEPS).replace("'", "''")
_UNSEEN = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(look.unseen()))


def _form(x: str) -> str:
    """A text as it looks: no unseen characters, one line end, plain letters, composed."""
    return f"trim(nfc_normalize(translate(replace(regexp_replace({x}, '[{_UNSEEN}]+', '', 'g'), chr(13) || chr(10), chr(10)), '{_FROM}', '{_TO}')), ' ')"


_WORDS = f"regexp_extract_all(lower({_form('text')}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"

ORACLES: dict[str, str] = {
    "p6_found": f"""WITH t AS (SELECT DISTINCT cache_id, text, {_form('text')} AS f FROM text_cache WHERE text IS NOT NULL AND cache_id IS NOT NULL)
SELECT DISTINCT a.cache_id AS cache_id_a, b.cache_id AS cache_id_b FROM t a JOIN t b ON a.f = b.f AND a.cache_id < b.cache_id AND a.text <> b.text WHERE a.f <> ''""",
    "p7_found": f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM gold_claims WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)), y AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d))
SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (g)""",
    "p1_found": f"""WITH RECURSIVE s AS (SELECT company_id, ticker FROM crawl_documents UNION SELECT company_id, ticker FROM candidates),
e AS (SELECT DISTINCT nullif(trim(company_id), '') AS c, CASE WHEN regexp_full_match(b, '[A-Z]{{3,5}}') AND b NOT IN {(*splits.EXCHANGES, *splits.PLACEHOLDERS)} THEN b END AS t FROM (SELECT company_id, {_BARE} AS b FROM s)),
l AS (SELECT DISTINCT x.c AS a, y.c AS b FROM e x JOIN e y ON x.t = y.t WHERE x.c IS NOT NULL AND y.c IS NOT NULL),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT DISTINCT a AS company_id_a, b AS company_id_b FROM r WHERE a < b""",
    "p2_found": """SELECT DISTINCT unit_id FROM units u LEFT JOIN intake_settings s ON u.settings_id = s.settings_id
WHERE length(u.text) > coalesce(s.chunk_size_chars, (SELECT chunk_size_chars FROM intake_settings WHERE profile = 'default')) AND unit_id IS NOT NULL""",
    "p5_found": f"SELECT item_id, verdict FROM (SELECT item_id, verdict, count(*) AS c, sum(count(*)) OVER (PARTITION BY item_id) AS n FROM ({_VOTES}) GROUP BY item_id, verdict) WHERE n >= 2 AND 2 * c > n",
    "p5_agreement": f"""WITH v AS ({_VOTES}), c AS (SELECT item_id, verdict, count(*) AS k FROM v GROUP BY ALL), i AS (SELECT item_id, sum(k) AS n, sum(k * (k - 1)) AS same FROM c GROUP BY 1 HAVING sum(k) > 1),
t AS (SELECT verdict, sum(k) AS k FROM c WHERE item_id IN (SELECT item_id FROM i) GROUP BY 1), e AS (SELECT sum(k * (k - 1)) / (sum(k) * (sum(k) - 1)) AS e FROM t), o AS (SELECT count(*) AS n_items, sum(n)::BIGINT AS n_pairable, sum(same / (n - 1)) / sum(n) AS o FROM i)
SELECT n_items, n_pairable, round(o, 9) AS observed, round(e, 9) AS expected, round((o - e) / (1 - e), 9) AS alpha FROM o CROSS JOIN e""",
}
