"""Rows for review and training sets: figures of tables, claim sentences, altered figures, filters of what is worth labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import numbers
from attestra.functions import text as tx
from attestra.operators import facts, lexicon

# A label with a number after it, names of total rows (folded), and the shortest and longest claim sentence.
LABEL_VALUE = r"([^\n|]{2,70}?)\s*[:|]?\s+(\d[\d.,]{2,})(?:\D|$)"
TOTALS = ("tong cong", "cong", "tong", "total", "grand total", "sum")
SENTENCE_CHARS = (25, 500)
LABEL_WORDS = 7
AFTER = r"^\s*((?:nghìn|ngàn|triệu|tỷ|thousand|million|billion)\s+)?(tco2e?|tấn\s*co2e?|co2e|gj|mj|tj|kwh|mwh|gwh|m3|m³|tấn|kg|%)(?:[^\p{L}\p{N}]|$)"
MULTIPLIERS = {"nghìn": 1e3, "ngàn": 1e3, "thousand": 1e3, "triệu": 1e6, "million": 1e6, "tỷ": 1e9, "billion": 1e9}


def trimmed_label(raw: Column, terms: tuple[str, ...], words: int = LABEL_WORDS) -> Column:
    """The longest tail of at most ``words`` words that names an indicator, a scope or a total; null for none.

    Text before the last end of a sentence doesn't belong to the label.
    """
    last = F.element_at(F.split(raw, r"[.!?;]\s+"), -1)
    w = F.filter(F.split(F.regexp_replace(last, r"^[\s.·–—|:-]+|[\s.·–—|:-]+$", ""), r"\s+"), lambda x: x != "")
    tails = F.transform(F.sequence(F.least(F.size(w), F.lit(words)), F.lit(1)), lambda n: F.array_join(F.slice(w, F.size(w) - n + 1, n), " "))

    def names(t: Column) -> Column:
        m = tx.match_form(t)
        return tx.any_of([F.contains(m, F.lit(x)) for x in terms]) | m.rlike(r"(?:scope|pham vi)\s*[123]") | m.isin(*TOTALS)

    return F.when(F.size(w) > 0, F.get(F.filter(tails, names), F.lit(0)))


def disclosed(lines: DataFrame, key: list[str], terms: tuple[str, ...], frame: DataFrame | None = None, line: str = "line") -> DataFrame:
    """Figures that stand behind a label on a line: key, line, label, value, unit, period, is_total.

    The unit stands behind the value, in the label, or is the page's (``frame``: key, page_unit, page_period), the
    period is the last year of the line or the page's. Labels without an indicator, figures without a
    unit and years are left out. Null lines give nothing.
    """
    own = lines.where(F.col(line).isNotNull())
    own = own if frame is None else own.join(frame, key, "left")
    of_page = (F.col("page_unit"), F.col("page_period")) if frame is not None else (F.lit(None).cast("string"),) * 2
    all_ = F.arrays_zip(F.regexp_extract_all(line, F.lit(LABEL_VALUE), F.lit(1)).alias("label"), F.regexp_extract_all(line, F.lit(LABEL_VALUE), F.lit(2)).alias("raw"))
    # what stands right behind a value
    one = own.withColumn("_x", F.explode(all_)).withColumn("_rest", F.substring(F.get(F.split(F.col(line), F.concat(F.lit(r"\Q"), F.col("_x.raw"), F.lit(r"\E"))), F.lit(1)), 1, 24))
    after = lambda g: F.nullif(F.lower(F.trim(F.regexp_extract(F.lower("_rest"), AFTER, g))), F.lit(""))
    times = F.coalesce(*(F.when(after(1) == w, f) for w, f in MULTIPLIERS.items()), F.lit(1.0))
    label = trimmed_label(F.col("_x.label"), terms)
    unit = F.coalesce(after(2), facts.unit_hint(F.col("_x.label")), of_page[0])
    out = one.select(*key, line, label.alias("label"), numbers.locale_number(F.col("_x.raw")).alias("v"), times.alias("t"), unit.alias("unit"), F.coalesce(tx.last_year(F.regexp_replace(F.col(line), r"\d[\d.,]{4,}", " ")), of_page[1]).alias("period"))
    year = out["v"].between(1900, 2100) & out["unit"].isNull()
    return out.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~year & F.col("unit").isNotNull()).select(*key, line, "label", (F.col("v") * F.col("t")).alias("value"), "unit", "period", tx.match_form(F.col("label")).isin(*TOTALS).alias("is_total"))


def claim_sentences(docs: DataFrame, types: list[lexicon.Bucket]) -> DataFrame:
    """Distinct sentences of (doc_id, text) with what the rules say of them: id, doc_id, text, rule_label, rule_reason, lexicon_hit, has_figure.

    A sentence is known by its matching form; of equal ones that of the smallest doc_id and place stands.
    rule_label is 1 for a lexicon hit without a reason against it; a bare year is no figure.
    """
    low, high = SENTENCE_CHARS
    rows = docs.select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("text"))
    rows = rows.where(F.length("text").between(low, high)).withColumn("id", F.substring(F.sha1(tx.match_form(F.col("text"))), 1, 16))
    first = rows.groupBy("id").agg(F.min(F.struct("doc_id", "pos", "text")).alias("x")).select("id", "x.doc_id", "x.text")
    marked = first.withColumns({"m": tx.match_form(F.col("text")), "reason": F.coalesce(tx.heading_reason(F.col("text")), F.lit(""))})
    hit = lexicon.best_bucket(F.col("m"), types).isNotNull()
    figure = F.regexp_replace("text", tx.YEAR, "").rlike(r"\d")
    return marked.select("id", "doc_id", "text", (hit & (F.col("reason") == "")).cast("int").alias("rule_label"), F.col("reason").alias("rule_reason"), hit.cast("int").alias("lexicon_hit"), figure.cast("int").alias("has_figure"))


# The next larger multiplier, the scope that takes a scope's place, and factors of changed values.
NEXT_TIMES = {"": "nghìn", "nghìn": "triệu", "triệu": "tỷ"}
OTHER_SCOPE = {"s1": "s1+s2", "s1+s2": "s1", "s2": "s1", "s3": "s1+s2+s3"}
FACTORS = (0.7, 0.8, 1.25, 1.4)
ALTERED = ("value", "multiplier_text", "change_direction", "period", "status", "scope", "boundary", "value_kind", "unit_text", "metric")


def figure_variants(rows: DataFrame, neighbours: dict[str, str]) -> DataFrame:
    """Families of altered figures with the label they must get: the key quantity_id, family, label and the altered columns ``ALTERED``.

    S0 as it is, S1 rounded to one decimal of thousands or millions; C1 another value (percent 15 points
    off, else one of four factors by the key), C2 the next multiplier, C3 the other direction; N1 the year
    before, N2 target for actual and the reverse, N3 another scope, N4 the group for a facility, N5 per
    tonne of product, N6 a neighbouring metric. A family that doesn't apply to a figure is left out.
    """
    c = {n: F.col(n) for n in ALTERED}
    kind = F.coalesce(c["value_kind"], F.lit("absolute"))
    times = F.lower(F.coalesce(c["multiplier_text"], F.lit("")))
    percent = F.trim(F.coalesce(c["unit_text"], F.lit(""))) == "%"
    scale = F.when(c["value"] >= 1e6, 1e6).otherwise(1e3)
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), (F.pmod("quantity_id", F.lit(4)) + 1).cast("int"))
    amount = kind.isin("absolute", "count")
    pick = lambda x, table: F.coalesce(*(F.when(x == k, v) for k, v in table.items()))

    def make(family: str, when: Column | None = None, **new: Column) -> Column:
        x = F.struct(F.lit(family).alias("family"), F.lit(family[0]).alias("label"), *(new.get(n, c[n]).cast("double" if n == "value" else "int" if n == "period" else "string").alias(n) for n in ALTERED))
        return x if when is None else F.when(when, x)

    families = F.array(
        make("S0"),
        make("S1", (amount | (kind == "intensity")) & (times == "") & (c["value"] >= 10_000), value=F.round(c["value"] / scale, 1), multiplier_text=F.when(c["value"] >= 1e6, "triệu").otherwise("nghìn")),
        make("C1", value=F.when(percent, F.when(c["value"] <= 80, c["value"] + 15).otherwise(c["value"] - 15)).otherwise(c["value"] * factor)),
        make("C2", amount & (c["value"] != 0) & times.isin(*NEXT_TIMES) & ~percent, multiplier_text=pick(times, NEXT_TIMES)),
        make("C3", (kind == "change") & c["change_direction"].isin("decrease", "increase"), change_direction=F.when(c["change_direction"] == "decrease", "increase").otherwise("decrease")),
        make("N1", c["period"].isNotNull(), period=c["period"] - 1),
        make("N2", status=F.when(c["status"] == "target", "actual").otherwise("target"), period=F.when(c["status"] == "target", None).when(F.coalesce(c["period"], F.lit(0)) < 2026, 2030).otherwise(c["period"])),
        make("N3", (c["metric"] == "ghg_emissions") & c["scope"].isNotNull(), scope=F.coalesce(pick(c["scope"], OTHER_SCOPE), F.lit("s1"))),
        make("N4", c["boundary"] == "facility", boundary=F.lit("group")),
        make("N5", (kind == "absolute") & (F.trim("unit_text") != "") & ~F.contains("unit_text", F.lit("/")) & ~percent, value_kind=F.lit("intensity"), unit_text=F.concat("unit_text", F.lit("/tấn sản phẩm"))),
        make("N6", c["metric"].isin(*neighbours), metric=pick(c["metric"], neighbours)),
    )
    return rows.where("quantity_id is not null and value is not null").select("quantity_id", F.explode(F.array_compact(families)).alias("x")).select("quantity_id", "x.*")


def prose(x: Column) -> Column:
    """Whether a text reads as a sentence: 45 characters and 8 words or more, at most 60 % of them capitalised; false for null."""
    w = F.filter(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+"), lambda t: t != "")
    big = F.size(F.filter(w, lambda t: t.rlike(r"^\p{Lu}")))
    return F.coalesce((F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) >= 45) & (F.size(w) >= 8) & (big <= 0.6 * F.size(w)), F.lit(False))


def on_topic(x: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text has a word that begins with one of the terms."""
    return F.coalesce(F.lower(x).rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(terms) + ")"), F.lit(False))


def usable(pairs: DataFrame, head: int = 80) -> DataFrame:
    """Pairs (claim_text, claim_year, evidence_text, evidence_year) without those whose evidence holds the claim's beginning or came later."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    own = F.coalesce(F.contains(flat("evidence_text"), F.nullif(F.substring(flat("claim_text"), 1, head), F.lit(""))), F.lit(False))
    later = F.coalesce(F.col("evidence_year") > F.col("claim_year"), F.lit(False))
    return pairs.where(F.col("evidence_text").isNotNull() & ~own & ~later)


def other_year(sentence: Column, period: Column, baseline: Column) -> Column:
    """The years that a sentence is about where none is the claim's period or baseline, joined by ``/``; null otherwise."""
    y = F.array_sort(F.array_distinct(tx.years(sentence)))
    own = F.coalesce(F.array_contains(y, period.cast("string")), F.lit(False)) | F.coalesce(F.array_contains(y, baseline.cast("string")), F.lit(False))
    return F.when(period.isNotNull() & (F.size(y) > 0) & ~own, F.array_join(y, "/"))


def metric_sentences(x: Column, terms: tuple[str, ...]) -> Column:
    """The sentences of a passage that name one of the terms (folded), all of them without terms; a passage without sentences is one."""
    s = tx.split_sentences(x)
    all_ = F.when(F.size(s) > 0, s).otherwise(F.array(x))
    return F.filter(all_, lambda t: tx.any_of([F.contains(tx.match_form(t), F.lit(w)) for w in terms])) if terms else all_


# Words that date a figure, before its year.
DATED = r"(?:^|[^\p{L}])(?:năm|giai đoạn|niên độ|kỳ|đến hết|tính đến|so với|trong|tháng)[^\n.;\p{L}][^\n.;]{0,25}?"


def defect(sentence: Column, metric: Column, period: Column, metric_text: Column, unit_text: Column) -> Column:
    """Why a figure can't be a case: another metric, a year that the sentence doesn't date, a digit in the metric's name, a unit that is none; null for a good one."""
    dated_in = F.coalesce(F.lower(sentence), F.lit(""))
    dated = F.regexp_like(dated_in, F.concat(F.lit(DATED), period.cast("string")))
    return (
        F.when(metric == "other_env", "other_env").when(period.isNotNull() & ~dated, "period_not_dated").when(F.coalesce(metric_text, F.lit("")).rlike(r"\d"), "metric_has_digit")
        .when(F.lower(F.trim(unit_text)) == "đơn vị", "unit_placeholder")
    )


def slot_verdicts(claims: DataFrame, mapped: DataFrame) -> DataFrame:
    """Verdict of each claim from its slots (claim_id, slot, value, half, kind, sign) and what they map to (claim_id, slot, type, part, value, half, kind).

    ``direct``: equal within both precisions, N for another kind; ``sum``: against the sum of its parts;
    ``change``: percent from part 1 to part 2, with the slot's sign; no mapping or a part without value is N.
    One C makes the claim C, S needs all slots; a claim without slots has no row.
    """
    parts = mapped.groupBy("claim_id", "slot").agg(
        F.first("type").alias("type"), F.sum("value").alias("total"), F.sum("half").alias("halves"), F.min("kind").alias("part_kind"), F.count("value").alias("n"), F.count("*").alias("all"),
        F.min_by("value", "part").alias("a"), F.max_by("value", "part").alias("b"),
    )
    both = claims.join(parts, ["claim_id", "slot"], "left")
    near = lambda x, y, tol: F.when(F.abs(x - y) <= tol, "S").otherwise("C")
    percent = (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)) * 100
    whole = F.col("n") == F.col("all")
    one = (
        F.when((F.col("type") == "direct") & whole & (F.col("n") == 1), F.when(F.col("kind") != F.col("part_kind"), "N").otherwise(near(F.col("value"), F.col("total"), F.col("half") + F.col("halves"))))
        .when((F.col("type") == "sum") & whole, near(F.col("value"), F.col("total"), F.col("half") + F.col("halves")))
        .when((F.col("type") == "change") & whole & (F.col("n") == 2) & percent.isNotNull(), near(percent, F.col("value") * F.coalesce(F.nullif(F.col("sign"), F.lit(0)), F.lit(1)), F.col("half") + 0.05))
        .otherwise("N")
    )
    return both.withColumn("one", one).groupBy("claim_id").agg(F.when(F.bool_or(F.col("one") == "C"), "C").when(F.bool_and(F.col("one") == "S"), "S").otherwise("N").alias("label"), F.count("*").alias("n_slots"))


def prominence(page: Column, front: int = 20, scores: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:
    """Score of a place in a document: of the first ``front`` pages, of later ones, and of an unknown page."""
    return F.when(page.isNull(), scores[2]).when(page <= front, scores[0]).otherwise(scores[1])


def case_grid(companies: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row for each company_id and type of case."""
    return companies.where("company_id is not null").select("company_id").distinct().select("company_id", F.explode(F.array(*map(F.lit, types))).alias("case_type"))


def first_roles(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each instrument, that of the first role, with all its roles in order."""
    cols = [F.col(x) for x in rows.columns]
    g = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*cols), F.struct(order, *(x.cast("string") for x in cols))).alias("r"), F.count("*").alias("n_roles"))
    return g.select("r.*", "n_roles")


def newest_instruments(rows: DataFrame, n: int) -> DataFrame:
    """The n instruments that came into force last, of equal dates the smaller ids; those without a date come last."""
    return rows.orderBy(F.desc_nulls_last("effective_from"), "id").limit(n)


def codebook_version(text: str) -> str:
    """The version of labelling conventions: the first twelve hex digits of their SHA-256."""
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:12]
