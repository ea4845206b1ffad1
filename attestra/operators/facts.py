"""Figures with the dimensions that their words state, and whether two of them can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import numbers
from attestra.functions import text as tx
from attestra.operators import quantities

# Cue words of each dimension, in folded form; of a dimension's names the first that is present counts.
CHANGE = ("tang", "giam", "cat giam", "tiet kiem", r"reduc[a-z]*", r"decreas[a-z]*", r"increas[a-z]*", "cut", r"lower[a-z]*", "so voi", "compared (?:to|with)", "year[- ]on[- ]year", "yoy", "muc tang", "muc giam")
SHARE = (
    "chiem", "ty trong", "ty le", "tren tong", "trong tong", "cua tong", "tong (?:luong|so|tieu thu)", "share", "proportion", "of (?:total|the total)", "out of", "percent of", "la nang luong",
    "den tu", "duoc cung cap tu", "accounts? for",
)
TARGET = ("muc tieu", "target", "cam ket", "huong toi", "huong den", r"den nam 20[0-9]{2}", r"by 20[0-9]{2}", "phan dau", "ke hoach", "du kien", "se dat", "aim", "goal", "pledge")
INTENSITY = ("cuong do", "intensity", "per (?:tonne|ton|unit|mwh|kwh)", "tren (?:moi )?(?:tan|don vi|san pham|mwh|kwh)", "moi tan")
INTENSITY_SLASH = r"/\s*(?:tan|t|mwh|kwh|san pham|tonne|ton)(?:[^a-z0-9]|$)"
BOUNDARIES = {
    "project": ("du an", "project"),
    "facility": ("nha may", "khu lien hop", "co so san xuat", "co so", "facility", "facilities", "plant", "site", "chi nhanh", "phan xuong"),
    "subsidiary": ("cong ty con", "cong ty thanh vien", "don vi thanh vien", "subsidiary", "subsidiaries", "cong ty tnhh", "cong ty co phan", "ctcp"),
    "group": ("tap doan", "toan tap doan", "hop nhat", "toan he thong", "group", "consolidated", "group-wide", "toan cong ty", "cap tap doan"),
}
TECHNOLOGIES = {
    "dri_eaf": ("dri[- ]?eaf", "dri"), "scrap_eaf": ("scrap[- ]?eaf", "eaf", "lo dien", "lo ho quang", "electric arc"), "bf_bof": ("bf[- ]?bof", "bof", "lo cao", "lo thoi", "blast furnace", "basic oxygen"),
    "solar": ("dien mat troi", "mat troi", "solar", "pv"), "wind": ("dien gio", "wind"), "hydro": ("thuy dien", "hydro"), "biomass": ("sinh khoi", "biomass"),
}
VARIANTS = {
    "non_hazardous": ("khong nguy hai", "non[- ]hazardous"), "hazardous": ("nguy hai", "hazardous"),
    "recovered": ("tai che", "tai su dung", "thu hoi", r"recycl[a-z]*", r"reus[a-z]*", r"recover[a-z]*", "diverted"),
    "disposed": ("thai bo", "tieu huy", "chon lap", "dot", r"landfill[a-z]*", r"incinerat[a-z]*", r"dispos[a-z]*"),
    "renewable": ("tai tao", "renewable", "nang luong sach", "nang luong xanh", "re100"), "grid": ("luoi dien", "luoi", "grid", "evn", "dien mua"),
    "fossil": ("hoa thach", "fossil", "than", "coal", "dau", "oil", "khi dot", "gas"),
}
GROUP_NAME = ("cong ty co phan tap doan", "tap doan")
#: Ratios of two values from which a pair is left to a reader: where a dimension is unknown, and always.
GAP, GAP_ALWAYS = 20.0, 100.0
#: Characters on both sides of a figure in which its dimensions are looked for first.
NEAR = 32


def _has(x: Column, words: tuple[str, ...]) -> Column:
    return x.rlike(tx.whole_words(words))


def _first(x: Column, named: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(_has(x, words), name) for name, words in named.items()))


def _all(x: Column, named: dict[str, tuple[str, ...]]) -> Column:
    return F.array_compact(F.array(*(F.when(_has(x, words), name) for name, words in named.items())))


def facts(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row for each figure of a sentence: the rows' columns, value, kind, half, basis, is_target, boundary, technology, variant, scopes.

    Bare years aren't figures. Dimensions are read from the words around the figure, else from the whole
    sentence; basis and boundary are ``unknown`` where nothing is stated, technology null, variant and
    scopes empty. Null texts and texts without a figure give no row.
    """
    names = ("value", "kind", "half", "basis", "is_target", "boundary", "technology", "variant", "scopes")
    # one figure at a time: each has its own surroundings
    own = rows.drop(*names).withColumn("_t", tx.composed(F.col(text))).withColumn("_f", F.replace(tx.fold(F.col("_t")), F.lit(GROUP_NAME[0]), F.lit(GROUP_NAME[1].rjust(len(GROUP_NAME[0])))))
    own = own.withColumn("_q", F.explode(quantities.quantities(F.col("_t"))))
    near = F.substring(F.col("_f"), F.greatest(F.col("_q.begin") + 1 - NEAR, F.lit(1)), F.col("_q.end") - F.col("_q.begin") + 2 * NEAR)
    own = own.where(~(F.col("_q.kind").isNull() & F.col("_q.value").between(1900, 2100))).withColumn("_w", near)
    share = lambda x: (_has(x, CHANGE), _has(x, SHARE))
    (c, s), (c2, s2) = share(F.col("_w")), share(F.col("_f"))
    one = lambda c, s: F.when(c & ~s, "percentage_change").when(s & ~c, "percentage_share")
    percent = F.when(c & s, "unknown").otherwise(F.coalesce(one(c, s), one(c2, s2), F.lit("unknown")))
    basis = F.when(F.col("_q.kind").isNull(), "unknown").when(F.col("_q.kind") == "share", percent).when(_has(F.col("_f"), INTENSITY) | F.col("_f").rlike(INTENSITY_SLASH), "intensity").otherwise("absolute")
    variant = lambda x: _all(x, VARIANTS)
    return own.select(
        *(x for x in rows.columns if x not in names), F.col("_q.value").alias("value"), F.col("_q.kind").alias("kind"), F.col("_q.half").alias("half"), basis.alias("basis"),
        _has(F.col("_f"), TARGET).alias("is_target"), F.coalesce(_first(F.col("_w"), BOUNDARIES), _first(F.col("_f"), BOUNDARIES), F.lit("unknown")).alias("boundary"),
        F.coalesce(_first(F.col("_w"), TECHNOLOGIES), _first(F.col("_f"), TECHNOLOGIES)).alias("technology"),
        F.array_sort(F.when(F.size(variant(F.col("_w"))) > 0, variant(F.col("_w"))).otherwise(variant(F.col("_f")))).alias("variant"), tx.emission_scopes(F.col("_t")).alias("scopes"),
    )


def eligibility(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct(status, reason) of two facts: NOT_COMPARABLE by the first dimension that differs, AMBIGUOUS, or COMPARABLE.

    ``a`` and ``b`` have value, unit, basis, boundary, technology, variant, scopes and is_target. A
    dimension that one side doesn't state (null, ``unknown``, empty) tells nothing apart but the unit,
    which both must have. A target is never held against an actual, and values far apart are left to a reader.
    """
    known = lambda x: F.when(~x.isin("unknown", ""), x)
    apart = lambda d: F.coalesce(known(a[d]) != known(b[d]), F.lit(False))
    sets = lambda d: F.coalesce((F.size(a[d]) > 0) & (F.size(b[d]) > 0) & (F.array_sort(a[d]) != F.array_sort(b[d])), F.lit(False))
    target = lambda x: F.coalesce(x["is_target"], F.lit(False))
    small, large = F.least(F.abs(a["value"]), F.abs(b["value"])), F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    ratio = F.when(a["value"].isNotNull() & b["value"].isNotNull(), large / F.greatest(small, F.lit(1e-9)))
    unknown = F.greatest(*(known(x[d]).isNull().cast("int") for x in (a, b) for d in ("basis", "boundary"))) == 1
    pair = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    out = F.when(F.coalesce(a["unit"] != b["unit"], F.lit(True)), pair("NOT_COMPARABLE", "different_unit"))
    for d, test in (("basis", apart), ("boundary", apart), ("technology", apart), ("variant", sets), ("scopes", sets)):
        out = out.when(test(d), pair("NOT_COMPARABLE", "different_scope" if d == "scopes" else f"different_{d}"))
    out = out.when(target(a) != target(b), pair("AMBIGUOUS", "target_vs_actual"))
    out = out.when(F.coalesce((ratio >= GAP_ALWAYS) | (unknown & (ratio >= GAP)), F.lit(True)), pair("AMBIGUOUS", "magnitude_gap"))
    return out.otherwise(pair("COMPARABLE", None))


# The dimensions of a read figure that two must share, in the order in which they are compared.
SHARED = ("metric", "value_kind", "status", "period", "scope")


def compare(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct(label, reason): S equal within both printed precisions, C apart or of opposite direction, N not comparable.

    ``a`` and ``b`` have ``SHARED``, baseline_year, boundary, change_direction, value, half and unit (the kind of its
    common unit). A count is an absolute figure; an unspecified boundary fits any; the baseline counts for changes only.
    """
    kind = lambda x: F.when(x["value_kind"] == "count", "absolute").otherwise(F.coalesce(x["value_kind"], F.lit("absolute")))
    status = lambda x: F.coalesce(x["status"], F.lit("actual"))
    view = {"value_kind": kind, "status": status}
    pair = lambda s, r: F.struct(F.lit(s).alias("label"), F.lit(r).cast("string").alias("reason"))
    out = None
    for d in SHARED:
        x, y = (view.get(d, lambda z: z[d])(z) for z in (a, b))
        test = ~x.eqNullSafe(y)
        out = F.when(test, pair("N", d)) if out is None else out.when(test, pair("N", d))
    change = kind(a) == "change"
    place = lambda x: F.coalesce(x["boundary"], F.lit("unspecified"))
    out = out.when(change & ~a["baseline_year"].eqNullSafe(b["baseline_year"]), pair("N", "baseline_year"))
    out = out.when((place(a) != "unspecified") & (place(b) != "unspecified") & (place(a) != place(b)), pair("N", "boundary"))
    out = out.when(a["value"].isNull() | b["value"].isNull(), pair("N", "number")).when(~a["unit"].eqNullSafe(b["unit"]), pair("N", "unit"))
    out = out.when(change & ~a["change_direction"].eqNullSafe(b["change_direction"]), pair("C", "direction"))
    return out.when(F.abs(a["value"] - b["value"]) <= a["half"] + b["half"], pair("S", None)).otherwise(pair("C", None))


def decide(labelled: DataFrame, key: list[str], written: Column | None = None) -> DataFrame:
    """Verdict over all evidence figures of a claim: the one label other than N that its pairs (label, reason) have, else N.

    ``written`` says of a pair that the evidence prints the claim's own number: then a C that rests on no
    opposite direction is left to a reader.
    """
    one = F.count_distinct(F.when(F.col("label") != "N", F.col("label")))
    only = F.max(F.when(F.col("label") != "N", F.col("label")))
    turned = F.bool_or(F.coalesce(F.col("reason") == "direction", F.lit(False)))
    g = labelled.groupBy(*key).agg(one.alias("_n"), only.alias("_l"), turned.alias("_t"), F.bool_or(F.coalesce(written, F.lit(False)) if written is not None else F.lit(False)).alias("_w"), F.count("*").alias("n_pairs"))
    label = F.when(F.col("_n") != 1, "N").when((F.col("_l") == "C") & F.col("_w") & ~F.col("_t"), "N").otherwise(F.col("_l"))
    return g.select(*key, label.alias("label"), "n_pairs")


# Multiplier words that may follow a number.
TIMES = ("nghìn", "ngàn", "thousand", "triệu", "million", "tỷ", "billion")
_NUMBER = r"\d+(?:[.,]\d+)*"


def ground(value_text: Column, multiplier_text: Column, years: dict[str, Column], sentence: Column) -> Column:
    """A reader's figure held to its sentence: struct(value_text, multiplier_text, each of ``years``), null where the number isn't written.

    The number is given as the sentence spells it, with the multiplier that stands right after it ('' for
    none; null result where occurrences differ and the reader's is none of them); a year that the sentence
    doesn't write becomes null.
    """
    read = numbers.locale_number(F.regexp_extract(value_text, _NUMBER, 0))
    inner = F.lower(F.regexp_extract(value_text, rf"{_NUMBER}\s*({'|'.join(TIMES)})", 1))
    said = F.when(F.coalesce(F.trim(multiplier_text), F.lit("")) != "", F.lower(F.trim(multiplier_text))).otherwise(inner)
    spots = F.regexp_extract_all(sentence, F.lit(rf"(?i)({_NUMBER}(?:\s*(?:{'|'.join(TIMES)}))?)"), F.lit(1))
    both = F.transform(spots, lambda s: F.struct(F.regexp_extract(s, _NUMBER, 0).alias("number"), F.lower(F.trim(F.regexp_replace(s, _NUMBER, ""))).alias("times")))
    same = F.filter(both, lambda s: numbers.locale_number(s["number"]) == read)
    exact = F.filter(same, lambda s: s["number"] == F.regexp_extract(value_text, _NUMBER, 0))
    hits = F.when(F.size(exact) > 0, exact).otherwise(same)
    times = F.array_distinct(F.transform(hits, lambda s: s["times"]))
    written = F.transform(tx.years(sentence), lambda y: y.cast("int"))
    found = F.struct(F.get(hits, F.lit(0))["number"].alias("value_text"), F.when(F.array_contains(times, said), said).otherwise(F.get(times, F.lit(0))).alias("multiplier_text"), *(F.when(F.array_contains(written, y), y).alias(n) for n, y in years.items()))
    return F.when((F.size(hits) > 0) & (F.array_contains(times, said) | (F.size(times) == 1)), found)


# Words of a decrease and of an increase, in folded form.
DOWN, UP = ("giam", "cat giam", "ha thap", r"reduc[a-z]*", r"decreas[a-z]*", "fell", "lower"), ("tang", "gia tang", r"increas[a-z]*", "rose", "grew", "higher")


def direction(x: Column) -> Column:
    """Whether a sentence tells of a ``decrease`` or an ``increase``; null for neither or both."""
    t = tx.match_form(x)
    return F.when(_has(t, DOWN) & ~_has(t, UP), "decrease").when(_has(t, UP) & ~_has(t, DOWN), "increase")


def reversed_direction(claim: Column, evidence: Column) -> Column:
    """Whether two sentences tell of opposite directions; false where one tells of none."""
    return F.coalesce(direction(claim) != direction(evidence), F.lit(False))


def unit_hint(x: Column) -> Column:
    """The unit that a heading declares for what stands below it: "(tCO2e)", "Đơn vị: GJ"; null for none."""
    said = F.regexp_extract(x, r"(?i)[(（]\s*(?:đơn vị(?: tính)?\s*[:：]\s*)?(tco2e?|tấn\s*co2e?|co2e|gj|mj|tj|kwh|mwh|gwh|m3|m³|tấn|kg|%)\s*[)）]|đơn vị(?: tính)?\s*[:：]\s*(tco2e?|gj|mj|tj|kwh|mwh|gwh|m3|m³|tấn|kg|%)", 0)
    return F.nullif(F.lower(F.regexp_replace(said, r"(?i)đơn vị(?: tính)?|[()（）:：\s]", "")), F.lit(""))


def page_frame(lines: DataFrame, key: list[str], order: str, line: str = "line") -> DataFrame:
    """Of each page the unit that its first hint declares and the year it names most often (of equally frequent ones the latest)."""
    hint = unit_hint(F.col(line))
    unit = lines.groupBy(*key).agg(F.min_by(hint, F.when(hint.isNotNull(), F.col(order))).alias("page_unit"))
    # counted by year before a page's years come together
    years = lines.select(*key, F.explode(tx.years(F.col(line))).alias("year")).groupBy(*key, "year").agg(F.count("*").alias("n"))
    period = years.groupBy(*key).agg(F.max_by("year", F.struct("n", "year")).alias("page_period"))
    return unit.join(period, key, "left")


def scope_parts(figures: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """The largest total of each key against parts of different scopes: key, total, parts_sum, parts, foots.

    ``figures``: key, value, scopes (sorted array), is_total. Parts are taken greedily, those of fewest
    scopes first, then the smallest scopes and the larger value, and never two that share a scope; a key
    has at most the seven sets of three scopes to choose from, of each the largest value.
    """
    total = figures.where("is_total").groupBy(*key).agg(F.max("value").alias("total"))
    best = figures.where(~F.col("is_total") & (F.size("scopes") > 0)).groupBy(*key, "scopes").agg(F.max("value").alias("value"))
    listed = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.size("scopes").alias("n"), "scopes", "value"))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def take(acc: Column, p: Column) -> Column:
        free = ~F.arrays_overlap(acc["used"], p["scopes"])
        return F.struct(F.when(free, F.concat(acc["used"], p["scopes"])).otherwise(acc["used"]).alias("used"), (acc["sum"] + F.when(free, p["value"]).otherwise(0.0)).alias("sum"), (acc["n"] + F.when(free, 1).otherwise(0)).alias("n"))

    summed = total.join(listed, key).withColumn("x", F.aggregate("all", start, take))
    return summed.where("x.n >= 2").select(*key, "total", F.col("x.sum").alias("parts_sum"), F.col("x.n").alias("parts"), (F.abs(F.col("total") - F.col("x.sum")) <= tolerance).alias("foots"))
