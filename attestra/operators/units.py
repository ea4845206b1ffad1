"""The same quantity recorded in different units and scales, brought to common units.

A record's number, multiplier and unit are read from its fields or from the sentence around them.
Several readings of one record, and units that are not stated, are decided by identities that the
true values obey: recorded value = printed number x multiplier, mass = density x volume, and so on.
The combination of units with the smallest log residual wins; where the runner-up does as well, the
result is flagged as not unique.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.runtime import cut

# Spellings of units by kind, with the factor to the common unit that is named first.
UNITS: dict[str, tuple[str, dict[float, tuple[str, ...]]]] = {
    "mass": ("kg", {
        0.001: ("g", "gram", "grams", "gam"),
        1.0: ("kg", "kilogram", "kilograms", "kilogramme", "ki lô gam", "kilôgam"),
        10.0: ("yến",),
        100.0: ("tạ", "ta", "quintal", "quintals"),
        1000.0: ("tấn", "tan", "t", "ton", "tons", "tonne", "tonnes", "metric ton", "metric tons", "mt"),
        1e6: ("kt", "kilotonne", "kilotonnes", "kiloton", "kilotons"),
    }),
    "energy": ("kWh", {
        0.001: ("wh",),
        1.0: ("kwh", "kilowatt giờ", "kilowatt-giờ", "kilowatt hour", "kilowatt hours", "kilowatt-hours"),
        1e3: ("mwh", "megawatt giờ", "megawatt hours"),
        1e6: ("gwh", "gigawatt giờ", "gigawatt hours"),
        1e9: ("twh",),
        1 / 3600: ("kj", "kilojoule", "kilojoules"),
        1 / 3.6: ("mj", "megajoule", "megajoules"),
        1e3 / 3.6: ("gj", "gigajoule", "gigajoules"),
        1e6 / 3.6: ("tj", "terajoule", "terajoules"),
        11630.0: ("toe", "tấn dầu quy đổi", "tấn dầu tương đương", "tonnes of oil equivalent"),
        11.63e6: ("ktoe",),
    }),
    "volume": ("m3", {
        1e-6: ("ml", "mililít", "millilitres"),
        0.001: ("l", "lít", "lit", "litre", "litres", "liter", "liters"),
        1.0: ("m3", "m³", "m^3", "khối", "mét khối", "met khoi", "cubic metre", "cubic metres", "cubic meter", "cubic meters", "cbm"),
        1000.0: ("ML", "megalitre", "megalitres", "megaliter", "megaliters"),
    }),
    "area": ("m2", {
        1.0: ("m2", "m²", "m^2", "mét vuông", "square metre", "square metres", "square meters"),
        1e4: ("ha", "hecta", "héc-ta", "héc ta", "hectare", "hectares"),
        1e6: ("km2", "km²", "km^2", "ki lô mét vuông", "square kilometres", "square kilometers"),
    }),
    "share": ("%", {
        1.0: ("%", "percent", "per cent", "phần trăm", "pct"),
        0.1: ("‰", "per mille", "phần nghìn", "phần ngàn"),
    }),
}
# What marks a mass as one of greenhouse gas, and multiplier words.
GAS = ("co2e", "co2-e", "co2 e", "co2eq", "co2-eq", "co2 eq", "co2 tương đương", "co2 equivalent", "co₂e", "co2tđ")
MULTIPLIERS = {
    1e3: ("nghìn", "ngàn", "thousand", "k", "nghin", "ngan"),
    1e6: ("triệu", "million", "millions", "mn", "mio", "trieu"),
    1e9: ("tỷ", "tỉ", "billion", "billions", "bn", "ty"),
}
# What follows a multiplier word that is part of another word (a ratio, a share).
NOT_TIMES = "lệ|số|trọng|suất"
#: Two amounts are the same within this share of the larger.
TOLERANCE = 0.005
#: Largest log residual at which a printed number is the recorded value.
MATCH = 0.002
_BLANK = r"[ \u00a0\u2000-\u200a\u202f\u205f\u3000]"
NUMBER = rf"\d{{1,3}}(?:{_BLANK}\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)*"


def tidy(text: str | None) -> str:
    """Composed characters, one blank for each run of blanks, no unseen characters."""
    if not text:
        return ""
    if text.isascii() and text.isprintable():
        return text.strip() if "  " not in text else " ".join(text.split())
    t = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", t).strip()


def parse_number(text: str) -> float | None:
    """A number in Vietnamese, English or plain notation.

    Blanks group digits. Of two kinds of separators the last is the decimal one, a repeated one groups.
    A single separator with exactly three digits after it groups thousands, unless a zero or blanks
    stand before it.
    """
    t = re.sub(r"\s", " ", text.strip()).replace("−", "-")
    m = re.fullmatch(rf"([+-]?)({NUMBER})", t)
    if not m:
        return None
    spaced = " " in m.group(2)
    digits = m.group(2).replace(" ", "")
    seps = [c for c in digits if c in ".,"]
    decimal = ""
    if len(set(seps)) == 2:
        decimal = seps[-1] if seps.count(seps[-1]) == 1 else ""
    elif len(seps) == 1:
        head, tail = re.split(r"[.,]", digits)
        if len(tail) != 3 or spaced or not head.lstrip("0") or len(head) > 3:
            decimal = seps[0]
    out = "".join("." if c == decimal and decimal else c for c in digits if c not in ".," or c == decimal)
    try:
        return float(m.group(1) + out)
    except ValueError:
        return None


@cache
def _spellings() -> dict[str, tuple[str, float]]:
    out: dict[str, tuple[str, float]] = {}
    for kind, (_, by_factor) in UNITS.items():
        for factor, names in by_factor.items():
            for name in names:
                out[name] = (kind, factor)
    for factor, names in UNITS["mass"][1].items():
        for name in names:
            for gas in GAS:
                for between in ("", " "):
                    out[f"{name}{between}{gas}"] = ("co2e", factor)
    return out


@cache
def _multipliers() -> dict[str, float]:
    return {name: factor for factor, names in MULTIPLIERS.items() for name in names}


@cache
def _pattern() -> re.Pattern:
    """[multiplier] unit [/ unit [of product]] at the place where it is matched."""
    names = "|".join(re.escape(x) for x in sorted({n.lower() for n in _spellings()}, key=len, reverse=True))
    words = "|".join(sorted(_multipliers(), key=len, reverse=True))
    end = r"(?![\w²³₂])"
    return re.compile(rf"\s*((?:(?:{words})(?!\w)(?!\s*(?:{NOT_TIMES})\b)\s*)*)(?:({names}){end}(?:\s*(?:/|per\b|trên mỗi|mỗi)\s*({names}){end}(?:\s*(?:sản phẩm|of product|product|sp)\b)?)?)?", re.I)


def _one(name: str) -> tuple[str, float]:
    table = _spellings()
    return table["ML"] if name in ("ML", "Ml") else table[name.lower()]


def read_unit(text: str, at: int = 0) -> tuple[float, str | None, float] | None:
    """(multiplier, kind, factor) that stand at a place of a tidy text; kind is None where only a multiplier does.

    A unit over another is a kind of its own, per the denominator's 1000 common units where that is a mass.
    """
    m = _pattern().match(text, at)
    if not m or m.end() == at:
        return None
    times = math.prod(_multipliers()[w] for w in m.group(1).lower().split())
    if not m.group(2):
        return (times, None, 1.0) if m.group(1) else None
    kind, factor = _one(m.group(2))
    if m.group(3):
        below, under = _one(m.group(3))
        kind, factor = f"{kind}/{below}", factor / under * (1000.0 if below == "mass" else 1.0)
    return times, kind, factor


def whole_unit(text: str) -> tuple[float, str | None, float] | None:
    got = read_unit(text)
    return got if got and _pattern().match(text).end() == len(text) else None


@lru_cache(1 << 16)
def spelt(field: str | None) -> tuple[float, str | None, float] | None:
    """``whole_unit`` of a field; the spellings in use are few."""
    unit = tidy(field)
    return whole_unit(unit) if unit else None


_NUMBERS = re.compile(rf"(?<![\w.,])(?:{NUMBER})(?![\w]*\d)")
_HEADER = re.compile(r"\(\s*(?:đơn vị(?: tính)?|đvt|unit|units|in)\s*[:：]?\s*([^()]*)\)", re.I)


def readings(sentence: str) -> list[tuple[float, float, str | None, float]]:
    """(number, multiplier, kind, factor) of each number of a tidy sentence; a header gives the unit to bare ones."""
    header = None
    for m in _HEADER.finditer(sentence):
        header = header or whole_unit(m.group(1).strip())
    out = []
    for m in _NUMBERS.finditer(sentence):
        value = parse_number(m.group())
        if value is None:
            continue
        unit = read_unit(sentence, m.end())
        if unit is None or unit[1] is None:
            unit = header if header and unit is None else (unit[0] if unit else 1.0, header[1] if header else None, header[2] if header else 1.0)
        out.append((value, *unit))
    return out


def _same(a: float, b: float) -> bool:
    return a == b or (a * b > 0 and abs(math.log(a / b)) < 1e-9)


Reading = tuple[float, str, str]


def text_figure(value_text: str | None, unit_text: str | None, multiplier_text: str | None, sentence: str | None) -> list[Reading]:
    """Readings (amount, kind, where the unit stood) of a figure as text; several where the sentence allows them."""
    value = tidy(value_text)
    own, outer = spelt(unit_text), spelt(multiplier_text)
    factor = outer[0] if outer else 1.0
    m = re.match(rf"[+\-−]?(?:{NUMBER})", value)
    number = parse_number(m.group()) if m else None
    if number is None:
        if value:
            return []
        found = [r for r in readings(tidy(sentence)) if r[2]]
        return [(n * t * f, k, "sentence") for n, t, k, f in found] if len(found) == 1 else []
    inner = read_unit(value, m.end())
    if own and own[1]:
        return [(number * factor * own[0] * (inner[0] if inner else 1.0) * own[2], own[1], "field")]
    given = [x[0] for x in (inner, own, outer) if x and x[0] != 1.0]
    if inner and inner[1]:
        return [(number * (given[0] if given else 1.0) * inner[2], inner[1], "value")]
    if outer and outer[1]:
        return [(number * (given[0] if given else 1.0) * outer[2], outer[1], "multiplier")]
    out = []
    for n, t, k, f in readings(tidy(sentence)):
        if k and _same(n, number):
            out.append((number * (given[0] if given else t) * f, k, "sentence"))
    return list(dict.fromkeys(out))


def number_figure(value: float | None, unit: str | None, sentence: str | None) -> list[Reading]:
    """Readings of a recorded value, which includes any multiplier.

    Without a unit, the identity value = printed number x multiplier picks the number of the sentence,
    and with it the unit: those of the smallest log residual, if that is under ``MATCH``.
    """
    if value is None or value != value:
        return []
    own = spelt(unit)
    if own and own[1]:
        return [(value * own[0] * own[2], own[1], "field")]
    found = []
    for n, t, k, f in readings(tidy(sentence)):
        if k:
            residual = 0.0 if n * t == value else (abs(math.log(n * t / value)) if n * t * value > 0 else math.inf)
            found.append((residual, value * f, k))
    if not found or min(found)[0] > MATCH:
        return []
    least = min(found)[0]
    return list(dict.fromkeys((a, k, "sentence") for r, a, k in found if r <= least + 1e-9))


OUT = "quantity_id long, company_id string, subject_text string, metric string, period int, readings array<struct<amount:double,kind:string,read_from:string>>"
_KEYS = ("quantity_id", "company_id", "subject_text", "metric", "period")


def _read(rows: DataFrame, fields: tuple[str, ...], reader) -> DataFrame:
    own = rows.select(*(F.col(k) for k in _KEYS), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("amount", pa.float64()), ("kind", pa.string()), ("read_from", pa.string())]))
        for batch in batches:
            columns = [batch.column(5 + i).to_pylist() for i in range(len(fields))]
            got = [[dict(zip(("amount", "kind", "read_from"), r)) for r in reader(*x)] for x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got, kind)], names=[*_KEYS, "readings"])

    return own.mapInArrow(run, OUT)


def amounts(ir_figures: DataFrame, numeric_facts: DataFrame) -> DataFrame:
    """quantity_id, company_id, subject_text, metric, period, amount, kind, common_unit, read_from, is_unique.

    One row for each distinct record with a quantity_id. Amounts are in the common unit of their kind;
    null where no number or no unit can be read. Of several readings of a record the one with the
    smallest log residual to the sure amounts of the same company, subject, metric and period is taken;
    is_unique is false where none is nearest. Other columns are ignored.
    """
    both = _read(ir_figures, ("value_text", "unit_text", "multiplier_text", "sentence"), text_figure).unionByName(
        _read(numeric_facts, ("value", "unit", "sentence"), number_figure)
    )
    # written once: both the sure and the open records are taken from it
    rows = cut(both.where("quantity_id is not null").distinct())
    rows = rows.select(*_KEYS, F.size("readings").alias("n"), F.explode_outer("readings").alias("r")).select(*_KEYS, "n", "r.*")
    key = ["company_id", "subject_text", "metric", "period"]
    sure, open_ = rows.where("n <= 1"), rows.where("n > 1")
    near = open_.join(sure.select(*key, "kind", F.col("amount").alias("other")).where("amount is not null").distinct(), [*key, "kind"], "left")
    near = near.withColumn("residual", F.when(F.col("amount") * F.col("other") > 0, F.abs(F.log(F.col("amount") / F.col("other")))))
    best = near.groupBy(*_KEYS, "n", "amount", "kind", "read_from").agg(F.min("residual").alias("residual"))
    least = best.groupBy("quantity_id").agg(
        F.min_by(F.struct(*key, "amount", "kind", "read_from"), F.struct(F.coalesce("residual", F.lit(math.inf)), "amount", "kind")).alias("x"),
        F.sort_array(F.collect_list(F.coalesce("residual", F.lit(math.inf)))).alias("all"),
    )
    chosen = least.select("quantity_id", "x.*", (F.col("all")[0] + 1e-6 < F.col("all")[1]).alias("is_unique"))
    out = sure.withColumn("is_unique", F.col("amount").isNotNull()).drop("n").unionByName(chosen)
    common = reduce(lambda c, k: F.when(F.col("kind") == k, UNITS[k][0]).otherwise(c), UNITS, F.when(F.col("kind") == "co2e", "kgCO2e").when(F.col("kind") == "co2e/mass", "kgCO2e/t"))
    return out.select(*_KEYS, "amount", "kind", common.alias("common_unit"), "read_from", "is_unique")


def same_amounts(read: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(quantity_id_a, quantity_id_b), a < b, of one key and kind whose amounts differ by ``tolerance`` of the larger at most.

    An amount that isn't unique is not known and matches nothing; ``amounts`` flags it.

    Amounts meet in logarithmic bands, so that a group of many records makes no more pairs than match.
    Records with a null key, kind or amount match nothing.
    """
    key = ["company_id", "subject_text", "metric", "period", "kind"]
    width = -math.log(1 - tolerance) * 1.0001
    band = F.when(F.col("amount") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("amount")) / width))
    own = read.where("is_unique").dropna(subset=[*key, "amount"]).select("quantity_id", *key, "amount", F.signum("amount").cast("int").alias("sign"), band.alias("band")).distinct()
    a = own.select(*key, "sign", "band", F.col("quantity_id").alias("quantity_id_a"), F.col("amount").alias("x"))
    b = own.select(*key, "sign", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), F.col("quantity_id").alias("quantity_id_b"), F.col("amount").alias("y"))
    near = F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest(F.abs("x"), F.abs("y")) * (1 + 1e-12)
    return a.join(b, [*key, "sign", "band"]).where(near & (F.col("quantity_id_a") < F.col("quantity_id_b"))).select("quantity_id_a", "quantity_id_b").distinct()


def infer_units(rows: DataFrame, by: str, columns: dict[str, dict[str, float]], identity: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """The units that each source used for columns that obey an identity, from the values alone.

    ``columns`` has each column's possible units with their factors, ``identity`` the exponents e of
    prod(column ** e) = 1 in common units, such as {"mass": 1, "density": -1, "volume": -1}. Each
    combination of units has for each source the median of its absolute log residual. Result: by, one
    <column>_unit each, residual, runner_up, is_unique (false where the runner-up is within
    ``tolerance``), n_rows. Rows with a null or with values of zero or below in a column say nothing; a
    source with no other rows has no result. Work is one pass and one aggregate of fixed width.
    """
    names = list(columns)
    combos = list(itertools.product(*(columns[n].items() for n in names)))
    log: Column = reduce(lambda a, b: a + b, (F.log(F.col(n)) * float(identity[n]) for n in names))
    good = reduce(lambda a, b: a & b, (F.col(n) > 0 for n in names))
    base = rows.select(F.col(by).alias("_by"), *names).where(good).select("_by", log.alias("r"))
    shifts = [sum(identity[n] * math.log(f) for n, (_, f) in zip(names, c)) for c in combos]
    grid = base.groupBy("_by").agg(F.count("*").alias("n_rows"), F.percentile_approx("r", 0.5, 10000).alias("m"))
    cells = F.array(*(F.struct(F.abs(F.col("m") + s).alias("residual"), *(F.lit(u).alias(f"{n}_unit") for n, (u, _) in zip(names, c))) for s, c in zip(shifts, combos)))
    out = grid.withColumn("x", F.array_sort(cells)).select(
        F.col("_by").alias(by), *(F.col("x")[0][f"{n}_unit"].alias(f"{n}_unit") for n in names), F.col("x")[0]["residual"].alias("residual"),
        (F.get("x", F.lit(1))["residual"] if len(combos) > 1 else F.lit(None).cast("double")).alias("runner_up"), "n_rows",
    )
    return out.withColumn("is_unique", F.coalesce(F.col("runner_up") - F.col("residual") > tolerance, F.lit(True)))
