"""Quantities written in a sentence, and text with its figures masked.

What only looks like a figure (labels and numbers chained to them, document numbers, item and heading
numbers) is blanked first, all in one pattern and without changing the length of the text; every
number that is left is a figure. Both steps need the text's own places, so they run as an Arrow
function, which sentences without a digit never reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators import units

# Words after which a number is a label, words that chain further labels to it, both in folded
# form, the longest stretch between chained labels, and the names of currencies.
LABELS = (
    "pham vi", "scope", "tier", "category", "cat", "iso", "tcvn", "qcvn", "gri", "sdg", "sasb", "dieu", "khoan", "muc", "phu luc", "chuong", "phan", "bang", "hinh", "trang",
    "thuyet minh", "chu thich", "ghi chu", "section", "article", "clause", "table", "figure", "fig", "page", "note", "appendix", "annex", "chapter", "part", "item", "step", "buoc",
    "giai doan", "phase", "quy", "q", "nghi dinh", "quyet dinh", "thong tu", "luat", "nd", "qd", "tt", "so", "no", "ref", "id", "ma",
)
CHAINED_BY = ("va", "and", "&", "+", "to", "den", "-", "toi", "hoac", "or")
CHAIN_CHARS = 8
CURRENCIES = {"vnd": "VND", "vnđ": "VND", "đồng": "VND", "dong": "VND", "usd": "USD", "eur": "EUR"}
#: Characters before a figure in which its unit may stand.
BEFORE_CHARS = 24
_D = {ord("đ"): "d", ord("Đ"): "d"}
_NUM = r"\d[\d.,]*"
_any = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_LOOKS_ONLY = re.compile(
    "|".join(
        (
            rf"(?<!\w)(?:{_any(LABELS)})\.?\s*(?<![\w./-]){_NUM}(?:(?=[^\d]{{1,{CHAIN_CHARS}}}\d)[\s,]*(?:{_any(CHAINED_BY)})?[\s,]*{_NUM})*",  # labels
            rf"(?<![\w./-]){_NUM}[/-](?=\d)[\w./-]*",  # document numbers
            r"\A\s*(?:\d+(?:\.\d+)*|[ivx]+)\s*[.)|:\-–]\s",  # the item's own number
            r"(?<![\w.,/-])0\d[\d.,]*",  # counted with a leading zero
        )
    )
)
_HEADING = re.compile(r"(?<![\w.,])\d+(?:\.\d+)*\s+(?=[A-ZÀ-Ỹ]{2})")
_FIGURE = re.compile(rf"(?<![\w./-]){_NUM}")
_MONEY = re.compile(rf"\s*(?:({_any(m for n in units.MULTIPLIERS.values() for m in n)})\s*)?({_any(CURRENCIES)})(?!\w)", re.I)
_GAS_FIRST = re.compile(r"co2\s*(?:eq?)?\s*\)?\s*(?:tấn|tan)\W*\Z", re.I)
_YEAR = re.compile(r"(?:19|20)\d\d")
QUANTITY = T.ArrayType(T.StructType([
    T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("half", T.DoubleType()), T.StructField("raw", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("year", T.StringType()),
]))


def folded(text: str) -> str:
    """Accent-free lower case of the same length."""
    return "".join(unicodedata.normalize("NFD", c)[0].lower()[:1] or c for c in text).translate(_D)


def published(raw: str) -> tuple[float, float] | None:
    """Value of a printed number, and half of the last place that it was published to.

    Two kinds of separators: the last is the decimal one. One separator before three digits groups,
    though a comma after a single digit is a decimal one all the same. Zeros at the end of a whole
    number are rounding.
    """
    groups, marks = re.split("[.,]", raw), re.sub(r"\d", "", raw)
    digits = "".join(groups)
    if not digits or (len(set(marks)) == 2 and marks.count(marks[-1]) > 1):
        return None
    triple = len(groups) == 2 and len(groups[1]) == 3 and len(groups[0]) <= 3
    places = len(groups[-1]) if len(set(marks)) == 2 or (len(marks) == 1 and not triple) else 0
    below = 3 if triple and marks == "," and len(groups[0]) == 1 else places
    last = -places if places else len(digits) - len(digits.rstrip("0"))
    return int(digits) / 10**below, 0.5 * 10.0**last


def _blanked(text: str) -> str:
    blank = lambda m: " " * len(m.group())
    # capitals that are a unit head nothing
    heading = lambda m: m.group() if _MONEY.match(text, m.end() - 1) or (units.read_unit(text, m.end() - 1) or (1, None))[1] else blank(m)
    return _LOOKS_ONLY.sub(blank, folded(_HEADING.sub(heading, text)))


def _unit(view: str, begin: int, end: int) -> tuple[float, str | None, float]:
    """(multiplier, kind, factor) after a figure, else of a unit right before it, as in a row read from left to right."""
    money = _MONEY.match(view, end)
    if money:
        name = (money.group(1) or "").lower()
        return next((n for n, words in units.MULTIPLIERS.items() if name in words), 1.0), CURRENCIES[money.group(2).lower()], 1.0
    after = units.read_unit(view, end) or (1.0, None, 1.0)
    if after[1]:
        return after
    before = view[max(0, begin - BEFORE_CHARS) : begin]
    if _GAS_FIRST.search(before):
        return after[0], "co2e", 1000.0
    words = re.findall(r"\S+", re.sub(r"[:()\-–\s]+\Z", "", before))
    for n in (3, 2, 1):
        got = units.whole_unit(" ".join(words[-n:]).strip("():")) if len(words) >= n else None
        if got and got[1]:
            return after[0], got[1], got[2]
    return after


def scan(text: str) -> list[dict]:
    """Quantities of a sentence in order: value in the common unit of its kind, half unit, span, nearest year before.

    Left out: labels and what is chained to them, years without a unit, item and heading numbers,
    numbers with a leading zero, parts of 21/2025 or 14064-1.
    """
    view, out, year = units_view(text), [], None
    for m in _FIGURE.finditer(_blanked(text)):
        raw = m.group().rstrip(".,")
        size, end = published(raw), m.start() + len(raw)
        times, kind, factor = _unit(view, m.start(), end)
        if kind is None and times == 1.0 and _YEAR.fullmatch(raw):
            year = raw
        elif size:
            out.append({"value": size[0] * times * factor, "kind": kind, "half": size[1] * times * factor, "raw": raw, "begin": m.start(), "end": end, "year": year})
    return out


def units_view(text: str) -> str:
    """The text with every blank as a plain one, of the same length."""
    return re.sub(r"\s", " ", text)


@F.pandas_udf(QUANTITY)
def _quantities(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [] if t is None else scan(t))


def quantities(x: Column) -> Column:
    """array<struct> of the quantities of a text; empty for null and for texts without a digit."""
    return F.when(F.coalesce(x.rlike(r"\d"), F.lit(False)), _quantities(x)).otherwise(F.array().cast(QUANTITY))


def mask(text: str, prefix: str = "S", names: tuple[str, ...] = ()) -> tuple[str, dict[str, dict]]:
    """The text with quantities as <S1>, <S2>.. and names as [NAME_1].., and what the slots stand for."""
    for i, name in enumerate(names, 1):
        text = re.sub(r"\s+".join(map(re.escape, name.split())), f"[NAME_{i}]", text, flags=re.I)
    out, slots, at = [], {}, 0
    for q in scan(text):
        slot = f"{prefix}{len(slots) + 1}"
        slots[slot] = {k: q[k] for k in ("raw", "value", "kind", "half")}
        out += (text[at : q["begin"]], f"<{slot}>")
        at = q["end"]
    return "".join(out) + text[at:], slots


_SLOT = T.StructType([T.StructField("raw", T.StringType()), *(T.StructField(n, t) for n, t in (("value", T.DoubleType()), ("kind", T.StringType()), ("half", T.DoubleType())))])
_MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("slots", T.MapType(T.StringType(), _SLOT))])


def masked(rows: DataFrame, text: str, names: tuple[str, ...] = (), name: str = "masked") -> DataFrame:
    """Rows with a struct of the masked text and its slots; null for null."""
    source = rows.drop(name)
    schema = T.StructType([*source.schema.fields, T.StructField(name, _MASKED)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [None if t is None else mask(t, "S", names) for t in b[text]]
            yield b.assign(**{name: [None if m is None else {"text": m[0], "slots": m[1]} for m in both]})

    return source.mapInPandas(run, schema)
