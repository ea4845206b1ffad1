"""Numbers, units and intervals as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(x: Column, c: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))


def locale_number(raw: Column) -> Column:
    """A number with dots and commas in either notation as double, else null.

    With both, the last one is the decimal separator. Dots before one group of three digits or repeated
    group; so do commas, but for a single digit before one group (1,234 is 1.234).
    """
    t = F.regexp_replace(F.trim(raw), "[.,]+$", "")
    dots, commas = _count(t, "."), _count(t, ",")
    drop = lambda c: F.replace(t, F.lit(c), F.lit(""))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, F.replace(drop("."), F.lit(","), F.lit("."))).otherwise(drop(",")))
        .when((dots > 1) | t.rlike(r"^\d{1,3}\.\d{3}$"), drop("."))
        .when((commas > 1) | t.rlike(r"^\d{2,3},\d{3}$"), drop(","))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return F.when(t.rlike(r"^\d[\d.,]*$"), plain.try_cast("double"))


def half_unit(raw: Column) -> Column:
    """Half of the last significant place that a number was published to; zeros at the end of an integer are rounding."""
    t = F.regexp_replace(F.trim(raw), "[.,]+$", "")
    dots, commas = _count(t, "."), _count(t, ",")
    after = lambda c: F.length(F.substring_index(t, c, -1))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    decimals = (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, after(",")).otherwise(after(".")))
        .when((commas == 1) & ~t.rlike(r"^\d{1,3},\d{3}$"), after(","))
        .when((dots == 1) & ~t.rlike(r"^\d{1,3}\.\d{3}$"), after("."))
        .otherwise(0)
    )
    digits = F.regexp_replace(t, "[.,]", "")
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    return F.when(t.rlike(r"^\d[\d.,]*$"), 0.5 * F.pow(F.lit(10.0), F.when(decimals > 0, -decimals).otherwise(zeros)))


def figure_number(raw: Column) -> Column:
    """The rule for figures: any single separator with three digits after it groups; struct of value and half."""
    t = F.regexp_replace(raw, r"[\s\u00a0]", "")
    dots, commas = _count(t, "."), _count(t, ",")
    both = (dots > 0) & (commas > 0)
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    one = (dots + commas == 1) & ~t.rlike(r"[.,]\d{3}$")
    whole = F.regexp_replace(t, "[.,]", "")
    tail = F.when(both, F.when(comma_last, F.substring_index(t, ",", -1)).otherwise(F.substring_index(t, ".", -1))).when(one, F.regexp_extract(t, r"[.,](\d*)$", 1)).otherwise("")
    head = F.substring(whole, F.lit(1), F.length(whole) - F.length(tail))
    value = F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), F.when(tail == "", "0").otherwise(tail)).try_cast("double")
    ok = t.rlike(r"^[\d.,]*\d[\d.,]*$")
    return F.when(ok, F.struct(value.alias("value"), (0.5 * F.pow(F.lit(10.0), -F.length(tail))).alias("half")))


def printed_half(x: Column) -> Column:
    """Half of the last digit of a double as it is printed without needless zeros."""
    t = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return 0.5 * F.pow(F.lit(10.0), F.when(F.contains(t, F.lit(".")), -F.length(F.substring_index(t, ".", -1))).otherwise(0))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct of low and high: the Wilson interval of k of n; null for n = 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def safe_int(x: Column) -> Column:
    return F.trim(x).try_cast("int")


def safe_date(x: Column) -> Column:
    """A date in year-month-day or day/month/year order; null for all else."""
    return F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "dd/MM/yyyy"))
