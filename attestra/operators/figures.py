"""Figures of tables: rows from words, cross-foots, corroboration, comparison of amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_foot(parts: DataFrame, totals: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Totals against the sum of their parts: difference and whether it is within ``tolerance``.

    Parts are added up where they are read; a total without parts has none, and doesn't foot.
    """
    s = parts.groupBy(key).agg(F.sum(value).alias("parts_sum"), F.count("*").alias("n_parts"))
    out = totals.join(s, key, "left").withColumn("difference", F.col(value) - F.col("parts_sum"))
    return out.withColumn("foots", F.coalesce(F.abs("difference") <= tolerance, F.lit(False)))


def corroborate(rows: DataFrame, key: list[str], source: str, value: str, tolerance: float) -> DataFrame:
    """Values of one key stated by two sources or more, and whether they agree within a share of the largest."""
    g = rows.dropna(subset=[*key, value]).groupBy(*key).agg(F.count_distinct(source).alias("n_sources"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.where("n_sources > 1").withColumn("agree", F.col("high") - F.col("low") <= tolerance * F.abs("high"))


def comparison(a: Column, b: Column, half_a: Column, half_b: Column, same_kind: Column) -> Column:
    """S, C or N of two amounts: equal within their printed precision, else apart, or not comparable."""
    tol = F.greatest(half_a, half_b)
    return F.when(~F.coalesce(same_kind, F.lit(False)) | a.isNull() | b.isNull(), "N").when(F.abs(a - b) <= tol, "S").otherwise("C")


def mismatch(tests: dict[str, Column]) -> Column:
    """The first reason in the given order why two facts can't be compared; null where they can."""
    return F.coalesce(*(F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()))


def table_rows(words: DataFrame, page: str = "page") -> DataFrame:
    """Words with (x0, y0, x1, y1, text) to row and segment numbers of their page.

    A word whose middle is further than 0.45 heights below the one before begins a row; within a row a
    gap of more than 2.5 heights begins a segment. Words are ordered by their middle and then x0.
    """
    mid, tall = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    down = Window.partitionBy(page).orderBy("mid", "x0")
    w = words.withColumns({"mid": mid, "tall": tall})
    w = w.withColumn("new_row", F.coalesce((F.col("mid") - F.lag("mid").over(down) > 0.45 * F.col("tall")).cast("int"), F.lit(1)))
    w = w.withColumn("row_no", F.sum("new_row").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(page, "row_no").orderBy("x0")
    w = w.withColumn("new_seg", F.coalesce((F.col("x0") - F.lag("x1").over(across) > 2.5 * F.col("tall")).cast("int"), F.lit(1)))
    w = w.withColumn("segment_no", F.sum("new_seg").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return w.groupBy(page, "row_no", "segment_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))


def column_cross_foot(cells: DataFrame, page: str, order: str, value: str, is_total: Column, half: Column) -> DataFrame:
    """Each total of a column against the rows above it since the total before; tolerance is the sum of half units."""
    w = Window.partitionBy(page).orderBy(order)
    c = cells.withColumns({"t": is_total.cast("int"), "half": half})
    c = c.withColumn("block", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t"))
    g = c.groupBy(page, "block").agg(
        F.max(F.when(F.col("t") == 1, F.col(value))).alias("total"), F.sum(F.when(F.col("t") == 0, F.col(value))).alias("parts_sum"),
        F.count_if(F.col("t") == 0).alias("n_parts"), F.sum("half").alias("tolerance"),
    )
    return g.where("total is not null and n_parts > 0").withColumn("foots", F.abs(F.col("total") - F.col("parts_sum")) <= F.col("tolerance"))


def magnitude(rows: DataFrame, unit: str, value: str, least: int = 3) -> DataFrame:
    """A value's share of its unit's values at or below it; 0.5 where there are fewer than ``least``."""
    w = Window.partitionBy(unit)
    n = F.count(value).over(w)
    return rows.withColumn("magnitude", F.when(n < least, 0.5).otherwise(F.cume_dist().over(w.orderBy(value))))


def queue(rows: DataFrame, score: str, id_col: str, threshold: float, least: int, most: int) -> DataFrame:
    """Rank by score and whether the row is in a queue of min(max(number at the threshold, least), most) rows.

    Only the first ``most`` rows are ranked against each other; all others are out.
    """
    n = rows.where(F.col(score) >= threshold).count()
    size = min(max(n, least), most)
    top = rows.orderBy(F.desc(score), id_col).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def year_columns(cells: DataFrame) -> DataFrame:
    """Figures of tables whose heads name years: (doc_id, line_no, label, year, value).

    ``cells`` has (doc_id, line_no, col_no, label, value). A row with a year as value in a column is a
    head for that column until the next head; rows before any head have no year and are left out, as
    are values that are no number.
    """
    from attestra.functions import numbers

    w = Window.partitionBy("doc_id", "col_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_year = F.col("value").rlike(r"^(?:19|20)\d{2}$")
    c = cells.withColumn("year", F.last(F.when(is_year, F.col("value")), ignorenulls=True).over(w))
    return c.where(~is_year & F.col("year").isNotNull()).select("doc_id", "line_no", "label", F.col("year").cast("int").alias("year"), numbers.locale_number(F.col("value")).alias("value")).where("value is not null")


def beta_share(a, b, x):
    """The distribution function of Beta(a, b) at x, for arrays: its continued fraction, on the side where that converges fast."""
    import math

    import numpy as np

    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((lgamma(a + b) - lgamma(a) - lgamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    keep = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(y), 1 / keep(1 - (p + q) * y / (p + 1))
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    share = front * out / p
    return np.where(turn, 1 - share, share)


def beta_lower(rows: DataFrame, k: str, n: str, q: float = 0.05, name: str = "lower") -> DataFrame:
    """The q-quantile of Beta(k + 1, n - k + 1), the lower bound of a share; null for null counts.

    The distribution function is inverted by bisection, for all rows of a batch at once, whatever n.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    base = rows.drop(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b[k].notna() & b[n].notna()
            k_, n_ = b.loc[ok, k].astype(float).to_numpy(), b.loc[ok, n].astype(float).to_numpy()
            lo, hi = np.full(len(k_), 1e-12), np.full(len(k_), 1 - 1e-12)
            for _ in range(45 if len(k_) else 0):
                mid = (lo + hi) / 2
                below = beta_share(k_ + 1, n_ - k_ + 1, mid) < q
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            out = pd.Series(np.nan, index=b.index)
            out[ok] = lo
            yield b.assign(**{name: out})

    return base.mapInPandas(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))
