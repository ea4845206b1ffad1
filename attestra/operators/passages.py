"""Texts to sentences, passages, candidates and table rows; folds over one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx

# Phrases of claims, and words of evidence.
CLAIM_TERMS = (
    "cam kết", "mục tiêu", "đến năm", "net zero", "trung hòa carbon", "giảm phát thải", "năng lượng tái tạo", "phát triển bền vững", "thân thiện môi trường", "kinh tế tuần hoàn",
    "tiết kiệm năng lượng", "giảm nước", "tái chế", "will reduce", "target", "by 2030", "net-zero", "carbon neutral", "renewable energy", "sustainable",
)
EVIDENCE_TERMS = (
    "tco2e", "co2e", "scope 1", "scope 2", "scope 3", "phát thải", "năng lượng", "điện", "nước", "chất thải", "tái chế", "capex", "chi phí môi trường", "iso 14001", "fsc", "asc", "bap", "leed",
    "kiểm toán", "assurance", "verified", "mwh", "gj", "m3", "tấn",
)


def sentences(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, text) to (doc_id, pos, sentence), pos from 0; a null text has none."""
    return docs.select("doc_id", F.posexplode(tx.split_sentences(F.col("text"), least)).alias("pos", "sentence"))


def paragraph_sentences(paragraph: Column, glue: int = 40) -> Column:
    """Sentences of a paragraph, of which those under ``glue`` characters are put before the next."""
    marked = F.regexp_replace(tx.rejoin_lines(paragraph), r"([.!?;])\s+", "$1" + tx.CUT)
    parts = F.filter(F.transform(F.split(marked, f"{tx.CUT}|\\n+"), lambda p: F.regexp_replace(p, r"^[ •\t]+|[ •\t]+$", "")), lambda p: p != "")

    def add(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        glued = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", last, p)))
        return F.when((F.size(out) > 0) & (F.length(last) < glue), glued).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def windows(x: Column, size: int = 600, most: int = 3) -> Column:
    """Passages of at most ``most`` sentences and, but for a single longer one, ``size`` characters, within a paragraph."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["n"] > 0) & ((F.length(acc["cur"]) + 1 + F.length(s) > size) | (acc["n"] >= most))
        out = F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cur = F.when(full | (acc["n"] == 0), s).otherwise(F.concat_ws(" ", acc["cur"], s))
        return F.struct(out.alias("out"), cur.alias("cur"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"))

    def passages(p: Column) -> Column:
        return F.aggregate(paragraph_sentences(p), start, add, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))

    paragraphs = F.filter(F.split(tx.squeeze(F.replace(x, F.lit("\r\n"), F.lit("\n"))), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.flatten(F.transform(paragraphs, passages))


def passages(docs: DataFrame, size: int = 600, most: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, block, passage_id, text), block from 1."""
    cut = docs.select("doc_id", F.posexplode(windows(F.col("text"), max(120, size), max(1, most))).alias("pos", "text"))
    block = F.col("pos") + 1
    return cut.select("doc_id", block.alias("block"), tx.stable_id(F.col("doc_id").cast("string"), block.cast("string"), F.col("text")).alias("passage_id"), "text")


def overlapping_chunks(x: Column, size: int = 1800, overlap: int = 1, least: int = 20) -> Column:
    """Chunks of whole sentences up to ``size`` characters, each beginning with the last ``overlap`` sentences of the one before."""
    parts = tx.split_sentences(x, least)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, y: s + F.length(y) + 1)

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["n"] + F.length(s) > size)
        kept = F.when(full, F.slice(acc["cur"], -overlap, overlap) if overlap else F.array().cast("array<string>")).otherwise(acc["cur"])
        n = F.when(full, total(kept)).otherwise(acc["n"])
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["out"]).alias("out"),
            F.concat(kept, F.array(s)).alias("cur"), (n + F.length(s) + 1).cast("int").alias("n"),
        )

    return F.aggregate(parts, start, add, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_index from 1, kind, has_number, text): sentences with a claim phrase, or a figure and an evidence word."""
    s = sentences(docs, 20).select("doc_id", (F.col("pos") + 1).alias("sentence_index"), F.col("sentence").alias("text"), F.lower("sentence").alias("low"))
    number = F.col("low").rlike(r"\d")
    claim = tx.any_of(F.contains(F.col("low"), F.lit(t)) for t in CLAIM_TERMS)
    evidence = number & tx.any_of(F.contains(F.col("low"), F.lit(t)) for t in EVIDENCE_TERMS)
    kinds = F.array_compact(F.array(F.when(claim, "claim"), F.when(evidence, "evidence")))
    return s.select("doc_id", "sentence_index", F.explode(kinds).alias("kind"), number.alias("has_number"), "text")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line), line ends of any system dropped."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))


def table_cells(docs: DataFrame) -> DataFrame:
    """Cells of pipe tables: (doc_id, line_no, col_no, label, value), where the label is the row's first cell."""
    rows = lines(docs).where(F.contains(F.col("line"), F.lit(" | "))).select("doc_id", "line_no", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("c"))
    cells = rows.select("doc_id", "line_no", F.get("c", F.lit(0)).alias("label"), F.posexplode("c").alias("col_no", "value"))
    return cells.where("col_no > 0 and value <> ''")


def neighbours(rows: DataFrame, partition: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Rows with the text before and after them in their group."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumns({"before": F.lag(text).over(w), "after": F.lead(text).over(w)})


def with_context(rows: DataFrame, partition: list[str], order: str, marker: Column, name: str = "context") -> DataFrame:
    """Rows with the last marker that isn't null at or before them."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def assertions(x: Column) -> Column:
    """A sentence split at ``;``, "đồng thời", "trong khi đó" and "mặt khác", if each part has six words and a figure and none begins with one.

    The words split only before twelve characters or more without a comma or semicolon.
    """
    marked = F.regexp_replace(x, r"\s*;\s+|\s+(?:đồng thời|trong khi đó|mặt khác)\s+(?=[^,;]{12})", tx.CUT)
    parts = F.filter(F.transform(F.split(marked, tx.CUT), lambda p: F.regexp_replace(p, "^[ ,;]+|[ ,;]+$", "")), lambda p: p != "")
    good = F.forall(parts, lambda p: (F.size(F.split(p, r"\s+")) >= 6) & p.rlike(r"\d") & ~p.rlike(r"^\d"))
    return F.when((F.size(parts) > 1) & good, parts).otherwise(F.array(x))
