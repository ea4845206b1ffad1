"""Readers: files of several kinds to (path, part, text), JSON lines, feeds of links."""

from __future__ import annotations

import io
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = ("txt", "md", "csv", "yaml", "yml")
HTML = ("html", "htm")
KNOWN = (*PLAIN, *HTML, "json", "docx", "xlsx")
PART = "path string, part int, text string"
# Elements whose text isn't content, and those that part blocks.
SKIPPED = frozenset("script style noscript nav footer header svg".split())
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 section article table".split())
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def _mark(self, tag: str, opening: bool) -> None:
        if tag in BLOCKS:
            self.out.append("\n\n")
        elif opening and tag == "br":
            self.out.append("\n")
        elif opening and tag in ("td", "th"):
            self.out.append(" | ")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.depth += 1
        else:
            self._mark(tag, True)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.depth = max(0, self.depth - 1)
        else:
            self._mark(tag, False)

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def html_text(html: str) -> str:
    """The content of a page: blocks parted by empty lines, cells by bars, furniture left out."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in "".join(p.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def docx_text(content: bytes) -> str:
    """Paragraphs and tables of a document in order; deleted runs are left out, table rows are pipe rows."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))

    def runs(node: ET.Element) -> str:
        if node.tag in (f"{_W}del", f"{_W}moveFrom"):
            return ""
        if node.tag == f"{_W}t":
            return node.text or ""
        if node.tag in (f"{_W}tab", f"{_W}br"):
            return "\t" if node.tag.endswith("tab") else "\n"
        return "".join(map(runs, node))

    blocks = []
    for node in root.find(f"{_W}body"):
        if node.tag == f"{_W}p":
            blocks.append(runs(node).strip())
        elif node.tag == f"{_W}tbl":
            rows = [" | ".join(" ".join(runs(p).strip() for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
            blocks.append("\n".join(rows))
    return "\n\n".join(b for b in blocks if b)


def xlsx_sheets(content: bytes) -> list[str]:
    """The sheets of a workbook as pipe rows, in the order of their files."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group())):
        rows = []
        for row in ET.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                value = "" if v is None else v.text or ""
                cells.append(shared[int(value)] if c.get("t") == "s" and value else "".join(t.text or "" for t in c.iter(f"{_S}t")) or value)
            rows.append(" | ".join(cells))
        out.append("\n".join(r for r in rows if r.strip(" |")))
    return out


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, part, text) of the files under a path, part from 1; a workbook has a part a sheet.

    Kinds go by suffix. An unknown suffix or an unreadable file raises, and names the file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"]):
                kind = name.rpartition(".")[2].lower()
                if kind not in KNOWN:
                    raise ValueError(f"unsupported file type: {name}")
                content = bytes(content)
                try:
                    if kind == "xlsx":
                        parts = xlsx_sheets(content)
                    elif kind == "docx":
                        parts = [docx_text(content)]
                    else:
                        text = content.decode("utf-8-sig")
                        parts = [html_text(text) if kind in HTML else json.dumps(json.loads(text), ensure_ascii=False, indent=2) if kind == "json" else text]
                except Exception as e:
                    raise ValueError(f"can't read {name}: {e}") from e
                rows += [(name, i, t) for i, t in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["path", "part", "text"])

    return files.mapInPandas(run, PART)


@F.pandas_udf(T.StringType())
def html_to_text(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html_text(t))


def html_links(pages: DataFrame) -> DataFrame:
    """(url, html) to (url, link), each link once a page: href, src, data-* and onclick addresses and bare ones, without fragment."""
    found = F.regexp_extract_all("html", F.lit(r"""(?:(?:href|src|data-[\w-]+)\s*=\s*|location\s*=\s*|open\(\s*)["']([^"'#\s]+)"""), F.lit(1))
    bare = F.regexp_extract_all("html", F.lit(r"""(https?://[^\s"'<>#)]+)"""), F.lit(1))
    return pages.select("url", F.explode(F.array_distinct(F.concat(found, bare))).alias("link")).where(~F.col("link").rlike("^(?:javascript|mailto|tel|data):"))


def sitemap_locations(xml: Column) -> Column:
    """The loc entries of a sitemap or sitemap index."""
    return F.xpath(xml, F.lit("//*[local-name()='loc']/text()"))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines parted at line feeds only, so that other Unicode separators stay inside strings; a bad line raises."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows_at_once: int = 10_000) -> DataFrame:
    """A table of a local SQLite file, read by one task in blocks: such a file has one reader by nature."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            cur = con.execute(f"SELECT {', '.join(names)} FROM {table}")
            while got := cur.fetchmany(rows_at_once):
                yield pd.DataFrame(got, columns=names)
            con.close()

    return spark.range(1).coalesce(1).mapInPandas(run, schema)


def page_blocks(words: DataFrame) -> DataFrame:
    """Extracted blocks (doc_id, page, block, x, y, text) to page texts, blocks ordered by line and then column."""
    order = F.struct(F.round("y").alias("y"), F.round("x").alias("x"), "block", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "\n")
    return words.groupBy("doc_id", "page").agg(text.alias("text"), F.count("*").alias("n_blocks"))


def page_inspection(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) to page count, native characters, share of scanned pages (under 80 characters) and whether a page needs OCR (under 40)."""
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(n).alias("n_chars"), F.avg((n < 80).cast("int")).alias("scanned_share"), F.count_if(n < 40).alias("n_ocr_pages"))


def read_rules(spark: SparkSession, path: str, schema: str, key: str = "rules") -> DataFrame:
    """The list under a key of a YAML file as a table of a given schema; a field that the schema lacks raises, a missing one is null."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get(key) or []
    fields = spark.createDataFrame([], schema).schema
    unknown = sorted({k for r in rows for k in r} - set(fields.fieldNames()))
    if unknown:
        raise ValueError(f"{path}: unknown fields {', '.join(unknown)}")
    return spark.createDataFrame([tuple(r.get(n) for n in fields.fieldNames()) for r in rows], fields)


def read_case_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases (cases/*/case.json), claims (claims.jsonl) and evidence (evidence.jsonl) of a pack, the last two with their case's fields.

    Claims and evidence of an unknown case keep null case fields; evidence of no known claim is kept too.
    """
    cases = spark.read.schema("case_id string, organization string, jurisdiction string, split string, case_status string").option("multiLine", "true").json(f"{path}/cases/*/case.json")
    claims = read_json_lines(spark, f"{path}/claims.jsonl", "claim_id string, case_id string, text string, expected_status string")
    evidence = read_json_lines(spark, f"{path}/evidence.jsonl", "evidence_id string, case_id string, source_id string, page int, evidence_type string, text string")
    small = cases.select("case_id", "organization", "split")
    return cases, claims.join(small, "case_id", "left"), evidence.join(small, "case_id", "left")


def read_label_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sessions to one row a candidate passage: (claim_id, split, evidence_id, rank, relation); a label by id comes before one by rank."""
    schema = "claim_id string, split string, evidence_candidates array<struct<rank:int,evidence_id:string,text:string>>, labels struct<verdict:string,evidence:map<string,string>>"
    rows = read_json_lines(spark, path, schema).select("claim_id", "split", "labels", F.explode("evidence_candidates").alias("c"))
    by = lambda k: F.try_element_at("labels.evidence", k)
    return rows.select("claim_id", "split", "c.evidence_id", "c.rank", F.coalesce(by(F.col("c.evidence_id")), by(F.col("c.rank").cast("string"))).alias("relation"))
