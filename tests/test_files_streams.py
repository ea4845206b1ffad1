from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.plans import evidence
from attestra.queries import TYPES
from attestra.sources import readers, writers
from attestra.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Một") + "<w:p><w:del><w:r><w:delText>xoá</w:delText><w:t>cũ</w:t></w:r></w:del><w:r><w:t>mới</w:t></w:r></w:p>" + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    shared = f"<sst {S}><si><t>Điện</t></si></sst>"
    sheet = f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>12.5</v></c></row></sheetData></worksheet>'
    return zipped({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": sheet})


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿xin chào", encoding="utf-8")
    (tmp_path / "b.html").write_text("<nav>menu</nav><p>Một &amp; hai</p><table><tr><td>x</td><td>y</td></tr></table><script>z</script>", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"b":1,"a":"é"}', encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "e.xlsx").write_bytes(xlsx())
    got = {(r["path"].rsplit("/", 1)[1], r["part"]): r["text"] for r in readers.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt", 1] == "xin chào" and got["b.html", 1] == "Một & hai\n\n| x | y" and got["c.json", 1] == json.dumps({"b": 1, "a": "é"}, ensure_ascii=False, indent=2)
    assert got["d.docx", 1] == "Một\n\nmới\n\na | b" and got["e.xlsx", 1] == got["e.xlsx", 2] == "Điện | 12.5"
    (tmp_path / "f.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file type"):
        readers.read_files(spark, f"file://{tmp_path}").collect()


def test_links_and_sitemap(spark):
    html = """<a href="/a.pdf#x">1</a><a href='/a.pdf'>2</a><a href="mailto:x@y">m</a><div data-url="b.pdf"></div><b onclick="location='c'">x</b> https://d.vn/e"""
    got = [r["link"] for r in readers.html_links(spark.createDataFrame([("u", html)], "url string, html string")).collect()]
    assert set(got) == {"/a.pdf", "b.pdf", "c", "https://d.vn/e"} and len(got) == 4
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://a</loc></url><url><loc>http://b</loc></url></urlset>'
    assert spark.createDataFrame([(xml,)], "x string").select(readers.sitemap_locations(F.col("x"))).first()[0] == ["http://a", "http://b"]


def test_json_lines_keep_separators(spark, tmp_path):
    rows = [(1, "a\u2028b\u2029c\x85d"), (2, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    writers.write_json_lines(df, f"{tmp_path}/x")
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "x").glob("part*"))
    assert "\\u2028" in raw and "\u2028" not in raw and len(raw.splitlines()) == 2
    assert sorted(map(tuple, readers.read_json_lines(spark, f"{tmp_path}/x", "id long, t string").collect())) == rows
    assert writers.write_layers({"raw": df, "none": df.limit(0)}, f"{tmp_path}/l") == {"raw": 2, "none": 0}


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE t (id INTEGER, name TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(25)])
    con.commit()
    assert readers.read_sqlite(spark, str(tmp_path / "x.db"), "t", "id long, name string", 10).count() == 25


def test_store_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "sha256 string, v int")
    assert writers.store_new(df, f"{tmp_path}/s") == 2 and writers.store_new(df, f"{tmp_path}/s") == 0 and spark.read.parquet(f"{tmp_path}/s").count() == 2


def test_pages(spark):
    w = spark.createDataFrame([("d", 1, 1, 50.0, 10.2, "b"), ("d", 1, 2, 5.0, 10.4, "a"), ("d", 1, 3, 5.0, 90.0, "c")], "doc_id string, page int, block int, x double, y double, text string")
    assert readers.page_blocks(w).first()["text"] == "a\nb\nc"
    p = spark.createDataFrame([("d", 1, "x" * 100), ("d", 2, None)], "doc_id string, page int, text string")
    r = readers.page_inspection(p).first()
    assert (r["n_pages"], r["n_chars"], r["scanned_share"], r["n_ocr_pages"]) == (2, 100, 0.5, 1)


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_event_stream_equals_batch(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    got = run(spark, streams.windowed_counts(stream), "win", "complete")
    want = streams.windowed_counts(spark.read.parquet(f"{tmp_path}/e"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_log_states(spark, tmp_path):
    rows = [(1, "r", "a", "DRAFT"), (2, "r", "a", "REVIEWED"), (3, "r", "a", "DRAFT"), (4, "r", "b", "FINAL"), (5, "r", "a", "FINAL")]
    spark.createDataFrame(rows, "seq long, run_id string, item_id string, new_state string").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("seq long, run_id string, item_id string, new_state string").parquet(f"{tmp_path}/log")
    allowed = {"": ("DRAFT",), "DRAFT": ("REVIEWED",), "REVIEWED": ("FINAL",)}
    got = {r["item_id"]: (r["state"], r["n_entries"], r["n_rejected"]) for r in run(spark, streams.log_states(stream, allowed), "states", "update").collect()}
    assert got == {"a": ("FINAL", 3, 1), "b": ("", 0, 1)}


def test_keep_new_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "sha256 string, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sha256 string, v int").parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.keep_new(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_claims_conserve_sentences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    c = evidence.claims(docs, TYPES)
    assert c.where("claim_id is null or claim_type is null").count() == 0
    kept = c.where("reject_reason is null")
    assert kept.count() == kept.select(F.lower("text")).distinct().count()
    shuffled = evidence.claims(docs.orderBy(F.desc("doc_id")).repartition(5), TYPES)
    order = ["claim_id", "pos"]
    assert sorted(map(tuple, c.select(*order, "reject_reason").fillna("").collect())) == sorted(map(tuple, shuffled.select(*order, "reject_reason").fillna("").collect()))


def test_compared(spark):
    q = spark.createDataFrame([(1, "Năm 2024 dùng 12,0 MWh"), (2, "không có số")], "query_id long, text string")
    f = spark.createDataFrame([(1, 10, 1, "đã dùng 12 MWh"), (1, 11, 2, "đã dùng 40 MWh"), (1, 12, 3, "12 ha"), (2, 10, 1, "12 MWh")], "query_id long, doc_id long, rank int, text string")
    got = {(r["query_id"], r["doc_id"]): r["label"] for r in evidence.compared(q, f).collect()}
    assert got == {(1, 10): "S", (1, 11): "C", (1, 12): "N", (2, 10): "N"}


def test_stances_and_verdicts(spark):
    q = spark.createDataFrame([(1, "dùng 12,0 MWh"), (2, "xanh"), (3, "xanh")], "query_id long, text string")
    f = spark.createDataFrame([(1, 10, 1, 0.9, "đã dùng 40 MWh"), (1, 11, 2, 0.9, "đã dùng 12 MWh"), (2, 10, 1, 0.9, "không vi phạm gì"), (2, 11, 2, 0.1, "được chứng nhận"), (3, 1, 1, 0.9, "xanh")], "query_id long, doc_id long, rank int, score double, text string")
    s = evidence.stances(q, f, ("vi phạm",), ("chứng nhận",), ("không",))
    got = {(r["query_id"], r["doc_id"]): (r["stance"], r["method"]) for r in s.collect()}
    assert got == {(1, 10): ("REFUTES", "figure"), (1, 11): ("SUPPORTS", "figure"), (2, 10): ("RELATED", "words"), (2, 11): ("SUPPORTS", "cue"), (3, 1): ("RELATED", "words")}
    assert {r["query_id"]: r["verdict"] for r in evidence.verdicts(s).collect()} == {1: "CONTRADICTED", 2: "SUPPORTED", 3: "INSUFFICIENT_EVIDENCE"}


def test_packs_sessions_and_rules(spark, tmp_path):
    (tmp_path / "cases" / "a").mkdir(parents=True)
    (tmp_path / "cases" / "a" / "case.json").write_text(json.dumps({"case_id": "a", "organization": "o", "split": "test"}, indent=1))
    (tmp_path / "claims.jsonl").write_text(json.dumps({"claim_id": "1", "case_id": "a", "text": "t"}) + "\n" + json.dumps({"claim_id": "2", "case_id": "zz"}) + "\n")
    (tmp_path / "evidence.jsonl").write_text(json.dumps({"evidence_id": "e", "case_id": "a", "page": 3}) + "\n")
    cases, claims, ev = readers.read_case_pack(spark, str(tmp_path))
    assert cases.count() == 1 and {r["claim_id"]: r["organization"] for r in claims.collect()} == {"1": "o", "2": None} and ev.first()["split"] == "test"
    row = {"claim_id": "c", "split": "dev", "evidence_candidates": [{"rank": 1, "evidence_id": "x"}, {"rank": 2, "evidence_id": "y"}, {"rank": 3, "evidence_id": "z"}], "labels": {"verdict": "S", "evidence": {"x": "SUPPORTS", "2": "CONTEXT"}}}
    (tmp_path / "s.jsonl").write_text(json.dumps(row) + "\n")
    assert {r["evidence_id"]: r["relation"] for r in readers.read_label_sessions(spark, f"{tmp_path}/s.jsonl").collect()} == {"x": "SUPPORTS", "y": "CONTEXT", "z": None}
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rules:\n- {rule_id: r1, terms: [a, b]}\n- {rule_id: r2}\n")
    assert sorted((r["rule_id"], r["terms"]) for r in readers.read_rules(spark, f"{tmp_path}/r.yaml", "rule_id string, terms array<string>").collect()) == [("r1", ["a", "b"]), ("r2", None)]
    with pytest.raises(ValueError, match="unknown fields terms"):
        readers.read_rules(spark, f"{tmp_path}/r.yaml", "rule_id string")
