"""The found queries have the columns asked for, and those with SQL the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from attestra.llm import queries as q
from tests.conftest import SMALL

FOUND = {
    "p1_found": ["company_id_a", "company_id_b"], "p2_found": ["unit_id"], "p4_found": ["crawl_id_a", "crawl_id_b"], "p5_found": ["item_id", "verdict"], "p6_found": ["cache_id_a", "cache_id_b"],
    "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", FOUND)
def test_found(spark, name):
    df = q.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == FOUND[name] and len(rows) == len(set(rows)) and rows
    if len(df.columns) == 2 and df.columns[0].endswith("_a"):
        assert all(a < b for a, b in rows)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(FOUND)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = q.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(q.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert sorted(names) == cols and [tuple(map(pytest.approx, r)) if any(isinstance(v, float) for v in r) else r for r in want] == got
