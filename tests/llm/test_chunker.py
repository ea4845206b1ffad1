from __future__ import annotations

import bisect

from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import chunker as c

TEXT = st.text(alphabet="aăb Ô.\n!,é9", min_size=0, max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 80), st.integers(1, 4), st.integers(0, 90))
def test_pieces_cover_within_size_and_overlap(text, size, sentences, overlap):
    spans = c.pieces(text, c.Limits(size, sentences, overlap))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    real = min(overlap, size - 1)
    if len(text) <= size:
        assert len(spans) == 1
    for a, b in spans:
        assert b - a <= size
    for (a, b), (x, y) in zip(spans, spans[1:]):
        assert x == max(0, b - real) and y > b


def test_cuts_at_natural_places():
    text = "One two three four. Five six seven eight.\n\nNine ten eleven. Twelve thirteen fourteen fifteen."
    spans = c.pieces(text, c.Limits(50, 3, 0))
    natural, _ = c.boundaries(text)
    assert [text[a:b].strip() for a, b in spans][0].endswith("eight.") and all(b in natural for _, b in spans[:-1])


def test_sentence_limit():
    text = " ".join(f"This is sentence number {w} of the text." for w in "abcdefghij")
    spans = c.pieces(text, c.Limits(300, 2, 20))
    _, stops = c.boundaries(text)
    assert len(spans) > 4
    for a, b in spans:
        assert bisect.bisect_left(stops, b) - bisect.bisect_right(stops, a) + 1 <= 2


def test_no_place_to_cut():
    spans = c.pieces("x" * 1000, c.Limits(100, 3, 10))
    assert all(b - a <= 100 for a, b in spans) and spans[-1][1] == 1000


def test_units(spark):
    rows = [("u1", 1, "a. " * 300), ("u1", 1, "a. " * 300), ("u2", None, "b" * 601), ("u3", 9, "c" * 600), ("u4", 2, None), ("u5", 2, ""), ("u6", 2, "é" * 1000), ("u7", 2, "  \n")]
    units = spark.createDataFrame([(*r, "lim") for r in rows], "unit_id string, settings_id int, text string, lim_size string")
    conf = spark.createDataFrame([(1, "x", 100, None, None), (2, "y", 1000, 5, 10), (3, "default", 600, 3, 0)], "settings_id int, profile string, chunk_size_chars int, max_sentences_per_chunk int, chunk_overlap_chars int")
    out = c.cut_units(units, conf)
    assert {r["unit_id"] for r in out.select("unit_id").distinct().collect()} == {"u1", "u2"}
    whole = c.cut_units(units, conf, only_oversized=False)
    assert {r["unit_id"]: r["n_pieces"] for r in whole.where("piece_no = 0").collect()}["u6"] == 1
    assert c.cut_units(units.limit(0), conf).count() == 0
    back = {}
    for r in sorted(out.where("unit_id = 'u2'").collect(), key=lambda r: r["piece_no"]):
        back[r["piece_no"]] = r["text"][r["new_from"] - r["begin"] :]
    assert "".join(back.values()) == "b" * 601
