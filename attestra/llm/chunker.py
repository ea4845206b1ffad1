"""Oversized texts cut into overlapping pieces at natural boundaries.

Cut positions are chosen by dynamic programming over the boundaries of a text: each cut costs by its
kind (end of a paragraph, line, sentence, word, or anywhere), each piece by its distance from the
even length. A piece begins ``overlap`` characters before the end of the one before.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.sentences import ends

#: Cost of a cut at the end of a paragraph, line, sentence, word, and inside a word; weight of unevenness.
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 0.0, 0.3, 0.5, 3.0, 12.0
UNEVEN = 1.0
#: Values of the profile ``default`` where the settings have none: size, sentences, overlap.
FALLBACK = (600, 3, 0)
#: Cost of each sentence too many that a piece touches with its overlap, where none can be avoided.
CROWDED = 50.0
_PARAGRAPH = re.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:(?:\r?\n|\r)\s*)+")
_LINE = re.compile(r"\r\n|\n|\r")
_WORD = re.compile(r"[^\S\r\n]+")


@dataclass(frozen=True)
class Limits:
    size: int
    sentences: int
    overlap: int


def boundaries(text: str) -> tuple[dict[int, float], list[int]]:
    """Natural cut positions with their cost, and the ends of sentences, in order."""
    cost: dict[int, float] = {}
    stops: list[int] = []
    at = 0
    for m in [*_PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.strip():
            for e in ends(part):
                # the blanks after a sentence belong to it
                e += len(part[e:]) - len(part[e:].lstrip())
                cost[at + e] = SENTENCE
                stops.append(at + e)
        if m:
            cost[m.end()] = PARAGRAPH
            if stops:
                stops[-1] = m.end()
            at = m.end()
    for m in _LINE.finditer(text):
        if cost.get(m.end(), LINE) >= LINE:
            cost[m.end()] = LINE if m.end() not in cost else min(cost[m.end()], LINE)
    cost.pop(0, None)
    cost.pop(len(text), None)
    return cost, sorted(set(stops))


def _refine(text: str, cost: dict[int, float], step: int) -> dict[int, float]:
    """Cuts at words, then anywhere, where natural ones are more than ``step`` characters apart."""
    out = dict(cost)
    for name in ("word", "inside"):
        known = [0, *sorted(out), len(text)]
        for a, b in zip(known, known[1:]):
            if b - a <= step:
                continue
            if name == "word":
                out |= {m.end(): WORD for m in _WORD.finditer(text, a, b) if a < m.end() < b}
            else:
                stride = max(1, step // 8)
                for p in range(a + stride, b, stride):
                    while p < b and unicodedata.combining(text[p]):
                        p += 1
                    if p < b:
                        out[p] = INSIDE
    return out


def _best(n: int, at: list[int], price: list[float], stops: list[int], lim: Limits, overlap: int, strict: bool) -> list[int] | None:
    """Cheapest cut positions, or None where no choice keeps within the limits.

    Not ``strict``, a piece may touch too many sentences with its overlap, at a high cost, but not with
    its new text.
    """
    count = max(1, -(-(n - overlap) // max(1, lim.size - overlap)))
    even = (n + (count - 1) * overlap) / count
    points, costs = [0, *at, n], [0.0, *price, 0.0]
    first = [max(0, p - overlap) if p else 0 for p in points]
    # a piece from i to j touches reached[j] - opened[i] sentences, its new text reached[j] - begun[i]
    reached = [bisect.bisect_left(stops, p) + 1 for p in points]
    begun = [bisect.bisect_right(stops, p) for p in points]
    opened = [bisect.bisect_right(stops, p) for p in first]
    known = opened if strict else begun
    endless = float("inf")
    scale = UNEVEN / even**2
    best, back = [0.0] + [endless] * (len(points) - 1), [0] * len(points)
    # (end - even - first)^2 without the part that no choice of the begin changes
    square, slope = [scale * f * f for f in first], [2 * scale * f for f in first]
    fixed = [square[0]]
    low = 0
    for j in range(1, len(points)):
        end = points[j]
        least, need = end - lim.size, reached[j] - lim.sentences
        while low < j and (first[low] < least or known[low] < need):
            low += 1
        far = end - even
        if low < j:
            found = [f - g * far for f, g in zip(fixed[low:j], slope[low:j])]
            if not strict:
                found = [c + CROWDED * max(0, need - o) for c, o in zip(found, opened[low:j])]
            top = min(found)
            back[j] = low + found.index(top)
            best[j] = top + scale * far * far + costs[j]
        fixed.append(best[j] + square[j])
    if best[-1] == endless:
        return None
    out, j = [], len(points) - 1
    while back[j]:
        j = back[j]
        out.append(points[j])
    return out[::-1]


def pieces(text: str, lim: Limits) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text, in order; a text within the size is one piece whatever its sentences.

    Every piece has at most ``size`` characters and, but for texts where no cut allows it, touches at
    most ``sentences`` sentences; each begins ``overlap`` characters before the end of the one before.
    An overlap of the size or more leaves no room for new text and is taken as one character less than
    the size; a size under one character raises. Where sentences are so short that the overlap alone
    holds too many, pieces exceed ``sentences`` by those of the overlap.
    """
    if lim.size < 1:
        raise ValueError(f"no piece fits into {lim.size} characters")
    n = len(text)
    if n <= lim.size:
        return [(0, n)]
    overlap = min(max(0, lim.overlap), lim.size - 1)
    room = lim.size - overlap
    natural, stops = boundaries(text)
    cuts: list[int] | None = None
    for step, strict in ((room, True), (max(1, room // 4), True), (max(1, room // 12), True), (max(1, room // 12), False)):
        cost = _refine(text, natural, step)
        at = sorted(cost)
        cuts = _best(n, at, [cost[p] for p in at], stops, lim, overlap, strict)
        if cuts is not None:
            break
    if cuts is None:
        cost = natural | {p: INSIDE for p in range(1, n) if p not in natural}
        cuts = _best(n, sorted(cost), [cost[p] for p in sorted(cost)], stops, Limits(lim.size, n, overlap), overlap, False)
    edge = [0, *cuts, n]
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(edge, edge[1:])]


def limits(units: DataFrame, settings: DataFrame) -> DataFrame:
    """The settings' values beside each unit as lim_size, lim_sentences, lim_overlap.

    A null settings_id, one that the settings don't have, and a null value mean the profile ``default``,
    and what that lacks (as with an empty settings table) means ``FALLBACK``.
    """
    names = ("chunk_size_chars", "max_sentences_per_chunk", "chunk_overlap_chars")
    short = ("lim_size", "lim_sentences", "lim_overlap")
    own = settings.select("settings_id", "profile", *names)
    base = own.where(F.lower(F.trim("profile")) == "default").agg(*(F.min(n).alias(n) for n in names)).first()
    fallback = {n: f if base[n] is None else base[n] for n, f in zip(names, FALLBACK)}
    by_id = own.where("settings_id is not null").groupBy("settings_id").agg(*(F.min(n).alias(s) for n, s in zip(names, short)))
    small = F.broadcast(by_id) if settings.count() <= 100_000 else by_id
    out = units.drop(*short).join(small, "settings_id", "left")
    return out.withColumns({s: F.coalesce(s, F.lit(fallback[n])) for n, s in zip(names, short)})


def oversized(size: Column, text: Column) -> Column:
    return F.char_length(text) > size


def cut_units(units: DataFrame, settings: DataFrame, only_oversized: bool = True) -> DataFrame:
    """Pieces of units: unit_id, piece_no (from 0), n_pieces, begin, end, new_from, text.

    ``units``: unit_id, settings_id, text. Characters are code points as stored. Null texts have no
    piece; with ``only_oversized`` neither have texts within the size, else each is one piece. Repeated
    rows give repeated pieces.
    """
    own = limits(units.select("unit_id", "settings_id", "text"), settings).where("unit_id is not null and text is not null")
    if only_oversized:
        own = own.where(oversized(F.col("lim_size"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, no, of, begin, end, new, out = [], [], [], [], [], [], []
            for k, (text, *lim) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)))):
                spans = pieces(text, Limits(*lim))
                for i, (a, b) in enumerate(spans):
                    unit.append(k)
                    no.append(i)
                    of.append(len(spans))
                    begin.append(a)
                    end.append(b)
                    new.append(spans[i - 1][1] if i else 0)
                    out.append(text[a:b])
            ints = [pa.array(x, pa.int32()) for x in (no, of, begin, end, new)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(unit, pa.int64())), *ints, pa.array(out, pa.string())], names=["unit_id", "piece_no", "n_pieces", "begin", "end", "new_from", "text"])

    kind = own.schema["unit_id"].dataType.simpleString()
    schema = f"unit_id {kind}, piece_no int, n_pieces int, begin int, end int, new_from int, text string"
    return own.select("unit_id", "text", "lim_size", "lim_sentences", "lim_overlap").mapInArrow(run, schema)
