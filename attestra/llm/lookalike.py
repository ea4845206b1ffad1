"""Texts that look the same brought to one form.

A unit is a letter with its marks as written, if both are drawn as one composed character, and else a
single code point. Unicode bounds the number of units, whatever the corpus. Units that are drawn
alike are united (union-find over strings and code points, step by step: width, look-alike letter,
composition, blanks, unseen characters); the most frequent unit of a class stands for it. A
multi-pattern automaton rewrites the others, the longest match first.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.look import _odd, fold, relations, spans, unseen
from attestra.llm.words import points
from attestra.runtime import cut


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Unseen characters; a line end of two characters, or a letter with marks."""
    hidden = spans(map(ord, unseen()))
    marks = spans(c for c in range(0x300, 0x10000) if unicodedata.combining(chr(c)) or 0xFF9E <= c <= 0xFF9F)
    return re.compile(f"[{hidden}]+"), re.compile(f"(?s)\\r\\n|[^{marks}][{marks}]+|[{marks}]+")


def split_units(text: str) -> tuple[list[str], list[str]]:
    """(stretches of single code points, units of several) of a text without unseen characters, in turn: one stretch more."""
    single, several, at = [], [], 0
    for m in _patterns()[1].finditer(text):
        unit, before = m.group(), text[at : m.start()]
        at = m.end()
        # marks that compose with nothing, or not with all of the letter, are units of their own
        if unit != "\r\n" and len(form := fold(unit) or unit) > 1:
            unit, before = form[-1], before + form[:-1]
        single.append(before)
        several.append(unit)
    return [*single, text[at:]], several


def units(text: str) -> list[str]:
    """The units of a text, unseen characters left out."""
    single, several = split_units(_patterns()[0].sub("", text))
    out = list(single[0])
    for unit, rest in zip(several, single[1:]):
        out += (unit, *rest)
    return out


def plain(text: str) -> bool:
    return not _odd().search(text) and unicodedata.is_normalized("NFC", text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    alone = np.zeros(0x110000, dtype=np.int64)
    hidden = _patterns()[0]
    for batch in batches:
        stretches = []
        for text in batch.column(0).to_pylist():
            if not (text.isascii() and text.isprintable()) and _odd().search(text):
                single, several = split_units(hidden.sub("", text))
                stretches += single
                total.update(several)
            else:
                stretches.append(text)
        at = points("".join(stretches))
        if len(at):
            counted = np.bincount(at)
            alone[: len(counted)] += counted
    seen = np.flatnonzero(alone)
    total.update({chr(c): int(n) for c, n in zip(seen.tolist(), alone[seen])})
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["unit", "n"])


class Alike:
    """Classes of units: union-find with the unit's count."""

    def __init__(self, counts: dict[str, int]):
        self.parent: dict[str, str] = {}
        self.counts = counts
        one = {b: a for a, b in relations()}
        for unit in counts:
            for form in self._steps(unit, one):
                self.union(unit, form)

    @staticmethod
    def _steps(unit: str, one: dict[str, str]) -> Iterator[str]:
        """Strings drawn like the unit, each one step away from the one before."""
        bare = "".join(c for c in unit if c not in unseen())
        yield bare
        if unit == "\r\n":
            yield "\n"
            return
        wide = "".join(one.get(c, c) for c in unicodedata.normalize("NFD", bare))
        yield wide
        yield unicodedata.normalize("NFC", wide)

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[a] = b

    def rewrites(self) -> dict[str, str]:
        """Each unit that isn't its class's representative to the representative.

        The class of nothing is written as nothing; else the most frequent member stands for the class,
        of equally frequent ones the shortest and then the first by code point.
        """
        members: dict[str, list[str]] = {}
        for x in self.parent:
            members.setdefault(self.find(x), []).append(x)
        out = {}
        for group in members.values():
            best = "" if "" in group else min(group, key=lambda x: (-self.counts.get(x, 0), len(x), x))
            out |= {x: best for x in group if x != best and x}
        return out


def unit_rewrites(texts: DataFrame, column: str = "text") -> dict[str, str]:
    """The rewriting table of a corpus. The driver gets one count for each distinct unit, of which Unicode has a bounded number."""
    counted = texts.select(F.col(column).alias("text")).where("text is not null").mapInArrow(_count, "unit string, n long")
    return Alike({r["unit"]: r["n"] for r in counted.groupBy("unit").agg(F.sum("n").alias("n")).collect()}).rewrites()


class Rewriter:
    """Rewrites texts by a table of units; what the table doesn't know, by the rule it was made from."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.ascii = any(unit.isascii() and unit.isprintable() for unit in table)
        self.auto = ahocorasick.Automaton()
        for unit, form in table.items():
            self.auto.add_word(unit, (len(unit), form))
        if table:
            self.auto.make_automaton()
        inverse: dict[str, str] = {}
        for unit, form in table.items():
            inverse.setdefault(fold(unit) or unit, form)
        self.inverse = inverse

    def __call__(self, text: str) -> str:
        if self.ascii or not text.isascii() or not text.isprintable():
            # a mark right of an unseen character still belongs to the letter left of it
            text = _patterns()[0].sub("", text)
            if self.table:
                out, at = [], 0
                for end, (n, form) in self.auto.iter_long(text):
                    out += (text[at : end + 1 - n], form)
                    at = end + 1
                text = "".join(out) + text[at:]
            if not plain(text):
                text = "".join(map(self._rule, units(text)))
        return text.strip(" ")

    def _rule(self, unit: str) -> str:
        form = self.table.get(unit)
        if form is None:
            form = fold(unit) if unit.strip(" ") else unit
            form = self.inverse.get(form, form)
        return form


def one_form(texts: DataFrame, column: str = "text", table: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``texts`` with ``one_form`` added: equal exactly for texts that look the same.

    Null stays null, a text of unseen characters only becomes ''. Blanks at the ends are dropped.
    An existing column of that name is replaced.
    """
    table = unit_rewrites(texts, column) if table is None else table
    shared = texts.sparkSession.sparkContext.broadcast(table)

    rest = texts.drop("one_form")
    at = rest.columns.index(column)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(shared.value)
        for batch in batches:
            forms = [None if t is None else rewriter(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "one_form"])

    return rest.mapInArrow(rewrite, T.StructType([*rest.schema.fields, T.StructField("one_form", T.StringType())]))


def same_look(texts: DataFrame, key: str = "cache_id", column: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: rows whose texts have one form but aren't equal. Null and blank texts pair with nothing."""
    own = one_form(texts.select(F.col(key).alias("id"), F.col(column).alias("text")).where("id is not null and text is not null"))
    # written once: the rewriting isn't repeated for the forms that vary and for their rows
    own = cut(own.where("one_form <> ''").select("id", F.unhex(F.md5("one_form")).alias("form"), F.unhex(F.md5("text")).alias("exact")).distinct())
    varied = own.groupBy("form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("form")
    own = own.join(varied, "form")
    a, b = own.select("form", F.col("id").alias("a"), F.col("exact").alias("x")), own.select("form", F.col("id").alias("b"), F.col("exact").alias("y"))
    return a.join(b, "form").where("a < b and x <> y").select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()
