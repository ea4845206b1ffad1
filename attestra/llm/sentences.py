"""Sentences of a text, counted for the reading level."""

from __future__ import annotations

import re

from attestra.llm.look import fold

# Abbreviations that never end a sentence, and those that don't before a number.
ABBREVIATIONS = (
    "tp", "tx", "ths", "ts", "gs", "pgs", "bs", "ks", "ô", "đc", "vd", "mr", "mrs", "ms", "dr", "prof", "jr", "sr", "vs", "viz", "cf", "approx", "est",
    "dept", "inc", "ltd", "corp", "govt", "e.g", "i.e", "a.m", "p.m", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
BEFORE_NUMBER = ("tr", "no", "nos", "p", "pp", "fig", "figs", "eq", "art", "sec", "ch", "vol", "q", "k", "st", "so", "số", "tel", "đt")

#: Characters before a full stop that an abbreviation or item number may take.
LONGEST = 12
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
_END = re.compile(r"[.!?…]+(?!\S)")
_DOT = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")
_ENUM = re.compile(r"^\W*(?:\d{1,3}|[ivxIVX]{1,5}|[a-zA-Z])$")


def ends(part: str) -> list[int]:
    """Where sentences end in a text without empty lines (after the mark), the end of the text included."""
    out = []
    for m in _END.finditer(part):
        if m.group() == "." and m.end() < len(part):
            before = part[max(0, m.start() - LONGEST) : m.start()].split()
            word = before[-1] if before and not part[m.start() - 1].isspace() else ""
            bare = word.lstrip("([{\"'“‘«").lower()
            if bare in ABBREVIATIONS:
                continue
            after = part[m.end() :].lstrip()[:1] if bare in BEFORE_NUMBER else ""
            if after.isdigit():
                continue
            if "." in bare and _DOT.fullmatch(bare):
                continue
            # a number or letter that only counts an item: nothing of a sentence stands before it
            begin = out[-1] if out else 0
            if not part[begin : m.start() - len(word)].strip() and _ENUM.match(word):
                continue
        out.append(m.end())
    if not out or part[out[-1] :].strip():
        out.append(len(part))
    return out


def parts(text: str) -> list[str]:
    """The stretches between empty lines."""
    return [p for p in _BREAK.split(text.replace("\r\n", "\n").replace("\r", "\n")) if p and not p.isspace()]


def count(text: str) -> tuple[int, int]:
    """(blank-separated words, sentences) of a text as it looks."""
    n_words = n = 0
    for p in parts(fold(text)):
        w = len(p.split())
        if w:
            n_words += w
            n += len(ends(p))
    return n_words, n
