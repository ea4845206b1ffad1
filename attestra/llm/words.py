"""Words of many texts at once, as 64-bit hashes in numpy.

A word is an unbroken run of letters, digits and marks of the folded text (``look.fold``), in lower
case. Texts are laid end to end as code points; a word's hash is a polynomial over its code points,
taken from prefix sums, so that no Python object is made for a word.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from attestra.llm.look import fold

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PIECE = 1 << 20
U = np.uint64


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind (True in a word) of each code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    for c in (*range(0xD800), *range(0xE000, 0x20000)):
        ch = chr(c)
        word[c] = unicodedata.category(ch)[0] in "LNM"
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    word[0x20000:0x32000] = True
    return lower, word


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=U), np.full(n, _INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _hash(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower, word = _tables()
    c = lower[points(text)]
    n = len(c)
    if not n:
        e = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U), e, e
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word[c]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(PIECE * 2, 1 << (n + 1).bit_length()))
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((c.astype(U) + U(1)) * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)), start, end


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, first word of each text and one past the last) of runs of texts.

    A null text has no words. Runs hold about ``PIECE`` code points, a longer text is a run of its own.
    """
    run: list[str] = []
    size, first, k = 0, 0, -1
    for k, text in enumerate(texts):
        t = fold(text) if text else ""
        if run and size + len(t) > PIECE:
            yield first, *_run(run)
            run, size, first = [], 0, k
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, *_run(run)


def _run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h, start, _ = _hash("\n".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, begins)


def runs_of(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``k`` words; one for each start, so ``len(h) - k + 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(n, dtype=U)
    for i in range(k):
        total += h[i : i + n] * U((0xD6E8FEB86659FD93 * (2 * (i + seed) + 1)) % (1 << 64))
    return mix(total)


def words_of(text: str | None) -> list[str]:
    """The words themselves, in order: the plain form of what ``word_hashes`` hashes."""
    if not text:
        return []
    lower, word = _tables()
    c = lower[points(fold(text))]
    inside = np.zeros(len(c) + 2, dtype=bool)
    inside[1:-1] = word[c]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s = c.tobytes().decode("utf-32-le")
    return [sys.intern(s[a:b]) for a, b in zip(edge[::2], edge[1::2])]
