"""How text looks: the relation between strings that are drawn alike, and a fold that picks one form.

Drawn alike are full-width and half-width forms, kinds of blanks, look-alike letters of other
scripts, composed and decomposed accents. Characters without a visible form are drawn as nothing.
Case, digits and accents are visible and are kept apart.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

# Letters of other alphabets (Cyrillic, Greek, Armenian, Cherokee, Lisu) and of the Latin one
# itself that are drawn as the letter named first, in its case.
LOOK_ALIKE = (
    ("A", "АΑᎪꓮ"), ("B", "ВΒᏴꓐ"), ("C", "СϹᏟꓚ"), ("D", "Ꭰꓓ"), ("E", "ЕΕᎬꓰ"), ("F", "ꓝ"), ("G", "Ԍꓖ"), ("H", "НΗᎻꓧ"), ("I", "ІΙӀꓲ"), ("J", "ЈͿᎫꓙ"),
    ("K", "КΚᏦꓗ"), ("L", "Ꮮꓡ"), ("M", "МΜᎷꓟ"), ("N", "Νꓠ"), ("O", "ОΟꓳ"), ("P", "РΡᏢꓑ"), ("Q", "Ԛ"), ("R", "ꓣ"), ("S", "ЅՏᏚꓢ"), ("T", "ТΤᎢꓔ"),
    ("U", "Սꓴ"), ("V", "ѴᏙꓦ"), ("W", "ԜᎳꓪ"), ("X", "ХΧꓫ"), ("Y", "УΥҮꓬ"), ("Z", "ΖᏃꓜ"), ("Đ", "ÐƉ"), ("Æ", "Ӕ"), ("Ə", "Ә"),
    ("a", "аɑ"), ("c", "сϲ"), ("d", "ԁ"), ("e", "е"), ("g", "ɡ"), ("h", "һ"), ("i", "і"), ("j", "јϳ"),
    ("l", "ӏ"), ("o", "оοօ"), ("p", "р"), ("q", "ԛ"), ("s", "ѕ"), ("u", "ս"), ("v", "νѵ"), ("w", "ԝ"), ("x", "х"), ("y", "у"), ("æ", "ӕ"), ("ə", "ә"),
    ("µ", "μ"), ("-", "‐‑"),
)
# Default-ignorable code points outside category Cf, and Cf code points that are drawn.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
DRAWN_CF = "؀؁؂؃؄؅۝܏࣢\U000110bd\U000110cd"
BLANKS = "\t\x0b\x0c⠀"


@functools.cache
def unseen() -> frozenset[str]:
    """Code points without a visible form."""
    found = {chr(c) for c in (*range(0x10000), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(c)) == "Cf"}
    found |= {chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x20), *range(0x7F, 0xA0))}
    return frozenset((found | set(UNSEEN)) - set(DRAWN_CF) - set("\t\n\x0b\x0c\r\x85"))


@functools.cache
def relations() -> tuple[tuple[str, str], ...]:
    """Pairs of strings that are drawn alike, one step apart; accents are decomposed (NFD)."""
    pairs = [(latin, other) for latin, others in LOOK_ALIKE for other in others]
    for c in (*range(0xFF01, 0xFFE7),):
        wide = chr(c)
        narrow = unicodedata.normalize("NFKC", wide)
        if narrow != wide and wide not in UNSEEN:
            pairs.append((unicodedata.normalize("NFD", narrow), wide))
    pairs += [(" ", chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20]
    pairs += [(" ", c) for c in BLANKS]
    pairs += [("\n", c) for c in "\r\x85  "] + [("\n", "\r\n")]
    pairs += [("", c) for c in sorted(unseen())]
    return tuple(pairs)


def spans(points: Iterable[int]) -> str:
    """Code points as the ranges of a pattern's character class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def _step() -> dict[int, str]:
    return {ord(b): a for a, b in relations() if len(b) == 1}


@functools.cache
def _odd() -> re.Pattern:
    """Finds a text that the fold may change: a code point of the relation, or a combining mark."""
    points = sorted(_step()) + [c for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))]
    points += [c for c in range(0x370, 0x10000) if unicodedata.normalize("NFC", chr(c)) != chr(c)]
    # Cyrillic and Greek letters with accents hide a look-alike base
    points += [c for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)) if unicodedata.decomposition(chr(c))]
    return re.compile(f"[{spans(set(points) - {0x0A})}]")


def fold(text: str) -> str:
    """The one form of all texts that look like ``text``; blanks at the ends are dropped.

    An empty text, and one of unseen characters only, folds to ''.
    """
    if not text.isascii() or not text.isprintable():
        if _odd().search(text):
            d = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
            text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", d.translate(_step())))
    return text.strip(" ")
