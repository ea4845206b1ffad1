"""Dictionary operators: term lists are data, given as plain tuples or read from a small table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as tx


@dataclass(frozen=True)
class Bucket:
    name: str
    terms: tuple[str, ...]
    priority: int = 1


def from_table(rows: DataFrame, kind: str) -> list[Bucket]:
    """Buckets of one kind of a (bucket, kind, ord, priority, term) table; a lexicon fits on the driver by nature."""
    got = rows.where(F.col("kind") == kind).orderBy("ord", "bucket", "term").collect()
    out: dict[str, list] = {}
    for r in got:
        out.setdefault(r["bucket"], [r["priority"] or 1]).append(r["term"])
    return [Bucket(b, tuple(v[1:]), v[0]) for b, v in out.items()]


def best_bucket(x: Column, buckets: list[Bucket]) -> Column:
    """The bucket with most terms in a text in matching form; ties by priority, then by the later name. Null without a hit."""
    scored = F.array(*(F.struct(tx.hits(x, b.terms).alias("hits"), F.lit(b.priority).alias("priority"), F.lit(b.name).alias("name")) for b in buckets))
    top = F.array_max(F.filter(scored, lambda s: s["hits"] > 0))
    return top["name"]


def first_bucket(x: Column, buckets: list[Bucket]) -> Column:
    """The first bucket in the given order of which a term occurs, else null."""
    return F.coalesce(*(F.when(tx.any_of(F.contains(x, F.lit(t)) for t in b.terms), b.name) for b in buckets))


def vote_language(x: Column, by_language: dict[str, tuple[str, ...]]) -> Column:
    """The language with most terms; ties go to the one given first, no hit gives ``unknown``."""
    counts = {lang: tx.hits(x, terms) for lang, terms in by_language.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    return F.when(best == 0, "unknown").otherwise(F.coalesce(*(F.when(c == best, lang) for lang, c in counts.items())))


def boilerplate_reasons(x: Column, verbs: tuple[str, ...], navigation: tuple[str, ...]) -> Column:
    """Every reason that a record looks like page furniture and no statement."""
    low = F.lower(F.trim(x))
    menu = tx.hits(low, navigation)
    ratio = tx.title_ratio(x)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(tx.CONTENT), F.lit(0))))
    tests = (
        ("too_short", F.length(F.trim(x)) < 40),
        ("navigation_menu", (menu >= 3) | ((menu >= 2) & (ratio > 0.45))),
        ("no_predicate", ~tx.any_of(F.contains(low, F.lit(v)) for v in verbs)),
        ("title_case_fragment", (ratio > 0.6) & ~F.contains(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("."))),
        ("too_few_unique_tokens", distinct < 6),
    )
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests)))


def informativeness(x: Column, has_number: Column, cues: tuple[str, ...]) -> Column:
    """An additive score that puts specific statements before vague ones."""
    low = F.lower(x)
    measured = low.rlike(r"\d+([.,]\d+)?\s*(%|tco2e|co2e|mwh|gwh|tấn|kwh)")
    year = low.rlike(r"\b20\d{2}\b")
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    return one(has_number, 2.0) + F.least(tx.hits(low, cues), F.lit(3)) * 1.0 + one(measured, 1.5) + one(year, 1.0) - one(F.length(x) > 1200, 1.0)


def cue_present(x: Column, cue: str, negations: tuple[str, ...] = (), reach: int = 4) -> Column:
    """Whether a cue occurs as whole words and, with ``negations``, not within ``reach`` words after one.

    A cue with accents is looked for in the text as it is, one without in the folded text.
    """
    accented = cue != cue.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO))
    t = F.lower(x) if accented else tx.fold(x)
    esc = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in cue)
    found = t.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){esc}(?:[^\p{{L}}\p{{N}}_]|$)")
    if not negations:
        return found
    no = "|".join(n if accented else n.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)) for n in negations)
    negated = t.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{no})(?:[^\p{{L}}\p{{N}}_]+[\p{{L}}\p{{N}}_]+){{0,{reach - 1}}}[^\p{{L}}\p{{N}}_]+{esc}(?:[^\p{{L}}\p{{N}}_]|$)")
    return found & ~negated
