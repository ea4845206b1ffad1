"""Addresses and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that a canonical address lacks, suffixes of page assets, magic bytes.
UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
ASSETS = (
    "js", "mjs", "css", "map", "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif", "woff", "woff2", "ttf", "eot", "otf", "mp4", "webm", "mp3", "wav", "zip", "rar", "gz",
)
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0", "ole"), ("89504E47", "png"), ("FFD8FF", "jpg"), ("1F8B", "gz"))
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without fragment and campaign parameters; null for what is no address."""
    query = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*UTM))
    joined = F.array_join(query, "&")
    tail = F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")
    return F.when(url.rlike(PARTS), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _part(url, 3), tail))


def host(url: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^[^@]*@", ""), r":\d*$", "")
    return F.when(h != "", h)


def host_allowed(url: Column, domains: list[str]) -> Column:
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def filename(url: Column) -> Column:
    """The last part of the path, ``document`` without one."""
    name = F.regexp_extract(_part(url, 3), r"([^/]*)/?$", 1)
    return F.when(url.isNull(), None).when(name == "", "document").otherwise(name)


def is_asset(url: Column) -> Column:
    return F.lower(F.regexp_extract(filename(url), r"\.([A-Za-z0-9]+)$", 1)).isin(*ASSETS)


def file_kind(content: Column, name: Column) -> Column:
    """A file's kind by its first bytes, else by the suffix of its name."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return out.otherwise(F.when(suffix != "", suffix))
