"""Evaluation passages inside a corpus, found by spaced seeds.

A mask is a pattern over ``SPAN`` consecutive words that ignores some of them. Each window of each
test item is hashed under every mask; the corpus is scanned once and its windows are looked up in
those hashes. Around a hit, item and document are laid on the hit's diagonal and compared word by
word, so that an overlap with substituted words is found whole, and the longest unbroken run of
equal words is known exactly. Any 12 equal words in a row hit under every mask, and 12 words of
which one was substituted hit under at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.words import U, mix, word_hashes
from attestra.runtime import cut

SPAN = 12
#: Positions that each mask ignores.
MASKS = tuple(tuple(i for i in range(SPAN) if i % 4 == k) for k in range(4))
#: Words of test items held by a task at once (under 200 MB of seeds); a larger test set is taken in blocks, one scan each.
BLOCK_WORDS = 1_000_000
OUT = "doc_id {id}, item_id {item}, run_words int, overlap_words int, same_words int, item_words int"


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of every window of ``SPAN`` words under each mask."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return [np.zeros(0, dtype=U) for _ in MASKS]
    parts = [h[i : i + n] * U((0xD6E8FEB86659FD93 * (2 * i + 3)) % (1 << 64)) for i in range(SPAN)]
    whole = parts[0].copy()
    for p in parts[1:]:
        whole += p
    out = []
    for k, skip in enumerate(MASKS):
        t = whole + U(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for i in skip:
            t -= parts[i]
        out.append(mix(t))
    return out


class Items:
    """Test items of one block: their words and a table from seed to (item, position)."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.words = ids, []
        for _, h, at in word_hashes(texts):
            self.words += [h[a:b] for a, b in zip(at[:-1], at[1:])]
        key, item, pos = [], [], []
        for k, h in enumerate(self.words):
            for s in seeds(h):
                key.append(s)
                item.append(np.full(len(s), k, dtype=np.int32))
                pos.append(np.arange(len(s), dtype=np.int32))
        key_ = np.concatenate(key) if key else np.zeros(0, dtype=U)
        order = np.argsort(key_, kind="stable")
        self.key = key_[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int32)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, dtype=np.int32)
        # eight places a seed, so that few windows of the corpus pass by chance
        self.shift = U(64 - max(16, (8 * len(self.key)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[(self.key >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and seeds of the windows, whole inside one text, that have a known seed."""
        n = len(h) - SPAN + 1
        if n <= 0 or not len(self.key):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        found_p, found_s = [], []
        for s in seeds(h):
            p = np.flatnonzero(self.bits[(s >> self.shift).astype(np.int64)])
            k = np.searchsorted(self.key, s[p])
            p = p[(k < len(self.key)) & (self.key[np.minimum(k, len(self.key) - 1)] == s[p])]
            found_p.append(p)
            found_s.append(s[p])
        p, s = np.concatenate(found_p), np.concatenate(found_s)
        end = at[np.searchsorted(at, p, side="right")] if len(p) else p
        ok = p + SPAN <= end
        return p[ok], s[ok]

    def overlaps(self, h: np.ndarray, p: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, longest run, overlap, equal words in it) of one document's words ``h`` and its hits."""
        lo, hi = np.searchsorted(self.key, s), np.searchsorted(self.key, s, side="right")
        n = hi - lo
        idx = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.stack([self.item[idx].astype(np.int64), np.repeat(p, n) - self.pos[idx]], axis=1), axis=0)
        best: dict[int, tuple[int, int, int]] = {}
        for item, diag in pairs.tolist():
            w = self.words[item]
            a, b = max(0, -diag), min(len(w), len(h) - diag)
            same = w[a:b] == h[a + diag : b + diag]
            now = (longest_run(same), *tolerant(same))
            best[item] = max(best.get(item, (0, 0, 0)), now)
        return [(k, *v) for k, v in best.items()]


def longest_run(same: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def tolerant(same: np.ndarray) -> tuple[int, int]:
    """Length and equal words of the stretch with most equal words, each other word costing three."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return end - start, int(same[start:end].sum())


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Every (document, item) pair with a seed hit, one row each, with the best overlap.

    ``run_words`` is the longest run of consecutive equal words, ``overlap_words`` and ``same_words``
    the length and the equal words of the best overlap that allows substitutions, ``item_words`` the
    item's length. Null and short texts (under ``SPAN`` words) of either side hit nothing; repeated
    rows of a document or an item give one row; other columns are ignored. The scan is narrow: only
    the pairs found are shuffled. The items travel to the tasks in blocks of about ``BLOCK_WORDS``
    words, whatever their number; with more than one block the hits of each are written before the
    next is read, so that driver and tasks hold one block at a time.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    types = {"id": corpus.schema["doc_id"].dataType.simpleString(), "item": own.schema["item_id"].dataType.simpleString()}
    schema = OUT.format(**types)
    total = own.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    found = None
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = part.collect()  # one block of at most about BLOCK_WORDS words
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        one = corpus.mapInArrow(_scan(shared), schema)
        if blocks > 1:
            one = cut(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("run_words", "overlap_words", "same_words", "item_words")).alias("b")
    ).select("doc_id", "item_id", "b.*")


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in batches:
            items = items or Items(*shared.value)
            ids = batch.column(0)
            rows: list[tuple[int, int, int, int, int]] = []
            for first, h, at in word_hashes(batch.column(1).to_pylist()):
                p, s = items.hits(h, at)
                if not len(p):
                    continue
                doc = np.searchsorted(at, p, side="right") - 1
                for d in np.unique(doc).tolist():
                    mine = doc == d
                    for item, *v in items.overlaps(h[at[d] : at[d + 1]], p[mine] - at[d], s[mine]):
                        rows.append((first + d, item, *v))
            if rows:
                at_, item_, run, over, same = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at_)),
                        pa.array([items.ids[i] for i in item_]),
                        pa.array(run, pa.int32()),
                        pa.array(over, pa.int32()),
                        pa.array(same, pa.int32()),
                        pa.array([len(items.words[i]) for i in item_], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "run_words", "overlap_words", "same_words", "item_words"],
                )

    return scan
