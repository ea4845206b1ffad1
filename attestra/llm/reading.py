"""How demanding a text is to read.

Features of each text (lexical diversity, word rarity in the corpus, connectives, a proxy of clause
depth, lengths of text and words) go into a regularised ordinal regression, fitted on graded texts.
Without grades of one's own the texts are graded by words a sentence, in the steps of ``GRADES``; no
feature knows where a sentence ends, so that the level is an estimate and not the grade read back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from attestra.llm import sentences
from attestra.llm.words import U, word_hashes
from attestra.runtime import cut, cut_path, forget

# Connectives, and words that open a subordinate clause.
CONNECTIVES = (
    "and", "but", "or", "so", "however", "therefore", "moreover", "furthermore", "because", "although", "while", "whereas", "despite", "in addition", "compared with",
    "according to", "as well", "và", "nhưng", "hoặc", "nên", "tuy", "tuy nhiên", "do đó", "vì", "vì vậy", "mặc dù", "trong khi", "đồng thời", "ngoài ra", "so với", "theo", "căn cứ", "nhằm", "dù",
)
SUBORDINATORS = (
    "that", "which", "who", "if", "when", "since", "because", "although", "while", "whereas", "before", "after", "having", "despite", "unless",
    "rằng", "mà", "nếu", "khi", "vì", "do", "để", "trong khi", "mặc dù", "sau khi", "trước khi", "nhằm", "căn cứ",
)
#: Upper bounds of words a sentence of the grades 0 to 3; grade 4 is above.
GRADES = (10.0, 20.0, 30.0, 45.0)
#: Bits of surprise of the rarest words. Words are counted exactly; those that make up less than 2 ** -RARE_BITS of all
#: words are equally rare, so that at most 2 ** RARE_BITS words have a count of their own in the tasks, at any corpus size.
RARE_BITS = 18
#: Distinct words that a task holds before it hands their counts on.
HELD = 1 << 20
#: Graded texts that the regression is fitted on, at most.
FIT_ROWS = 4000
FEATURES = ("log_words", "word_chars", "diversity", "rarity", "connectives", "clauses")


def _table(words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the one-word and of the two-word entries."""
    one, two = [], []
    for _, h, at in word_hashes(words):
        for a, b in zip(at[:-1], at[1:]):
            if b - a == 1:
                one.append(h[a:b])
            else:
                two.append(h[a : a + 1] * U(3) + h[a + 1 : a + 2] * U(5))
    return np.concatenate(one), np.concatenate(two)


def _hits(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    found = np.isin(h, table[0]).astype(np.int32)
    if len(h) > 1:
        found[:-1] += np.isin(h[:-1] * U(3) + h[1:] * U(5), table[1])
    return found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word, n = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for _, h, _ in word_hashes(batch.column(0).to_pylist()):
            more, times = np.unique(h, return_counts=True)
            both, at = np.unique(np.concatenate([word, more]), return_inverse=True)
            word, n = both, np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)
        if len(word) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
            word, n = word[:0], n[:0]
    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


@dataclass
class Rarity:
    """Bits of surprise of the words, as sorted hashes, that aren't rarest."""

    words: np.ndarray
    bits: np.ndarray

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), float(RARE_BITS))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.bits[at], float(RARE_BITS))


def word_rarity(texts: DataFrame, text: str = "text") -> Rarity:
    """The rarity of words in all texts, from their exact counts."""
    counted = texts.select(F.col(text).alias("text")).where("text is not null").mapInArrow(_word_counts, "word long, n long")
    counted = cut(counted.groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 1
    rows = counted.where(F.col("n") > total / 2.0**RARE_BITS).collect()  # fewer than 2 ** RARE_BITS rows
    forget(texts.sparkSession, cut_path(counted))
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(U)
    order = np.argsort(words)
    return Rarity(words[order], np.log2(total / np.array([r["n"] for r in rows], dtype=np.float64))[order])


def features(texts: DataFrame, key: str = "doc_id", text: str = "text", rarity: Rarity | None = None) -> DataFrame:
    """(key, text) to one row a text that has a letter: id, n_words, n_sentences and ``FEATURES``.

    Null and blank texts and texts without a letter have no row. Whole texts are read.
    """
    own = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rarity = word_rarity(own) if rarity is None else rarity
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_bits, joins, opens = shared.value, _table(CONNECTIVES), _table(SUBORDINATORS)
        for batch in batches:
            texts_ = batch.column(1).to_pylist()
            rows = []
            for first, h, at in word_hashes(texts_):
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (rare_bits(h), _hits(h, joins), _hits(h, opens))]
                rare, con, sub = ((s[at[1:]] - s[at[:-1]]).tolist() for s in sums)
                for d in range(len(at) - 1):
                    n = int(at[d + 1] - at[d])
                    t = texts_[first + d]
                    if not n or not any(map(str.isalpha, t)):
                        continue
                    w, s = sentences.count(t)
                    types = len(np.unique(h[at[d] : at[d + 1]]))
                    commas = t.count(",") + t.count(";") + t.count(":")
                    rows.append((first + d, w, s, np.log(n), (len(t) - t.count(" ")) / n, types / np.sqrt(2 * n), rare[d] / n, con[d] / n, (sub[d] + commas) / n))
            cols = list(zip(*rows)) or [()] * (3 + len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])],
                names=["id", "n_words", "n_sentences", *FEATURES],
            )

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(measure, f"id {kind}, n_words long, n_sentences long, " + ", ".join(f"{f} double" for f in FEATURES))


class Ordinal:
    """Proportional-odds regression with an L2 penalty: P(grade <= k) = sigmoid(cut_k - x.w)."""

    def __init__(self, grades: int, penalty: float = 1.0):
        self.grades, self.penalty = grades, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600) -> Ordinal:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z, n, k = (x - self.mean) / self.scale, len(x), self.grades - 1
        share = np.clip(np.array([(y <= c).mean() for c in range(k)]), 1e-3, 1 - 1e-3)
        cuts = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(k) * 1e-3)
        p = np.concatenate([np.zeros(z.shape[1]), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for i in range(1, steps + 1):
            g = self._gradient(p, z, y, n)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p -= 0.1 * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        self.w, self.cuts = p[: z.shape[1]], self._cuts(p[z.shape[1] :])
        return self

    @staticmethod
    def _cuts(c: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))

    def _gradient(self, p: np.ndarray, z: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        d = z.shape[1]
        cuts = self._cuts(p[d:])
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = z @ p[:d]
        hi, lo = 1 / (1 + np.exp(np.clip(s - edge[y + 1], -500, 500))), 1 / (1 + np.exp(np.clip(s - edge[y], -500, 500)))
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gw = z.T @ ((dhi - dlo) / mass) / n + self.penalty * p[:d] / n
        gc = np.zeros(len(cuts))
        for c in range(len(cuts)):
            gc[c] = -(dhi / mass)[y == c].sum() / n + (dlo / mass)[y == c + 1].sum() / n
        tail = np.cumsum(gc[::-1])[::-1]
        return np.concatenate([gw, [tail[0]], tail[1:] * np.exp(p[d + 1 :])])


def graded(measured: DataFrame) -> DataFrame:
    """Measured texts with a grade by words a sentence."""
    per = F.col("n_words") / F.col("n_sentences")
    grade = F.lit(len(GRADES))
    for k in reversed(range(len(GRADES))):
        grade = F.when(per < GRADES[k], k).otherwise(grade)
    return measured.withColumn("grade", grade)


def fit(measured: DataFrame, rows: int = FIT_ROWS) -> Ordinal | None:
    """A regression on the grades of a bounded sample by hash of the id; None for an empty table."""
    got: list[Row] = graded(measured).orderBy(F.xxhash64("id"), "id").select("grade", *FEATURES).limit(rows).collect()
    if not got:
        return None
    data = np.array([[float(v) for v in r] for r in got])
    return Ordinal(len(GRADES) + 1).fit(data[:, 1:], data[:, 0].astype(int))


def reading_levels(texts: DataFrame, key: str = "doc_id", text: str = "text", model: Ordinal | None = None) -> DataFrame:
    """id, n_words, n_sentences, words_per_sentence, the features, demand (real-valued) and level (0 easiest).

    ``model`` may be fitted on one's own grades. Repeated rows give repeated rows.
    """
    measured = cut(features(texts, key, text))
    model = model or fit(measured)
    out = measured.withColumn("words_per_sentence", F.col("n_words") / F.col("n_sentences"))
    if model is None:
        return out.withColumn("demand", F.lit(None).cast("double")).withColumn("level", F.lit(None).cast("int"))
    demand = F.lit(0.0)
    for f, w, m, s in zip(FEATURES, model.w, model.mean, model.scale):
        demand = demand + (F.col(f) - float(m)) * float(w / s)
    level = F.lit(0)
    for c in model.cuts:
        level = level + F.when(F.col("demand") > float(c), 1).otherwise(0)
    return out.withColumn("demand", demand).withColumn("level", level)


def easy_texts(levels: DataFrame, words: float = GRADES[0]) -> DataFrame:
    """Texts with fewer than so many words a sentence."""
    return levels.where(F.col("words_per_sentence") < words)
