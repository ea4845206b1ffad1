"""Exact ranking of all texts for a stated query set, in the scan.

Texts are scored against all queries where they are read, so that a pair of text and query never
becomes a row: of a block only the rows leave the task that can be among the first k of a query. The
scores are those of ``retrieval`` (its joins take over where the queries or the n-grams are too many
to go to the tasks). N-grams are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import retrieval
from attestra.runtime import cut

#: Queries up to this number are scored in the scan, ``QUERY_BLOCK`` of them in one; more are joined.
MOST_QUERIES, QUERY_BLOCK = 4096, 256
#: Distinct n-grams of the corpus up to this number go to the tasks (16 bytes each); more are joined.
MOST_GRAMS = 4_000_000
#: Texts of a block, and n-grams that are counted at once.
BLOCK, GRAMS = 4096, 1 << 20
#: Words whose products with the queries a task keeps.
KEPT_WORDS = 1 << 15
#: What ``\\s`` is in the JVM.
BLANKS = r"[ \t\n\x0B\f\r]+"
U = np.uint64


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def _lower() -> Column:
    """What ``_split`` parts into words: a string is far less work to send than its words."""
    return F.lower(F.coalesce("text", F.lit(""))).alias("w")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the values of a list column, null as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by word and hashes of the n-grams that ``retrieval.char_ngrams`` gives for each word: all windows of 3 to 5 of the padded word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))
    c = np.concatenate([c, np.zeros(4, U)])
    m = len(left)
    three = _mix(c[:m] | c[1 : m + 1] << U(21) | c[2 : m + 2] << U(42))
    four = _mix(three + U(0x9E3779B97F4A7C15) * (c[3 : m + 3] + U(1)))
    five = _mix(four + U(0xC2B2AE3D27D4EB4F) * (c[4 : m + 4] + U(1)))
    all_, kept = np.stack([three, four, five], 1), np.stack([left >= n for n in (3, 4, 5)], 1)
    per = np.add.reduceat(kept.sum(1), np.cumsum(size) - size) if m else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(per, dtype=np.int64)]), all_[kept]


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets by text, numbers and distinct ones of the words of lower-case texts; blanks at an end give an empty word, which has no n-grams."""
    at, values = _lists(pc.split_pattern_regex(column, BLANKS))
    coded = values.dictionary_encode()
    return at, _numbers(coded.indices).astype(np.int64), coded.dictionary


def _text_grams(at: np.ndarray, code: np.ndarray, offsets: np.ndarray, known: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, text, id, count) of the n-grams of texts of words, for some texts at a time; ``known`` are the ids, below ``most``, of the words' n-grams."""
    sizes = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(sizes[code])])[at] if len(code) else np.zeros(len(at), np.int64)
    a = 0
    while a < len(at) - 1:
        b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + GRAMS, "right")) - 1), len(at) - 1, a + BLOCK)
        words = code[at[a] : at[b]]
        n = sizes[words]
        place = np.arange(n.sum()) + np.repeat(offsets[words] - (np.cumsum(n) - n), n)
        text = np.repeat(np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), n)
        pairs, count = np.unique(text * most + known[place], return_counts=True)
        yield a, b, pairs // most, pairs % most, count
        a = b


def _gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): number of texts with each n-gram; the row of gram null has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, rows = np.zeros(0, U), np.zeros(0, np.int64), 0
        for batch in batches:
            at, code, words = _split(batch.column(0))
            offsets, hashes = gram_hashes(words.to_pylist())
            seen, back = np.unique(hashes, return_inverse=True)
            own = np.zeros(max(1, len(seen)), np.int64)
            for _, _, _, g, _ in _text_grams(at, code, offsets, back, len(own)):
                own += np.bincount(g, minlength=len(own))
            rows += batch.num_rows
            have, back = np.unique(np.concatenate([have, seen]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, own[: len(seen)]]), len(have)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(have.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.select(_lower()).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Queries:
    """The queries on the driver, with their words and n-grams."""

    def __init__(self, queries: DataFrame, words=tx.tokens):
        rows = queries.select("query_id", words(F.col("text")).alias("t"), _words(F.col("text")).alias("w")).toArrow()
        self.type = queries.schema["query_id"].dataType
        self.ids = rows["query_id"].to_pylist()
        self.tokens = [sorted(set(t or ())) for t in rows["t"].to_pylist()]
        self.words = [w or [] for w in rows["w"].to_pylist()]
        self.terms = sorted({t for own in self.tokens for t in own})

    @classmethod
    def of(cls, queries: DataFrame) -> Queries | None:
        """None if there are none or too many, or an id isn't unique."""
        own = cls(queries) if 0 < queries.count() <= MOST_QUERIES else None
        return own if own and len(set(own.ids)) == len(own.ids) and None not in own.ids else None

    def blocks(self) -> list[range]:
        return [range(i, min(i + QUERY_BLOCK, len(self.ids))) for i in range(0, len(self.ids), QUERY_BLOCK)]


def indexed(corpus: DataFrame, queries: Queries, keep: tuple[str, ...] = ("doc_id",), words=tx.tokens) -> DataFrame:
    """Columns of the corpus with n (tokens), own (distinct tokens) and terms, tf (those that queries have, by number), written once: the texts' tokens are read only here."""
    terms = corpus.sparkSession.sparkContext.broadcast(queries.terms)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value, pa.string())
        most = max(1, len(known))
        for batch in batches:
            at, values = _lists(batch.column(batch.num_columns - 1))
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            coded = values.dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, count = np.unique(text * size + _numbers(coded.indices).astype(np.int64), return_counts=True)
            term = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            text, term = pairs // size, term[pairs % size] if len(pairs) else pairs
            own = np.bincount(text, minlength=batch.num_rows)
            text, term, count = text[term >= 0], term[term >= 0], count[term >= 0]
            order = np.argsort(text * most + term)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (term, count)]
            cols = [*batch.columns[:-1], pa.array(np.diff(at).astype(np.int32)), pa.array(own.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "n", "own", "terms", "tf"])

    schema = ", ".join(f"`{c}` {corpus.schema[c].dataType.simpleString()}" for c in keep)
    rows = corpus.select(*keep, words(F.coalesce("text", F.lit(""))).alias("_t"))
    return cut(rows.mapInArrow(reduce, f"{schema}, n int, own int, terms array<int>, tf array<int>"))


def _matrix(rows: list[dict[int, float]], n: int) -> np.ndarray:
    out = np.zeros((max(1, n), len(rows)))
    for q, row in enumerate(rows):
        for t, v in row.items():
            out[t, q] = v
    return out


class Bm25:
    """``retrieval.bm25`` over ``indexed``."""

    needs = ("n", "terms", "tf")

    def __init__(self, queries: Queries, index: DataFrame):
        whole = index.agg(F.count("*").alias("c"), F.avg("n").alias("avg")).first()
        self.avg, total = max(1.0, whole["avg"] or 0.0), max(1, whole["c"])
        df = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        self.idf = {t: float(np.log(1 + (total - d + 0.5) / (d + 0.5))) for t, d in zip(df["t"].to_pylist(), df["df"].to_pylist())}
        self.queries = queries

    def fitted(self, block: range):
        place = {t: i for i, t in enumerate(self.queries.terms)}
        have = [{place[t]: self.idf[place[t]] for t in self.queries.tokens[q] if place[t] in self.idf} for q in block]
        weights, avg = _matrix(have, len(place)), self.avg

        def score(cols: dict[str, pa.Array]) -> Iterator[tuple[int, int, np.ndarray]]:
            for a, b, text, term, tf, n in _indexed_rows(cols):
                part = tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * n[text] / avg))
                s = _product(text, term, part, weights, b - a)
                yield a, b, s / (s + retrieval.SQUASH)

        return score


class Jaccard:
    """``retrieval.jaccard`` over ``indexed``."""

    needs = ("own", "terms", "tf")

    def __init__(self, queries: Queries):
        self.queries = queries

    def fitted(self, block: range):
        place = {t: i for i, t in enumerate(self.queries.terms)}
        weights = _matrix([{place[t]: 1.0 for t in self.queries.tokens[q]} for q in block], len(place))
        m = np.array([len(self.queries.tokens[q]) for q in block], float)

        def score(cols: dict[str, pa.Array]) -> Iterator[tuple[int, int, np.ndarray]]:
            for a, b, text, term, tf, n in _indexed_rows(cols, "own"):
                c = _product(text, term, np.ones(len(text)), weights, b - a)
                yield a, b, c / np.maximum(n[:, None] + m - c, 1)

        return score


class Tfidf:
    """``retrieval.tfidf_cosine`` over texts. ``of`` gives None if the corpus has too many n-grams."""

    needs = ("w",)

    def __init__(self, queries: Queries, grams: np.ndarray, n: np.ndarray, total: int):
        order = np.argsort(grams)
        self.grams, self.idf, self.queries = grams[order], np.log((1.0 + total) / (1 + n[order])) + 1, queries

    @classmethod
    def of(cls, queries: Queries, corpus: DataFrame) -> Tfidf | None:
        counts = cut(_gram_counts(corpus))
        if counts.count() > MOST_GRAMS:
            return None
        rows = counts.toArrow()
        grams, n = rows["gram"], rows["n"]
        total = pc.sum(n.filter(pc.is_null(grams))).as_py() or 0
        valid = pc.is_valid(grams)
        return cls(queries, grams.filter(valid).to_numpy().view(U), n.filter(valid).to_numpy(), total)

    def fitted(self, block: range):
        grams, idf = self.grams, self.idf
        own = []
        for q in block:
            h, count = np.unique(gram_hashes(self.queries.words[q])[1], return_counts=True)
            at, found = _find(grams, h)
            own.append(dict(zip(at[found].tolist(), (count[found] * idf[at[found]]).tolist())))
        used = np.array(sorted({t for row in own for t in row}), np.int64)
        column = np.full(len(grams) + 1, -1, np.int32)
        column[used] = np.arange(len(used))
        weights = _matrix([{int(column[t]): v for t, v in row.items()} for row in own], len(used))
        norms = np.maximum(np.sqrt((weights * weights).sum(0)), 1e-300)

        # a text's product is the sum of its words' products, which are taken once
        kept: list = [pa.array([], pa.string()), np.zeros((0, len(block)))]

        def products(words: pa.Array, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
            words = words.cast(pa.string())
            new = np.nonzero(pc.is_null(pc.index_in(words, value_set=kept[0])).to_numpy(zero_copy_only=False))[0]
            if len(kept[0]) + len(new) > KEPT_WORDS:
                kept[:], new = [kept[0][:0], kept[1][:0]], np.arange(len(words))
            if len(new):
                n = np.diff(offsets)[new]
                col_of = known[np.arange(n.sum()) + np.repeat(offsets[new] - (np.cumsum(n) - n), n)]
                word, col = np.repeat(np.arange(len(new)), n), column[col_of]
                asked = col >= 0
                rows = _product(word[asked], col[asked], idf[col_of[asked]], weights, len(new))
                kept[:] = [pa.concat_arrays([kept[0], words.take(pa.array(new))]), np.concatenate([kept[1], rows])]
            return kept[1][pc.index_in(words, value_set=kept[0]).to_numpy(zero_copy_only=False)]

        def score(cols: dict[str, pa.Array]) -> Iterator[tuple[int, int, np.ndarray]]:
            at, code, words = _split(cols["w"])
            offsets, hashes = gram_hashes(words.to_pylist())
            known = _find(grams, hashes)[0]
            by_word = products(words, offsets, known)
            # words in an order of their own: equal texts, and texts of the same words, get equal sums
            sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes, dtype=U)])
            order = np.argsort(sums[offsets[1:]] - sums[offsets[:-1]], kind="stable")
            order = order[by_word[order].any(1)]
            place = np.full(len(words), -1, np.int64)
            place[order] = np.arange(len(order))
            by_word, most = by_word[order], max(1, len(order))
            for a, b, text, gram, tf in _text_grams(at, code, offsets, known, len(grams) + 1):
                w = tf * idf[gram]
                norm = np.sqrt(np.bincount(text, w * w, b - a))
                word, text = place[code[at[a] : at[b]]], np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                pairs, count = np.unique(text[word >= 0] * most + word[word >= 0], return_counts=True)
                dots = _product(pairs // most, pairs % most, count.astype(float), by_word, b - a)
                yield a, b, dots / np.where(norm > 0, norm, 1)[:, None] / norms

        return score


def _find(have: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(have, asked)
    return at, (have[np.minimum(at, len(have) - 1)] == asked) & (at < len(have)) if len(have) else np.zeros(len(asked), bool)


def _indexed_rows(cols: dict[str, pa.Array], length: str = "n") -> Iterator[tuple]:
    at, terms = _lists(cols["terms"])
    tf, n, terms = _numbers(_lists(cols["tf"])[1]).astype(float), _numbers(cols[length]).astype(float), _numbers(terms)
    for a in range(0, len(n), BLOCK):
        b = min(a + BLOCK, len(n))
        yield a, b, np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), terms[at[a] : at[b]], tf[at[a] : at[b]], n[a:b]


def _product(text: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of value x weights[term] by text; equal texts get equal sums, whatever lies beside them."""
    out = np.zeros((n, weights.shape[1]))
    own, first = np.unique(text, return_index=True)
    last = np.append(first[1:], len(text))
    for i, a, b in zip(own.tolist(), first.tolist(), last.tolist()):
        out[i] = np.einsum("i,ij->j", value[a:b], weights[term[a:b]])
    return out


def _rounded(s: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return s if digits is None else np.floor(s * 10.0**digits + 0.5) / 10.0**digits


def _blocks(cols: dict[str, pa.Array], fits: list, digits: int | None) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first, last, scores by measure, which pairs have a score at all) of some texts at a time."""
    n = len(next(iter(cols.values())))
    for a in range(0, n, BLOCK):
        size = min(BLOCK, n - a)
        own = {c: x.slice(a, size) for c, x in cols.items()}
        parts = [np.concatenate([s for _, _, s in fit(own)]) for fit in fits]
        some = np.logical_or.reduce([p > 0 for p in parts])
        yield a, a + size, [_rounded(p, digits) for p in parts], some


def _columns(source: DataFrame, needs: set[str]) -> DataFrame:
    cols = [F.col(c) for c in sorted(needs - {"w"})]
    if "w" in needs:
        cols.append(_lower())
    return source.select("doc_id", *cols)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as they do."""
    return np.array([x.encode() for x in column.to_pylist()]) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else _numbers(column)


def _first(held: list, new: list, by: int, k: int) -> list:
    """The first k rows of each query of two lists of columns (q, id, key, scores), by measure ``by``."""
    both = [pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y]) for x, y in zip(held, new)]
    rank = np.lexsort((both[1], -both[3 + by], both[0]))
    q = both[0][rank]
    rank = rank[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return [x.take(pa.array(rank)) if isinstance(x, pa.Array) else x[rank] for x in both]


def _tops(source: DataFrame, measures: list, block: range, k: int, digits: int | None) -> DataFrame:
    """(q, doc_id, s0.., by): rows that can be among the first k of a query by measure ``by``."""
    fits, count = [m.fitted(block) for m in measures], len(block)
    names = [f"s{i}" for i in range(len(measures))]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by measure the first k rows of each query so far, and what the k-th of them reaches: a later row has to reach it as well
        least = [np.zeros(count) for _ in fits]
        held: list = [None for _ in fits]
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            keys = cols.pop("doc_id")
            for a, b, scores, some in _blocks(cols, fits, digits):
                ids = _ids(keys.slice(a, b - a))
                order = np.argsort(ids, kind="stable")
                ids, some = ids[order], some[order]
                scores = [s[order] for s in scores]
                for by, s in enumerate(scores):
                    s = np.where(some, s, -1.0)
                    if len(s) >= k:
                        least[by] = np.maximum(least[by], np.partition(s, len(s) - k, axis=0)[len(s) - k])
                    q, row = np.nonzero(((s >= least[by]) & some).T)
                    if not len(q):
                        continue
                    # the rows of a query are in the order of their ids already
                    rank = np.lexsort((row, -s[row, q], q))
                    q, row = q[rank], row[rank]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, row = q[place < k], row[place < k]
                    new = [q, ids[row], keys.take(pa.array(order[row] + a)), *(x[row, q] for x in scores)]
                    held[by] = new if held[by] is None else _first(held[by], new, by, k)
                    full = np.searchsorted(held[by][0], np.arange(count), "right") - 1
                    full = full[np.bincount(held[by][0], minlength=count)[:count] >= k]
                    least[by][held[by][0][full]] = np.maximum(least[by][held[by][0][full]], held[by][3 + by][full])
        for by, own in enumerate(held):
            if own is not None:
                out = [pa.array(own[0].astype(np.int32)), own[2], *map(pa.array, own[3:]), pa.array(np.full(len(own[0]), by, np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["q", "doc_id", *names, "by"])

    needs = set().union(*(m.needs for m in measures))
    kind = source.schema["doc_id"].dataType.simpleString()
    return _columns(source, needs).mapInArrow(best, f"q int, doc_id {kind}, {', '.join(f'{s} double' for s in names)}, `by` int")


def _named(rows: DataFrame, queries: Queries, block: range) -> DataFrame:
    spark = rows.sparkSession
    ids = spark.createDataFrame([(i, queries.ids[q]) for i, q in enumerate(block)], f"q int, query_id {queries.type.simpleString()}")
    return rows.join(F.broadcast(ids), "q").drop("q")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top(source: DataFrame, queries: Queries, measure, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` of each query, ties to the smaller doc_id."""
    parts = [_named(_tops(source, [measure], block, k, digits), queries, block) for block in queries.blocks()]
    rows = _union(parts).select("query_id", "doc_id", F.col("s0").alias("score"))
    return retrieval.top_k(rows, k)


def fused_top(source: DataFrame, queries: Queries, lexical, semantic, k: int, digits: int | None = None, constant: int = 60) -> DataFrame:
    """What ``retrieval.fused_top`` gives for the scores of two measures of all pairs that have one of them (the other counts as 0)."""
    depth = constant + 2 * k
    parts = []
    for block in queries.blocks():
        w = Window.partitionBy("q").orderBy(F.desc("s"), "doc_id")
        tops = cut(_tops(source, [lexical, semantic], block, depth, digits))
        first = [tops.where(F.col("by") == i).withColumn("s", F.col(f"s{i}")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth) for i in (0, 1)]
        pool = first[0].unionByName(first[1]).select("q", "doc_id", "s0", "s1").distinct().toArrow()
        parts.append(_named(_ranked(source, [lexical, semantic], block, digits, pool), queries, block))
    by = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id")
    fused = _union(parts).withColumn("rrf", 1 / (constant + F.col("lexical_rank")) + 1 / (constant + F.col("semantic_rank")))
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _ranked(source: DataFrame, measures: list, block: range, digits: int | None, pool: pa.Table) -> DataFrame:
    """The pool's rows with their rank in both orders among all rows of their query, from counts between them."""
    spark = source.sparkSession
    q, keys = _numbers(pool["q"].combine_chunks()), pool["doc_id"].combine_chunks()
    ids = _ids(keys) if len(keys) else np.zeros(0)
    scores = [_numbers(pool[f"s{i}"].combine_chunks()) for i in (0, 1)]
    # ids as places among all of the pool: whole numbers compare faster
    ids, place = np.unique(ids, return_inverse=True)
    orders = [np.lexsort((place, -s, q)) for s in scores]
    begin = np.searchsorted(np.sort(q), np.arange(len(block) + 1))
    marks = [(-s[o], place[o]) for s, o in zip(scores, orders)]
    shared, fits = spark.sparkContext.broadcast(marks), [m.fitted(block) for m in measures]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(begin[-1] + 1, np.int64) for _ in fits]
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            own = cols.pop("doc_id")
            for a, b, scores, some in _blocks(cols, fits, digits):
                docs = np.searchsorted(ids, _ids(own.slice(a, b - a))) if len(ids) else np.zeros(b - a, np.int64)
                some = np.ascontiguousarray(some.T)
                for by, s in enumerate(scores):
                    s = -np.ascontiguousarray(s.T)
                    for i in range(len(begin) - 1):
                        value, mark = (x[begin[i] : begin[i + 1]] for x in shared.value[by])
                        have = some[i]
                        at = _place(value, mark, s[i, have], docs[have])
                        n[by][begin[i] : begin[i + 1]] += np.bincount(at, minlength=len(value) + 1)[: len(value)]
        for by, x in enumerate(n):
            at = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), by, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["by", "at", "n"])

    needs = set().union(*(m.needs for m in measures))
    counted = _columns(source, needs).mapInArrow(count, "`by` int, at int, n long").groupBy("by", "at").agg(F.sum("n").alias("n")).toArrow()
    by, at, n = (_numbers(counted[c].combine_chunks()) for c in ("by", "at", "n"))
    ranks = []
    for i, order in enumerate(orders):
        found = np.zeros(len(q), np.int64)
        found[at[by == i]] = n[by == i]
        ahead = np.concatenate([[0], np.cumsum(found)])
        rank = np.zeros(len(q), np.int64)
        rank[order] = ahead[1:] - ahead[begin[q[order]]]
        ranks.append(rank)
    rows = list(zip(q.tolist(), keys.to_pylist(), scores[0].tolist(), scores[1].tolist(), ranks[0].tolist(), ranks[1].tolist()))
    kind = source.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"q int, doc_id {kind}, lexical double, semantic double, lexical_rank long, semantic_rank long")


def _place(value: np.ndarray, mark: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each (own, ids) the first of the sorted marks that doesn't come before it."""
    at = np.searchsorted(value, own)
    if len(value):
        tied = np.nonzero(value[np.minimum(at, len(value) - 1)] == own)[0]
        for first in np.unique(at[tied]).tolist():
            rows = tied[at[tied] == first]
            last = int(np.searchsorted(value, value[first], "right"))
            at[rows] = first + np.searchsorted(mark[first:last], ids[rows])
    return at


def bm25_top(corpus: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """The first ``k`` rows of (query_id, doc_id, score, rank) by ``retrieval.bm25``, scores rounded; doc_id is unique."""
    own = Queries.of(queries)
    if own is None:
        return retrieval.top_k(retrieval.bm25(corpus, queries).withColumn("score", F.round("score", digits)), k)
    index = indexed(corpus, own)
    return top(index, own, Bm25(own, index), k, digits)


def tfidf_top(corpus: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """As ``bm25_top`` by ``retrieval.tfidf_cosine``."""
    own = Queries.of(queries)
    fit = None if own is None else Tfidf.of(own, corpus)
    if fit is None:
        return retrieval.top_k(retrieval.tfidf_cosine(corpus, queries).withColumn("score", F.round("score", digits)), k)
    return top(corpus, own, fit, k, digits)


def jaccard_top(corpus: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """As ``bm25_top`` by ``retrieval.jaccard``."""
    own = Queries.of(queries)
    if own is None:
        return retrieval.top_k(retrieval.jaccard(corpus, queries).withColumn("score", F.round("score", digits)), k)
    return top(indexed(corpus, own), own, Jaccard(own), k, digits)


def token_fusion(corpus: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """``retrieval.fused_top`` of ``retrieval.bm25`` and ``retrieval.jaccard`` with rounded scores; doc_id is unique."""
    own = Queries.of(queries)
    if own is None:
        lex = retrieval.bm25(corpus, queries).select("query_id", "doc_id", F.round("score", digits).alias("lexical"))
        sem = retrieval.jaccard(corpus, queries).select("query_id", "doc_id", F.round("score", digits).alias("semantic"))
        # written once: tops and counts are both taken from the scores
        return retrieval.fused_top(cut(lex.join(sem, ["query_id", "doc_id"])), k)
    index = indexed(corpus, own)
    return fused_top(index, own, Bm25(own, index), Jaccard(own), k, digits)


def text_fusion(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``retrieval.fused_top`` of ``retrieval.bm25`` and ``retrieval.tfidf_cosine`` over all pairs that share a token or an n-gram, and the (doc_id, text) it read; doc_id is unique."""
    own = Queries.of(queries)
    index = None if own is None else indexed(corpus, own, ("doc_id", "text"))
    fit = None if own is None else Tfidf.of(own, index)
    if fit is not None:
        return fused_top(index, own, Bm25(own, index), fit, k), index.select("doc_id", "text")
    lex = retrieval.bm25(corpus, queries).select("query_id", "doc_id", F.col("score").alias("lexical"))
    sem = retrieval.tfidf_cosine(corpus, queries).select("query_id", "doc_id", F.col("score").alias("semantic"))
    both = cut(lex.join(sem, ["query_id", "doc_id"], "full").fillna(0.0, ["lexical", "semantic"]))
    return retrieval.fused_top(both, k), corpus
