"""New batches of documents against everything accepted before.

A text's distinct three-word runs are dealt by their own hash into chunks, so an edit changes only the
chunks of the runs that it touches. There are so many chunks that similar texts must have several of
them whole in common, whatever the edits. Chunk hashes with the text that holds them form a table; texts
that share enough chunks are compared in full, and no pair of similar texts is missed. Identical texts
are one class and are never paired with each other. ``batch_repeats`` checks a whole delivery at once,
``History`` keeps the chunk table on storage and checks batch by batch.

Fixed by the statement of the problem: runs of three words, similarity 0.8, at least 20 words.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attestra.llm.words import U, _powers, mix, runs_of, word_hashes
from attestra.runtime import cut, cut_path, forget

RUN, SIMILAR, LEAST_WORDS = 3, 0.8, 20
#: Texts of fewer runs are looked up by single runs (level 0), others by chunks (level 1 and up).
LEAST_RUNS = 32
#: A single run in more classes than this is looked up together with a second such run of the text.
HOT = 16
#: Largest number of runs of the texts whose level this is (level 1 first). A text similar to one of a level has at
#: most a quarter more runs, so it is of that level or of the next.
TOP = [LEAST_RUNS * 5 // 4 - 1]
while TOP[-1] < 2**31:
    TOP.append(TOP[-1] * 5 // 4)
#: Of a text of n runs and a similar one no shorter, at most n / 4 runs are in one of them only, each in one chunk. With
#: ``SHARE`` chunks more than that, so many chunks at least are equal (of both texts without a run, or the same in both).
APART = [top // 4 for top in TOP]
SHARE = [3 * x // 10 + 2 for x in APART]
#: Equal chunks that a lookup must find; so many fewer than ``SHARE`` of the commonest chunks aren't looked up.
FOUND = [x // 8 + 1 for x in SHARE]
#: The last bits of a chunk's key are its level.
LEVELS = 128
#: Chunks are looked up in so many passes, by the first bits of their keys: a pass leaves on the disk what is held more than once.
PASSES = 3
#: Keys of 24 bytes up to this number are broadcast (under 50 MB as a table in memory), more are joined.
BROADCAST_IDS = 400_000
TEXT_SCHEMA = "id {id}, class binary, runs int, chunks array<bigint>, empty array<struct<level:int,n:int>>"

# Query parameters that only track visits.
TRACKING = r"^(utm_[a-z_]*|gclid|fbclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|ref_src)$"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def address_key(url: Column) -> Column:
    """One form for addresses that lead to the same page; null for null, blank or not an http(s) address."""
    u = F.trim(F.regexp_replace(url, r"[\s​﻿]+$|^[\s​﻿]+", ""))
    part = lambda k: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    host = F.regexp_replace(host, r"^[^@]*@|\.$", "")
    for name, port in DEFAULT_PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":{port}$|:$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(_percent(path), "/+$", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    query = F.concat_ws("&", F.array_sort(F.transform(kept, _percent)))
    return F.when(F.length(host) > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _percent(x: Column) -> Column:
    """Percent-escapes undone, but for those of characters that part an address (kept, in upper case)."""
    kept = F.regexp_replace(x, r"%(?=2[356Bbf]|2F|3[bBdDfF]|25)", "%25")
    kept = F.regexp_replace(kept, r"%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), x)
    return F.when(F.contains(x, F.lit("%")), plain).otherwise(x)


def file_key(sha: Column) -> Column:
    """The 64 hex digits of a file hash however written; null where there are none."""
    found = F.regexp_extract(F.lower(sha), r"(?:^|[^0-9a-f])([0-9a-f]{64})(?:[^0-9a-f]|$)", 1)
    return F.when(found != "", found)


# --- texts ---------------------------------------------------------------------------------------


def levels(runs: int) -> list[int]:
    """Levels of a text of so many distinct runs: its own, and the one below if a similar text may be of that; two similar texts share that of the shorter one."""
    if runs < LEAST_RUNS:
        return [0]
    own = 1 + bisect_left(TOP, runs)
    return [own - 1, own] if own == 1 or 4 * runs <= 5 * TOP[own - 2] else [own]


def chunks(runs: np.ndarray, sums: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Hashes of a level's chunks that have a run, and the number of those without; ``runs`` are distinct and sorted.

    ``sums`` are prefix sums of the mixed runs. The chunk of a run follows from its upper bits, so
    chunks are stretches of the sorted runs.
    """
    k = APART[level - 1] + SHARE[level - 1]
    place = ((runs >> U(32)) * U(k)) >> U(32)
    start = np.flatnonzero(np.concatenate([_TRUE, place[1:] != place[:-1]]))
    end = np.append(start[1:], len(runs))
    return sums[end] - sums[start] + place[start] * U(0x9FB21C651E98DF25) + U(level * 0xD1B54A32D192ED03 % (1 << 64)), k - len(start)


_TRUE = np.ones(1, dtype=bool)


def _keyed(hashes: np.ndarray, level: int) -> np.ndarray:
    return (mix(hashes) & ~U(LEVELS - 1)) | U(level)


def _sums(x: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=U)
    np.cumsum(x * up[: len(x)], out=out[1:])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of runs and sums that stand for a text's words, for many texts at once; then each text's chunks."""
    for batch in batches:
        row, count, sizes, keys, classes, empties = [], [], [0], [], [], []
        for first, h, at in word_hashes(batch.column(1).to_pylist()):
            up, down = _powers(max(1 << 21, 1 << (len(h) + 1).bit_length()))
            runs, sums = runs_of(h, RUN), _sums(h, up)
            long = np.flatnonzero(np.diff(at) >= LEAST_WORDS)
            a, b = at[long], at[long + 1]
            # 128 bits that stand for a text's words
            other = _sums(mix(h + U(1)), up)
            classes.append(np.stack([mix((s[b] - s[a]) * down[a] + (b - a).astype(U)) for s in (sums, other)], axis=1))
            for d, i, j in zip(long.tolist(), a.tolist(), b.tolist()):
                r = np.unique(runs[i : j - RUN + 1])
                u = len(r)
                row.append(first + d)
                count.append(u)
                total = np.zeros(u + 1, dtype=U)
                np.cumsum(mix(r), out=total[1:])
                at_levels = levels(u)
                single, n, empty = at_levels[0] == 0, 0, []
                for level in at_levels:
                    if level:
                        k, none = chunks(r, total, level)
                        # chunks without a run aren't stored; texts with so many of them that these could be all that is equal are looked up by runs too
                        single |= none >= SHARE[level - 1]
                        keys.append(_keyed(k, level))
                        empty.append({"level": level, "n": none})
                        n += len(k)
                if single:
                    keys.append(_keyed(r, 0))
                    empty.append({"level": 0, "n": 0})
                    n += u
                empties.append(empty)
                sizes.append(sizes[-1] + n)
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
        cls = np.concatenate(classes) if classes else np.zeros((0, 2), dtype=U)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array([c.tobytes() for c in cls], pa.binary()),
                pa.array(count, pa.int32()),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)),
                pa.array(empties, pa.list_(pa.struct([("level", pa.int32()), ("n", pa.int32())]))),
            ],
            names=["id", "class", "runs", "chunks", "empty"],
        )


def _run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for _, h, at in word_hashes(batch.column(1).to_pylist()):
            sets += [np.unique(runs_of(h[a:b], RUN)).tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "set"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similar"])


def features(texts: DataFrame) -> DataFrame:
    """(id, text) to (id, class, runs, chunks); texts of fewer than ``LEAST_WORDS`` words have no row."""
    return texts.mapInArrow(_features, TEXT_SCHEMA.format(id=texts.schema["id"].dataType.simpleString()))


def chunk_pairs(left: DataFrame, right: DataFrame | None = None, similar: float = SIMILAR, drop: str | None = None) -> DataFrame:
    """Candidate pairs of classes (a, b), a < b: all that can be similar, and others that share as many chunks.

    ``left`` has (class, runs, chunks, empty), one row each. With ``right`` (class, runs, empty, h: the chunk table
    of a history) one of the two is of ``left`` and the other of either, else both are of ``left``. Two similar
    texts have ``SHARE`` equal chunks of a level, so a text needn't be looked up by its commonest ones:
    without ``SHARE - FOUND`` of them, ``FOUND`` equal ones remain, less those that have no run in
    either text (``empty`` counts a text's; these are the commonest). Chunks of one class pair nothing and are
    dropped while a row is a key and a text; of the history only rows of the chunks looked up are read
    on. Single runs (level 0) go the same way, 80 % of a text's being shared; one held by more than
    ``HOT`` classes is looked up together with each other such run of the text, for which one run more
    than needed is kept. ``drop`` is the path of the written table that ``left`` is read from; its chunks
    are looked up in ``PASSES``, so that no more than a part of them is shuffled at a time, and it is
    removed as soon as they have been.
    """
    if similar < SIMILAR:
        raise ValueError(f"chunks are made for a similarity of {SIMILAR} and above")
    text = F.xxhash64("class").alias("text")
    rows = left.select(text, F.explode("chunks").alias("h"))
    names = left.select(text, "class", "runs", "empty")
    if right is not None:
        old = cut(touched(right, rows.select("h").distinct(), "h"))
        names = names.unionByName(old.select(text, "class", "runs", "empty")).dropDuplicates(["text"])
        rows = rows.withColumn("side", F.lit(0)).unionByName(old.select(text, "h", F.lit(1).alias("side")))
    names = cut(names) if drop else names
    of = F.shiftright(F.shiftrightunsigned("h", 48) * PASSES, 16)
    parts = [cut(_shared(rows.where(of == i))) for i in range(PASSES)] if drop else [_shared(rows)]
    forget(left.sparkSession, drop)
    found = reduce(DataFrame.unionByName, parts).withColumn("level", F.col("h").bitwiseAND(LEVELS - 1).cast("int"))
    found = found if right is not None else found.withColumn("side", F.lit(0))
    # by level: chunks that aren't looked up, those to find, most runs (level 0 follows from the text)
    rules = [(0, 0, 1, 2**31 - 1), *((i + 1, s - f, f, min(top, 2**31 - 1)) for i, (s, f, top) in enumerate(zip(SHARE, FOUND, TOP)))]
    rules = F.broadcast(left.sparkSession.createDataFrame(rules, "level int, spare int, found int, top int"))
    info = names.select("text", "runs", F.inline("empty")).join(rules, "level")
    skip = F.when(F.col("level") == 0, F.ceil(similar * F.col("runs") - 1e-6).cast("int") - 2).otherwise(F.col("spare") - F.col("n"))
    need = F.when(F.col("level") == 0, 1).otherwise(F.col("found") - F.greatest(F.col("n") - F.col("spare"), F.lit(0)))
    info = info.select("text", "level", "runs", skip.alias("skip"), need.cast("int").alias("need"), (F.col("runs") <= F.col("top")).alias("own"))
    after = F.row_number().over(Window.partitionBy("text", "side", "level").orderBy(F.desc("df"), F.desc("h"))) - 1
    # a row or two of a text: the chunks are sorted for the window alone
    kept = found.join(info.hint("shuffle_hash"), ["text", "level"]).withColumn("after", after).where((F.col("side") == 1) | (F.col("after") >= F.col("skip")))
    kept = cut(kept.select("text", "side", "level", "runs", "h", "df", "need", "own"))
    for part in parts:
        forget(left.sparkSession, cut_path(part))
    cols = ["text", "side", "level", "runs", "need", "own"]
    hot = (F.col("level") == 0) & (F.col("df") > HOT) & (F.col("runs") > 1)
    two = kept.where(hot).join(kept.where(hot).select("text", "side", F.col("h").alias("h2")), ["text", "side"]).where("h < h2")
    keys = kept.where(~hot).select(*cols, F.col("h").alias("key")).unionByName(two.select(*cols, F.xxhash64("h", "h2").alias("key")))
    side = lambda x, c: keys.where(c).select("key", "level", *(F.col(k).alias(f"{k}_{x}") for k in ("text", "side", "runs", "need", "own")))
    pairs = side("a", "true").join(side("b", "side = 0"), ["key", "level"]).where("text_a < text_b or (side_a = 1 and text_a <> text_b)")
    pairs = pairs.where((F.least("runs_a", "runs_b") >= similar * F.greatest("runs_a", "runs_b") - 1e-6) & ((F.col("level") == 0) | F.col("own_a") | F.col("own_b")))
    # a level and what both texts need of it in one number, with the side: fewer bytes for each pair
    code = (F.greatest("need_a", "need_b").cast("long") * LEVELS + F.col("level")) * 2 + F.col("side_a")
    pairs = pairs.select(F.least("text_a", "text_b").alias("text_a"), F.greatest("text_a", "text_b").alias("text_b"), code.alias("code"))
    # as many as both texts need
    pairs = pairs.groupBy("text_a", "text_b", "code").agg(F.count("*").alias("found")).withColumn("need", F.floor(F.col("code") / (2 * LEVELS)))
    pairs = cut(pairs.where("found >= need").select("text_a", "text_b").distinct())
    forget(left.sparkSession, cut_path(kept))
    name = lambda x: names.select(F.col("text").alias(f"text_{x}"), F.col("class").alias(x))
    pairs = pairs.join(name("a"), "text_a").join(name("b"), "text_b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows with a key that others have too, and the number of these (df)."""
    often = rows.groupBy("h").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # far fewer than the rows, which needn't be sorted for them
    return rows.join(often.hint("shuffle_hash"), "h")


def touched(rows: DataFrame, asked: DataFrame, *on: str) -> DataFrame:
    """The rows of a stored table whose keys are asked for; a batch's keys travel to the table where they are few enough."""
    asked = cut(asked)
    return rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, list(on), "left_semi")


def near_identical(texts: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(id, text) to members (id, class) and links (a, b, similar) between classes of different texts, a < b.

    Texts of one class have the same words. Links have a similarity of ``similar`` or more of their
    sets of three-word runs. Null texts and texts of fewer than 20 words are in neither; ids may
    repeat with other texts. No pairs are made within a class.
    """
    f = cut(features(texts))
    members = cut(f.select("id", "class"))
    whole = _representatives(f, members)
    pairs = cut(chunk_pairs(whole, similar=similar, drop=cut_path(whole) or cut_path(f)))
    one = members.groupBy("class").agg(F.min("id").alias("id"))
    want = cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(one, "class"))
    sets = _sets(texts, want)
    x, y = sets.select(F.col("class").alias("a"), F.col("set").alias("x")), sets.select(F.col("class").alias("b"), F.col("set").alias("y"))
    links = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similarity, "a binary, b binary, similar double")
    return members, links.where(F.col("similar") >= similar)


def _representatives(f: DataFrame, members: DataFrame) -> DataFrame:
    """One row of each class. Where ids tell rows apart, and they or those of repeats are few enough to be broadcast, the chunks stay where they are."""
    one = cut(members.groupBy("class").agg(F.min("id").alias("id")))
    if members.distinct().count() == members.count():
        if one.count() <= BROADCAST_IDS:
            return f.join(F.broadcast(one), ["id", "class"], "left_semi")
        rest = cut(members.join(one, ["id", "class"], "left_anti"))
        if rest.count() <= BROADCAST_IDS:
            return f.join(F.broadcast(rest), ["id", "class"], "left_anti")
    whole = cut(f.groupBy("class").agg(F.min("id").alias("id"), F.first("runs").alias("runs"), F.first("chunks").alias("chunks"), F.first("empty").alias("empty")))
    forget(f.sparkSession, cut_path(f))
    return whole


def _sets(texts: DataFrame, want: DataFrame) -> DataFrame:
    """(class, set of run hashes) of the wanted (class, id)."""
    ids = F.broadcast(want) if want.count() <= BROADCAST_IDS else want
    return cut(texts.join(ids, "id").select("class", "text").mapInArrow(_run_sets, "class binary, set binary").dropDuplicates(["class"]))


def batch_repeats(
    records: DataFrame, texts: DataFrame, record_id: str = "crawl_id", text_id: str = "crawl_id", arrived: str = "downloaded", similar: float = SIMILAR
) -> DataFrame:
    """For each arrived record that repeats earlier ones, the earliest of them, and by what it repeats it.

    ``records``: record_id, batch_no, document_id, sha256, final_url, status. ``texts``: text_id, text.
    A record repeats those with the same document_id, file hash, address or a near-identical text; the
    order is batch_no, then record_id. Result: record, earliest, by (array of document_id, sha256,
    final_url, text: those that tie it to the earliest). Null keys and short texts match nothing, rows
    of other status and rows without id are left out, repeated rows count once. A key that a third of
    all records hold is reduced to its earliest before it is joined.
    """
    own = records.where(F.col("status") == arrived).select(
        F.col(record_id).alias("id"),
        F.struct(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch"), F.col(record_id).alias("id")).alias("at"),
        F.trim("document_id").alias("document_id"), file_key(F.col("sha256")).alias("sha256"), address_key(F.col("final_url")).alias("final_url"),
    ).where("id is not null")
    names = ("document_id", "sha256", "final_url")
    keys = own.select("id", "at", F.explode(F.array(*(F.struct(F.lit(i).alias("by"), F.when(F.col(c) != "", F.col(c)).alias("k")) for i, c in enumerate(names)))).alias("x"))
    keys = cut(keys.where("x.k is not null").select("id", "at", F.col("x.by").alias("by"), F.unhex(F.md5("x.k")).alias("key")))
    first = keys.groupBy("by", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    hits = keys.join(first, ["by", "key"]).where("first < at").select("id", "at", "by", "first")

    written = texts.select(F.col(text_id).alias("id"), F.col("text")).where("id is not null and text is not null")
    members, links = near_identical(written, similar)
    members = members.distinct().join(own.select("id", "at").distinct(), "id")
    earliest = members.groupBy("class").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(earliest.select(F.col("class").alias("b"), "at"), "b").groupBy(F.col("a").alias("class")).agg(F.min("at").alias("near"))
    best = earliest.join(near, "class", "left").select("class", "n", F.least("at", "near").alias("first"), F.col("near").isNotNull().alias("linked"))
    alike = members.join(best.where("n > 1 or linked"), "class").where("first < at").select("id", "at", F.lit(3).alias("by"), "first")
    label = F.array(*(F.lit(x) for x in (*names, "text")))
    out = hits.unionByName(alike).groupBy("id").agg(F.min("first").alias("first"), F.collect_set(F.struct("by", "first")).alias("all"))
    return out.select(
        F.col("id").alias("record"), F.col("first.id").alias("earliest"),
        F.array_sort(F.transform(F.filter("all", lambda x: x["first"] == F.col("first")), lambda x: label[x["by"]])).alias("by"),
    )


class History:
    """Everything so far, on storage: keys, the chunk-to-text table, sets of runs, accepted records.

    Rows of a batch become visible only when its name is written to the list of commits, after all its
    tables, so that a batch that failed half-way leaves nothing behind and can be added again. The
    tables are narrow (no text is kept), and a batch reads on only the rows that its own keys, chunks
    and classes touch.
    """

    TABLES = {
        "keys": "by int, key binary, record {id}, seq int", "chunks": "class binary, runs int, empty array<struct<level:int,n:int>>, h bigint", "texts": "class binary, record {id}, seq int, set binary",
        "accepted": "record {id}, seq int",
    }

    def __init__(self, spark: SparkSession, path: str, record_id: str = "crawl_id", id_type: str = "bigint"):
        self.spark, self.path, self.record_id, self.id_type = spark, path.rstrip("/"), record_id, id_type

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch string, seq int").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None

    def table(self, name: str) -> DataFrame:
        schema = self.TABLES[name].format(id=self.id_type)
        done = self._commits()
        if done is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}").join(done.select("batch"), "batch", "left_semi").drop("batch")

    def accepted(self) -> DataFrame:
        return self.table("accepted").select("record")

    def add(self, batch: DataFrame, similar: float = SIMILAR, against: str = "accepted") -> DataFrame:
        """(record, repeats): what each record of a batch repeats, null for what is accepted.

        A record repeats an accepted record, or an earlier one (by id) of its own batch, with the same
        document_id, file hash or address or a near-identical text; of several the one of the earliest
        batch, then of the smallest id. With ``against="all"`` rejected records are looked up too, so
        that the batches one by one give what ``batch_repeats`` gives for all of them at once. Null keys
        and texts under 20 words match nothing, rows without id are left out, repeated rows count once.
        """
        if against not in ("accepted", "all"):
            raise ValueError("against is 'accepted' or 'all'")
        done = self._commits()
        now = F.lit(done.count() if done is not None else 0)
        cols = ("document_id", "sha256", "final_url")
        own = batch.select(F.col(self.record_id).cast(self.id_type).alias("id"), F.trim("document_id").alias("document_id"), file_key(F.col("sha256")).alias("sha256"), address_key(F.col("final_url")).alias("final_url"), "text")
        own = cut(own.where("id is not null"))
        x = F.explode(F.array(*(F.struct(F.lit(i).alias("by"), F.when(F.col(c) != "", F.col(c)).alias("k")) for i, c in enumerate(cols))))
        keys = cut(own.select("id", x.alias("x")).where("x.k is not null").select("id", F.col("x.by").alias("by"), F.unhex(F.md5("x.k")).alias("key")).distinct())
        old = touched(self.table("keys"), keys.select("by", "key").distinct(), "by", "key")
        at, own_at = F.struct("seq", F.col("record").alias("id")), F.struct(now.alias("seq"), "id")
        first = old.select("by", "key", at.alias("at")).unionByName(keys.select("by", "key", own_at.alias("at"))).groupBy("by", "key").agg(F.min("at").alias("first"))
        hits = keys.join(first, ["by", "key"]).select("id", "first")

        texts = own.select("id", "text").where("text is not null")
        f = cut(features(texts))
        whole = cut(f.groupBy("class").agg(F.min("id").alias("id"), F.first("runs").alias("runs"), F.first("chunks").alias("chunks"), F.first("empty").alias("empty")))
        sets = _sets(texts, whole.select("class", "id"))
        pairs = cut(chunk_pairs(whole, self.table("chunks"), similar))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(whole.select("class")).distinct()
        stored = cut(touched(self.table("texts"), ends, "class"))
        all_sets = stored.select("class", "set").unionByName(sets).dropDuplicates(["class"])
        side = lambda c, n: all_sets.select(F.col("class").alias(c), F.col("set").alias(n))
        links = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_similarity, "a binary, b binary, similar double").where(F.col("similar") >= similar)
        earliest = stored.select("class", at.alias("at")).unionByName(whole.select("class", own_at.alias("at"))).groupBy("class").agg(F.min("at").alias("at"))
        same = whole.select(F.col("class").alias("a"), F.col("class").alias("b"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
        near = both.join(earliest.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.min("at").alias("first"))
        best = hits.unionByName(f.select("id", "class").join(near, "class").select("id", "first")).where(F.col("first") < own_at)
        out = own.select("id").distinct().join(best.groupBy("id").agg(F.min("first").alias("first")), "id", "left")
        out = cut(out.select(F.col("id").alias("record"), F.col("first.id").alias("repeats")))
        self._append(out if against == "all" else out.where("repeats is null"), out, now, keys, f, sets, stored)
        return out

    def _append(self, kept: DataFrame, out: DataFrame, now: Column, keys: DataFrame, f: DataFrame, sets: DataFrame, stored: DataFrame) -> None:
        name = uuid.uuid4().hex
        of = kept.select(F.col("record").alias("id"))
        new = f.join(of, "id", "left_semi").join(stored.select("class"), "class", "left_anti")
        new = new.groupBy("class").agg(F.min("id").alias("record"), F.first("runs").alias("runs"), F.first("chunks").alias("chunks"), F.first("empty").alias("empty"))
        tables = {
            "keys": keys.join(of, "id", "left_semi").select("by", "key", F.col("id").alias("record"), now.alias("seq")),
            "chunks": new.select("class", "runs", "empty", F.explode("chunks").alias("h")),
            "texts": new.select("class", "record", now.alias("seq")).join(sets, "class"),
            "accepted": out.where("repeats is null").select("record", now.alias("seq")),
        }
        for table, rows in tables.items():
            rows.withColumn("batch", F.lit(name)).write.mode("append").parquet(f"{self.path}/{table}")
        self.spark.range(1).select(F.lit(name).alias("batch"), now.cast("int").alias("seq")).write.mode("append").parquet(f"{self.path}/commits")


def deliveries(records: DataFrame, texts: DataFrame, path: str, record_id: str = "crawl_id", arrived: str = "downloaded") -> DataFrame:
    """(record, earliest) of the batches of ``records`` given to a ``History`` at ``path`` one by one, in the order of batch_no.

    ``records`` and ``texts`` as in ``batch_repeats``, whose rows these are: every record of an earlier
    batch is looked up, whether it was accepted or not. Records without batch_no come last.
    """
    spark = records.sparkSession
    store = History(spark, path, record_id, records.schema[record_id].dataType.simpleString())
    own = records.where((F.col("status") == arrived) & F.col(record_id).isNotNull()).select(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no"), record_id, "document_id", "sha256", "final_url")
    own = cut(own.join(texts.select(record_id, "text"), record_id, "left"))
    out = []
    for n in sorted(r[0] for r in own.select("batch_no").distinct().collect()):  # one row a batch
        out.append(store.add(own.where(F.col("batch_no") == n), against="all"))
    if not out:
        return own.select(F.col(record_id).alias("record"), F.col(record_id).alias("earliest"))
    return reduce(DataFrame.unionByName, out).where("repeats is not null").select("record", F.col("repeats").alias("earliest")).distinct()
