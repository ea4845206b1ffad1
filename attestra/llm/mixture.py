"""A mixture of sources with given shares of all tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.runtime import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def source_key(source: Column) -> Column:
    """A source's name in its clean form: lower case, words joined by underscores; null where there is none."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(source, r"\p{Cf}+", "")), r"[\s\p{Z}\-‐‑–_]+", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(plain != "", plain)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens) of each document by a public byte-level vocabulary; a null text has 0 tokens.

    The vocabulary file (about a megabyte) is read where the driver has it and travels to the tasks.
    """
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "source", "n_tokens"])

    own = docs.select(F.col(key).alias("id"), source_key(F.col("source")).alias("source"), F.col(text).alias("text"))
    return own.mapInArrow(count, f"id {own.schema['id'].dataType.simpleString()}, source string, n_tokens long")


@dataclass
class Mixture:
    """documents: id, source, n_tokens, copies (1 or more). rates: by target source, before the draw.

    shares: by target source, target_share and the tokens, share and most copies that were reached.
    """

    documents: DataFrame
    rates: DataFrame
    shares: DataFrame


def mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> Mixture:
    """Documents of (id, source, n_tokens) with the number of copies that brings each source to its share.

    A source's rate is its share of ``total_tokens`` over the tokens it has, at most max_repeats. A
    document is emitted floor(rate) times, and once more with the probability of the rest, drawn from a
    hash of the seed and its id. Without ``total_tokens`` the mixture is the largest in which no source
    with documents is short of its target. Target sources without documents (or with no tokens) get
    nothing and their share is divided among the others in proportion; documents of other sources,
    without source or with 0 tokens are left out. Repeated rows of a document are mixed once each.
    """
    goal = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats > 0")
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).where("tokens > 0")
    both = goal.join(have, "source", "left")
    there = F.when(F.col("tokens") > 0, F.col("target_share"))
    whole = both.agg(F.sum(there).alias("present"), F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("largest")).first()
    present = whole["present"] or 1.0
    total = float(total_tokens) if total_tokens is not None else (whole["largest"] or 0.0) * present
    # one row for each target source: the driver holds no more than the targets
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") / present * total / F.col("tokens"))
    rates = both.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11)).cast("double") / float(1 << 53)
    # the targets are fewer than sources can be: checked before they are broadcast
    small = rates.select("source", "rate")
    small = F.broadcast(small) if targets.count() <= 100_000 else small
    drawn = counted.where("n_tokens > 0").join(small, "source")
    copies = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    documents = drawn.withColumn("copies", copies.cast("int")).where("copies > 0").select("id", "source", "n_tokens", "copies")
    got = documents.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    reached = rates.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), "rate",
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    # one row for each target source
    shares = reached.withColumn("reached_share", F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy()), F.lit(0)))
    return Mixture(documents, rates, shares)


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizers: str = TOKENIZERS) -> Mixture:
    """``mix`` of documents counted once: the counts are written before they are used twice."""
    return mix(cut(token_counts(docs, tokenizers=tokenizers)), targets, total_tokens, seed)


def emit(documents: DataFrame) -> DataFrame:
    """One row for each copy of a document, numbered from 1."""
    return documents.select("id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
