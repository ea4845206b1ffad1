"""Streams: windowed counts with late data, states of an append-only log, exactly-once stores, arriving documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestra.operators import passages
from attestra.sources.writers import store_new

STATES = "run_id string, item_id string, state string, n_entries long, n_rejected long"
KEPT = "state string, n long, bad long"


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each event type in tumbling windows; rows later than ``late`` are dropped on a stream."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")
    ).select("event_type", "n_events", "total", F.col("w.start").alias("window_start"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", "n_events", F.col("w.start").alias("begin"), F.col("w.end").alias("end"))


def log_states(log: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The state of each (run_id, item_id) of a log with (seq, new_state), entries that the transitions forbid being counted and skipped.

    ``allowed``: state to the states that may follow; "" is the state before the first entry.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n, bad = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for new in rows["new_state"]:
            if new in allowed.get(now, ()):
                now, n = new, n + 1
            else:
                bad += 1
        state.update((now, n, bad))
        yield pd.DataFrame({"run_id": [key[0]], "item_id": [key[1]], "state": [now], "n_entries": [n], "n_rejected": [bad]})

    return log.groupBy("run_id", "item_id").applyInPandasWithState(step, STATES, KEPT, "update", GroupStateTimeout.NoTimeout)


def keep_new(stream: DataFrame, path: str, checkpoint: str, key: str = "sha256") -> StreamingQuery:
    """Append to a store what it lacks; a batch that is run again after a failure appends nothing twice."""
    return stream.writeStream.foreachBatch(lambda df, _: store_new(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_candidates(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Claim and evidence candidates of documents as their files arrive."""
    return passages.candidates(spark.readStream.schema(schema).parquet(path))
