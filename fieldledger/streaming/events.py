"""Structured Streaming over the custody event log: running verification, activity, and a sink."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chains import envelope, genesis_of
from ..schema import CUSTODY, TABLES, TS_FORMAT

STATE = "next_seq int, head string, last_at string, broken boolean"
FAULTS = "memory_id string, seq int, error string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The custody chain's Parquet folder as a stream, so many files a trigger."""
    return spark.readStream.schema(TABLES["custody_chain"]).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _follow(begin: str, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Checks what has come for one memory against its head; reports its first fault, once."""
    subject = key[0]
    seq, head, last, broken = state.get if state.exists else (0, genesis_of(CUSTODY, subject, begin), "", False)
    out = []
    # a trigger's events of one memory, put in order; one memory's share of a trigger is small
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for r in rows.itertuples(index=False):
        if broken:
            break
        error = None
        if r.seq != seq:
            error = "seq"
        elif (r.event_type == CUSTODY.birth) != (seq == 0):
            error = "birth" if seq == 0 else "rebirth"
        elif r.prev_hash != head:
            error = "link"
        elif sha256((head + r.envelope).encode()).hexdigest() != r.entry_hash:
            error = "hash"
        elif r.created_at < last:
            error = "backwards"
        if error:
            broken = True
            out.append((subject, int(r.seq), error))
        else:
            seq, head, last = seq + 1, r.entry_hash, r.created_at
    state.update((int(seq), head, last, bool(broken)))
    yield pd.DataFrame(out, columns=["memory_id", "seq", "error"])


def faults(events: DataFrame) -> DataFrame:
    """memory_id, seq and error of each chain's first fault as its events arrive.

    What is kept per memory is its next number, its head hash and its last instant.
    """
    rows = events.select("memory_id", "seq", "event_type", "created_at", "prev_hash", "entry_hash", envelope(CUSTODY).alias("envelope"))
    return rows.groupBy("memory_id").applyInPandasWithState(partial(_follow, CUSTODY.prefix), FAULTS, STATE, "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per window, actor and type; windows close once the watermark has passed them."""
    timed = events.withColumn("at", F.to_timestamp("created_at", TS_FORMAT)).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "actor_id", "event_type").agg(F.count("*").alias("n"))


def into_field(events: DataFrame, field, checkpoint: str):
    """Starts a query that commits every batch of new events to a field, as one version.

    The checkpoint names the writer, so a query that starts again from it commits no batch twice.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            field.commit_frames(once=(checkpoint, number), custody_chain=batch)

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
