"""Chains verified as their events arrive, in whatever order they arrive.

An event that comes before its predecessor waits in state until the gap is closed, so the verdict is that of the
batch. A gap that stays open for longer than the patience given is a fault of the event that waits
behind it; a timer tells. What is kept per memory is its next number, its head hash, its last instant, and the early events.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.canonical import is_canonical_text
from ..operators.chains import envelope, genesis_of
from ..schema import CUSTODY, HEX_PATTERN, TS_PATTERN

FAULTS = "memory_id string, seq int, error string"
EVENT = ("event_type", "created_at", "prev_hash", "entry_hash", "payload_json", "envelope", "content_sha256")
#: The state store that timers and maps need; set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_fault(seq: int, event: tuple, head: str, last_at: str) -> str | None:
    """The first structural fault of an event whose predecessor has the hash head, in the order of the batch."""
    kind, at, prev, entry, payload, text, content = event
    tests = (
        ("vocabulary", kind not in CUSTODY.events), ("birth", seq == 0 and kind != CUSTODY.birth), ("rebirth", seq > 0 and kind == CUSTODY.birth), ("link", prev != head),
        ("payload", not is_canonical_text(payload)), ("hash", text is None or sha256(((prev or "") + text).encode()).hexdigest() != entry), ("timestamp", not re.match(TS_PATTERN, at or "")),
        ("backwards", seq > 0 and (at or "") < last_at), ("seal", seq == 0 and not re.match(HEX_PATTERN, content or "")),
    )
    return next((name for name, wrong in tests if wrong), None)


class Follower(StatefulProcessor):
    """Follows one memory's chain; reports its first fault, once."""

    def __init__(self, begin: str, patience_ms: int) -> None:
        self.begin, self.patience_ms = begin, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next_seq int, head string, last_at string, broken boolean")
        self.early = handle.getMapState("early", "seq int", ", ".join(f"{c} string" for c in EVENT))

    def _report(self, subject: str, seq: int, error: str) -> Iterator[pd.DataFrame]:
        if self.early.exists():
            self.early.clear()
        yield pd.DataFrame([(subject, seq, error)], columns=["memory_id", "seq", "error"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        subject = key[0]
        seq, head, last, broken = self.at.get() if self.at.exists() else (0, genesis_of(CUSTODY, subject, self.begin), "", False)
        if broken:
            return
        waited = self.early.exists()
        arrived: dict[int, tuple] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                event = tuple(None if v is None or v != v else v for v in (getattr(row, c) for c in EVENT))
                number = int(row.seq)
                # a number that has been taken, whenever its second event comes
                if number < seq or number in arrived or (waited and self.early.containsKey((number,))):
                    self.at.update((seq, head, last, True))
                    yield from self._report(subject, number, "seq")
                    return
                arrived[number] = event
        while True:
            if seq in arrived:
                event = arrived.pop(seq)
            elif waited and self.early.containsKey((seq,)):
                event = self.early.getValue((seq,))
                self.early.removeKey((seq,))
            else:
                break
            if error := first_fault(seq, event, head, last):
                self.at.update((seq, head, last, True))
                yield from self._report(subject, seq, error)
                return
            seq, head, last = seq + 1, event[3], event[1]
        self.at.update((seq, head, last, False))
        for number, event in arrived.items():
            self.early.updateValue((number,), event)
        if arrived:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, head, last, broken = self.at.get()
        if broken or not self.early.exists():
            return
        waiting = min(int(k[0]) for k in self.early.keys())
        self.at.update((seq, head, last, True))
        yield from self._report(key[0], waiting, "seq")

    def close(self) -> None:
        pass


def faults_in_any_order(events: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """memory_id, seq and error of each chain's first fault, its events arriving in any order.

    The session's state store must be the one named by PROVIDER. A query of this kind runs on, for its
    timers may still go off: give it a processing-time trigger, and stop it.
    """
    rows = events.select("memory_id", "seq", "event_type", "created_at", "prev_hash", "entry_hash", "payload_json", envelope(CUSTODY).alias("envelope"), F.get_json_object("payload_json", "$.content_sha256").alias("content_sha256"))
    return rows.groupBy("memory_id").transformWithStateInPandas(Follower(CUSTODY.prefix, patience_ms), FAULTS, "Append", "ProcessingTime")
