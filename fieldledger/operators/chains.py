"""Hash chains: genesis, building, heads and structural verification."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import is_canonical_text, json_object, json_text
from ..schema import CUSTODY, HEX_PATTERN, TS_PATTERN, ChainKind
from .graph import settled


def genesis(kind: ChainKind, subject: str | Column) -> Column:
    c = F.col(subject) if isinstance(subject, str) else subject
    return F.sha2(F.concat(F.lit(kind.prefix), c), 256)


def genesis_of(kind: ChainKind, subject: str, prefix: str | None = None) -> str:
    """prefix is for tasks, which do not know the profile that the driver uses."""
    return sha256(((prefix or kind.prefix) + subject).encode()).hexdigest()


def envelope(kind: ChainKind) -> Column:
    """The canonical text of an event, from the chain's columns; payload_json is taken as it is."""
    members = {c: json_text(c) for c in (kind.subject, "event_type", kind.actor, "reason", "created_at")}
    return json_object(seq=F.col("seq").cast("string"), payload=F.col("payload_json"), **members)


def recomputed(kind: ChainKind) -> Column:
    return F.sha2(F.concat("prev_hash", envelope(kind)), 256)


def subject_rows(chain: DataFrame, kind: ChainKind, subject: str) -> DataFrame:
    """One subject's chain in order."""
    return chain.where(F.col(kind.subject) == subject).orderBy("seq")


def _link(kind: ChainKind, schema: list[str]):
    begin = kind.prefix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, head = None, ""
        for frame in batches:
            prev, entry = [], []
            for s, text in zip(frame[kind.subject], frame["_envelope"], strict=True):
                if s != subject:
                    subject, head = s, genesis_of(kind, s, begin)
                prev.append(head)
                head = sha256((head + text).encode()).hexdigest()
                entry.append(head)
            yield frame.assign(prev_hash=prev, entry_hash=entry)[schema]

    return run


def build(events: DataFrame, kind: ChainKind) -> DataFrame:
    """The chain of events that lack their hashes: prev_hash and entry_hash come in.

    Hashing is sequential within a subject, so subjects are dealt out, sorted by seq, and
    streamed with one hash as the only state: a long chain takes time, not memory.
    """
    schema = [kind.subject, "seq", "event_type", kind.actor, "reason", "created_at", "payload_json", "prev_hash", "entry_hash"]
    ddl = ", ".join(f"{c} {'int' if c == 'seq' else 'string'}" for c in schema)
    rows = events.select(*schema[:-2], envelope(kind).alias("_envelope"))
    return rows.repartition(kind.subject).sortWithinPartitions(kind.subject, "seq").mapInPandas(_link(kind, schema), ddl)


def streamed(rows: DataFrame, key: str, order: Sequence[str], fold: Callable[[str, Iterable[str], object], object], finish: Callable[[str, object, int], tuple], schema: str) -> DataFrame:
    """One row a key from its texts in order, which pass as a stream: fold(key, texts, state) takes the
    next of them (state is None at first), finish(key, state, count) makes the row.

    rows has key, the columns of order, and text. A key of any size takes time, not memory.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for frame in batches:
            done = []
            for k, texts in frame.groupby(key, sort=False)["text"]:
                if k != current:
                    if current is not None:
                        done.append(finish(current, state, count))
                    current, state, count = k, None, 0
                state, count = fold(k, texts, state), count + len(texts)
            yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([finish(current, state, count)], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, "text").mapInPandas(run, schema)


def folded_heads(events: DataFrame, kind: ChainKind) -> DataFrame:
    """Each subject's head and length straight from its events, one hash being the only state."""
    begin = kind.prefix

    def fold(subject: str, texts: Iterable[str], head: object) -> str:
        head = head or genesis_of(kind, subject, begin)
        for text in texts:
            head = sha256((head + text).encode()).hexdigest()
        return head

    rows = events.select(kind.subject, "seq", envelope(kind).alias("text"))
    return streamed(rows, kind.subject, ["seq", "text"], fold, lambda subject, head, n: (subject, head, n), f"{kind.subject} string, entry_hash string, length int")


def heads(chain: DataFrame, kind: ChainKind) -> DataFrame:
    return chain.groupBy(kind.subject).agg(F.max_by("entry_hash", "seq").alias("entry_hash"))


def births(chain: DataFrame, kind: ChainKind) -> DataFrame:
    return chain.where("seq = 0")


#: What an event learns of the row before it in its chain, and whether its payload is canonical.
BESIDE = (("_prev_seq", "int"), ("_prev", "string"), ("_prev_at", "string"), ("_canonical", "boolean"))


def _last_rows(kind: ChainKind):
    """The last row of a range, in few columns."""
    names = ["_range", kind.subject, "seq", "entry_hash", "created_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield last.select(names)

    return run


def _beside(kind: ChainKind, carried: dict[int, tuple]):
    """Streams a range in order; each row gets what it needs of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if before is None:
                before = carried.get(batch["_range"][0].as_py(), (None, None, None, None))
            shifted = []
            for value, name in zip(before, (kind.subject, "seq", "entry_hash", "created_at"), strict=True):
                own = batch[name]
                shifted.append(pa.concat_arrays([pa.array([value], own.type), own.slice(0, len(own) - 1)]))
            same = pc.fill_null(pc.equal(shifted[0], batch[kind.subject]), False)
            none = [pa.scalar(None, a.type) for a in shifted[1:]]
            # most payloads of a chain are of a few forms, so each text is parsed once a batch
            coded = batch["payload_json"].dictionary_encode()
            fine = pa.array([is_canonical_text(t) for t in coded.dictionary.to_pylist()], pa.bool_()).take(coded.indices)
            new = [*[pc.if_else(same, a, n) for a, n in zip(shifted[1:], none, strict=True)], pc.fill_null(fine, False)]
            before = tuple(batch[name][-1].as_py() for name in (kind.subject, "seq", "entry_hash", "created_at"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[n for n, _ in BESIDE]])

    return run


def checked_rows(chain: DataFrame, kind: ChainKind, events: tuple[str, ...] | None = None) -> DataFrame:
    """The chain with ``error``, the first structural fault of each event (or null), and ``_fault``, its place among the faults.

    One shuffle: rows are dealt by ranges of (subject, seq), so that a subject with most of all
    events is checked in parallel, and stream through once. A range is told the last row of the
    one before it, which is one row a range. Of rows that share a subject and a seq, all but one have the fault ``seq``.
    """
    vocabulary = list(events or kind.events)
    ordered = chain.repartitionByRange(kind.subject, "seq").sortWithinPartitions(kind.subject, "seq", "entry_hash")
    laid = settled(ordered.withColumn("_range", F.spark_partition_id()))
    rows = laid.mapInArrow(_last_rows(kind), f"_range int, {kind.subject} string, seq int, entry_hash string, created_at string").collect()  # one a range
    ends = sorted(tuple(r) for r in rows)
    carried = {after[0]: last[1:] for last, after in zip(ends, ends[1:], strict=False)}
    beside = ", ".join(f"{n} {t}" for n, t in BESIDE)
    rows = laid.mapInArrow(_beside(kind, carried), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + ", " + beside)
    first = F.col("seq") == 0
    expected = F.when(first, genesis(kind, kind.subject)).otherwise(F.col("_prev"))
    sealed = F.coalesce(F.get_json_object("payload_json", "$.content_sha256").rlike(HEX_PATTERN), F.lit(False)) if kind is CUSTODY else F.lit(True)
    steps = F.when(first, F.col("_prev_seq").isNull()).otherwise(F.col("_prev_seq") == F.col("seq") - 1)
    faults = [
        ("seq", (F.col("seq") < 0) | ~F.coalesce(steps, F.lit(False))),
        ("vocabulary", ~F.col("event_type").isin(vocabulary)),
        ("birth", first & (F.col("event_type") != kind.birth)),
        ("rebirth", ~first & (F.col("event_type") == kind.birth)),
        ("link", F.col("prev_hash") != expected),
        ("payload", ~F.col("_canonical")),
        ("hash", recomputed(kind) != F.col("entry_hash")),
        ("timestamp", ~F.col("created_at").rlike(TS_PATTERN)),
        ("backwards", ~first & (F.col("created_at") < F.col("_prev_at"))),
        ("seal", first & ~sealed),
    ]
    place = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(i)) for i, (_, test) in enumerate(faults)])
    names = F.array(*[F.lit(name) for name, _ in faults])
    return rows.withColumn("_fault", place).withColumn("error", F.get(names, F.col("_fault"))).drop("_range", *[n for n, _ in BESIDE])


def verify(chain: DataFrame, kind: ChainKind, events: tuple[str, ...] | None = None) -> DataFrame:
    """subject, seq and error of the first fault of each faulty chain."""
    bad = checked_rows(chain, kind, events).where("error IS NOT NULL")
    first = bad.groupBy(F.col(kind.subject).alias("subject")).agg(F.min(F.struct("seq", "_fault", "error")).alias("f"))
    return first.select("subject", "f.seq", "f.error")
