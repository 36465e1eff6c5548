"""Line deduplication across documents with keep bitmaps.

Each line's key (ASCII white space stripped, A-Z in lower case) is hashed to 128 bits. The
hashes are range-partitioned, with document and position as secondary sort, so equal keys stand
together and the first document that holds a key comes first. A partition streams its rows and
notes the positions that some other, smaller document already holds. The range boundaries run
over (hash, document, position), so one very common line spreads over many partitions; what a
partition must know of the one before it, the first document of its first hash, is one row a
partition. What is decided travels as bitmaps: one zlib-compressed bit a line, and only for
documents that lose a line. They meet their texts in one join (``with_bitmaps``), which is where a text travels, once.

Defined results: a null or empty text is one empty line and keeps it; a row with a null doc_id
keeps all its lines and holds no key; rows that repeat a doc_id hold their keys together and
decide by their own texts; a key that one document holds twice keeps both lines; keys under
``min_chars`` always stay; a very long text is split by one task, and only the hashes of its
lines travel; an empty table gives no rows; other columns, whatever their names, stay as they
are, but for n_chars, which counts what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import carried, shared_dir, shared_table, text_of, uncarried

#: What is stripped from a line, and the least length of a key.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
LOWER = {c: c + 32 for c in range(65, 91)}
#: Lines that one range holds on average, and the fewest ranges.
RANGE_LINES, LEAST_RANGES = 500_000, 64

LINES = "h binary, doc_id long, text_key long, pos int"


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(LOWER)


def text_key() -> F.Column:
    """Tells rows with the same doc_id apart by their text."""
    return F.xxhash64(text_of())


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                hs, ids, keys, places = [], [], [], []
                for doc, tk, text in zip(part["doc_id"].to_pylist(), part["text_key"].to_pylist(), part["text"].to_pylist(), strict=True):
                    for pos, line in enumerate(text.split("\n")):
                        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                            hs.append(digest(key.encode("utf-8", "surrogatepass")))
                            ids.append(doc)
                            keys.append(tk)
                            places.append(pos)
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], ["h", "doc_id", "text_key", "pos"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first hash, its last hash and the first document of the last one."""
    first = last = owner = part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hs, docs = batch["h"].to_numpy(zero_copy_only=False), batch["doc_id"].to_numpy()
        if first is None:
            first, part = hs[0], batch["part"][0].as_py()
        if hs[-1] != last:
            last, at = hs[-1], len(hs) - 1
            while at and hs[at - 1] == last:
                at -= 1
            owner = int(docs[at])
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([owner], pa.int64())], ["part", "first_h", "last_h", "owner"])


def _losers(carried: dict[int, tuple[bytes, int]]):
    """Streams a sorted partition; yields the lines whose key a smaller document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, owner, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                begun = True
                current, owner = carried.get(batch["part"][0].as_py(), (None, None))
            hs, docs = batch["h"].to_numpy(zero_copy_only=False), batch["doc_id"].to_numpy()
            starts = np.empty(len(hs), bool)
            starts[0] = hs[0] != current
            starts[1:] = hs[1:] != hs[:-1]
            at = np.maximum.accumulate(np.where(starts, np.arange(len(hs)), -1))
            owners = np.where(at >= 0, docs[at], 0 if owner is None else owner)
            lost = docs != owners
            current, owner = hs[-1], int(owners[-1])
            yield batch.select(["doc_id", "text_key", "pos"]).filter(pa.array(lost))

    return run


def _carried(ends: list[tuple[int, bytes, bytes, int]]) -> dict[int, tuple[bytes, int]]:
    """For each range that begins with its predecessor's last hash: that hash and its first document."""
    out: dict[int, tuple[bytes, int]] = {}
    last, owner = None, None
    for part, first_h, last_h, own in sorted(ends):
        if first_h == last:
            out[part] = (last, owner)
            if last_h == first_h:
                continue
        last, owner = last_h, own
    return out


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key and pos of every line that goes."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))
    lines = shared_table(keyed.mapInArrow(_hashes(min_chars), LINES), "line-hashes")
    ranges = max(LEAST_RANGES, lines.count() // RANGE_LINES)
    ordered = lines.repartitionByRange(ranges, "h", "doc_id", "text_key", "pos").sortWithinPartitions("h", "doc_id", "text_key", "pos")
    # checkpointed as it lies: both passes see the very same ranges, whatever is lost meanwhile
    shared_dir(docs.sparkSession)
    ranged = ordered.withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    # one row a range
    ends = [(r["part"], bytes(r["first_h"]), bytes(r["last_h"]), r["owner"]) for r in ranged.mapInArrow(_ends, "part int, first_h binary, last_h binary, owner long").collect()]
    return ranged.mapInArrow(_losers(_carried(ends)), "doc_id long, text_key long, pos int")


def pack_bits(n_lines: int, lost: list[int]) -> bytes:
    """The keep bitmap: a bit a line, first line in the highest bit, compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[lost] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        # as long as the last lost line; the lines after it stay
        n = [int(max(p)) + 1 for p in frame["lost"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "text_key": frame["text_key"], "n_bits": n, "n_dropped": [len(set(p.tolist())) for p in frame["lost"]], "keep": [pack_bits(k, p) for k, p in zip(n, frame["lost"], strict=True)]})


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, n_bits, n_dropped and the bitmap keep, for documents that lose a line.

    Lines past n_bits stay.
    """
    lost = lost_lines(docs, min_chars).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("lost"))
    return lost.mapInPandas(_bitmaps, "doc_id long, text_key long, n_bits int, n_dropped long, keep binary")


def kept_text(text: str, bitmap: bytes | None, n_bits: int) -> str:
    if bitmap is None:
        return text
    keep = unpack_bits(bitmap, int(n_bits))
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i >= n_bits or keep[i])


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (all columns of docs), doc_id, text, and keep, n_bits and n_dropped (null: nothing goes)."""
    rows = carried(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text_of("row.text").alias("text")).withColumn("text_key", text_key())
    return rows.join(keep_bitmaps(docs.select("doc_id", "text"), min_chars), ["doc_id", "text_key"], "left").drop("text_key")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = [kept_text(t, k, n) for t, k, n in zip(part["text"].to_pylist(), part["keep"].to_pylist(), part["n_bits"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.string())], ["row", "text"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines gone from text and n_chars, where there is one, counting what is left.

    Rows that lose nothing keep their text as it is, null included.
    """
    both = with_bitmaps(docs, min_chars)
    schema = StructType([both.schema["row"], StructField("text", StringType())])
    cut = both.where(F.col("keep").isNotNull()).select("row", "text", "keep", "n_bits").mapInArrow(_apply, schema)
    return both.where(F.col("keep").isNull()).select("row.*").union(uncarried(cut, docs, text=F.col("text"), n_chars=F.length("text")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part["text"].to_pylist()
            kept = [kept_text(t, k, n) for t, k, n in zip(texts, part["keep"].to_pylist(), part["n_bits"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pa.array([n or 0 for n in part["n_dropped"].to_pylist()], pa.int64()), pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, one row per row of docs."""
    both = with_bitmaps(docs.select("doc_id", "text"), min_chars).drop("row")
    return both.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
