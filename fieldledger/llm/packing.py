"""Best-fit packing by minimum bin slack.

Documents become token ids and an end token; longer ones are cut into full sequences, their
first piece being the shorter one. What packing must decide depends on the lengths alone, so
the plan is made from the histogram of lengths (at most ``capacity`` - 1 numbers, however many
documents there are): per bin, a bitset subset-sum over the available lengths finds the fullest
combination with the longest length left, which is then removed; while the stock allows the
same combination again, the plan repeats it. Pieces of a length are then numbered without
gaps, over all machines, and each number names its place in the plan.

Defined results: a null text is the empty text and is packed as its end token; a null id is packed
like any other; repeated rows are packed each; pieces of equal length, whatever their ids, are
interchangeable to the plan and are numbered by a hash, ties by document and piece; a very long text is coded and cut by one
task, in the memory of its ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, dense_number, shared_table, text_of

CAPACITY, END_ID = 1024, 2
#: Text chunks whose ids a worker keeps at a time; only speed depends on it.
CACHE = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_CODERS: dict[str, "Coder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Token ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit integers.

    The pre-tokenizer never looks past a single space before a visible character, so texts are
    cut there and the ids of each chunk are kept for the next use. Chunks of Latin letters, on
    whose character classes all Unicode versions agree, are coded with the same vocabulary by
    the faster library; other chunks by the tokenizer itself. Texts with a space before other
    white space or at their end, or with a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.whole = re.compile("|".join([r" \s", r" \Z", *map(re.escape, special)]))
        self.latin = re.compile("[\0-\u024f]*")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        missing = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = list(dict.fromkeys(chunks))
        latin, fast, pack = self.latin.fullmatch, self.fast, struct.pack
        for c in missing:
            if latin(c):
                ids = fast(c)
                self.known[c] = pack(f"<{len(ids)}I", *ids)
            else:
                self.known[c] = self.encode(c)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if self.whole.search(text):
                out.append(self.encode(text))
                continue
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]
            try:
                out.append(b"".join(map(self.known.__getitem__, chunks)))
            except KeyError:
                self.learn(chunks)
                out.append(b"".join(map(self.known.__getitem__, chunks)))
        return out


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than capacity if there are more."""
    if length <= capacity:
        return [(0, length)]
    short = length % capacity
    starts = [*([0] if short else []), *range(short, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc, ids in zip(part["doc_id"].to_pylist(), code(part["text"].to_pylist()), strict=True):
                    ids += end
                    rows += [(doc, i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(first: int, stock: dict[int, int], capacity: int) -> list[int]:
    """The lengths, first among them, whose sum comes closest to capacity from below.

    A bitset holds the reachable sums; lengths join it from the longest to the shortest, each up
    to its stock, and the way back takes as few of the short ones as it can.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(stock, reverse=True):
        many = min(stock[length] - (length == first), room // length)
        take = 1
        while many > 0:  # binary splitting: copies 1, 2, 4, ... and the rest
            take = min(take, many)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            many -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, [first]
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths of one sequence) for the whole stock of lengths."""
    stock = {k: v for k, v in histogram.items() if v}
    out = []
    while stock:
        lengths = fullest(max(stock), stock, capacity)
        uses = {k: lengths.count(k) for k in set(lengths)}
        often = min(stock[k] // n for k, n in uses.items())
        out.append((often, lengths))
        for k, n in uses.items():
            stock[k] -= n * often
            if not stock[k]:
                del stock[k]
    return out


def slots(steps: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, copies in a sequence, first sequence, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for often, lengths in steps:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * often
            offset += n * length
        sequence += often
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                rows = table[int(length)]
                row = rows[np.searchsorted(rows[:, 0], numbers[mine], "right") - 1]
                behind, within = np.divmod(numbers[mine] - row[:, 0], row[:, 1])
                sequence[mine] = row[:, 2] + behind
                offset[mine] = row[:, 3] + within * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    path = tokenizer or default_tokenizer()
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_pieces(path, capacity, end_id), PIECES)
    pieces = shared_table(coded, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = slots(plan(counts, capacity))
    # repeated rows of a document are told apart by where they lie in the written table
    pieces = pieces.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_twin", F.monotonically_increasing_id())
    numbered = dense_number(pieces, ["length"], ["_id", "piece", "_twin"], "number", buckets_for(sum(counts.values())))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").cast("long").alias("number")).mapInArrow(_place(table), PIECES + ", sequence_id long, offset long")
