"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, about as wide as the logarithm of a block's rows, and each block
keeps, for every segment, its rows sorted by the segment's value. A query looks up the values at
segment radius 0, then 1, and so on, one segment after the other, and verifies the full distance
of every row that it meets. After radius r in all segments and r + 1 in the first j, every row
within (r + 1) * segments - 1 + j has been met: once k verified distances are within that, or
the k-th distance that an earlier block has already proven is, the answer is complete.

Defined results: see ``vectors.usable`` for the vectors that take part, also where ids repeat; bit
i of a code is set if component i is above zero; codes of different widths do not meet; a row is
never a neighbour of its own id; ties go to the smaller id; fewer candidates than k give fewer
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .vectors import QUERY_EVERY, TOP_K, in_blocks, usable


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch["vec_id"].to_pylist(), batch["width"].to_pylist(), batch["embedding"], strict=True)
        codes = [(i, w, np.packbits(v.values.to_numpy() > 0).tobytes()) for i, w, v in rows]
        columns = list(zip(*codes, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["vec_id", "width", "code"])


def binary_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, width and code, the packed signs of the components."""
    return usable(vectors).mapInArrow(_codes, "vec_id long, width int, code binary")


class Segments:
    """The multi-index of one block of codes, an array of shape (rows, bytes), of which ``bits`` count."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        rows, width = codes.shape
        self.bits = bits
        # a segment as wide as the logarithm of the rows has about one row a value
        self.count = max(1, min(bits, round(bits / max(1.0, math.log2(rows)))), -(-bits // 24))
        self.parts = np.array_split(np.arange(bits), self.count)
        self.words = self.whole_words(codes)
        values = self.segment(codes)
        self.order = [np.argsort(v, kind="stable") for v in values]
        self.begin = [np.r_[0, np.cumsum(np.bincount(v, minlength=1 << len(p)))] for v, p in zip(values, self.parts, strict=True)]
        self.masks = {}
        for n in {len(p) for p in self.parts}:
            weights = np.bitwise_count(np.arange(1 << n, dtype=np.uint64))
            by_weight = np.argsort(weights, kind="stable")
            self.masks[n] = np.split(by_weight, np.cumsum(np.bincount(weights, minlength=n + 1))[:-1])

    @staticmethod
    def whole_words(codes: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
        padded[:, : codes.shape[1]] = codes
        return padded.view(np.uint64)

    def segment(self, codes: np.ndarray) -> list[np.ndarray]:
        """The value of each segment, one array a segment."""
        bits = np.unpackbits(codes, axis=1)
        return [(bits[:, p].astype(np.float64) @ (2.0 ** np.arange(len(p)))).astype(np.int64) for p in self.parts]

    def nearest(self, values: list[int], word: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and distances of the k nearest within bound, rows of own left out, ties by id; and how many were verified."""
        met = np.zeros(len(self.words), bool)
        met[own] = True  # as if met, so that they are never verified
        rows, distances, verified = [], [], 0
        have = np.zeros(self.words.shape[1] * 64 + 2, np.int64)
        for radius, s in itertools.product(range(max(map(len, self.parts)) + 1), range(self.count)):
            masks = self.masks[len(self.parts[s])]
            if radius < len(masks):
                at = values[s] ^ masks[radius]
                begin, end = self.begin[s][at], self.begin[s][at + 1]
                some = end > begin
                begin, length = begin[some], (end - begin)[some]
                if len(begin):
                    places = np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                    new = self.order[s][places]
                    new = new[~met[new]]
                    if len(new):
                        met[new] = True
                        verified += len(new)
                        d = np.bitwise_count(self.words[new] ^ word).sum(axis=1, dtype=np.int64)
                        rows.append(new)
                        distances.append(d)
                        have += np.bincount(d, minlength=len(have))
            covered = radius * self.count + s  # every row within this distance has been met
            if covered >= bound or have[: covered + 1].sum() >= k:
                break
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), verified
        r, d = np.concatenate(rows), np.concatenate(distances)
        best = np.lexsort((ids[r], d))[:k]
        best = best[d[best] <= bound]
        return r[best], d[best], verified


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        asked, stock = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and stock.num_rows:
            codes, queries = (np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (stock, asked))
            ids, qids = stock["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            place = {i: at for at, i in enumerate(ids.tolist())}
            bounds = asked["bound"].to_numpy()
            index = Segments(codes, group["width"][0].as_py())
            values, words = np.stack(index.segment(queries), axis=1), index.whole_words(queries)
            for i, own in enumerate(qids.tolist()):
                bound = math.inf if np.isnan(bounds[i]) else bounds[i]
                rows, d, _ = index.nearest(values[i].tolist(), words[i], np.array([place[own]] if own in place else [], np.int64), ids, k, bound)
                found.append((np.full(len(rows), own), ids[rows], d))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "distance": columns[2].astype(np.int32)})

    return run


def search(codes: DataFrame, k: int = TOP_K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and distance: the k nearest codes of every row whose id ``every`` divides."""
    # a row takes its code, its id and a place in each segment's order
    found = in_blocks(codes, _search(k), "query_id long, vec_id long, distance int", "distance", False, lambda width: F.lit(96) + width / 8, False, every, k)
    return found.select("query_id", "rank", "vec_id", "distance")


def nearest(vectors: DataFrame, k: int = TOP_K, every: int = QUERY_EVERY) -> DataFrame:
    return search(shared_table(binary_codes(vectors), "hamming-codes"), k, every)
