"""Approximate nearest neighbours by largest inner product, from randomly rotated one-bit codes.

Indexing rotates each vector into ``bits`` dimensions (at least its own) by a seeded random
orthonormal map and keeps the sign bits, packed, with two correction scalars: the norm, and the
inner product of the unit vector with its own code. A query turns into one table for each byte of
the codes, which tells what any value of that byte adds; estimates are sums of table entries
picked by the packed bytes, scaled by the scalars, and come with an error bound that fails with
a chosen small probability. A vector is reranked with its original components, in double precision,
unless its upper bound stays below the k-th exact score that is known by then: the one of the
first block, which goes with the query, or the one among the block's best estimates.

Rows travel with their original components: in a query block of thousands of queries, some query
reranks nearly every row, so that fetching originals pair by pair would move far more.

Defined results: see ``vectors.usable`` for the vectors that take part, also where ids repeat;
vectors of different widths do not meet; a row is never a neighbour of its own id; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .vectors import QUERY_EVERY, TOP_K, in_blocks, usable

#: Code length, the seed of the rotation, and how many standard errors a bound reaches out.
BITS, SEED, REACH = 256, 7, 3.3
#: Queries and rows that are estimated at a time, and pairs that are scored at a time; only speed depends on them.
STEP, ROWS, PAIRS = 128, 2048, 4096

_ROTATIONS: dict[tuple[int, int, int], np.ndarray] = {}


def code_length(dim: int, bits: int = BITS) -> int:
    """A multiple of eight, no shorter than the vectors."""
    return -(-max(bits, dim) // 8) * 8


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(dim, code_length) with orthonormal rows: a random rotation after padding with zeros."""
    key = dim, bits, seed
    if key not in _ROTATIONS:
        random = np.random.default_rng(seed).standard_normal((code_length(dim, bits), dim))
        q, r = np.linalg.qr(random)
        _ROTATIONS[key] = np.ascontiguousarray((q * np.sign(np.diag(r))).T)
    return _ROTATIONS[key]


def encode(x: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, norms, and inner products of the unit vectors with their codes."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotate
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), norm, fit


def _index(bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = part["embedding"].flatten().to_numpy().astype(np.float64).reshape(part.num_rows, width)
                codes, norm, fit = encode(x, rotation(int(width), bits, seed))
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["embedding"], part["width"], *made], ["vec_id", "embedding", "width", "code", "norm", "fit"])

    return run


def build_index(vectors: DataFrame, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """vec_id, embedding, width, code, norm and fit of every vector that takes part."""
    rows = usable(vectors)
    return rows.mapInArrow(_index(bits, seed), f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, width int, code binary, norm double, fit double")


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for left, right in zip(np.ascontiguousarray(a.T, np.float64), np.ascontiguousarray(b.T, np.float64), strict=True):
        total += left * right
    return total


def scores(q: np.ndarray, which: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(which))
    for at in range(0, len(which), PAIRS):
        out[at : at + PAIRS] = dot(q[which[at : at + PAIRS]], x[near[at : at + PAIRS]])
    return out


#: What the eight bits of each byte value add, as signs.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def byte_tables(turned: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): the inner product of each query's part with the signs of each byte value."""
    parts = np.ascontiguousarray(turned.T, np.float32).reshape(-1, 8, len(turned))
    return np.stack([SIGNS @ p for p in parts])


def estimates(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, queries): inner products of codes and rotated queries, from packed bytes alone."""
    out = np.empty((len(codes), tables.shape[2]), np.float32)
    picked = np.empty((ROWS, tables.shape[2]), np.float32)
    for at in range(0, len(codes), ROWS):
        part = codes[at : at + ROWS]
        total = out[at : at + ROWS]
        np.take(tables[0], part[:, 0], axis=0, out=total, mode="clip")
        for b in range(1, len(tables)):
            np.take(tables[b], part[:, b], axis=0, out=picked[: len(part)], mode="clip")
            total += picked[: len(part)]
    return out


def search_block(q: np.ndarray, qid: np.ndarray, floors: np.ndarray, x: np.ndarray, xid: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, rotate: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """query ids, vector ids and scores of each query's k best in the block; and how many pairs were scored.

    floors are scores that k other rows reach already (-inf for none).
    """
    bits = codes.shape[1] * 8
    turned, q_norm = (q.astype(np.float64) @ rotate).astype(np.float32), np.linalg.norm(q.astype(np.float64), axis=1)
    # <code, query> / <code, vector> estimates the inner product; what is left of the code
    # beside the vector points in a random direction, hence the standard error
    gain = (norm / (fit * np.sqrt(bits))).astype(np.float32)
    error = (norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * reach / np.sqrt(max(bits - 1, 1)) + 1e-6 * norm).astype(np.float32)
    codes = codes.astype(np.intp)
    first, out, scored = 2 * k + 8, [], 0
    for at in range(0, len(q), STEP):
        mine = slice(at, at + STEP)
        guess = estimates(codes, byte_tables(turned[mine])) * gain[:, None]
        floor = floors[mine].copy()
        if len(x) > first:
            # exact scores of the best guesses: their k-th is as high a floor as this block gives
            # before the rest is looked at; the query's own row does not count
            best = np.argpartition(guess, len(x) - first, axis=0)[-first:]
            sure = scores(q, np.repeat(np.arange(at, at + guess.shape[1])[None], first, axis=0).ravel(), x, best.ravel()).reshape(best.shape)
            sure[xid[best] == qid[mine][None]] = -np.inf
            floor = np.maximum(floor, np.partition(sure, first - k, axis=0)[first - k])
        guess += error[:, None] * q_norm[mine][None].astype(np.float32)
        near, which = np.nonzero(guess >= floor[None].astype(np.float32))
        other = xid[near] != qid[at + which]
        near, which = near[other], which[other] + at
        exact = scores(q, which, x, near)
        scored += len(exact)
        enough = exact >= floors[which]
        near, which, exact = near[enough], which[enough], exact[enough]
        order = np.lexsort((xid[near], -exact, which))
        near, which, exact = near[order], which[order], exact[order]
        begin = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, int)
        best = np.arange(len(which)) - np.repeat(begin, np.diff(np.r_[begin, len(which)])) < k
        out.append((qid[which[best]], xid[near[best]], exact[best]))
    return (*[np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))], scored)


def _search(k: int, bits: int, seed: int, reach: float):
    def run(group: pa.Table) -> pa.Table:
        asks, width = group["asks"].to_numpy(), group["width"][0].as_py()
        asked, stock = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and stock.num_rows:
            q, x = (t["embedding"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, width) for t in (asked, stock))
            codes = np.frombuffer(b"".join(stock["code"].to_pylist()), np.uint8).reshape(len(x), -1)
            floors = asked["bound"].to_numpy()
            floors = np.where(np.isnan(floors), -np.inf, floors)
            *found, _ = search_block(q, asked["vec_id"].to_numpy(), floors, x, stock["vec_id"].to_numpy(), codes, stock["norm"].to_numpy(), stock["fit"].to_numpy(), rotation(width, bits, seed), k, reach)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return run


def search(index: DataFrame, k: int = TOP_K, every: int = QUERY_EVERY, bits: int = BITS, seed: int = SEED, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of every row of the index whose id ``every`` divides.

    bits and seed are those that the index was built with.
    """
    # a row takes its components, its code and a column of estimates
    found = in_blocks(index, _search(k, bits, seed, reach), "query_id long, vec_id long, score double", "score", True, lambda width: 8 * width + 4 * STEP + BITS, True, every, k)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = TOP_K, every: int = QUERY_EVERY) -> DataFrame:
    return search(shared_table(build_index(vectors), "ann-index"), k, every)
