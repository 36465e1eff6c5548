"""Recall for many queries at once: exact results, with few exact products.

Queries in blocks meet memories in blocks. A block computes inner products in double precision,
which for components of up to 53 bits are off by at most a small multiple of the query's length:
fl(q . x) differs from q . x by less than n u |q| |x| / (1 - n u), so the product with x / |x|, which
orders memories and whose components are off by less than n u / 2 + 4 u of themselves, differs by
less than 2 n u + 8 u times |q|, whatever the memory. The k-th greatest lower
bound of a block is a lower bound of the k-th score; what lies below it by its upper bound cannot be among
the first k. A first block answers all queries, and its bound goes with each query to all
others. Only what is left gets the exact integer key. Scores at or below zero are equal, so
of those only the k smallest ids of each block can matter.

Blocks are bounded in bytes; a block of memories and a block of queries are one task's work, which holds
their vectors once and gives what is left in batches. Of equal vectors with equal factors, only as many as can
count are looked at. Nothing is collected. Memories that a query's walk has touched have a factor of their own: they are left
out of the blocks and keyed exactly, as many as the walk touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, exact_key
from ..schema import DEFAULT_HOPS, DEFAULT_TOP_K
from .graph import settled
from .recall import gated, live_links, ranked_marks
from .walks import walks

#: Bytes of vectors in a block of memories and of queries; memories of the first block on average.
BLOCK_BYTES, QUERY_BYTES, FIRST_ROWS = 16 << 20, 2 << 20, 4096
#: Products that a task holds at a time.
CELLS = 1 << 20
#: Components beyond it are no longer exact as doubles.
EXACT = 2**53

FOUND = "query_id string, memory_id string, low double, high double"


def candidates_of_all(memories: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """The servable, unforgotten memories with a vector that is not zero."""
    return gated(memories, override).where("field_state <> 'FORGOTTEN'").where(F.exists("vec", lambda x: x != 0))


def _copies(x: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its class, rows of equal vector and factor, and its place in it."""
    seen: dict[tuple[bytes, float], int] = {}
    of = np.fromiter((seen.setdefault((row.tobytes(), f), len(seen)) for row, f in zip(x, factor.tolist(), strict=True)), np.int64, len(x))
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return of, place


def _search(k: int):
    """One block of memories (kind 0) against one of queries (kind 1); pairs of kind 2 are left out.

    Takes and gives batches: a task holds the vectors of its blocks once, and CELLS products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
        for batch in batches:
            kind = batch["kind"].to_numpy()
            for i, rows in read.items():
                at = np.flatnonzero(kind == i)
                if len(at):
                    part = batch.take(pa.array(at))
                    vec = None if i == 2 else part["vec"].flatten().to_numpy().astype(np.float64).reshape(len(at), -1)
                    rows.append((vec, part["memory_id"], part["query_id"], part["factor" if i == 0 else "bound"]))
        if not read[0] or not read[1]:
            return

        def column(i: int, at: int) -> np.ndarray:
            return np.concatenate([r[at].to_numpy(zero_copy_only=False) for r in read[i]]) if read[i] else np.zeros(0, object)

        (x, q), ids, factor = (np.concatenate([r[0] for r in read[i]]) for i in (0, 1)), column(0, 1), column(0, 3).astype(float)
        names, bound = column(1, 2), np.nan_to_num(column(1, 3).astype(float), nan=0.0)
        out = list(zip(column(2, 2), column(2, 1), strict=True))
        read.clear()
        # in id order, so that of equals the first are the smallest ids
        order = np.argsort(ids.astype(str), kind="stable")
        x, ids, factor = x[order], ids[order], factor[order]
        # of copies only the first k can be among a query's first k, after those that it leaves out
        of, place = _copies(x, factor)
        row_of, gone = {n: i for i, n in enumerate(ids)} if out else {}, {}
        for n, m in out:
            if m in row_of:
                gone.setdefault(n, []).append(row_of[m])
        most = np.full(len(ids), k)
        for rows in gone.values():
            classes, times = np.unique(of[rows], return_counts=True)
            most[classes] = np.maximum(most[classes], k + times)
        stay = place < most[of]
        number = np.cumsum(stay) - 1
        gone = {n: [number[r] for r in rows if stay[r]] for n, rows in gone.items()}
        x, ids, factor = x[stay], ids[stay], factor[stay]
        x *= (factor / np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]
        margins = (4 * q.shape[1] + 64) * 2.0**-53 * np.sqrt(np.einsum("ij,ij->i", q, q)) * factor.max()
        for at in range(0, len(q), step := max(1, CELLS // len(x))):
            found: list[tuple[np.ndarray, ...]] = []
            for i, score in enumerate(q[at : at + step] @ x.T, at):
                score[gone.get(names[i], [])] = -np.inf
                high, floor = score + margins[i], bound[i]
                keep = np.flatnonzero((high > 0) & (high >= floor))
                if len(keep) >= k:
                    floor = max(floor, np.partition(score[keep], len(keep) - k)[len(keep) - k] - margins[i])
                    keep = keep[high[keep] >= floor]
                if floor <= 0:
                    keep = np.r_[keep, np.flatnonzero((high <= 0) & (score > -np.inf))[:k]]
                found.append((np.full(len(keep), i), keep, np.maximum(score[keep] - margins[i], 0), np.maximum(high[keep], 0)))
            row, near, low, high = (np.concatenate(f) for f in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names[row], pa.string()), pa.array(ids[near], pa.string()), pa.array(low), pa.array(high)], ["query_id", "memory_id", "low", "high"])

    return run


def survivors(memories: DataFrame, queries: DataFrame, k: int, factor: Column | None = None, apart: DataFrame | None = None, first_rows: int = FIRST_ROWS) -> DataFrame:
    """query_id and memory_id of all that can be among a query's first k by score times factor, and of little else.

    memories has memory_id and vec, queries has query_id and vec; all vectors are of one width.
    factor is a double column of memories; apart has pairs that do not count.
    """
    facts = memories.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    if (facts["most"] or 0) >= EXACT:
        raise OverflowError("a component has more than 53 bits")
    n, row_bytes, asked = facts["n"], 8 * max(facts["width"], 1), queries.count()
    blocks, sets = max(1, -(-n * row_bytes // BLOCK_BYTES)), max(1, -(-asked * row_bytes // QUERY_BYTES))
    cores = memories.sparkSession.sparkContext.defaultParallelism
    blocks = max(blocks, min(cores, n // 1000, 64))
    none = {"query_id": "string", "memory_id": "string", "vec": "array<bigint>", "factor": "double", "bound": "double"}

    def of(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("block", "set", F.lit(kind).alias("kind"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def searched(stock: DataFrame, asking: DataFrame, pairs: DataFrame | None, tasks: int) -> DataFrame:
        rows = of(stock.withColumn("set", numbers(sets)), 0).unionByName(of(asking, 1))
        if pairs is not None:
            rows = rows.unionByName(of(pairs, 2))
        return rows.repartition(tasks, "block", "set").groupBy("block", "set").applyInArrow(_search(k), FOUND)

    place = F.when(F.pmod(F.xxhash64(F.lit("first"), "memory_id"), F.lit(max(n, 1))) < first_rows, -1).otherwise(F.pmod(F.xxhash64("memory_id"), F.lit(blocks))).cast("int")
    set_of = F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int")
    dealt = memories.select("memory_id", "vec", (F.lit(1.0) if factor is None else factor).alias("factor"), place.alias("block"))
    asking = queries.select("query_id", "vec", set_of.alias("set"))
    pairs = None if apart is None else apart.select("query_id", "memory_id", place.alias("block"), set_of.alias("set"))
    start = settled(searched(dealt.where("block = -1"), asking.withColumn("block", F.lit(-1)), pairs, sets))
    if n <= first_rows:
        return start
    ranked = Window.partitionBy("query_id").orderBy(F.desc("low"))
    bounds = start.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == k).select("query_id", F.col("low").alias("bound"))
    informed = asking.join(bounds, "query_id", "left").withColumn("block", numbers(blocks))
    both = start.unionByName(searched(dealt.where("block >= 0"), informed, pairs, min(blocks * sets, 50_000)))
    least = both.withColumn("_r", F.row_number().over(ranked)).withColumn("_floor", F.max(F.when(F.col("_r") == k, F.col("low"))).over(Window.partitionBy("query_id")))
    return settled(least.where(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor"))).select(*both.columns))


def _exact(pairs: DataFrame, memories: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, memory_id and more) with d, n and field_state, of candidates only."""
    # one memory may be near to all queries: those joins are Spark's to split
    both = pairs.join(memories.select("memory_id", "vec", "field_state"), "memory_id").join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
    return both.withColumn("d", dot(F.col("vec"), F.col("_q"))).withColumn("n", dot(F.col("vec"), F.col("vec"))).drop("vec", "_q")


def seeds_of(memories: DataFrame, queries: DataFrame, first_rows: int = FIRST_ROWS) -> DataFrame:
    """query_id and memory_id, the nearest candidate of each query; ties go to the smaller id."""
    near = survivors(memories, queries, 1, first_rows=first_rows).select("query_id", "memory_id")
    key = exact_key("d", "n", F.lit("NEUTRAL"), F.lit(-1), F.lit(0))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "memory_id")
    return _exact(near, memories, queries).withColumn("key", key).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "memory_id")


def recall_all(
    memories: DataFrame, links: DataFrame, queries: DataFrame, top_k: int = DEFAULT_TOP_K, hops: int = DEFAULT_HOPS, override: dict[str, str] | None = None, first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), memory_id, d, n, hop, resonant, rescued and key: for each query what ``recall`` serves.

    queries has query_id and vec, none of them zero. Queries without any candidate have no rows.
    """
    found = settled(candidates_of_all(memories, override).select("memory_id", "vec", "field_state"))
    queries = settled(queries.select(F.col("query_id").cast("string").alias("query_id"), "vec"))
    seeds = settled(seeds_of(found, queries, first_rows))
    marks = walks(live_links(links, gated(memories, override)), seeds.select(F.col("query_id").alias("walk"), "memory_id"), hops)
    marks = settled(marks.withColumnRenamed("walk", "query_id"))
    plain = F.when(F.col("field_state") == "REINFORCED", 1.5).otherwise(1.0)
    near = survivors(found, queries, top_k, plain, marks.select("query_id", "memory_id"), first_rows)
    pairs = near.select("query_id", "memory_id", F.lit(-1).alias("hop"), F.lit(0).alias("resonant"), F.lit(False).alias("inhibited")).unionByName(marks.select("query_id", "memory_id", "hop", "resonant", "inhibited"))
    keyed = ranked_marks(_exact(pairs, found, queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "memory_id")
    best = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.select("query_id", "rank", "memory_id", "d", "n", "hop", "resonant", "rescued", "field_state", "key")
