"""Copies and ties in a batch of recalls: what a task holds and leaves is bounded, and the results stay exact."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldledger.operators import batch_recall


def test_of_copies_only_those_that_can_count_are_left(spark):
    n, k = 3000, 10
    # two vectors, each of them 1,500 times
    memories = spark.range(n).select(F.format_string("m%05d", "id").alias("memory_id"), F.array(F.lit(3), F.lit(4), F.col("id") % 2 * 5).cast("array<long>").alias("vec"))
    queries = spark.createDataFrame([("a", [3, 4, 0]), ("b", [3, 4, 5])], "query_id string, vec array<long>")
    # a query leaves out the first 40 of its copies
    gone = spark.range(0, 80, 2).select(F.lit("a").alias("query_id"), F.format_string("m%05d", "id").alias("memory_id"))
    left = batch_recall.survivors(memories, queries, k, apart=gone, first_rows=512).collect()
    assert len(left) < 0.05 * 2 * n
    found = {q: sorted(r["memory_id"] for r in left if r["query_id"] == q) for q in "ab"}
    assert {f"m{i:05}" for i in range(80, 100, 2)} <= set(found["a"]) and not {f"m{i:05}" for i in range(0, 80, 2)} & set(found["a"])
    assert {f"m{i:05}" for i in range(1, 20, 2)} <= set(found["b"])


def test_a_task_gives_its_ties_in_batches(monkeypatch):
    """Parallel vectors tie with one another, and all of them stay."""
    monkeypatch.setattr(batch_recall, "CELLS", 1000)
    stock, asked = 300, 40
    vec = [[i + 1, 2 * (i + 1)] for i in range(stock)] + [[1, 2]] * asked
    rows = {
        "kind": pa.array([0] * stock + [1] * asked, pa.int32()), "query_id": pa.array([None] * stock + [f"q{i}" for i in range(asked)]), "memory_id": pa.array([f"m{i:03}" for i in range(stock)] + [None] * asked),
        "vec": pa.array(vec, pa.list_(pa.int64())), "factor": pa.array([1.0] * stock + [None] * asked), "bound": pa.array([None] * (stock + asked), pa.float64()),
    }
    found = list(batch_recall._search(5)(iter(pa.RecordBatch.from_pydict(rows).slice(at, 100) for at in range(0, stock + asked, 100))))
    assert max(b.num_rows for b in found) <= 1000 and sum(b.num_rows for b in found) == stock * asked
    low, high = (np.concatenate([b[c].to_numpy() for b in found]) for c in ("low", "high"))
    assert (low <= np.sqrt(5)).all() and (high >= np.sqrt(5)).all()
