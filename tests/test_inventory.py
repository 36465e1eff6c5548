"""Merkle roots and proofs, exact embeddings inside the JVM, drift as rows."""

from decimal import Decimal
from fractions import Fraction

import pytest

from fieldledger.functions.canonical import digest, quantize
from fieldledger.functions.embedding import WIDTH, embed, embedded, units
from fieldledger.operators import inventory
from pyspark.sql import functions as F


def plain_root(leaves):
    while len(leaves) > 1:
        leaves = [digest("".join(leaves[i : i + 2])) if len(leaves[i : i + 2]) > 1 else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 131])
def test_roots_and_proofs_do_not_depend_on_partitions(spark, monkeypatch, n):
    monkeypatch.setattr(inventory, "LEAVES", 8)
    names = sorted(f"m-{i * 7919 % 100_003}" for i in range(n))
    leaves = [digest(f"{name}:{digest(name)}") for name in names]
    root = plain_root(leaves)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "5", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            heads = spark.createDataFrame([(x, digest(x)) for x in names], "memory_id string, entry_hash string").repartition(int(parts))
            assert inventory.merkle_root(heads, "memory_id") == root
            paths = inventory.merkle_paths(heads, "memory_id").orderBy("place").collect()
            assert [(r["id"], r["hash"], r["place"]) for r in paths] == list(zip(names, leaves, range(n), strict=True))
            assert all(inventory.on_path(r["hash"], r["path"], root) for r in paths)
            assert n == 1 or not any(inventory.on_path(digest("other"), r["path"], root) for r in paths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_heads(spark):
    heads = spark.createDataFrame([], "memory_id string, entry_hash string")
    assert inventory.merkle_root(heads, "memory_id") == inventory.merkle_of([]) and inventory.merkle_paths(heads, "memory_id").isEmpty()


def test_embeddings_without_python(spark):
    texts = ["", "a", "the same text", "漢字 é", "x" * 5000, "line\nline"]
    found = {r["t"]: r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", embedded("t").alias("e")).collect()}
    for t in texts:
        assert len(found[t]) == WIDTH and [Decimal(x).scaleb(-10) for x in found[t]] == embed(t)


def test_halves_go_to_even(spark):
    ties = [i * 2**42 for i in range(-2048, 2049, 7)]
    near = [k + d for k in ties for d in (-1, 1) if abs(k + d) <= 2**53]
    values = [Fraction(k, 2**53) for k in (*ties, *near, 2**53, -(2**53), 0, 1, -1)]
    found = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", units(F.col("v")).alias("u")).orderBy("i").collect()
    assert [Decimal(r["u"]).scaleb(-10) for r in found] == [quantize(v) for v in values]


def test_drift_of_a_text_in_most_births(spark):
    rows = [(f"m{i:04}", "p", "x", "r", None, "same", f"v{i % 3}") for i in range(900)] + [("n1", "p", "x", "r", None, "once", "v"), ("n2", "p", "x", "r", None, "once", "v"), ("n3", None, None, None, None, "same", "w")]
    frame = spark.createDataFrame(rows, "memory_id string, provider string, model string, revision string, preprocessing string, input_content_hash string, output_vector_hash string")
    assert sorted((r["output_vector_hash"], r["memories"], r["first_memory"], r["distinct_vectors"]) for r in inventory.drift_vectors(frame).collect()) == [(f"v{i}", 300, f"m{i:04}", 3) for i in range(3)]
    members = inventory.drift_members(frame)
    assert {tuple(r) for r in members.collect()} == {(f"m{i:04}", f"m{i % 3:04}", f"v{i % 3}") for i in range(900)}
    assert "collect_list" not in members._jdf.queryExecution().toString()
