"""Sweeps along an order against plain scans, with one group of a third of all rows."""

import random
from bisect import bisect_right

from fieldledger.operators import authority, chains, sweeps
from fieldledger.schema import CUSTODY
from pyspark.sql import functions as F

AT = "2026-01-01T{:02d}:{:02d}:{:02d}.{:06d}+00:00"


def instant(n):
    return AT.format(n // 3_600_000_000 % 24, n // 60_000_000 % 60, n // 1_000_000 % 60, n % 1_000_000)


def test_sums_and_maxima_over_ranges(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else rng.choice("abcdx" if i % 3 else "h"), rng.randint(0, 40), rng.randint(-3, 9) if rng.random() < 0.8 else None, rng.random() < 0.5) for i in range(900)]
    rows += [("h", 20, 1, False)] * 200 + [("h", 20, None, True)] * 200
    frame = spark.createDataFrame(rows, "g string, at int, v int, asks boolean")
    counted = F.when(~F.col("asks"), F.col("v"))
    for first in (True, False):  # what counts before what asks, or after it
        order = F.when(F.col("asks") == F.lit(first), 1).otherwise(0)
        found = sweeps.swept(frame.withColumn("order", order), F.col("asks"), ["g"], ["at", "order"], 9, total=("sum", counted), most=("max", counted)).drop("order")

        def of(g, at, f, none):
            seen = [v for a, b, v, asks in rows if a == g and (b < at or b == at and first) and not asks and v is not None]
            return f(seen) if seen else none

        assert sorted(map(tuple, found.collect()), key=str) == sorted(((g, at, v, asks, of(g, at, sum, 0), of(g, at, max, None)) for g, at, v, asks in rows if asks), key=str)
    assert sweeps.swept(frame.limit(0), F.col("asks"), ["g"], ["at"], total=("sum", F.col("v"))).count() == 0


def test_an_actor_with_a_hundred_thousand_windows(spark):
    rng = random.Random(2)
    n = 100_000
    begins = sorted(rng.sample(range(0, 86_000_000_000, 7), n))
    # windows of one actor, now and then open until the next begins or longer; acts at their very borders, too
    spans = [(b, b + rng.choice([1, 100_000, 400_000, 2_000_000])) for b in begins]
    acts = [(("hot", b + rng.choice([-1, 0, 1, 50_000]))) for b in rng.sample(begins, 3000)] + [("hot", e) for _, e in rng.sample(spans, 500)]
    acts += [(f"a{rng.randint(0, 300)}", rng.randint(0, 86_000_000_000)) for _ in range(6000)]
    shut = [("hot", instant(b), instant(e)) for b, e in spans] + [("a1", instant(5), None), ("a2", instant(9), instant(9)), ("a3", instant(99), instant(7))]
    windows = spark.createDataFrame(shut, "actor_id string, from_at string, to_at string")
    events = spark.createDataFrame([(i, a, instant(t)) for i, (a, t) in enumerate(acts)], "i int, actor_id string, created_at string")
    found = {r["i"]: r["open"] for r in sweeps.covered(events, windows, ["actor_id"], "created_at", "from_at", "to_at", 16).collect()}
    ends = sorted(e for _, e in spans)
    for i, (a, t) in enumerate(acts):
        wanted = bisect_right(begins, t) - bisect_right(ends, t) if a == "hot" else int(a == "a1" and t >= 5)
        assert found[i] == wanted
    # and by the act's own check
    grants = events.select(F.col("actor_id").alias("subject_id"), F.lit("g").alias("grant_id"), F.array(F.lit("STORE")).alias("capabilities"), F.lit(instant(0)).alias("granted_at"), F.lit(None).cast("string").alias("revoked_at")).distinct()
    judged = authority.unauthorized(events.withColumns({"grant_id": F.lit("g"), "needed": F.lit("STORE")}), grants, windows.withColumnRenamed("actor_id", "subject_id"))
    assert {(r["i"], r["error"]) for r in judged.collect()} == {(i, "quarantined") for i, n in found.items() if n} | {(i, "not_active") for i, (a, t) in enumerate(acts) if t < 0 and not found[i]}


def test_ranges_know_the_row_before_them(spark):
    """One chain over many ranges, and faults at the first row of a range."""
    events = [("m-1", i) for i in range(400)] + [(f"m-{k}", i) for k in range(2, 40) for i in range(k % 5 + 1)]
    rows = spark.createDataFrame(events, "memory_id string, seq int").select(
        "memory_id", "seq", F.when(F.col("seq") == 0, "STORED").otherwise("REINFORCED").alias("event_type"), F.lit("a").alias("actor_id"), F.lit("r").alias("reason"),
        F.format_string("2026-01-01T00:00:00.%06d+00:00", "seq").alias("created_at"), F.when(F.col("seq") == 0, F.concat(F.lit('{"content_sha256":"'), F.sha2("memory_id", 256), F.lit('"}'))).otherwise("{}").alias("payload_json"),
    )
    built = chains.build(rows, CUSTODY).cache()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert chains.verify(built, CUSTODY).isEmpty()
            for gap in (0, 1, 57, 200, 398):
                found = chains.verify(built.where(f"NOT (memory_id = 'm-1' AND seq = {gap})"), CUSTODY).collect()
                assert [tuple(r) for r in found] == [("m-1", gap + 1, "seq")]
            twice = built.unionByName(built.where("memory_id = 'm-1' AND seq = 123"))
            assert [tuple(r) for r in chains.verify(twice, CUSTODY).collect()] == [("m-1", 123, "seq")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert chains.verify(built.limit(0), CUSTODY).isEmpty()
