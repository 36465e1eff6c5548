"""Claims' states at many instants: what tells nothing does not travel, and nothing is joined back."""

from pyspark.sql import functions as F

from fieldledger.operators import replay

ROWS = [
    ("a", 0, "CLAIM_ASSERTED", "01"), ("a", 1, "EVIDENCE_LINKED", "02"), ("a", 2, "CLAIM_VALIDATED", "03"), ("a", 3, "CLAIM_REFUTED", "05"),
    ("b", 0, "CLAIM_ASSERTED", "01"), ("b", 1, "CLAIM_VALIDATED", "01"), ("b", 2, "CLAIM_VALIDATED", "04"), ("c", 0, "CLAIM_ASSERTED", "09"),
]


def chain_of(spark):
    body = F.when(F.col("event_type") == "CLAIM_ASSERTED", F.concat(F.lit('{"statement_sha256":"'), F.sha2("claim_id", 256), F.lit('"}'))).when(F.col("event_type") == "EVIDENCE_LINKED", '{"memory_id":"m","stance":"SUPPORTS"}').otherwise("{}")
    return spark.createDataFrame(ROWS, "claim_id string, seq int, event_type string, created_at string").withColumn("payload_json", body)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_states_before(spark):
    asks = spark.createDataFrame([(c, t) for c in "abcd" for t in ("01", "02", "03", "04", "05", "06")] * 2 + [("a", None)], "claim_id string, at string")
    out = replay.claim_states_before(chain_of(spark), asks)
    got = sorted(((r["claim_id"], r["at"]), r["state"]) for r in out.collect() if r["at"])
    v, a = "VALIDATED", "ASSERTED"
    wanted = {"a": [a, a, a, v, v, "REFUTED"], "b": [a, v, v, v, a, a], "c": [a] * 6, "d": [a] * 6}
    assert got == [((c, f"0{i + 1}"), s) for c in "abcd" for i, s in enumerate(wanted[c])]
    assert joins(out) == 0


def test_sets_without_members(spark):
    members = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "a"), ("t", "b"), ("u", None)], "set_id string, claim_id string")
    asks = spark.createDataFrame([("s", "04"), ("s", "06"), ("t", "02"), ("t", "06"), ("u", "02"), ("w", "02"), ("s", "04")], "set_id string, at string")
    out = replay.set_capabilities(chain_of(spark), members, asks)
    j, a = "ADJUDICATE", "ASSERT"
    assert sorted(map(tuple, out.collect())) == [("s", "04", j), ("s", "06", a), ("t", "02", j), ("t", "06", a), ("u", "02", a), ("w", "02", a)]
    assert joins(out) <= 2  # of asks with members alone
