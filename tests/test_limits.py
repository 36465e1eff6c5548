"""What is cut, kept in range and refused; seals over standings; profiles of two threads."""

import threading

import pytest

from fieldledger import schema
from fieldledger.functions import limits
from fieldledger.operators import claims


def test_texts_are_cut_alike(spark):
    texts = ["", "short", "x" * 9, "x" * 10, "x" * 11, "漢字é" * 5, None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", limits.cut_text("t", 10).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in found] == [None if t is None else limits.cut(t, 10) for t in texts]
    assert limits.cut("y" * 50_001) == "y" * 49_999 + "..." and limits.cut("y" * 50_000) == "y" * 50_000


def test_ranges_and_identifiers():
    assert limits.in_range(0, -1) == (1, 0) and limits.in_range(99, 9) == (20, 4) and limits.in_range(7, 3) == (7, 3)
    assert limits.clean_id("  m-1 ", "id") == "m-1"
    for wrong in ("", "   ", None, "x" * 65):
        with pytest.raises(ValueError, match="id"):
            limits.clean_id(wrong, "id")


def test_standings_are_sealed_alike(spark):
    states = spark.createDataFrame(
        [("k1", "s" * 64, "VALIDATED", ["m1", "m2"], ["m3"], [("SUPPORTS", "OUT", "k2"), ("CONTRADICTS", "IN", "k3")]), ("k2", "t" * 64, 'odd "state"', [], ["gone"], [])],
        "claim_id string, statement_sha256 string, state string, supports array<string>, contradicts array<string>, relations array<struct<relation:string,direction:string,other:string>>",
    )
    memories = spark.createDataFrame([("m1", "CLEAN"), ("m2", "TAINT_FLAGGED"), ("m3", "CLEAN")], "memory_id string, custody_status string")
    sets = spark.createDataFrame([("set-1", "AT_MOST_ONE", '{"members":["k1","k2"]}'), ("set-0", "EXACTLY_ONE", '{"members":["k1"]}')], "set_id string, constraint_type string, members_json string")
    for row in claims.standing_seals(claims.standings(states, memories, sets)).collect():
        assert row["standing_sha256"] == claims.standing_seal(row.asDict(recursive=False))
    found = claims.evaluated(claims.members_of(sets), states).orderBy("set_id")
    assert [(r["set_id"], r["n"], r["held"], r["status"]) for r in found.collect()] == [("set-0", 1, 1, "SATISFIED"), ("set-1", 2, 1, "SATISFIED")]
    assert not [f for f in found.schema.fields if f.dataType.typeName() == "array"]


def test_a_profile_is_its_own_thread_s():
    other = schema.Profile("a/", "b/", "c/", "none", "bundle")
    seen = []
    with schema.under(other):
        thread = threading.Thread(target=lambda: seen.append(schema.profile()))
        thread.start()
        thread.join()
        assert schema.profile() is other
    assert seen == [schema.OWN] and schema.profile() is schema.OWN
