"""A bundle that is whole passes; each way of tampering with it, resealed, is caught by its check."""

import json

import pytest

from fieldledger import bundle, ledger
from fieldledger.sources.store import Field
from fieldledger.verify import verify

AT = "2026-03-01T12:{:02d}:00.000000+00:00"


@pytest.fixture(scope="module")
def acts(spark):
    """Six memories: one reinforced to promotion, two swept, one superseded, one quarantined."""
    a = ledger.Ledger(Field(spark))
    minute = iter(range(60))

    def at():
        return AT.format(next(minute))

    for who in ("agent-1", "pipeline-x", "analyst-anna"):
        a.add_actor(who, at=at())
    common = {"embedding_model": "m", "reason": "r"}
    a.store(memory_id="mem-1", content="blue", embedding=["1.0", "0.0"], actor_id="agent-1", topic="sky", claim="blue", at=at(), **common)
    a.store(memory_id="mem-2", content="green", embedding=["0.9", "0.1"], actor_id="pipeline-x", topic="sky", claim="green", at=at(), **common)
    a.store(memory_id="mem-3", content="three", embedding=["0.0", "1.0"], actor_id="agent-1", at=at(), **common)
    for _ in range(3):
        last = a.reinforce(memory_id="mem-1", actor_id="analyst-anna", reason="seen", at=at())
    assert last[1] == "REINFORCED" and str(last[0]) == "0.7890625000"
    a.reinforce(memory_id="mem-3", actor_id="pipeline-x", reason="seen", at=at())
    a.store(memory_id="mem-4", content="four", embedding=["0.5", "0.5"], actor_id="agent-1", at=at(), **common)
    a.supersede(old_memory_id="mem-4", memory_id="mem-5", content="five", embedding=["0.5", "0.6"], actor_id="analyst-anna", at=at(), **common)
    a.store(memory_id="mem-6", content="six", embedding=["0.4", "0.4"], actor_id="agent-1", at=at(), **common)
    a.quarantine_memory(memory_id="mem-6", actor_id="analyst-anna", reason="bad", at=at())
    sweep = a.quarantine_actor(actor_id="pipeline-x", initiated_by="analyst-anna", reason="poison", at=at(), sweep_id="sweep-1")
    assert sweep.flagged == ("mem-2", "mem-3")
    a.field.commit()
    return a


@pytest.fixture(scope="module")
def whole(acts):
    return bundle.export(acts.field)


def memory(body, name):
    return next(m for m in body["memories"] if m["memory_id"] == name)


def test_whole_passes(spark, whole):
    verdict = verify(spark, whole)
    assert verdict.ok, verdict.errors
    assert any("no authority ledger" in n for n in verdict.notes)


def test_part_declares_what_stays_behind(spark, acts):
    text = bundle.export(acts.field, ["mem-1", "mem-3"])
    body = json.loads(text)["body"]
    assert [s["sweep_id"] for s in body["excluded_sweeps"]] == ["sweep-1"] and not body["sweeps"]
    assert verify(spark, text).ok


def test_unsealed_edit(spark, whole):
    assert verify(spark, whole.replace('"content":"blue"', '"content":"bleu"')).checks == ["B1"]
    assert verify(spark, "no json").checks == ["B1"]


def relabel(body):
    memory(body, "mem-2")["custody_status"] = "CLEAN"


def inflate(body):
    memory(body, "mem-3")["confidence"] = "0.9000000000"


def rewrite(body):
    memory(body, "mem-1")["content"] = "bleu"


def forge_event(body):
    memory(body, "mem-1")["custody"][1]["reason"] = "other"


def graft(body):
    memory(body, "mem-1")["custody"][1:] = memory(body, "mem-3")["custody"][1:]


def deny_sweep(body):
    body["sweeps"][0]["flagged_count"] = 1


def exclude_sweep(body):
    body["excluded_sweeps"] = body["sweeps"]
    body["sweeps"] = []


def drop_sweep(body):
    body["sweeps"] = []


def both_lists(body):
    body["excluded_sweeps"] = list(body["sweeps"])


def forge_root(body):
    body["heads_merkle_root"] = "0" * 64


def old_words(body):
    body["protocols"]["claim_protocol"] = "9.0.0"


@pytest.mark.parametrize(
    ("changes", "checks"),
    [
        ((relabel, inflate, rewrite, deny_sweep, forge_root), {"B3", "B4", "B5", "B6"}),
        ((forge_event, exclude_sweep), {"B2", "B5"}), ((graft, drop_sweep), {"B2", "B5"}), ((both_lists,), {"B5"}), ((old_words,), {"B0"}),
    ],
    ids=lambda x: "-".join(getattr(f, "__name__", str(f)) for f in x),
)
def test_tampering(spark, whole, changes, checks):
    def change(body):
        for one in changes:
            one(body)

    assert checks <= set(verify(spark, bundle.resealed(whole, change)).checks)


def test_missing_exclusion_list_reads_as_empty(spark, whole):
    assert verify(spark, bundle.resealed(whole, lambda b: b.pop("excluded_sweeps"))).ok
