"""A fixed script of acts must give fixed digests, byte for byte."""

import json
from pathlib import Path

import pytest

from fieldledger import bundle, ledger, schema
from fieldledger.functions.canonical import canonical_json, digest, seal
from fieldledger.operators import chains
from fieldledger.schema import AUTHORITY, CLAIM, CUSTODY
from fieldledger.sources.store import Field

SCRIPT = json.loads((Path(__file__).parent / "data" / "script.json").read_text())


@pytest.fixture(scope="module", autouse=True)
def other_engine():
    """The digests are those of another engine with the same rules, whose profile stands beside them."""
    other = json.loads((Path(__file__).parent / "data" / "profile.json").read_text())
    with schema.under(schema.Profile(**other)):
        yield


@pytest.fixture(scope="module")
def world(spark):
    acts = ledger.Ledger(Field(spark))
    return acts, ledger.run(acts, SCRIPT["operations"])


@pytest.fixture(scope="module")
def exported(world):
    return bundle.export(world[0].field, created_at="2026-01-02T00:00:00.000000+00:00")


def test_genesis():
    for name, kind, subject in (("custody.m-1", CUSTODY, "m-1"), ("authority.root", AUTHORITY, "root"), ("claim.claim-0001", CLAIM, "claim-0001")):
        assert chains.genesis_of(kind, subject) == SCRIPT["digests"][f"genesis.{name}"]


@pytest.mark.parametrize("kind", [CUSTODY, AUTHORITY, CLAIM], ids=lambda k: k.name)
def test_heads(world, kind):
    heads = {r[0]: r[1] for r in chains.heads(world[0].field.table(kind.table), kind).collect()}
    wanted = {k.rsplit(".", 1)[1]: v for k, v in SCRIPT["digests"].items() if k.startswith(f"head.{kind.name}.")}
    assert wanted and heads == wanted
    assert chains.verify(world[0].field.table(kind.table), kind).isEmpty()
    rebuilt = chains.build(world[0].field.table(kind.table).drop("prev_hash", "entry_hash"), kind)
    assert {r[0]: r[1] for r in chains.heads(rebuilt, kind).collect()} == wanted


def test_seals(world):
    acts, made = world
    assert made["receipt"].receipt_sha256 == SCRIPT["digests"]["seal.receipt"]
    assert made["decision"]["record_sha256"] == SCRIPT["digests"]["seal.decision"]
    assert acts.impact("m-1")["impact_sha256"] == SCRIPT["digests"]["seal.impact.m-1"]
    assert acts.exposure(["m-3"])["exposure_sha256"] == SCRIPT["digests"]["seal.exposure.m-3"]
    assert acts.standing("claim-0001")["standing_sha256"] == SCRIPT["digests"]["seal.standing.claim-0001"]
    delta = acts.exclusion(["1.0000000000", "0.0000000000"], ["m-1"], top_k=3)
    assert delta["delta_sha256"] == SCRIPT["digests"]["seal.counterfactual.exclude-m-1"]


def test_bundle_digests(exported):
    body = json.loads(exported)["body"]
    assert body["heads_merkle_root"] == SCRIPT["digests"]["root.heads_merkle"]
    assert body["authority_merkle_root"] == SCRIPT["digests"]["root.authority_merkle"]
    del body["created_at"]
    assert digest(canonical_json(body)) == SCRIPT["digests"]["seal.bundle_body"]


def test_protocol_table():
    assert seal(schema.PROTOCOLS) == SCRIPT["digests"]["table.protocols"]
