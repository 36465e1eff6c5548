"""Sealed evidence bundles: one JSON document with everything that an auditor needs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.canonical import canonical_json, digest, now_ts, vector_json
from .operators import claims, graph, replay
from .operators.inventory import heads_merkle_of
from .schema import AUTHORITY, CLAIM, CUSTODY, PROTOCOLS, ChainKind, profile
from .sources.store import Field


def _chains(rows: DataFrame, kind: ChainKind) -> dict[str, list[dict]]:
    """subject to events in order."""
    out: dict[str, list[dict]] = {}
    for r in rows.orderBy(kind.subject, "seq").collect():
        out.setdefault(r[kind.subject], []).append(r.asDict())
    return out


def export(field: Field, memory_ids: Sequence[str] | None = None, created_at: str | None = None) -> str:
    """The bundle of some memories, or of all, as canonical JSON.

    The tables are cut down to the memories' evidence by joins; what is left is what one
    document holds. Sweeps and decisions travel only with all their evidence and are declared
    excluded otherwise, as are lineage counterparts that stay behind.
    """
    spark = field.spark
    memories, custody = field.table("memories"), field.table("custody_chain")
    if memory_ids is not None:
        wanted = spark.createDataFrame([(m,) for m in sorted(set(memory_ids))], "memory_id string")
        memories, chain = memories.join(wanted, "memory_id", "left_semi"), custody.join(wanted, "memory_id", "left_semi")
    else:
        chain = custody
    rows = {r["memory_id"]: r for r in memories.join(replay.custody_states(chain), "memory_id").collect()}
    if memory_ids is not None and (unknown := sorted(set(memory_ids) - set(rows))):
        raise ValueError(f"unknown memories {unknown}")
    chains = _chains(chain, CUSTODY)
    exported = set(rows)
    carried = [
        {
            "memory_id": m, "content": r["content"], "content_sha256": r["content_sha256"], "embedding_sha256": digest(vector_json(r["embedding"])),
            "custody_status": r["custody_status"], "field_state": r["field_state"], "confidence": r["confidence"], "custody": chains[m],
        }
        for m, r in sorted(rows.items())
    ]

    marks = custody.where("event_type = 'TAINT_FLAGGED'").select(F.get_json_object("payload_json", "$.sweep_id").alias("sweep_id"), "memory_id")
    outside = {r["sweep_id"] for r in marks.join(memories.select("memory_id"), "memory_id", "left_anti").select("sweep_id").distinct().collect()}
    sweeps = [r.asDict() for r in field.table("taint_sweeps").orderBy("sweep_id").collect()]

    claim_chain = field.table("claim_chain")
    claim_chains, states = _chains(claim_chain, CLAIM), replay.claim_states(claim_chain)
    state_of = {r["claim_id"]: r["state"] for r in states.select("claim_id", "state").collect()}
    claim_rows = [
        {"claim_id": r["claim_id"], "statement": r["statement"], "statement_sha256": r["statement_sha256"], "topic": r["topic"], "state": state_of[r["claim_id"]], "chain": claim_chains[r["claim_id"]]}
        for r in field.table("claims").orderBy("claim_id").collect()
    ]
    sets = field.table("claim_sets")
    status_of = {r["set_id"]: r["status"] for r in claims.evaluated(claims.members_of(sets), states).select("set_id", "status").collect()}
    set_rows = [r.asDict() | {"status": status_of[r["set_id"]]} for r in sets.orderBy("set_id").collect()]

    ledger = field.table("authority_chain")
    actors = chain.select(F.col("actor_id").alias("id")).union(claim_chain.select("actor_id")).union(replay.grants(ledger).where("root").select("subject_id"))
    needed = graph.closure(ledger.select(F.col("subject_id").alias("child"), F.col("issuer_id").alias("parent")), actors)
    part = ledger.join(needed, F.col("subject_id") == F.col("id"), "left_semi")
    authority_status = {r["subject_id"]: r["status"] for r in replay.authority_states(part).collect()}
    authority_rows = [{"subject_id": s, "status": authority_status[s], "chain": c} for s, c in sorted(_chains(part, AUTHORITY).items())]

    decisions = [r.asDict() for r in field.table("decisions").orderBy("decision_id").collect()]
    whole = [set(json.loads(d["used_json"])["used"]) <= exported for d in decisions]
    cited = {d["receipt_sha256"] for d in decisions}
    receipts = [r.asDict() for r in field.table("recall_receipts").orderBy("receipt_sha256").collect()]
    receipts = [r for r in receipts if r["receipt_sha256"] in cited or set(json.loads(r["served_json"])["served"]) <= exported]

    lineage = []
    for m in carried:
        before = json.loads(m["custody"][0]["payload_json"]).get("supersedes")
        if isinstance(before, str) and before not in exported:
            lineage.append({"memory_id": m["memory_id"], "role": "successor", "counterpart": before})
        after = [json.loads(e["payload_json"]).get("successor_memory_id") for e in m["custody"] if e["event_type"] == "SUPERSEDED_BY"]
        lineage += [{"memory_id": m["memory_id"], "role": "predecessor", "counterpart": s} for s in after if isinstance(s, str) and s not in exported]

    body = {
        "format": profile().bundle, "protocols": PROTOCOLS, "created_at": created_at or now_ts(), "memories": carried,
        "sweeps": [s for s in sweeps if s["sweep_id"] not in outside], "excluded_sweeps": [s for s in sweeps if s["sweep_id"] in outside],
        "receipts": receipts, "decisions": [d for d, w in zip(decisions, whole, strict=True) if w], "excluded_decisions": [d for d, w in zip(decisions, whole, strict=True) if not w],
        "excluded_lineage": sorted(lineage, key=lambda d: (d["memory_id"], d["role"], d["counterpart"])),
        "claims": claim_rows, "claim_sets": set_rows, "authority": authority_rows,
        "authority_genesis_at": ledger.agg(F.min("created_at")).head()[0],
        "authority_merkle_root": heads_merkle_of({a["subject_id"]: a["chain"][-1]["entry_hash"] for a in authority_rows}),
        "heads_merkle_root": heads_merkle_of({m["memory_id"]: m["custody"][-1]["entry_hash"] for m in carried}),
    }
    return sealed(body)


def sealed(body: dict) -> str:
    return canonical_json({"body": body, "bundle_sha256": digest(canonical_json(body))})


def resealed(text: str, change) -> str:
    """The bundle after change(body), with a fresh seal; for tests of what a seal does not show."""
    body = json.loads(text)["body"]
    change(body)
    return sealed(body)
