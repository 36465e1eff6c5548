"""Verification of evidence bundles: the checks B0 to B9, as joins over the bundle's own rows.

Each check gives rows (check, subject, seq, fault); what is proven only in part gives notes. A
bundle passes if no check gives a row. B0 and B1 end the verification, the others add up.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import canonical_json, digest
from .ledger import provenance_faults
from .operators import authority, causality, chains, claims, inventory, replay, taint
from .operators.recall import receipt_seals
from .schema import AUTHORITY, CLAIM, CUSTODY, CUSTODY_EVENTS, CUSTODY_EVENTS_1_0, PROTOCOLS, TABLES, ChainKind, profile

#: The versions whose rules are implemented here.
SUPPORTED = {
    "custody_protocol": ("1.0.0", "1.1.0"), "replay_protocol": ("1.0.0", "1.1.0"), "ranking_protocol": ("1.0.0",), "taint_protocol": ("1.0.0", "1.1.0", "2.0.0"),
    "authority_protocol": ("1.0.0", "1.1.0", "1.2.0", "1.3.0"), "receipt_protocol": ("2.0.0",), "claim_protocol": ("1.0.0", "1.1.0"),
}
FAULT = "check string, subject string, seq int, fault string"


@dataclass
class Verdict:
    errors: list[tuple[str, str | None, int | None, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    @property
    def checks(self) -> list[str]:
        return sorted({e[0] for e in self.errors})


def protocol_faults(declared: object) -> list[str]:
    """What is wrong with a declared block of versions."""
    if not isinstance(declared, dict):
        return ["no protocols are declared"]
    faults = [f"{name} is not declared" if name not in declared else f"{name} {declared[name]!r} is not implemented" for name in PROTOCOLS if declared.get(name) not in SUPPORTED[name]]
    return faults + [f"{name!r} is not known" for name in sorted(set(declared) - set(PROTOCOLS))]


class _Body:
    """The parts of a bundle's body as DataFrames."""

    def __init__(self, spark: SparkSession, body: dict) -> None:
        self.spark, self.body = spark, body
        self.memories = self._frame([(m["memory_id"], m.get("content"), m.get("content_sha256"), m.get("embedding_sha256"), m.get("custody_status"), m.get("field_state"), m.get("confidence")) for m in body.get("memories", [])], "memory_id string, content string, content_sha256 string, embedding_sha256 string, custody_status string, field_state string, confidence string")
        self.custody = self._chain(CUSTODY, [m["custody"] for m in body.get("memories", [])])
        self.authority = self._chain(AUTHORITY, [a["chain"] for a in body.get("authority", [])])
        self.claim_chain = self._chain(CLAIM, [c["chain"] for c in body.get("claims", [])])
        self.claims = self._frame([(c["claim_id"], c.get("statement"), c.get("statement_sha256"), c.get("state")) for c in body.get("claims", [])], "claim_id string, statement string, statement_sha256 string, declared string")
        self.sets = self._table("claim_sets", body.get("claim_sets", []))
        self.set_status = self._frame([(s["set_id"], s.get("status")) for s in body.get("claim_sets", [])], "set_id string, declared string")
        self.sweeps, self.excluded_sweeps = (self._table("taint_sweeps", body.get(k, [])) for k in ("sweeps", "excluded_sweeps"))
        self.decisions, self.excluded_decisions = (self._table("decisions", body.get(k, [])) for k in ("decisions", "excluded_decisions"))
        self.receipts = self._table("recall_receipts", body.get("receipts", []))
        self.lineage = self._frame([(d.get("memory_id"), d.get("role"), d.get("counterpart")) for d in body.get("excluded_lineage", [])], "memory_id string, role string, counterpart string")
        self.actors = self._frame([(a["subject_id"], a.get("status")) for a in body.get("authority", [])], "subject_id string, declared string")
        self.genesis = body.get("authority_genesis_at")

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _table(self, name: str, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in TABLES[name].names) for r in rows], TABLES[name])

    def _chain(self, kind: ChainKind, parts: list[list[dict]]) -> DataFrame:
        names = TABLES[kind.table].names
        return self.spark.createDataFrame([tuple(r.get(c) for c in names) for part in parts for r in part], TABLES[kind.table]).persist()


def _faults(check: str, rows: DataFrame, subject: str | Column, fault: str | Column, seq: str | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), (F.col(seq).cast("int") if seq else F.lit(None).cast("int")).alias("seq"), (F.lit(fault) if isinstance(fault, str) else fault).alias("fault"))


def _payload(path: str) -> Column:
    return F.get_json_object("payload_json", f"$.{path}")


def _b2(b: _Body) -> DataFrame:
    """Structure: every chain, by its declared vocabulary; a memory without a chain has no birth."""
    words = CUSTODY_EVENTS if b.body["protocols"]["custody_protocol"] != "1.0.0" else CUSTODY_EVENTS_1_0
    bad = chains.verify(b.custody, CUSTODY, words)
    empty = b.memories.join(b.custody.select("memory_id").distinct(), "memory_id", "left_anti")
    return _faults("B2", bad, "subject", F.col("error"), "seq").unionByName(_faults("B2", empty, "memory_id", "empty"))


def _b3(memories: DataFrame, sound: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Content against its birth's seal, and provenance."""
    births = sound.where("seq = 0").select("memory_id", _payload("content_sha256").alias("born"), "payload_json")
    both = memories.join(births, "memory_id")
    content = _faults("B3", both.where(F.sha2("content", 256) != F.col("born")), "memory_id", "content")
    declared = _faults("B3", both.where(~F.col("content_sha256").eqNullSafe(F.col("born"))), "memory_id", "declared_content")
    rows = []
    for r in both.where(_payload("embedding_provenance").isNotNull()).select("memory_id", "payload_json", "embedding_sha256", "born").collect():
        record = json.loads(r["payload_json"])["embedding_provenance"]
        if isinstance(record, dict):
            rows += [("B3", r["memory_id"], 0, x) for x in provenance_faults(record, r["embedding_sha256"], r["born"])]
    return content.unionByName(declared), rows


def _b4(b: _Body, memories: DataFrame, sound: DataFrame) -> DataFrame:
    """Replayed state against the declared one, and lineage from both sides."""
    promotion = b.body["protocols"]["replay_protocol"] != "1.0.0"
    out = [_faults("B4", replay.custody_errors(sound, promotion), "memory_id", F.col("error"), "seq")]
    found = replay.custody_states(sound).select("memory_id", F.col("custody_status").alias("s"), F.col("field_state").alias("f"), F.col("confidence").alias("c"))
    both = memories.join(found, "memory_id")
    out += [_faults("B4", both.where(~F.col(name).eqNullSafe(F.col(own))), "memory_id", name) for name, own in (("custody_status", "s"), ("field_state", "f"), ("confidence", "c"))]
    carried = sound.select("memory_id").distinct()
    up = sound.where("seq = 0").select("memory_id", _payload("supersedes").alias("other")).where("other IS NOT NULL")
    down = sound.where("event_type = 'SUPERSEDED_BY'").select("memory_id", _payload("successor_memory_id").alias("other")).where("other IS NOT NULL").distinct()
    for here, there, role, fault in ((up, down, "successor", "predecessor_silent"), (down, up, "predecessor", "successor_silent")):
        inside = here.join(carried.withColumnRenamed("memory_id", "other"), "other", "left_semi")
        mirror = there.select(F.col("other").alias("memory_id"), F.col("memory_id").alias("other"))
        out.append(_faults("B4", inside.join(mirror, ["memory_id", "other"], "left_anti"), "memory_id", fault))
        gone = here.join(carried.withColumnRenamed("memory_id", "other"), "other", "left_anti")
        declared = b.lineage.where(F.col("role") == role).select("memory_id", F.col("counterpart").alias("other"))
        out.append(_faults("B4", gone.join(declared, ["memory_id", "other"], "left_anti"), "memory_id", "counterpart_undeclared"))
    present = b.lineage.join(carried.withColumnRenamed("memory_id", "counterpart"), "counterpart", "left_semi")
    out.append(_faults("B4", present, "memory_id", "counterpart_carried"))
    return reduce(DataFrame.unionByName, out)


def _b5(b: _Body, sound: DataFrame) -> DataFrame:
    """Sweeps: partition, count, seal, genuine exclusion, references, and what they should have flagged."""
    marks = sound.where("event_type = 'TAINT_FLAGGED'").select(_payload("sweep_id").alias("sweep_id"), "memory_id").where("sweep_id IS NOT NULL")
    carried = marks.groupBy("sweep_id").agg(F.count_distinct("memory_id").alias("carried"))
    out = [_faults("B5", b.sweeps.join(b.excluded_sweeps.select("sweep_id"), "sweep_id", "left_semi"), "sweep_id", "both_lists")]
    out.append(_faults("B5", taint.verify_sweeps(b.sweeps, sound), "sweep_id", F.col("error")))
    complete = b.excluded_sweeps.join(carried, "sweep_id", "left").where(F.coalesce("carried", F.lit(0)) >= F.col("flagged_count"))
    out.append(_faults("B5", complete, "sweep_id", "excluded_though_complete"))
    known = b.sweeps.select("sweep_id").union(b.excluded_sweeps.select("sweep_id"))
    out.append(_faults("B5", carried.join(known, "sweep_id", "left_anti"), "sweep_id", "not_carried"))
    if b.body["protocols"]["taint_protocol"] == "2.0.0":
        out.append(_faults("B5", taint.rederived(b.sweeps, sound), "sweep_id", F.concat_ws(" ", "problem", "memory_id")))
    return reduce(DataFrame.unionByName, out)


def _b7(b: _Body, sound: DataFrame, verdict: Verdict) -> list[DataFrame]:
    """Authority: structure, status, root, no amplification, and a grant behind every act."""
    has = not b.actors.isEmpty()
    granted = sound.select("memory_id", "seq", "event_type", "actor_id", "created_at", "payload_json", _payload("grant_id").alias("grant_id"))
    if not has:
        out = [_faults("B7", granted.where("grant_id IS NOT NULL"), "memory_id", "grant_without_ledger", "seq")]
        if b.genesis is not None:
            verdict.errors.append(("B7", None, None, "genesis_without_ledger"))
        if b.body.get("authority_merkle_root") != inventory.merkle_of([]):
            verdict.errors.append(("B7", None, None, "merkle"))
        verdict.notes.append("the field has no authority ledger: nobody's permission is proven")
        return out
    if not isinstance(b.genesis, str):
        verdict.errors.append(("B7", None, None, "no_genesis"))
        return []
    broken = chains.verify(b.authority, AUTHORITY)
    errors = replay.authority_errors(b.authority)
    status = replay.authority_states(b.authority).join(b.actors, "subject_id", "full_outer").where(~F.col("status").eqNullSafe(F.col("declared")))
    early = [
        *_faults("B7", broken, "subject", F.col("error"), "seq").collect(), *_faults("B7", errors, "subject_id", F.col("error"), "seq").collect(), *_faults("B7", status, "subject_id", "status").collect(),
    ]
    heads = {r["subject_id"]: r["entry_hash"] for r in chains.heads(b.authority, AUTHORITY).collect()}
    if inventory.heads_merkle_of(heads) != b.body.get("authority_merkle_root"):
        early.append(("B7", None, None, "merkle"))
    if authority.genesis_at(b.authority).head()[0] != b.genesis:
        early.append(("B7", None, None, "genesis"))
    if early:  # what the ledger means is only asked of one that holds together
        verdict.errors += [tuple(x) for x in early]
        return []
    grants, windows = replay.grants(b.authority).persist(), replay.quarantine_windows(b.authority).persist()
    if authority.roots(grants).count() != 1:
        verdict.errors.append(("B7", None, None, "roots"))
    out = [_faults("B7", authority.amplified(b.authority), "subject_id", F.col("error"), "seq")]
    before = F.col("created_at") < b.genesis
    out.append(_faults("B7", granted.where(before & F.col("grant_id").isNotNull()), "memory_id", "grant_before_ledger", "seq"))
    events = granted.where(~before).withColumn("needed", authority.required_for_custody()).drop("payload_json", "event_type")
    out.append(_acts("B7", events, "memory_id", b, grants, windows))
    free = granted.where(before).count()
    if free:
        verdict.notes.append(f"{free} custody events are older than the ledger: nobody's permission for them is claimed")
    return out


def _acts(check: str, events: DataFrame, subject: str, b: _Body, grants: DataFrame, windows: DataFrame) -> DataFrame:
    """The acts that no grant covers; an actor without a chain in the bundle has none."""
    known = b.authority.select(F.col("subject_id").alias("actor_id"), F.lit(True).alias("known")).distinct()
    bad = authority.unauthorized(events, grants, windows).join(known, "actor_id", "left")
    fault = F.when(F.col("grant_id").isNotNull() & F.col("known").isNull(), "actor_unknown").otherwise(F.col("error"))
    return _faults(check, bad, subject, fault, "seq")


def _b8(b: _Body, sound: DataFrame) -> list[DataFrame]:
    """Causality: receipts, decisions, and their use from both sides."""
    out = [_faults("B8", receipt_seals(b.receipts).where("NOT ok"), "receipt_sha256", "receipt_seal")]
    declared = b.body["protocols"]["ranking_protocol"]
    out.append(_faults("B8", b.receipts.where(F.col("ranking_protocol") != declared), "receipt_sha256", "ranking_protocol"))
    good = b.receipts.join(receipt_seals(b.receipts).where("ok"), "receipt_sha256", "left_semi").where(F.col("ranking_protocol") == declared)
    out.append(_faults("B8", b.decisions.join(b.excluded_decisions.select("decision_id"), "decision_id", "left_semi"), "decision_id", "both_lists"))
    every = b.decisions.unionByName(b.excluded_decisions)
    seals = causality.decision_seals(every)
    out.append(_faults("B8", seals.where("NOT ok"), "decision_id", "decision_seal"))
    sealed = every.join(seals.where("ok"), "decision_id", "left_semi")
    anchored = sealed.join(good.select("receipt_sha256"), "receipt_sha256", "left_semi")
    out.append(_faults("B8", sealed.join(good.select("receipt_sha256"), "receipt_sha256", "left_anti"), "decision_id", "receipt_missing"))
    imagined = good.where(F.get_json_object("custody_override_json", "$.override") != "[]")
    out.append(_faults("B8", anchored.join(imagined.select("receipt_sha256"), "receipt_sha256", "left_semi"), "decision_id", "counterfactual_receipt"))
    out.append(_faults("B8", causality.unserved(anchored, good), "decision_id", F.concat_ws(" ", F.lit("not_served"), "memory_id")))
    carried = sound.select("memory_id").distinct()
    used = causality.used_of(anchored)
    inside = used.join(b.decisions.select("decision_id"), "decision_id", "left_semi")
    out.append(_faults("B8", inside.join(carried, "memory_id", "left_anti"), "decision_id", F.concat_ws(" ", F.lit("memory_missing"), "memory_id")))
    sides = causality.one_sided(used, sound)
    # a use is owed an event where the decision is included and the memory travels
    lacking = sides.where("problem = 'UNRECORDED'").join(carried, "memory_id", "left_semi").join(b.decisions.select("decision_id"), "decision_id", "left_semi")
    out.append(_faults("B8", lacking, "decision_id", F.concat_ws(" ", F.lit("event_missing"), "memory_id")))
    extra = sides.where("problem = 'UNCLAIMED'").join(causality.used_of(every).select("decision_id", "memory_id"), ["decision_id", "memory_id"], "left_anti")
    named = F.when(F.col("known"), "not_claimed").otherwise("decision_missing")
    out.append(_faults("B8", extra.join(every.select("decision_id", F.lit(True).alias("known")), "decision_id", "left"), "decision_id", F.concat_ws(" ", named, "memory_id")))
    absent = causality.used_of(b.excluded_decisions).join(carried, "memory_id", "left_anti").select("decision_id")
    out.append(_faults("B8", b.excluded_decisions.join(absent, "decision_id", "left_anti"), "decision_id", "excluded_though_complete"))
    return out


def _b9(b: _Body, sound: DataFrame, verdict: Verdict) -> list[DataFrame]:
    """Claims: structure, state, statement, relations and sets from both sides, and authority."""
    broken = chains.verify(b.claim_chain, CLAIM)
    chain = b.claim_chain.join(broken.select(F.col("subject").alias("claim_id")), "claim_id", "left_anti")
    errors = replay.claim_errors(chain)
    chain = chain.join(errors.select("claim_id"), "claim_id", "left_anti").persist()
    states = replay.claim_states(chain).persist()
    out = [_faults("B9", broken, "subject", F.col("error"), "seq"), _faults("B9", errors, "claim_id", F.col("error"), "seq")]
    both = states.select("claim_id", "state", F.col("statement_sha256").alias("sealed")).join(b.claims, "claim_id")
    out.append(_faults("B9", both.where(~F.col("state").eqNullSafe(F.col("declared"))), "claim_id", "state"))
    hashed = F.coalesce(F.sha2("statement", 256) == F.col("sealed"), F.lit(False))
    out.append(_faults("B9", both.where(~hashed), "claim_id", "statement"))
    out.append(_faults("B9", both.where(hashed & ~F.col("statement_sha256").eqNullSafe(F.col("sealed"))), "claim_id", "declared_statement"))
    out.append(_faults("B9", claims.unmirrored(claims.relations_of(states)), "claim_id", F.concat_ws(" ", F.lit("relation"), "relation", "direction", "other")))
    members = claims.members_of(b.sets)
    listed = F.from_json(F.get_json_object("members_json", "$.members"), "array<string>")
    out.append(_faults("B9", b.sets.where(~F.coalesce(claims.members_seal(listed) == F.col("members_sha256"), F.lit(False))), "set_id", "members_seal"))
    absent = members.join(states.select("claim_id"), "claim_id", "left_anti")
    out.append(_faults("B9", absent, "set_id", F.concat_ws(" ", F.lit("member_missing"), "claim_id")))
    whole = members.join(absent.select("set_id"), "set_id", "left_anti")
    recorded = states.select("claim_id", F.explode("sets").alias("set_id"))
    sides = claims.membership_faults(members, recorded)
    unrecorded = sides.where("problem = 'UNRECORDED'").join(whole.select("set_id").distinct(), "set_id", "left_semi")
    out.append(_faults("B9", unrecorded.unionByName(sides.where("problem = 'UNDECLARED'")), "set_id", F.concat_ws(" ", "problem", "claim_id")))
    evaluated = claims.evaluated(whole, states).join(b.set_status, "set_id")
    out.append(_faults("B9", evaluated.where(~F.col("status").eqNullSafe(F.col("declared"))), "set_id", "status"))
    verdict.notes += [f"claim set {r['set_id']} is violated" for r in evaluated.where("status = 'VIOLATED'").collect()]
    evidence = states.select(F.explode(F.array_union("supports", "contradicts")).alias("memory_id")).distinct()
    outside = evidence.join(sound.select("memory_id").distinct(), "memory_id", "left_anti").count()
    if outside:
        verdict.notes.append(f"{outside} memories named as evidence do not travel here")
    if isinstance(b.genesis, str) and not b.actors.isEmpty():
        faulty = replay.authority_errors(b.authority).select("subject_id")
        ledger = b.authority.join(faulty, "subject_id", "left_anti")
        acts = chain.where(F.col("created_at") >= b.genesis).select("claim_id", "seq", "event_type", "actor_id", "created_at", _payload("grant_id").alias("grant_id"), _payload("set_id").alias("set_id"))
        # joining a set that binds a settled claim costs more than joining one that does not
        joined = acts.where("event_type = 'SET_MEMBERSHIP'").select("set_id", F.col("created_at").alias("at")).distinct()
        dearer = replay.set_capabilities(chain, members, joined).where("needed = 'ADJUDICATE'")
        settled = dearer.select("set_id", F.col("at").alias("created_at"), F.lit(True).alias("settled"))
        acts = acts.join(settled, ["set_id", "created_at"], "left")
        dear = (F.col("event_type") == "SET_MEMBERSHIP") & F.col("settled")
        acts = acts.withColumn("needed", F.when(dear, "ADJUDICATE").otherwise(authority.required_for_claim())).drop("event_type", "set_id", "settled")
        out.append(_acts("B9", acts, "claim_id", b, replay.grants(ledger), replay.quarantine_windows(ledger)))
    return out


def verify(spark: SparkSession, text: str) -> Verdict:
    """The verdict on a bundle."""
    verdict = Verdict()

    def refuse(check: str, *faults: str) -> Verdict:
        verdict.errors += [(check, None, None, f) for f in faults]
        return verdict

    try:
        outer = json.loads(text)
        body, declared = outer["body"], outer["bundle_sha256"]
        whole = canonical_json(body)
    except (ValueError, TypeError, KeyError):
        return refuse("B1", "unreadable")
    if digest(whole) != declared:
        return refuse("B1", "seal")
    if body.get("format") != profile().bundle:
        return refuse("B1", "format")
    if faults := protocol_faults(body.get("protocols")):
        return refuse("B0", *faults)
    verdict.notes.append("semantics: " + ", ".join(f"{k} {body['protocols'][k]}" for k in PROTOCOLS))
    b = _Body(spark, body)
    broken = _b2(b).persist()
    bad = broken.select(F.col("subject").alias("memory_id")).distinct()
    sound = b.custody.join(bad, "memory_id", "left_anti").persist()
    memories = b.memories.join(bad, "memory_id", "left_anti")
    content, records = _b3(memories, sound)
    verdict.errors += records
    undeclared = sound.where("seq = 0").where(_payload("embedding_provenance").isNull()).count()
    if undeclared:
        verdict.notes.append(f"{undeclared} memories declare no embedding provenance")
    verdict.notes += [f"sweep {r['sweep_id']} is declared excluded; its seal was not checked" for r in b.excluded_sweeps.select("sweep_id").collect()]
    verdict.notes += [f"decision {r['decision_id']} is declared excluded; its evidence was not checked in full" for r in b.excluded_decisions.select("decision_id").collect()]
    verdict.notes += [f"{r['memory_id']} names {r['counterpart']} as its {'predecessor' if r['role'] == 'successor' else 'successor'}, which does not travel here" for r in b.lineage.collect()]
    heads = {r["memory_id"]: r["entry_hash"] for r in chains.heads(sound, CUSTODY).collect()}
    if inventory.heads_merkle_of(heads) != body.get("heads_merkle_root"):
        verdict.errors.append(("B6", None, None, "merkle"))
    parts = [broken, content, _b4(b, memories, sound), _b5(b, sound), *_b7(b, sound, verdict), *_b8(b, sound), *_b9(b, sound, verdict)]
    for part in parts:
        verdict.errors += [tuple(r) for r in part.collect()]
    verdict.errors.sort(key=lambda e: (e[0], str(e[1]), e[2] or 0, e[3]))
    for frame in (b.custody, b.authority, b.claim_chain, sound, broken):
        frame.unpersist()
    return verdict


def main(paths: list[str]) -> int:
    """Exit status 0 if the bundle passes, 1 if it fails, 2 if it cannot be read."""
    if len(paths) != 1:
        print("usage: verify BUNDLE", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        text = spark.read.text(paths[0], wholetext=True).head()[0]
    except Exception as error:  # noqa: BLE001 - whatever keeps it from being read
        print(f"cannot read {paths[0]}: {error}", file=sys.stderr)
        return 2
    verdict = verify(spark, text)
    for check, subject, seq, fault in verdict.errors:
        print(f"{check}: {subject or 'bundle'}{'' if seq is None else f' seq {seq}'}: {fault}")
    for note in verdict.notes:
        print(f"note: {note}")
    print("PASS" if verdict.ok else "FAIL")
    return 0 if verdict.ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
