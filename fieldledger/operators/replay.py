"""State derived from event chains: custody, authority and claims, now and at an instant.

The state machines are written as aggregates and windows instead of folds. An event that sets a
status outright makes everything before it irrelevant, so a status is the value of the last such
event and of what came after it; aggregates over (value, seq) merge in any order, on any number
of machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AUTHORITY, CAPABILITIES, CLAIM, CUSTODY, FIELD_STATES, ID_PATTERN, INITIAL_CONFIDENCE, PROMOTION, STANCES
from .sweeps import swept


def payload(path: str) -> Column:
    return F.get_json_object("payload_json", f"$.{path}")


def _set_to() -> Column:
    """The status that an event sets outright."""
    et = F.col("event_type")
    return F.when(et == "QUARANTINED", "QUARANTINED").when(et == "SUPERSEDED_BY", "SUPERSEDED").when(et == "REHABILITATED", "CLEAN")


def custody_states(chain: DataFrame) -> DataFrame:
    """memory_id, custody_status, field_state and confidence."""
    et = F.col("event_type")
    sets = et.isin("QUARANTINED", "SUPERSEDED_BY", "REHABILITATED")
    moves = (et == "STATE_CHANGED") & payload("to").isin(*FIELD_STATES)
    gains = (et == "REINFORCED") & payload("confidence_after").isNotNull()
    out = chain.groupBy("memory_id").agg(
        F.max(F.when(sets, F.struct("seq", _set_to().alias("value")))).alias("last_set"),
        F.max(F.when(et == "TAINT_FLAGGED", F.col("seq"))).alias("last_flag"),
        F.max(F.when(moves, F.struct("seq", payload("to").alias("value")))).alias("last_move"),
        F.max(F.when(gains, F.struct("seq", payload("confidence_after").alias("value")))).alias("last_gain"),
    )
    base = F.coalesce(F.col("last_set.value"), F.lit("CLEAN"))
    flagged = (base == "CLEAN") & (F.col("last_flag") > F.coalesce(F.col("last_set.seq"), F.lit(-1)))
    return out.select(
        "memory_id",
        F.when(flagged, "TAINT_FLAGGED").otherwise(base).alias("custody_status"),
        F.coalesce("last_move.value", F.lit("NEUTRAL")).alias("field_state"),
        F.coalesce("last_gain.value", F.lit(INITIAL_CONFIDENCE)).alias("confidence"),
    )


def custody_statuses(chain: DataFrame) -> DataFrame:
    """memory_id and custody_status alone, for chains whose payloads are not at hand."""
    return custody_states(chain).select("memory_id", "custody_status")


def custody_errors(chain: DataFrame, promotion: bool = True) -> DataFrame:
    """memory_id, seq and error of the events that their state before does not allow.

    promotion: whether a promotion must be due by confidence, and a due one must be recorded.
    """
    et = F.col("event_type")
    w = Window.partitionBy("memory_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sets = et.isin("QUARANTINED", "SUPERSEDED_BY", "REHABILITATED")
    moves = (et == "STATE_CHANGED") & payload("to").isin(*FIELD_STATES)
    gains = (et == "REINFORCED") & payload("confidence_after").isNotNull()
    rows = chain.select(
        "memory_id", "seq", "event_type", payload("from").alias("from"), payload("to").alias("to"), payload("confidence_before").alias("before"), payload("confidence_after").alias("after"),
        F.coalesce(F.max(F.when(sets, F.struct("seq", _set_to().alias("value")))).over(w)["value"], F.lit("CLEAN")).alias("set_to"),
        F.coalesce(F.max(F.when(sets, F.col("seq"))).over(w), F.lit(-1)).alias("set_at"),
        F.coalesce(F.max(F.when(et == "TAINT_FLAGGED", F.col("seq"))).over(w), F.lit(-1)).alias("flag_at"),
        F.coalesce(F.max(F.when(moves, F.struct("seq", payload("to").alias("value")))).over(w)["value"], F.lit("NEUTRAL")).alias("state"),
        F.coalesce(F.max(F.when(gains, F.struct("seq", payload("confidence_after").alias("value")))).over(w)["value"], F.lit(INITIAL_CONFIDENCE)).alias("confidence"),
    )
    status = F.when((F.col("set_to") == "CLEAN") & (F.col("flag_at") > F.col("set_at")), "TAINT_FLAGGED").otherwise(F.col("set_to"))
    high = F.lit(PROMOTION).cast("decimal(20,10)")
    due = F.col("after").cast("decimal(20,10)") >= high
    faults = [
        ((et == "REHABILITATED") & (status != "TAINT_FLAGGED"), "rehabilitated_from"),
        (F.lit(promotion) & (et == "STATE_CHANGED") & (F.col("from") == "NEUTRAL") & (F.col("to") == "REINFORCED") & (F.col("confidence").cast("decimal(20,10)") < high), "promotion_not_due"),
        ((et == "STATE_CHANGED") & ~F.col("from").eqNullSafe(F.col("state")), "state_from"),
        ((et == "STATE_CHANGED") & ~F.coalesce(F.col("to").isin(*FIELD_STATES), F.lit(False)), "state_to"),
        ((et == "REINFORCED") & ~F.col("before").eqNullSafe(F.col("confidence")), "confidence_before"),
        ((et == "REINFORCED") & F.col("after").isNull(), "confidence_after"),
    ]
    errors = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in faults]))
    found = rows.select("memory_id", "seq", F.explode(errors).alias("error"))
    if not promotion:
        return found
    # a reinforcement to the threshold while neutral must be followed by some state change
    last = rows.groupBy("memory_id").agg(
        F.max(F.when((et == "REINFORCED") & due & (F.col("state") == "NEUTRAL"), F.col("seq"))).alias("due_at"),
        F.max(F.when(et == "STATE_CHANGED", F.col("seq"))).alias("changed_at"),
    )
    missing = last.where(F.col("due_at") > F.coalesce("changed_at", F.lit(-1)))
    return found.unionByName(missing.select("memory_id", F.col("due_at").alias("seq"), F.lit("promotion_not_recorded").alias("error")))


def until(chain: DataFrame, instant: str) -> DataFrame:
    """The events up to and with the instant; instants compare as text."""
    return chain.where(F.col("created_at") <= instant)


def before(chain: DataFrame, instant: str) -> DataFrame:
    return chain.where(F.col("created_at") < instant)


def irreproducible(chain: DataFrame, instant: str) -> DataFrame:
    """memory_id and error of the chains whose events up to the instant cannot have happened so: what
    comes first is no birth, or an event is not allowed by the state before it."""
    part = until(chain, instant)
    first = part.groupBy("memory_id").agg(F.min_by("event_type", "seq").alias("first")).where("first <> 'STORED'")
    return first.select("memory_id", F.lit("unborn").alias("error")).unionByName(custody_errors(part).select("memory_id", "error"))


def states_at(chain: DataFrame, instant: str) -> DataFrame:
    """custody_states of the memories born by the instant; others are absent, not excluded."""
    part = until(chain, instant)
    born = part.where("seq = 0 AND event_type = 'STORED'").select("memory_id")
    return custody_states(part).join(born, "memory_id", "left_semi")


# --- authority -----------------------------------------------------------------------------


def grants(chain: DataFrame) -> DataFrame:
    """subject_id, grant_id, capabilities, granted_at, granted_seq, granted_by, revoked_at, revoked_seq, root."""
    made = chain.where("event_type = 'GRANTED'").select(
        "subject_id", payload("grant_id").alias("grant_id"), F.from_json(payload("capabilities"), "array<string>").alias("capabilities"),
        F.col("created_at").alias("granted_at"), F.col("seq").alias("granted_seq"), F.col("issuer_id").alias("granted_by"), F.coalesce(payload("root") == "true", F.lit(False)).alias("root"),
    )
    made = made.where(grant_fault().isNull()).groupBy("subject_id", "grant_id").agg(F.min_by(F.struct("capabilities", "granted_at", "granted_seq", "granted_by", "root"), "granted_seq").alias("g")).select("subject_id", "grant_id", "g.*")
    ended = chain.where("event_type = 'REVOKED'").groupBy("subject_id", payload("grant_id").alias("grant_id")).agg(F.min_by("created_at", "seq").alias("revoked_at"), F.min("seq").alias("revoked_seq"))
    return made.join(ended, ["subject_id", "grant_id"], "left")


def grant_fault() -> Column:
    """What is wrong with a grant by itself, or null; needs the columns of a made grant."""
    caps, known = F.col("capabilities"), F.array(*[F.lit(c) for c in CAPABILITIES])
    return (
        F.when(~F.coalesce(F.col("grant_id").rlike(ID_PATTERN), F.lit(False)), "grant_id")
        .when(caps.isNull() | (F.size(caps) == 0), "no_capabilities")
        .when(F.size(F.array_except(caps, known)) > 0, "unknown_capabilities")
        .when(caps != F.array_sort(F.array_distinct(caps)), "not_canonical")
        .when(F.col("root") & (F.col("granted_by") != F.col("subject_id")), "root_not_self_issued")
        .when(F.col("root") & (F.size(caps) != len(CAPABILITIES)), "root_partial")
    )


def quarantine_windows(chain: DataFrame) -> DataFrame:
    """subject_id, from_at, to_at (null: open): half-open windows in which a subject holds nothing."""
    w = Window.partitionBy("subject_id").orderBy("seq")
    marks = chain.where(F.col("event_type").isin("ACTOR_QUARANTINED", "ACTOR_REINSTATED"))
    marks = marks.withColumn("next_type", F.lead("event_type").over(w)).withColumn("next_at", F.lead("created_at").over(w))
    to_at = F.when(F.col("next_type") == "ACTOR_REINSTATED", F.col("next_at"))
    return marks.where("event_type = 'ACTOR_QUARANTINED'").select("subject_id", F.col("created_at").alias("from_at"), to_at.alias("to_at"))


def authority_states(chain: DataFrame) -> DataFrame:
    """subject_id, status, is_root, registered_at, registered_by and the number of grants."""
    et = F.col("event_type")
    out = chain.groupBy("subject_id").agg(
        F.max(F.when(et.isin("ACTOR_QUARANTINED", "ACTOR_REINSTATED"), F.struct("seq", et.alias("value"))))["value"].alias("last"),
        F.max(F.when(et == "ACTOR_REGISTERED", F.struct("seq", "created_at", "issuer_id"))).alias("reg"),
    )
    held = grants(chain).groupBy("subject_id").agg(F.count("*").cast("int").alias("n_grants"), F.bool_or("root").alias("is_root"))
    status = F.when(F.col("last") == "ACTOR_QUARANTINED", "QUARANTINED").otherwise("ACTIVE")
    return out.join(held, "subject_id", "left").select("subject_id", status.alias("status"), F.coalesce("is_root", F.lit(False)).alias("is_root"), F.col("reg.created_at").alias("registered_at"), F.col("reg.issuer_id").alias("registered_by"), F.coalesce("n_grants", F.lit(0)).alias("n_grants"))


def authority_errors(chain: DataFrame) -> DataFrame:
    """subject_id, seq and error of authority events that cannot mean what they say."""
    made = chain.where("event_type = 'GRANTED'").select("subject_id", "seq", payload("grant_id").alias("grant_id"), F.from_json(payload("capabilities"), "array<string>").alias("capabilities"), F.col("issuer_id").alias("granted_by"), F.coalesce(payload("root") == "true", F.lit(False)).alias("root"))
    made = made.withColumn("fault", grant_fault())
    w = Window.partitionBy("subject_id", "grant_id").orderBy("seq")
    again = made.where("fault IS NULL").withColumn("fault", F.when(F.row_number().over(w) > 1, "grant_reused"))
    errors = made.where("fault IS NOT NULL").unionByName(again.where("fault IS NOT NULL")).select("subject_id", "seq", F.col("fault").alias("error"))
    ends = chain.where("event_type = 'REVOKED'").select("subject_id", "seq", payload("grant_id").alias("grant_id")).withColumn("nth", F.row_number().over(w))
    live = grants(chain).select("subject_id", "grant_id", "granted_seq")
    ends = ends.join(live, ["subject_id", "grant_id"], "left").withColumn("error", F.when(F.col("granted_seq").isNull() | (F.col("granted_seq") > F.col("seq")), "revoked_unknown").when(F.col("nth") > 1, "revoked_twice"))
    order = Window.partitionBy("subject_id").orderBy("seq")
    marks = chain.where(F.col("event_type").isin("ACTOR_QUARANTINED", "ACTOR_REINSTATED")).withColumn("last", F.lag("event_type", 1, "ACTOR_REINSTATED").over(order))
    marks = marks.where("event_type = last").select("subject_id", "seq", F.when(F.col("event_type") == "ACTOR_QUARANTINED", "quarantined_from").otherwise("reinstated_from").alias("error"))
    return errors.unionByName(ends.where("error IS NOT NULL").select("subject_id", "seq", "error")).unionByName(marks)


# --- claims --------------------------------------------------------------------------------

#: The events that move a claim, where to, and from which states they may.
CLAIM_MOVES = {
    "CLAIM_VALIDATED": ("VALIDATED", ("ASSERTED",)), "CLAIM_REFUTED": ("REFUTED", ("ASSERTED", "VALIDATED")),
    "CLAIM_WITHDRAWN": ("WITHDRAWN", ("ASSERTED",)), "CLAIM_SUPERSEDED": ("SUPERSEDED", ("ASSERTED", "VALIDATED")),
}


def _moved() -> Column:
    out = None
    for event, (to, _) in CLAIM_MOVES.items():
        test = F.col("event_type") == event
        out = F.when(test, to) if out is None else out.when(test, to)
    return out


def claim_states(chain: DataFrame) -> DataFrame:
    """claim_id, state, statement_sha256, topic, asserted_by, asserted_at, supports, contradicts, relations, sets."""
    et = F.col("event_type")
    link = et == "EVIDENCE_LINKED"
    out = chain.groupBy("claim_id").agg(
        F.max(F.when(et.isin(*CLAIM_MOVES), F.struct("seq", _moved().alias("value"))))["value"].alias("moved"),
        F.max(F.when(et == "CLAIM_ASSERTED", F.struct("seq", payload("statement_sha256").alias("sha"), payload("topic").alias("topic"), "actor_id", "created_at"))).alias("a"),
        *[F.array_sort(F.collect_set(F.when(link & (payload("stance") == s), payload("memory_id")))).alias(s.lower()) for s in STANCES],
        F.array_sort(F.collect_set(F.when(et == "RELATED_TO", F.struct(payload("relation").alias("relation"), payload("direction").alias("direction"), payload("other_claim_id").alias("other"))))).alias("relations"),
        F.array_sort(F.collect_set(F.when(et == "SET_MEMBERSHIP", payload("set_id")))).alias("sets"),
    )
    return out.select("claim_id", F.coalesce("moved", F.lit("ASSERTED")).alias("state"), F.col("a.sha").alias("statement_sha256"), F.col("a.topic").alias("topic"), F.col("a.actor_id").alias("asserted_by"), F.col("a.created_at").alias("asserted_at"), "supports", "contradicts", "relations", "sets")


def _claims_judged(chain: DataFrame) -> DataFrame:
    """chain with ``errors``, what is wrong with each event by itself or by the state before it."""
    et = F.col("event_type")
    w = Window.partitionBy("claim_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.max(F.when(et.isin(*CLAIM_MOVES), F.struct("seq", _moved().alias("value")))).over(w)["value"], F.lit("ASSERTED"))
    rows = chain.withColumn("_state", state)
    wrong = F.lit(False)
    for event, (_, allowed) in CLAIM_MOVES.items():
        wrong = wrong | ((et == event) & ~F.col("_state").isin(*allowed))
    faults = [
        ((et == "CLAIM_ASSERTED") & ~F.coalesce(payload("statement_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "statement_hash"),
        ((et == "EVIDENCE_LINKED") & (payload("memory_id").isNull() | ~F.coalesce(payload("stance").isin(*STANCES), F.lit(False))), "evidence"),
        ((et == "RELATED_TO") & (payload("other_claim_id").isNull() | ~F.coalesce(payload("relation").isin("SUPPORTS", "CONTRADICTS", "SUPERSEDES", "DERIVED_FROM") & payload("direction").isin("OUT", "IN"), F.lit(False))), "relation"),
        ((et == "SET_MEMBERSHIP") & payload("set_id").isNull(), "set_id"),
        (wrong, "state_from"),
    ]
    errors = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in faults]))
    return rows.withColumn("errors", errors).drop("_state")


def claim_errors(chain: DataFrame) -> DataFrame:
    """claim_id, seq and error of claim events that their state before does not allow."""
    return _claims_judged(chain).select("claim_id", "seq", F.explode("errors").alias("error"))


def _states_before(chain: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (claim_id, at and more) with ``state``, a row an ask."""
    facts = _claims_judged(chain).select("claim_id", F.col("created_at").alias("at"), F.lit(1).alias("_order"), F.size("errors").alias("_wrong"), F.col("seq").alias("_seq"), _moved().alias("_moved"))
    # what neither moves a claim nor fails tells nothing
    facts = facts.where("_wrong > 0 OR _moved IS NOT NULL")
    asked = asks.select("*", F.lit(0).alias("_order"), F.lit(0).alias("_wrong"))
    one = F.lit(1).alias("_n")
    counted = asks.select("claim_id", one, F.lit(0).alias("_tells")).unionByName(chain.select("claim_id", one, F.lit(1).alias("_tells")))
    last = F.when(F.col("_moved").isNotNull(), F.struct("at", "_seq", "_moved"))
    found = swept(asked.unionByName(facts, allowMissingColumns=True), F.col("_order") == 0, ["claim_id"], ["at", "_order"], counted=counted, _errors=("sum", F.col("_wrong")), _last=("max", last))
    return found.select(*asks.columns, F.when(F.col("_errors") > 0, "ASSERTED").otherwise(F.coalesce("_last._moved", F.lit("ASSERTED"))).alias("state"))


def claim_states_before(chain: DataFrame, asks: DataFrame) -> DataFrame:
    """claim_id, at and state: each claim's state strictly before an instant, for all asks (claim_id, at) at once.

    A claim without events before the instant, or whose events before it cannot have happened so, counts as ASSERTED.
    Events and asks are swept together: what counts is the last move and whether there was an error.
    """
    # equal asks have equal states, and lie together already
    return _states_before(chain, asks.select("claim_id", "at")).distinct()


def set_capabilities(chain: DataFrame, members: DataFrame, asks: DataFrame) -> DataFrame:
    """set_id, at and needed: what binding a set at an instant costs. Where a member was VALIDATED before, it is
    ADJUDICATE, else ASSERT. members has set_id and claim_id, asks has set_id and at."""
    each = asks.select("set_id", "at").distinct().join(members.select("set_id", "claim_id").distinct(), "set_id", "left")
    states = _states_before(chain, each.where("claim_id IS NOT NULL")).select("set_id", "at", "state")
    found = states.unionByName(each.where("claim_id IS NULL").select("set_id", "at", F.lit(None).cast("string").alias("state")))
    return found.groupBy("set_id", "at").agg(F.when(F.coalesce(F.bool_or(F.col("state") == "VALIDATED"), F.lit(False)), "ADJUDICATE").otherwise("ASSERT").alias("needed"))


KINDS = (CUSTODY, AUTHORITY, CLAIM)
