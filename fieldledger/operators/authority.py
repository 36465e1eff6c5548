"""Temporal authority: grants and quarantine windows, at one instant or at those of many acts.

grants is replay.grants and windows is replay.quarantine_windows, or tables of that shape. A
grant is live from granted_at on until, but not at, revoked_at; a window is half open as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AUTHORITY_CAPABILITY, CAPABILITIES, CLAIM_CAPABILITY, CUSTODY_CAPABILITY
from .sweeps import covered, swept


def live(at: Column) -> Column:
    return (F.col("granted_at") <= at) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > at))


def grants_live_at(grants: DataFrame, instant: str) -> DataFrame:
    return grants.where(live(F.lit(instant)))


def quarantined_at(windows: DataFrame, instant: str) -> DataFrame:
    """The subjects inside a window at the instant."""
    return windows.where((F.col("from_at") <= instant) & (F.col("to_at").isNull() | (F.col("to_at") > instant))).select("subject_id").distinct()


def capabilities_at(grants: DataFrame, windows: DataFrame, instant: str) -> DataFrame:
    """subject_id and capability: what each subject effectively holds."""
    held = grants_live_at(grants, instant).join(quarantined_at(windows, instant), "subject_id", "left_anti")
    return held.select("subject_id", F.explode("capabilities").alias("capability")).distinct()


def conferring_grant(grants: DataFrame, windows: DataFrame, capability: str, instant: str) -> DataFrame:
    """subject_id and grant_id: the smallest live grant that confers the capability."""
    held = grants_live_at(grants, instant).join(quarantined_at(windows, instant), "subject_id", "left_anti")
    return held.where(F.array_contains("capabilities", capability)).groupBy("subject_id").agg(F.min("grant_id").alias("grant_id"))


def holders(grants: DataFrame, windows: DataFrame, instant: str, capability: str = "GRANT") -> DataFrame:
    return capabilities_at(grants, windows, instant).where(F.col("capability") == capability).select("subject_id")


def roots(grants: DataFrame) -> DataFrame:
    return grants.where("root").select("subject_id").distinct()


def genesis_at(chain: DataFrame) -> DataFrame:
    return chain.agg(F.min("created_at").alias("genesis_at"))


def required(event: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[event]


def required_for_custody() -> Column:
    """The capability of a custody event; storing over a predecessor is superseding it."""
    over = (F.col("event_type") == "STORED") & F.get_json_object("payload_json", "$.supersedes").isNotNull()
    return F.when(over, "SUPERSEDE").otherwise(required(F.col("event_type"), CUSTODY_CAPABILITY))


def required_for_authority() -> Column:
    return required(F.col("event_type"), AUTHORITY_CAPABILITY)


def required_for_claim() -> Column:
    return required(F.col("event_type"), CLAIM_CAPABILITY)


def unauthorized(events: DataFrame, grants: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of events whose act its grant did not allow at the time, with ``error``.

    events has actor_id, grant_id, created_at and needed, and the columns to carry through. A grant is
    one row, joined by (actor, grant); windows are swept along with the acts, so an actor with many of
    both is split by time.
    """
    columns = events.columns
    held = grants.select(F.col("subject_id").alias("actor_id"), "grant_id", "capabilities", "granted_at", "revoked_at")
    # whether a window covers an act depends on its actor and instant alone
    shut = covered(events.select("actor_id", "created_at").distinct(), windows.withColumnRenamed("subject_id", "actor_id"), ["actor_id"], "created_at", "from_at", "to_at")
    shut = shut.where("open > 0").select("actor_id", "created_at", F.lit(True).alias("_shut"))
    both = events.join(held, ["actor_id", "grant_id"], "left").join(shut, ["actor_id", "created_at"], "left")
    alive = F.col("granted_at").isNotNull() & live(F.col("created_at"))
    error = (
        F.when(F.col("grant_id").isNull(), "no_grant").when(F.col("_shut"), "quarantined").when(~alive, "not_active")
        .when(~F.array_contains("capabilities", F.col("needed")), "not_conferred")
    )
    return both.withColumn("error", error).where("error IS NOT NULL").select(*columns, "error")


#: What a sweep over capabilities counts: each of them, quarantine, errors of the replay, and whether there is a chain.
SHUT, ERRED, KNOWN = "#shut", "#erred", "#known"
COUNTED = (*sorted(CAPABILITIES), SHUT, ERRED, KNOWN)
#: A fact adds delta to all that its mask names, at a place on the holder's chain (own) or in time.
_FACT = "array<struct<own:boolean,place:string,mask:int,delta:int>>"


def _bit(name: str) -> Column:
    return F.lit(1 << COUNTED.index(name))


def _step(seq: Column) -> Column:
    """The place of an event on its chain, as a text that sorts like its number."""
    return F.lpad(seq.cast("string"), 20, "0")


def _fact(test: Column, own: bool, place: Column, mask: Column, delta: Column | int) -> Column:
    return F.when(test, F.struct(F.lit(own).alias("own"), place.alias("place"), mask.alias("mask"), (F.lit(delta) if isinstance(delta, int) else delta).alias("delta")))


def _told(rows: DataFrame, *facts: Column) -> DataFrame:
    return rows.select(F.col("subject_id").alias("holder"), F.explode(F.array_compact(F.array(*facts)).cast(_FACT)).alias("f")).select("holder", "f.*")


def _span(test: Column, begin: Column, end: Column, mask: Column) -> list[Column]:
    """The borders of a half-open interval in time (end null: never); one that ends before it begins holds nothing."""
    real = test & begin.isNotNull() & (end.isNull() | (end > begin))
    return [_fact(real, False, begin, mask, 1), _fact(real & end.isNotNull(), False, end, mask, -1)]


def authority_facts(chain: DataFrame) -> DataFrame:
    """holder, own, place, mask and delta: all that begins, ends or fails on the chains, as ``grants``, ``quarantine_windows``
    and ``authority_errors`` have it, in one pass over grants with their revocations and one over quarantines."""
    from .replay import grant_fault, payload

    kind, seq = F.col("event_type"), F.col("seq")
    made = chain.where(kind.isin("GRANTED", "REVOKED")).select(
        "subject_id", "seq", "event_type", "created_at", payload("grant_id").alias("grant_id"),
        F.from_json(payload("capabilities"), "array<string>").alias("capabilities"), F.col("issuer_id").alias("granted_by"), F.coalesce(payload("root") == "true", F.lit(False)).alias("root"),
    )
    given, ended = kind == "GRANTED", kind == "REVOKED"
    mask = sum((F.when(F.array_contains("capabilities", c), _bit(c)).otherwise(0) for c in CAPABILITIES), F.lit(0))
    made = made.withColumn("valid", given & grant_fault().isNull()).select("subject_id", "grant_id", "seq", "event_type", "created_at", "valid", mask.alias("mask"))
    each = Window.partitionBy("subject_id", "grant_id")
    so_far = each.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.col("valid")
    made = made.select(
        "*", F.count(F.when(valid, 1)).over(so_far).alias("nth_given"), F.count(F.when(ended, 1)).over(so_far).alias("nth_ended"),
        F.min(F.when(valid, seq)).over(each).alias("given_seq"), F.min(F.when(ended, F.struct("seq", "created_at"))).over(each).alias("end"),
    )
    first, until = valid & (F.col("nth_given") == 1), F.col("end.seq")
    unknown = F.col("given_seq").isNull() | (F.col("given_seq") > seq)
    wrong = (given & (~valid | (F.col("nth_given") > 1))) | (ended & (unknown | (F.col("nth_ended") > 1)))
    grants = _told(
        made, _fact(first, True, _step(seq), F.col("mask"), 1), _fact(first & (until > seq), True, _step(until), F.col("mask"), -1),
        *_span(first, F.col("created_at"), F.col("end.created_at"), F.col("mask")), _fact(wrong, True, _step(seq), _bit(ERRED), 1),
    )
    order = Window.partitionBy("subject_id").orderBy("seq")
    marks = chain.where(kind.isin("ACTOR_QUARANTINED", "ACTOR_REINSTATED")).select(
        "subject_id", "seq", "event_type", "created_at", F.lag("event_type", 1, "ACTOR_REINSTATED").over(order).alias("last"), F.lead("event_type").over(order).alias("next_type"), F.lead("created_at").over(order).alias("next_at"),
    )
    shut = kind == "ACTOR_QUARANTINED"
    to_at = F.when(F.col("next_type") == "ACTOR_REINSTATED", F.col("next_at"))
    windows = _told(
        marks, _fact(F.lit(True), True, _step(seq), _bit(SHUT), F.when(shut, 1).otherwise(-1)), _fact(kind == F.col("last"), True, _step(seq), _bit(ERRED), 1),
        *_span(shut, F.col("created_at"), to_at, _bit(SHUT)),
    )
    return grants.unionByName(windows)


def held_before(asks: DataFrame, chain: DataFrame, wanted: Column | None = None) -> DataFrame:
    """asks with ``held``: the capabilities that the holder had at the instant, sorted, and ``known``, whether it has a chain.

    asks has holder, at, own and seq. Where own is true, only what the
    holder's chain says before seq counts, and nothing is held if that cannot be replayed: an act is
    authorised by the state before it, never by what it does itself. wanted, an array column of asks, limits what
    is told. All asks are answered in one sweep over the holders, a row an ask: a capability
    is held while more grants of it have begun than ended, and no window is open.
    """
    own = F.col("own")
    # by instant, what begins or ends there is in force; by number, what the event itself does is not
    facts = authority_facts(chain).select("holder", "own", F.col("place").alias("_place"), F.when(own, 1).otherwise(0).alias("_order"), F.col("mask").alias("_mask"), F.col("delta").alias("_delta"))
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("own")
    # that there is a chain comes before all places, nulls included
    there = chain.select(F.col("subject_id").alias("holder")).distinct().select("holder", sides, F.lit(None).cast("string").alias("_place"), F.lit(-1).alias("_order"), _bit(KNOWN).alias("_mask"), F.lit(1).alias("_delta"))
    asked = asks.select("*", F.when(own, _step(F.col("seq"))).otherwise(F.col("at")).alias("_place"), F.when(own, 0).otherwise(1).alias("_order"), F.lit(0).alias("_mask"), F.lit(0).alias("_delta"), F.lit(True).alias("_asks"))
    rows = asked.unionByName(facts.unionByName(there), allowMissingColumns=True)
    # an event makes at most three facts of either kind, and a chain one more
    counted = asks.select("holder", "own", F.lit(1).alias("_n"), F.lit(0).alias("_tells")).unionByName(chain.select(F.col("subject_id").alias("holder"), sides, F.lit(4).alias("_n"), F.lit(4).alias("_tells")))
    running = {f"_open_{i}": ("sum", F.when(F.col("_mask").bitwiseAND(_bit(c)) != 0, F.col("_delta")).otherwise(0)) for i, c in enumerate(COUNTED)}
    found = swept(rows, F.col("_asks"), ["holder", "own"], ["_place", "_order"], counted=counted, **running)
    opened = {c: F.col(f"_open_{i}") > 0 for i, c in enumerate(COUNTED)}
    none = F.array().cast("array<string>")
    caps = F.array_compact(F.array(*[F.when(opened[c], c) for c in sorted(CAPABILITIES)]))
    held = F.when(opened[SHUT] | opened[ERRED], none).otherwise(caps if wanted is None else F.array_intersect(caps, wanted))
    return found.select(*asks.columns, held.alias("held"), opened[KNOWN].alias("known"))


def amplified(chain: DataFrame) -> DataFrame:
    """subject_id, seq, error and lacking of authority events that their issuer could not make.

    An issuer acts with what it held before the event: on its own chain what its earlier events
    left it, on others what was live at the instant.
    """
    from .replay import payload

    events = chain.where(~((F.col("issuer_id") == F.col("subject_id")) & F.coalesce(payload("root") == "true", F.lit(False))))
    none = F.array().cast("array<string>")
    conferred = F.when(F.col("event_type") == "GRANTED", F.from_json(payload("capabilities"), "array<string>"))
    asks = events.select(
        F.col("issuer_id").alias("holder"), F.col("created_at").alias("at"), (F.col("issuer_id") == F.col("subject_id")).alias("own"), "seq",
        "subject_id", required_for_authority().alias("needed"), F.coalesce(conferred, none).alias("conferred"),
    )
    both = held_before(asks, chain, F.array_compact(F.concat(F.array("needed"), "conferred")))
    lacking = F.array_sort(F.array_except("conferred", "held"))
    error = F.when(~F.col("known"), "issuer_unknown").when(~F.array_contains("held", F.col("needed")), "not_held").when(F.size(lacking) > 0, "amplified")
    return both.select("subject_id", "seq", error.alias("error"), lacking.alias("lacking")).where("error IS NOT NULL")


def summary(chain: DataFrame, instant: str) -> DataFrame:
    """Per subject: status, root, effective capabilities and number of grants."""
    from .replay import authority_states, grants, quarantine_windows

    caps = capabilities_at(grants(chain), quarantine_windows(chain), instant).groupBy("subject_id").agg(F.array_sort(F.collect_set("capability")).alias("capabilities"))
    return authority_states(chain).join(caps, "subject_id", "left").withColumn("capabilities", F.coalesce("capabilities", F.array().cast("array<string>")))
