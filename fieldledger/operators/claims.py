"""Claims: constraint evaluation, standing, and the two-sided checks on relations and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_array, json_object, json_text, seal


def members_of(sets: DataFrame) -> DataFrame:
    """set_id, constraint_type and claim_id, one row per member."""
    members = F.from_json(F.get_json_object("members_json", "$.members"), "array<string>")
    return sets.select("set_id", "constraint_type", F.explode(members).alias("claim_id"))


def members_seal(members: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"members":'), json_array(F.transform(F.array_sort(members), json_text)), F.lit("}")), 256)


def verdict() -> Column:
    """SATISFIED, UNDETERMINED or VIOLATED from constraint_type, n, held and open."""
    held, still_open, n, kind = F.col("held"), F.col("open"), F.col("n"), F.col("constraint_type")
    settled = F.when(still_open == 0, "SATISFIED").otherwise("UNDETERMINED")
    exactly = F.when(held > 1, "VIOLATED").when(held == 1, settled).when(still_open == 0, "VIOLATED").otherwise("UNDETERMINED")
    return (
        F.when(kind == "AT_MOST_ONE", F.when(held > 1, "VIOLATED").otherwise(settled))
        .when(kind == "EXACTLY_ONE", exactly)
        .otherwise(F.when(held == n, "VIOLATED").otherwise(settled))
    )


def member_states(members: DataFrame, states: DataFrame) -> DataFrame:
    """set_id, constraint_type, claim_id and state, one row per member; the state is null where there is no such claim."""
    return members.select("set_id", "constraint_type", "claim_id").join(states.select("claim_id", "state"), "claim_id", "left")


def evaluated(members: DataFrame, states: DataFrame) -> DataFrame:
    """set_id, constraint_type, n, held, open and status, from counts alone: a set of any size is one small row.

    members has set_id, constraint_type and claim_id; states has claim_id and state.
    """
    counted = member_states(members, states).groupBy("set_id", "constraint_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "VALIDATED").alias("held"), F.count_if(F.col("state") == "ASSERTED").alias("open"),
    )
    return counted.withColumn("status", verdict())


def evidence(states: DataFrame, memories: DataFrame) -> DataFrame:
    """claim_id, memory_id, stance and the memory's status, MISSING where there is none.

    states has the arrays supports and contradicts; memories has memory_id and custody_status.
    """
    links = None
    for column, stance in (("supports", "SUPPORTS"), ("contradicts", "CONTRADICTS")):
        part = states.select("claim_id", F.explode(column).alias("memory_id"), F.lit(stance).alias("stance"))
        links = part if links is None else links.unionByName(part)
    return links.join(memories.select("memory_id", "custody_status"), "memory_id", "left").select("claim_id", "memory_id", "stance", F.coalesce("custody_status", F.lit("MISSING")).alias("status"))


def standings(states: DataFrame, memories: DataFrame, sets: DataFrame) -> DataFrame:
    """Per claim: supporting, contradicting, withheld and the status of its sets. Only clean evidence counts."""
    found = evidence(states, memories)
    clean = F.col("status") == "CLEAN"

    def ids(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col("memory_id"))))

    tally = found.groupBy("claim_id").agg(
        ids(clean & (F.col("stance") == "SUPPORTS")).alias("supporting"), ids(clean & (F.col("stance") == "CONTRADICTS")).alias("contradicting"),
        F.array_sort(F.collect_list(F.when(~clean, F.struct("memory_id", "status")))).alias("withheld"),
    )
    members = members_of(sets)
    status = members.select("set_id", "claim_id").join(evaluated(members, states).select("set_id", "status"), "set_id").select("claim_id", F.struct("set_id", "status").alias("s"))
    status = status.groupBy("claim_id").agg(F.array_sort(F.collect_list("s")).alias("set_statuses"))
    return states.join(tally, "claim_id", "left").join(status, "claim_id", "left")


def standing_seal(row) -> str:
    """The seal over one row of standings."""
    return seal({
        "claim_id": row["claim_id"], "statement_sha256": row["statement_sha256"], "state": row["state"],
        "supporting": list(row["supporting"] or []), "contradicting": list(row["contradicting"] or []),
        "withheld_evidence": [list(x) for x in row["withheld"] or []],
        "relations": sorted(list(x) for x in row["relations"] or []), "sets": [list(x) for x in row["set_statuses"] or []],
    })


def standing_seals(standings: DataFrame) -> DataFrame:
    """standings with standing_sha256, the same seals as ``standing_seal`` makes, for all claims at once."""
    def listed(column: str, *fields: str) -> Column:
        items = F.coalesce(F.col(column), F.array())
        one = (lambda x: json_array(F.array(*[json_text(x[f]) for f in fields]))) if fields else json_text
        return json_array(F.transform(items, one))

    relations = standings.withColumn("relations", F.array_sort(F.transform("relations", lambda r: F.struct(r["relation"].alias("relation"), r["direction"].alias("direction"), r["other"].alias("other")))))
    body = json_object(
        claim_id=json_text("claim_id"), statement_sha256=json_text("statement_sha256"), state=json_text("state"), supporting=listed("supporting"), contradicting=listed("contradicting"),
        withheld_evidence=listed("withheld", "memory_id", "status"), relations=listed("relations", "relation", "direction", "other"), sets=listed("set_statuses", "set_id", "status"),
    )
    return relations.withColumn("standing_sha256", F.sha2(body, 256))


def relations_of(states: DataFrame) -> DataFrame:
    """claim_id, relation, direction and other."""
    return states.select("claim_id", F.explode("relations").alias("r")).select("claim_id", "r.relation", "r.direction", "r.other")


def unmirrored(relations: DataFrame) -> DataFrame:
    """The relations that the other side does not record in the other direction."""
    back = relations.select(F.col("other").alias("claim_id"), "relation", F.when(F.col("direction") == "IN", "OUT").otherwise("IN").alias("direction"), F.col("claim_id").alias("other"))
    return relations.join(back, ["claim_id", "relation", "direction", "other"], "left_anti")


def membership_faults(members: DataFrame, recorded: DataFrame) -> DataFrame:
    """set_id, claim_id and problem: UNRECORDED members, and UNDECLARED records of membership.

    recorded has claim_id and set_id from the claims' own chains.
    """
    declared = members.select("set_id", "claim_id").distinct()
    recorded = recorded.select("set_id", "claim_id").distinct()
    lacking = declared.join(recorded, ["set_id", "claim_id"], "left_anti").withColumn("problem", F.lit("UNRECORDED"))
    extra = recorded.join(declared, ["set_id", "claim_id"], "left_anti").withColumn("problem", F.lit("UNDECLARED"))
    return lacking.unionByName(extra)


def contradictions(births: DataFrame) -> DataFrame:
    """memory_id, topic and against: with how many memories on its topic a memory's claim disagrees.

    births has memory_id, topic and claim. What disagrees with a claim is what its topic holds
    but for the claim itself, so memories meet counts and never each other.
    """
    held = births.where("topic IS NOT NULL AND claim IS NOT NULL AND topic <> '' AND claim <> ''").select("memory_id", "topic", "claim")
    per = held.groupBy("topic", "claim").agg(F.count("*").alias("same"))
    whole = per.groupBy("topic").agg(F.sum("same").alias("every"))
    against = per.join(whole, "topic").where("every > same").select("topic", "claim", (F.col("every") - F.col("same")).alias("against"))
    return held.join(against, ["topic", "claim"]).select("memory_id", "topic", "against")


def topic_winners(served: DataFrame) -> DataFrame:
    """topic and claim of the best-ranked served memory that carries a claim on it; served has rank, topic and claim."""
    return served.where("topic IS NOT NULL AND claim IS NOT NULL").groupBy("topic").agg(F.min_by("claim", "rank").alias("claim"))
