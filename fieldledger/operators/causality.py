"""Decisions and their consequences: seals, two-sided use, and the graded blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import json_array, json_object, json_text, seal
from ..schema import PROTOCOLS
from .graph import Successions, settled


def used_of(decisions: DataFrame) -> DataFrame:
    """decision_id, actor_id and memory_id, one row per memory that a decision says it used."""
    used = F.from_json(F.get_json_object("used_json", "$.used"), "array<string>")
    return decisions.select("decision_id", "actor_id", "receipt_sha256", F.explode(used).alias("memory_id"))


def served_of(receipts: DataFrame) -> DataFrame:
    """receipt_sha256, rank and memory_id."""
    served = F.from_json(F.get_json_object("served_json", "$.served"), "array<string>")
    return receipts.select("receipt_sha256", F.posexplode(served).alias("rank", "memory_id"))


def decision_seals(decisions: DataFrame) -> DataFrame:
    """decision_id and whether record_sha256 recomputes."""
    used = F.transform(F.array_sort(F.from_json(F.get_json_object("used_json", "$.used"), "array<string>")), json_text)
    members = {c: json_text(c) for c in ("decision_id", "receipt_sha256", "decision_sha256", "policy_version", "actor_id", "reason", "created_at")}
    body = json_object(used_memory_ids=json_array(used), **members)
    return decisions.select("decision_id", F.coalesce(F.sha2(body, 256) == F.col("record_sha256"), F.lit(False)).alias("ok"))


def unserved(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """decision_id and memory_id of uses that the cited recall never served, or whose receipt is missing."""
    return used_of(decisions).join(served_of(receipts).select("receipt_sha256", "memory_id"), ["receipt_sha256", "memory_id"], "left_anti").select("decision_id", "memory_id")


def one_sided(used: DataFrame, chain: DataFrame) -> DataFrame:
    """decision_id, memory_id and problem: UNRECORDED uses and UNCLAIMED custody events."""
    events = chain.where("event_type = 'DECISION_USED_MEMORY'").select(F.get_json_object("payload_json", "$.decision_id").alias("decision_id"), "memory_id").where("decision_id IS NOT NULL").distinct()
    claimed = used.select("decision_id", "memory_id").distinct()
    lacking = claimed.join(events, ["decision_id", "memory_id"], "left_anti").withColumn("problem", F.lit("UNRECORDED"))
    extra = events.join(claimed, ["decision_id", "memory_id"], "left_anti").withColumn("problem", F.lit("UNCLAIMED"))
    return lacking.unionByName(extra)


def lineage(chain: DataFrame) -> DataFrame:
    """memory_id and successor_id from the predecessors' chains."""
    return chain.where("event_type = 'SUPERSEDED_BY'").select("memory_id", F.get_json_object("payload_json", "$.successor_memory_id").alias("successor_id"))


def descent(chain: DataFrame) -> DataFrame:
    """memory_id, decision_id and declarant of memories that declare descent from a decision."""
    return chain.where("seq = 0").select("memory_id", F.get_json_object("payload_json", "$.derived_from_decision").alias("decision_id"), F.col("actor_id").alias("declarant")).where("decision_id IS NOT NULL")


def _declared(descent: DataFrame, used: DataFrame) -> DataFrame:
    """descent with level: attested if the same actor made the decision and the memory."""
    made_by = used.select("decision_id", "actor_id").distinct()
    return descent.join(made_by, "decision_id", "left").withColumn("level", F.when(F.col("declarant") == F.col("actor_id"), "DERIVED").otherwise("DERIVED_UNATTESTED"))


def impact(memory_id: str, served: DataFrame, used: DataFrame, lineage: DataFrame, descent: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything that the memory reached: edges (level, kind, src, dst), and memories (id, level).

    A fixpoint over three relations: successors, decisions that used what was derived, and
    memories that declare descent from such decisions. Successions are followed to their ends in every round, by
    doubling, so there are as many rounds as decisions rest on one another. The edges follow
    from what is reached. So do the levels, but for memories that are reached both as successors
    and by unattested descent: they are derived as well only if the succession came first, which is counted step by step.
    """
    spark = served.sparkSession
    start = spark.range(1).select(F.lit(memory_id).alias("id"))
    direct_receipts = served.where(F.col("memory_id") == memory_id).select(F.col("receipt_sha256").alias("dst")).distinct()
    direct_decisions = used.where(F.col("memory_id") == memory_id).select(F.col("decision_id").alias("dst")).distinct()

    def edge(rows: DataFrame, level, kind: str, src, dst) -> DataFrame:
        return rows.select((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))

    declared = settled(_declared(descent, used))
    successors = Successions(lineage.select(F.col("memory_id").alias("child"), F.col("successor_id").alias("parent")))
    decisions = fresh_decisions = settled(direct_decisions.select(F.col("dst").alias("id")))
    reached, frontier = start.limit(0), start
    while True:
        fresh = settled(successors.closure(frontier, reached).join(reached, "id", "left_anti"))
        reached = reached.unionByName(fresh)
        uses = fresh.where(F.col("id") != memory_id).join(used, F.col("id") == F.col("memory_id")).select(F.col("decision_id").alias("id")).distinct()
        grown = settled(uses.join(decisions, "id", "left_anti"))
        decisions, fresh_decisions = decisions.unionByName(grown), fresh_decisions.unionByName(grown)
        born = fresh_decisions.join(declared, F.col("id") == F.col("decision_id")).select(F.col("memory_id").alias("id")).distinct()
        frontier = settled(born.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            break
        fresh_decisions = decisions.limit(0)
    reached, decisions = settled(reached.distinct()), settled(decisions.distinct())
    after = reached.join(lineage, F.col("id") == F.col("memory_id")).select(F.col("id").alias("src"), F.col("successor_id").alias("dst"))
    uses = reached.where(F.col("id") != memory_id).join(used, F.col("id") == F.col("memory_id")).select(F.col("id").alias("src"), F.col("decision_id").alias("dst"))
    born = settled(decisions.join(declared, F.col("id") == F.col("decision_id")).select(F.col("id").alias("src"), F.col("memory_id").alias("dst"), "level").distinct())
    edges = edge(direct_receipts, "DIRECT", "SERVED_BY", F.lit(memory_id), F.col("dst")).unionByName(edge(direct_decisions, "DIRECT", "USED_BY", F.lit(memory_id), F.col("dst")))
    edges = edges.unionByName(edge(after, "DERIVED", "SUPERSEDED_BY", F.col("src"), F.col("dst"))).unionByName(edge(uses, "DERIVED", "USED_BY", F.col("src"), F.col("dst")))
    edges = edges.unionByName(edge(born, F.col("level"), "DERIVED_FROM_DECISION", F.col("src"), F.col("dst")))
    by_descent = born.select(F.col("dst").alias("id"), "level").where(F.col("id") != memory_id).distinct()
    by_lineage = after.select(F.col("dst").alias("id")).where(F.col("id") != memory_id).distinct()
    unsure = by_descent.groupBy("id").agg(F.max("level").alias("most"), F.count("*").alias("n")).where("n = 1 AND most = 'DERIVED_UNATTESTED'").join(by_lineage, "id", "left_semi")
    if unsure.isEmpty():
        memories = by_descent.unionByName(by_lineage.withColumn("level", F.lit("DERIVED"))).distinct()
    else:
        memories = _levels_in_steps(memory_id, used, lineage, declared, decisions.sparkSession)
    with_it = direct_receipts.join(served, F.col("dst") == F.col("receipt_sha256")).where(F.col("memory_id") != memory_id)
    near = links.where((F.col("link_type") == "RESONANT") & (F.col("from_id") == memory_id) & (F.col("to_id") != memory_id))
    possible = edge(with_it, "POSSIBLE", "CO_SERVED", F.lit(memory_id), F.col("memory_id")).unionByName(edge(near, "POSSIBLE", "RESONANT_NEIGHBOUR", F.lit(memory_id), F.col("to_id")))
    return edges.distinct().unionByName(possible.distinct()), memories


def _levels_in_steps(memory_id: str, used: DataFrame, lineage: DataFrame, declared: DataFrame, spark: SparkSession) -> DataFrame:
    """id and level of what is reached, each relation followed one step a round, in their order: what an
    earlier one adds decides how a later one lists it. A memory can be derived and unattested at once."""
    none = spark.createDataFrame([], "id string, level string")
    memories = none
    decisions = fresh_decisions = used.where(F.col("memory_id") == memory_id).select(F.col("decision_id").alias("id")).distinct()
    for_lineage = spark.range(1).select(F.lit(memory_id).alias("id"))  # what each relation has not yet followed
    for_uses = none.select("id")
    while True:
        after = for_lineage.join(lineage, F.col("id") == F.col("memory_id")).select(F.col("successor_id").alias("id"), F.lit("DERIVED").alias("level"))
        by_lineage = settled(after.where(F.col("id") != memory_id).join(memories.select("id"), "id", "left_anti").distinct())
        memories = memories.unionByName(by_lineage)
        for_uses = for_uses.unionByName(by_lineage.select("id"))
        uses = for_uses.join(used, F.col("id") == F.col("memory_id")).select(F.col("decision_id").alias("id")).distinct()
        grown = settled(uses.join(decisions, "id", "left_anti"))
        decisions, fresh_decisions = decisions.unionByName(grown), fresh_decisions.unionByName(grown)
        born = fresh_decisions.join(declared, F.col("id") == F.col("decision_id")).select(F.col("memory_id").alias("id"), "level")
        by_descent = settled(born.where(F.col("id") != memory_id).join(memories, ["id", "level"], "left_anti").distinct())
        memories = memories.unionByName(by_descent)
        for_uses = by_descent.select("id").distinct()
        for_lineage = by_lineage.select("id").unionByName(for_uses).distinct()
        fresh_decisions = none.select("id")
        if for_lineage.isEmpty():
            return memories


#: Log of the entries that a reach sketch keeps: counts up to so many are exact, larger ones off by about one part in the root of it.
SKETCH_ENTRIES_LOG = 12


def reach_counts(used: DataFrame, lineage: DataFrame, descent: DataFrame, entries_log: int = SKETCH_ENTRIES_LOG) -> DataFrame:
    """memory_id, derived_memories and derived_decisions: how much each memory has reached, for all of them at once.

    A memory's reach is the union of its direct successors, uses and descendants and of what they
    reach, so the sets are carried as theta sketches, of bounded size and merged in any order, and a round merges only
    what has changed. There are as many rounds as the longest way. Counts up to 2**entries_log are
    exact; the edges of the memories worth asking for are those of ``impact``. A memory that reaches itself, over forged cycles, counts itself.
    """
    def named(kind: str, c: Column) -> Column:
        return F.concat(F.lit(kind), c)

    edges = lineage.select(named("m:", F.col("memory_id")).alias("src"), named("m:", F.col("successor_id")).alias("dst"))
    edges = edges.unionByName(used.select(named("m:", F.col("memory_id")).alias("src"), named("d:", F.col("decision_id")).alias("dst")))
    edges = settled(edges.unionByName(descent.select(named("d:", F.col("decision_id")).alias("src"), named("m:", F.col("memory_id")).alias("dst"))).distinct())
    log = F.lit(entries_log)

    def counted(rows: DataFrame) -> DataFrame:
        """With how much each sketch holds; whether it has grown shows in the count, and in the sketch where that is estimated."""
        return rows.withColumns({f"n_{k}": F.coalesce(F.theta_sketch_estimate(f"s_{k}"), F.lit(0)) for k in "md"})

    own = edges.groupBy("src").agg(*[F.theta_sketch_agg(F.when(F.col("dst").startswith(f"{k}:"), F.col("dst")), log).alias(f"s_{k}") for k in "md"])
    state = changed = settled(counted(own))
    while True:
        # what a node has gained goes to those that lead to it; the merge is added up before it is shuffled
        news = edges.join(changed.select(F.col("src").alias("dst"), "s_m", "s_d"), "dst").groupBy("src").agg(*[F.theta_union_agg(f"s_{k}", log).alias(f"a_{k}") for k in "md"])
        both = state.join(news, "src")
        merged = counted(both.select("src", F.theta_union("s_m", "a_m", log).alias("s_m"), F.theta_union("s_d", "a_d", log).alias("s_d"), F.struct("n_m", "n_d", "s_m", "s_d").alias("_was")))
        large = 1 << entries_log
        grown = (F.col("n_m") != F.col("_was.n_m")) | (F.col("n_d") != F.col("_was.n_d")) | ((F.col("n_m") > large) & (F.col("s_m") != F.col("_was.s_m"))) | ((F.col("n_d") > large) & (F.col("s_d") != F.col("_was.s_d")))
        changed = settled(merged.where(grown).drop("_was"))
        if changed.isEmpty():
            break
        state = settled(state.join(changed.select("src"), "src", "left_anti").unionByName(changed))
    mine = state.where(F.col("src").startswith("m:"))
    return mine.select(F.expr("substring(src, 3)").alias("memory_id"), F.col("n_m").cast("long").alias("derived_memories"), F.col("n_d").cast("long").alias("derived_decisions"))


def impact_report(memory_id: str, edges: DataFrame, memories: DataFrame) -> dict:
    """The sealed report of one memory; its edges are what one incident touches."""
    rows = sorted(tuple(r) for r in edges.distinct().collect())
    reached = {tuple(r) for r in memories.select("id", "level").collect()}

    def dst(level: str, *kinds: str) -> set[str]:
        return {d for lv, k, _, d in rows if lv == level and k in kinds}

    derived, unattested = ({m for m, lv in reached if lv == level} for level in ("DERIVED", "DERIVED_UNATTESTED"))
    possible = dst("POSSIBLE", "CO_SERVED", "RESONANT_NEIGHBOUR") - derived - unattested - {memory_id}
    body = {
        "memory_id": memory_id, "taint_protocol": PROTOCOLS["taint_protocol"],
        "direct_receipts": sorted(dst("DIRECT", "SERVED_BY")), "direct_decisions": sorted(dst("DIRECT", "USED_BY")),
        "derived_memories": sorted(derived), "derived_unattested": sorted(unattested),
        "derived_decisions": sorted(dst("DIRECT", "USED_BY") | dst("DERIVED", "USED_BY")),
        "possible_memories": sorted(possible), "edges": [list(r) for r in rows],
    }
    return body | {"impact_sha256": seal(body)}
