"""Two hypothetical worlds, one query, and the exact difference between what they serve."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import seal
from ..functions.vectors import display_score, dot, exact_key, multiplier
from ..schema import DEFAULT_HOPS, DEFAULT_TOP_K
from .graph import settled
from .recall import effective_status, literal_vector, missing, ranked_marks, recall
from .walks import walks


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """change, memory_id, a and b between two served lists with memory_id, rank and score (text).

    REMOVED and ENTERED, RANK_CHANGED, and SCORE_CHANGED where the rank is the same.
    """
    both = a.select("memory_id", F.col("rank").alias("ra"), F.col("score").alias("sa")).join(b.select("memory_id", F.col("rank").alias("rb"), F.col("score").alias("sb")), "memory_id", "full_outer")
    change = F.when(F.col("rb").isNull(), "REMOVED").when(F.col("ra").isNull(), "ENTERED").when(F.col("ra") != F.col("rb"), "RANK_CHANGED").when(F.col("sa") != F.col("sb"), "SCORE_CHANGED")
    ranks = F.col("change") == "RANK_CHANGED"
    scores = F.col("change") == "SCORE_CHANGED"
    out = both.withColumn("change", change).where("change IS NOT NULL")
    return out.select("change", "memory_id", F.when(ranks, F.col("ra").cast("string")).when(scores, F.col("sa")).alias("a"), F.when(ranks, F.col("rb").cast("string")).when(scores, F.col("sb")).alias("b"))


def servable(memories: DataFrame, override: dict[str, str]) -> DataFrame:
    return memories.where(effective_status(override) == "CLEAN").select("memory_id")


def moved(memories: DataFrame, a: dict[str, str], b: dict[str, str]) -> DataFrame:
    """The memories that exactly one of the two worlds serves; one pass, no join."""
    return memories.where((effective_status(a) == "CLEAN") != (effective_status(b) == "CLEAN")).select("memory_id")


def served_in(memories: DataFrame, links: DataFrame, query: Sequence[int], worlds: dict[str, dict[str, str]], top_k: int = DEFAULT_TOP_K, hops: int = DEFAULT_HOPS) -> DataFrame:
    """world, rank (from 0), memory_id, d, n, hop, resonant, rescued, field_state and key: what each world serves.

    worlds names overrides. All worlds are gated, walked and ranked in one plan: products are computed once
    a memory, a walk keeps to the links of its world, and each task keeps no more than the first k a world.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("world"), effective_status(override).alias("status")) for name, override in sorted(worlds.items())]))
    rows = memories.withColumn("d", dot(F.col("vec"), literal_vector(query))).withColumn("n", dot(F.col("vec"), F.col("vec"))).select("memory_id", "field_state", "d", "n", each.alias("_w"))
    clean = settled(rows.where("_w.status = 'CLEAN'").select("_w.world", "memory_id", "field_state", "d", "n"))
    found = clean.where("field_state <> 'FORGOTTEN' AND n > 0")
    first = Window.partitionBy("world").orderBy(F.desc("key"), "memory_id")
    plain = exact_key("d", "n", F.lit("NEUTRAL"), F.lit(-1), F.lit(0))
    seeds = settled(found.withColumn("key", plain).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("world").alias("walk"), "world", "memory_id"))
    ids = clean.select("world", F.col("memory_id").alias("_id"))
    live = links.withColumn("world", F.explode(F.array(*[F.lit(w) for w in sorted(worlds)])))
    for end in ("from_id", "to_id"):
        live = live.join(ids.withColumnRenamed("_id", end), ["world", end], "left_semi")
    marks = walks(live, seeds, hops, ["world"]).withColumnRenamed("walk", "world")
    both = found.join(marks, ["world", "memory_id"], "left").withColumn("hop", F.coalesce("hop", F.lit(-1))).withColumn("resonant", F.coalesce("resonant", F.lit(0)))
    best = ranked_marks(both).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top_k)
    return best.withColumn("rank", (F.col("_r") - 1).cast("int")).select("world", "rank", "memory_id", "d", "n", "hop", "resonant", "rescued", "field_state", "key")


def compared(
    memories: DataFrame, links: DataFrame, births: DataFrame, used: DataFrame, query: Sequence[int], world_a: dict[str, str], world_b: dict[str, str],
    top_k: int = DEFAULT_TOP_K, hops: int = DEFAULT_HOPS,
) -> DataFrame:
    """change, subject, a and b: all that differs between two worlds, as rows.

    Memories are REMOVED, ENTERED, RANK_CHANGED or (at the same rank) SCORE_CHANGED, a topic's
    CLAIM_CHANGED where its best-ranked served memory carries another claim, and a DECISION is named if it used what
    exactly one world serves. births has memory_id, topic and claim, used has decision_id and memory_id.
    """
    served = settled(served_in(memories, links, query, {"a": world_a, "b": world_b}, top_k, hops))
    n_query = sum(x * x for x in query)

    @F.pandas_udf("string")
    def shown(d: pd.Series, n: pd.Series, state: pd.Series, hop: pd.Series, resonant: pd.Series) -> pd.Series:
        return pd.Series([format(display_score(int(x), int(y), n_query, multiplier(s, int(h), int(k))), "f") for x, y, s, h, k in zip(d, n, state, hop, resonant, strict=True)], dtype=object)

    # the first k of each world
    listed = settled(served.withColumn("score", shown("d", "n", "field_state", "hop", "resonant")).select("world", "memory_id", "rank", "score"))
    lists = [listed.where(F.col("world") == w).drop("world") for w in "ab"]
    moves = difference(*lists).withColumnRenamed("memory_id", "subject")
    carried = listed.join(births.where("topic IS NOT NULL AND claim IS NOT NULL").select("memory_id", "topic", "claim"), "memory_id")
    won = carried.groupBy("topic", "world").agg(F.min_by("claim", "rank").alias("claim")).groupBy("topic").agg(*[F.coalesce(F.max(F.when(F.col("world") == w, F.col("claim"))), F.lit("")).alias(w) for w in "ab"])
    claims = won.where("a <> b").select(F.lit("CLAIM_CHANGED").alias("change"), F.col("topic").alias("subject"), "a", "b")
    none = F.lit(None).cast("string")
    touched = used.join(moved(memories, world_a, world_b), "memory_id", "left_semi").select("decision_id").distinct()
    decisions = touched.select(F.lit("DECISION").alias("change"), F.col("decision_id").alias("subject"), none.alias("a"), none.alias("b"))
    return moves.unionByName(claims).unionByName(decisions)


def _winners(births: DataFrame, served: Sequence[str]) -> dict[str, str]:
    """topic to claim, by the best-ranked served memory; births has memory_id, topic and claim."""
    rows = {r["memory_id"]: r for r in births.where(F.col("memory_id").isin(list(served))).select("memory_id", "topic", "claim").collect()} if served else {}
    out: dict[str, str] = {}
    for m in served:
        if m in rows and rows[m]["topic"] is not None and rows[m]["claim"] is not None:
            out.setdefault(rows[m]["topic"], rows[m]["claim"])
    return out


def compare(
    memories: DataFrame, links: DataFrame, births: DataFrame, used: DataFrame, query: Sequence[int],
    world_a: dict[str, str] | None = None, world_b: dict[str, str] | None = None, top_k: int = DEFAULT_TOP_K, hops: int = DEFAULT_HOPS,
) -> dict:
    """The sealed difference. used has decision_id and memory_id."""
    a, b = world_a or {}, world_b or {}
    hits_a, receipt_a = recall(memories, links, query, top_k, hops, a)
    hits_b, receipt_b = recall(memories, links, query, top_k, hops, b)
    at = [{h.memory_id: (i, format(h.score, "f")) for i, h in enumerate(hits)} for hits in (hits_a, hits_b)]
    both = sorted(set(at[0]) & set(at[1]))
    won = [_winners(births, r.served) for r in (receipt_a, receipt_b)]
    touched = used.join(moved(memories, a, b), "memory_id", "left_semi").select("decision_id").distinct()
    body = {
        "query_sha256": receipt_a.query_sha256, "top_k": top_k, "hops": hops, "ranking_protocol": receipt_a.ranking_protocol,
        "world_a_override": [list(p) for p in receipt_a.custody_override], "world_b_override": [list(p) for p in receipt_b.custody_override],
        "served_a": list(receipt_a.served), "served_b": list(receipt_b.served),
        "receipt_a_sha256": receipt_a.receipt_sha256, "receipt_b_sha256": receipt_b.receipt_sha256,
        "removed_from_serving": sorted(set(at[0]) - set(at[1])), "entered_top_k": sorted(set(at[1]) - set(at[0])),
        "rank_changed": [[m, at[0][m][0], at[1][m][0]] for m in both if at[0][m][0] != at[1][m][0]],
        "score_changed": [[m, at[0][m][1], at[1][m][1]] for m in both if at[0][m][0] == at[1][m][0] and at[0][m][1] != at[1][m][1]],
        "claim_outcome_changed": sorted([t, won[0].get(t, ""), won[1].get(t, "")] for t in {*won[0], *won[1]} if won[0].get(t) != won[1].get(t)),
        "decision_dependency_changed": sorted(r["decision_id"] for r in touched.collect()),
    }
    changed = ("removed_from_serving", "entered_top_k", "rank_changed", "score_changed", "claim_outcome_changed")
    body["interference"] = any(body[k] for k in changed)
    return body | {"delta_sha256": seal(body)}


def exclusion(memories: DataFrame, links: DataFrame, births: DataFrame, used: DataFrame, query: Sequence[int], excluded: Sequence[str], **options) -> dict:
    """What would be served without the excluded memories, against what is."""
    _known(memories, excluded)
    return compare(memories, links, births, used, query, None, {m: "QUARANTINED" for m in excluded}, **options)


def containment(memories: DataFrame, links: DataFrame, births: DataFrame, used: DataFrame, query: Sequence[int], contained: Sequence[str], **options) -> dict:
    """What is served, against what would be if the contained memories were still clean."""
    _known(memories, contained)
    return compare(memories, links, births, used, query, {m: "CLEAN" for m in contained}, None, **options)


def _known(memories: DataFrame, ids: Sequence[str]) -> None:
    if not ids:
        raise ValueError("name at least one memory")
    if unknown := missing(memories, ids):
        raise ValueError(f"unknown memories {unknown}")


def summary(delta: dict) -> str:
    """One sentence on a delta."""
    names = {"removed_from_serving": "removed", "entered_top_k": "entered", "rank_changed": "rank moved", "score_changed": "score moved", "claim_outcome_changed": "claims flipped"}
    parts = [f"{label}={len(delta[key])}" for key, label in names.items() if delta[key]]
    tail = f"; decisions whose inputs move: {len(delta['decision_dependency_changed'])}" if delta["decision_dependency_changed"] else ""
    return (f"INTERFERENCE: {', '.join(parts)}" if delta["interference"] else "NON-INTERFERENCE") + tail
