"""Taint sweeps: what an actor influenced, the seal over it, and its re-derivation."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import json_text, seal
from ..schema import NON_INFLUENCE
from .chains import streamed


def influence(chain: DataFrame) -> DataFrame:
    """The events by which an actor influences a memory: all but naming a contradiction or a use."""
    return chain.where(~F.col("event_type").isin(*NON_INFLUENCE))


def flagged_by(chain: DataFrame, actor: str) -> DataFrame:
    """The memories that a sweep of the actor flags."""
    return influence(chain).where(F.col("actor_id") == actor).select("memory_id").distinct()


def influenced(chain: DataFrame) -> DataFrame:
    """actor_id and memory_id for all actors at once."""
    return influence(chain).select("actor_id", "memory_id").distinct()


def ids_seals(marks: DataFrame, key: str) -> DataFrame:
    """key, flagged_count and flagged_ids_sha256: the seal over each key's distinct memory ids in order, as a stream."""

    def fold(_: str, texts: Iterable[str], state: object) -> object:
        seen = state or sha256(b'{"memory_ids":[')
        joined = ",".join(texts)
        seen.update((("," if state else "") + joined).encode())
        return seen

    def finish(name: str, seen: object, n: int) -> tuple:
        seen.update(b"]}")
        return name, n, seen.hexdigest()

    rows = marks.select(key, "memory_id").distinct().select(key, "memory_id", json_text("memory_id").alias("text"))
    return streamed(rows, key, ["memory_id"], fold, finish, f"{key} string, flagged_count int, flagged_ids_sha256 string")


def ids_seal_of(ids: list[str]) -> str:
    return seal({"memory_ids": ids})


def sweep_seals(chain: DataFrame) -> DataFrame:
    """sweep_id, flagged_count and flagged_ids_sha256, from the TAINT_FLAGGED events."""
    marks = chain.where("event_type = 'TAINT_FLAGGED'").select(F.get_json_object("payload_json", "$.sweep_id").alias("sweep_id"), "memory_id").where("sweep_id IS NOT NULL")
    return ids_seals(marks, "sweep_id")


def verify_sweeps(sweeps: DataFrame, chain: DataFrame) -> DataFrame:
    """sweep_id and error of the sweeps whose count or seal does not recompute."""
    found = sweep_seals(chain).select("sweep_id", F.col("flagged_count").alias("n"), F.col("flagged_ids_sha256").alias("sha"))
    none = ids_seal_of([])
    both = sweeps.join(found, "sweep_id", "left").select("sweep_id", "flagged_count", "flagged_ids_sha256", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sha", F.lit(none)).alias("sha"))
    error = F.when(F.col("flagged_count") != F.col("n"), "count").when(F.col("flagged_ids_sha256") != F.col("sha"), "seal")
    return both.select("sweep_id", error.alias("error")).where("error IS NOT NULL")


def resonant_neighbours(links: DataFrame, flagged: DataFrame) -> DataFrame:
    """Memories one resonant link away from a flagged one and not flagged themselves."""
    out = links.where("link_type = 'RESONANT'").join(flagged.select(F.col("memory_id").alias("from_id")), "from_id", "left_semi")
    return out.select(F.col("to_id").alias("memory_id")).distinct().join(flagged, "memory_id", "left_anti")


def rederived(sweeps: DataFrame, chain: DataFrame) -> DataFrame:
    """sweep_id, memory_id and problem: MISSED if the actor influenced the memory by then and it is
    not flagged, STRAY if it is flagged without that.

    The bound on time rides on an equality join on the actor, so it is no range join.
    """
    events = influence(chain).select("memory_id", "actor_id", F.col("created_at").alias("at"))
    due = sweeps.select("sweep_id", F.col("quarantined_actor").alias("actor_id"), F.col("created_at").alias("swept_at")).join(events, "actor_id").where("at <= swept_at").select("sweep_id", "memory_id").distinct()
    marks = chain.where("event_type = 'TAINT_FLAGGED'").select(F.get_json_object("payload_json", "$.sweep_id").alias("sweep_id"), "memory_id").distinct()
    marks = marks.join(sweeps.select("sweep_id"), "sweep_id", "left_semi")
    missed = due.join(marks, ["sweep_id", "memory_id"], "left_anti").withColumn("problem", F.lit("MISSED"))
    stray = marks.join(due, ["sweep_id", "memory_id"], "left_anti").withColumn("problem", F.lit("STRAY"))
    return missed.unionByName(stray)
