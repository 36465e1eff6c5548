"""Bounded influence over resonant links, and closures over issuers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import seal
from ..schema import EXPOSURE_DEPTH, PROTOCOLS


def exposure(links: DataFrame, sources: DataFrame, depth: int = EXPOSURE_DEPTH) -> DataFrame:
    """memory_id and depth of what the sources reach over resonant links, sources left out.

    Each link passes on half, so the greatest influence is that of the shortest path and the
    floor of 1/64 is a depth of 6: six joins, each kept for the next and following only what no
    earlier one has reached.
    """
    edges = links.where("link_type = 'RESONANT'").select("from_id", "to_id")
    frontier = reached = settled(sources.select("memory_id", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("memory_id") == F.col("from_id")).select(F.col("to_id").alias("memory_id")).distinct()
        frontier = settled(step.join(reached.select("memory_id"), "memory_id", "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached.where("depth > 0")


def graded(memories: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """memory_id, level (DIRECT_TAINT, EXPOSED or CLEAN) and budget as a fraction in lowest terms."""
    found = exposure(links, sources).select("memory_id", F.concat(F.lit("1/"), F.expr("CAST(shiftleft(1, depth) AS STRING)")).alias("budget"))
    marked = memories.select("memory_id").join(sources.select("memory_id", F.lit(True).alias("direct")).distinct(), "memory_id", "left").join(found, "memory_id", "left")
    level = F.when(F.col("direct"), "DIRECT_TAINT").when(F.col("budget").isNotNull(), "EXPOSED").otherwise("CLEAN")
    return marked.select("memory_id", level.alias("level"), F.when(level == "EXPOSED", F.col("budget")).alias("budget"))


def tainted(states: DataFrame) -> DataFrame:
    """The default sources: what is flagged or quarantined."""
    return states.where(F.col("custody_status").isin("TAINT_FLAGGED", "QUARANTINED")).select("memory_id")


def exposure_report(grades: DataFrame) -> dict:
    """The sealed report; it lists every memory, so it is for fields that one report can hold."""
    rows = sorted(tuple(r) for r in grades.collect())
    direct = [m for m, level, _ in rows if level == "DIRECT_TAINT"]
    body = {
        "taint_protocol": PROTOCOLS["taint_protocol"], "sources": direct, "direct_taint": direct,
        "exposed": [[m, b] for m, level, b in rows if level == "EXPOSED"], "clean": [m for m, level, _ in rows if level == "CLEAN"],
        "transfer": "1/2", "floor": f"1/{2**EXPOSURE_DEPTH}", "max_depth": EXPOSURE_DEPTH,
    }
    return body | {"exposure_sha256": seal(body)}


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once: checkpointed where a folder is set, else kept by Spark."""
    if rows.sparkSession.sparkContext.getCheckpointDir() is not None:
        return rows.checkpoint(eager=True)
    kept = rows.persist()
    kept.count()
    return kept


class Successions:
    """A relation (child, parent) that is followed from any number of ids at once.

    Where a child has one parent, as in a succession, pointers are doubled: after j joins they
    lead 2**j steps on, so a succession of length L takes log L joins, not L. Where a child
    has several parents, a round follows each of them a step. The doubled pointers are kept for later rounds.
    """

    def __init__(self, edges: DataFrame) -> None:
        per = settled(edges.select("child", "parent").distinct())
        counted = per.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
        self.jumps = [settled(counted.where("n = 1").select("child", "parent"))]
        self.many = settled(per.join(counted.where("n > 1").select("child"), "child", "left_semi"))
        self.branches = not self.many.isEmpty()

    def jump(self, j: int) -> DataFrame:
        """From each child, where 2**j single steps lead."""
        while len(self.jumps) <= j:
            last = self.jumps[-1]
            further = last.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
            self.jumps.append(settled(last.join(further, "parent").select("child", F.col("next").alias("parent"))))
        return self.jumps[j]

    def along(self, ids: DataFrame, known: DataFrame) -> DataFrame:
        """ids, and what single steps lead to from them that is not among the known."""
        reached, j = ids, 0
        while True:
            step = reached.join(self.jump(j), F.col("id") == F.col("child")).select(F.col("parent").alias("id")).distinct()
            # nothing new so many steps on: what lies further has been reached by another way
            new = settled(step.join(reached, "id", "left_anti").join(known, "id", "left_anti"))
            if new.isEmpty():
                return reached
            reached, j = settled(reached.unionByName(new)), j + 1

    def closure(self, seeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """id: the seeds and all that they lead to, but for what is known together with all that it leads to."""
        reached = seeds.select("id").limit(0)
        known = reached if known is None else known
        frontier = settled(seeds.select("id").distinct())
        while True:
            chain = self.along(frontier, known.unionByName(reached))
            reached = reached.unionByName(chain)
            if not self.branches:
                return reached
            step = chain.join(self.many, F.col("id") == F.col("child")).select(F.col("parent").alias("id")).distinct()
            frontier = settled(step.join(reached, "id", "left_anti").join(known, "id", "left_anti"))
            if frontier.isEmpty():
                return reached


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id: the seeds and all that they lead to over (child, parent) edges, until nothing is new."""
    return Successions(edges).closure(seeds)
