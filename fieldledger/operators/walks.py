"""The ordered walk over links as joins, from any number of seeds at once.

Level by level, and in id order within a level: a node that an earlier one of its own level
inhibits is skipped, and so are its links. Which nodes of a level are visited is thus the greedy choice over
(level, id), and it is found in rounds: a node that no undecided smaller node inhibits is visited,
and what it inhibits is skipped. Only nodes with such a link inside their level take part in rounds, of which
there are as many as inhibitions follow one another in id order; all others are decided at once.

A hub with more than one in HUBS of all links is spread: its links carry a number below its spread,
and its row in a frontier is repeated for each, so no task holds all links of a node. There are
fewer than HUBS hubs, whatever the data; that list is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_HOPS, MAX_HOPS
from .graph import settled

#: A from_id with more than one in so many links is a hub, but for at least so many links.
HUBS, HUB_LINKS = 10_000, 10_000


def spread_links(links: DataFrame, hubs: int = HUBS, least: int = HUB_LINKS) -> tuple[DataFrame, DataFrame]:
    """links with _part, and the hubs with _parts, how many parts each has."""
    degrees = settled(links.groupBy("from_id").agg(F.count("*").alias("_n")))
    most = max(least, (degrees.agg(F.sum("_n").alias("n")).first()["n"] or 0) // hubs)
    found = degrees.where(F.col("_n") > most).select("from_id", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    spread = links.join(F.broadcast(found), "from_id", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("to_id"), F.col("_parts")), F.lit(0)).cast("int"))
    return spread.drop("_parts"), found


def _out(frontier: DataFrame, spread: DataFrame, hubs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The links that leave a frontier, with their walk."""
    parted = frontier.withColumnRenamed("memory_id", "from_id").join(F.broadcast(hubs), "from_id", "left")
    parted = parted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return parted.join(spread, ["from_id", "_part", *keys]).drop("_part")


def skipped_in_level(frontier: DataFrame, out: DataFrame) -> DataFrame:
    """walk and memory_id of the nodes of one level that an earlier, visited one of it inhibits."""
    here = frontier.select("walk", F.col("memory_id").alias("to_id"))
    edges = settled(out.where("link_type = 'INHIBITORY' AND from_id < to_id").select("walk", "from_id", "to_id").distinct().join(here, ["walk", "to_id"], "left_semi"))
    skipped = edges.select("walk", F.col("to_id").alias("memory_id")).limit(0)
    while not edges.isEmpty():
        waiting = edges.select("walk", F.col("to_id").alias("from_id")).distinct()
        # what nothing undecided inhibits is visited, and decides what it inhibits
        done = settled(edges.join(waiting, ["walk", "from_id"], "left_anti").select("walk", F.col("to_id").alias("memory_id")).distinct())
        skipped = skipped.unionByName(done)
        gone_to, gone_from = done.withColumnRenamed("memory_id", "to_id"), done.withColumnRenamed("memory_id", "from_id")
        edges = settled(edges.join(gone_to, ["walk", "to_id"], "left_anti").join(gone_from, ["walk", "from_id"], "left_anti"))
    return skipped


def walks(links: DataFrame, seeds: DataFrame, hops: int = DEFAULT_HOPS, keys: Sequence[str] = (), hub_links: int = HUB_LINKS) -> DataFrame:
    """walk, memory_id, hop (-1: touched but not visited), resonant (how many links of visited nodes
    resonate with it) and inhibited (by one of them; a seed never is).

    seeds has walk and memory_id, one row a walk. keys are columns of seeds and links that a link
    must share with the walk that follows it, such as a world. Empty tables give no rows.
    """
    spread, hubs = spread_links(links, least=hub_links)
    frontier = settled(seeds.select("walk", *keys, "memory_id"))
    named = ["walk", *keys, "memory_id"]
    visited = touched = None
    for depth in range(min(hops, MAX_HOPS) + 1):
        out = settled(_out(frontier, spread, hubs, keys))
        skipped = skipped_in_level(frontier, out)
        now = frontier.join(skipped, ["walk", "memory_id"], "left_anti").withColumn("hop", F.lit(depth))
        kept = out.join(skipped.withColumnRenamed("memory_id", "from_id"), ["walk", "from_id"], "left_anti")
        kind = F.col("link_type")
        met = settled(
            kept.groupBy("walk", *keys, F.col("to_id").alias("memory_id")).agg(
                F.count_if(kind == "RESONANT").cast("int").alias("resonant"), F.bool_or(kind == "INHIBITORY").alias("inhibited"), F.bool_or(kind != "INHIBITORY").alias("ahead"),
            )
        )
        visited, touched = (now, met) if visited is None else (visited.unionByName(now), touched.unionByName(met))
        if depth == min(hops, MAX_HOPS):
            break
        closed = visited.select("walk", "memory_id").unionByName(touched.where("inhibited").select("walk", "memory_id"))
        frontier = settled(met.where("ahead").select(*named).join(closed, ["walk", "memory_id"], "left_anti"))
        if frontier.isEmpty():
            break
    none, no = F.lit(None).cast("int"), F.lit(False)
    both = visited.select("walk", "memory_id", "hop", F.lit(0).alias("resonant"), no.alias("inhibited")).unionByName(touched.select("walk", "memory_id", none.alias("hop"), "resonant", "inhibited"))
    marks = both.groupBy("walk", "memory_id").agg(F.coalesce(F.min("hop"), F.lit(-1)).alias("hop"), F.sum("resonant").cast("int").alias("resonant"), F.bool_or("inhibited").alias("inhibited"))
    return marks.withColumn("inhibited", F.col("inhibited") & (F.col("hop") != 0))


def walk(links: DataFrame, seed: str, hops: int = DEFAULT_HOPS) -> DataFrame:
    """memory_id, hop, resonant and inhibited of the walk from one seed."""
    seeds = links.sparkSession.range(1).select(F.lit(0).alias("walk"), F.lit(seed).alias("memory_id"))
    return settled(walks(links, seeds, hops).drop("walk"))
