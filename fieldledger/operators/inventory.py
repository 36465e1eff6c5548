"""Counts, embedding inventory and drift, and Merkle roots over chain heads."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..schema import profile
from .graph import settled
from .sweeps import ranged

PROVENANCE = ("provider", "model", "revision", "preprocessing")


def provenance(path: str) -> Column:
    return F.get_json_object("payload_json", f"$.embedding_provenance.{path}")


def declared(births: DataFrame) -> DataFrame:
    """memory_id and the provenance of each birth, nulls where none is declared."""
    return births.select("memory_id", *[provenance(p).alias(p) for p in (*PROVENANCE, "input_content_hash", "output_vector_hash")])


def embedding_inventory(rows: DataFrame) -> DataFrame:
    """Memories per provenance; those without one are the row with nulls."""
    return rows.groupBy(*PROVENANCE).agg(F.count("*").alias("memories"))


def drift_vectors(rows: DataFrame) -> DataFrame:
    """One row for each vector that an input of a drifting group became: the group, how many vectors it
    has, output_vector_hash, how many memories hold it, and the smallest of them. Drift is one model turning one input into different vectors."""
    known = rows.where("provider IS NOT NULL AND input_content_hash IS NOT NULL")
    per = known.groupBy(*PROVENANCE, "input_content_hash", "output_vector_hash").agg(F.count("*").alias("memories"), F.min("memory_id").alias("first_memory"))
    groups = per.groupBy(*PROVENANCE, "input_content_hash").agg(F.count("*").alias("distinct_vectors")).where("distinct_vectors > 1")
    group = [c for c in (*PROVENANCE, "input_content_hash")]
    own = per.select(*[F.col(c).alias(f"_{c}") for c in group], "output_vector_hash", "memories", "first_memory")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    return groups.join(own, same).select(*group, "distinct_vectors", "output_vector_hash", "memories", "first_memory")


def drift_members(rows: DataFrame) -> DataFrame:
    """memory_id, first_memory and output_vector_hash of every memory in a drifting group: the vectors' members as rows."""
    group = [*PROVENANCE, "input_content_hash", "output_vector_hash"]
    vectors = drift_vectors(rows).select(*[F.col(c).alias(f"_{c}") for c in group], "first_memory")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    # a text that many memories were made of is many rows, never one array
    return rows.where("provider IS NOT NULL AND input_content_hash IS NOT NULL").join(vectors, same).select("memory_id", "first_memory", "output_vector_hash")


def embedding_drift(rows: DataFrame) -> DataFrame:
    """The drifting groups with their vectors and members as arrays; for reports, whose groups one row can hold."""
    known = rows.where("provider IS NOT NULL AND input_content_hash IS NOT NULL")
    per = known.groupBy(*PROVENANCE, "input_content_hash", "output_vector_hash").agg(F.array_sort(F.collect_list("memory_id")).alias("members"))
    groups = per.groupBy(*PROVENANCE, "input_content_hash").agg(F.count("*").alias("distinct_vectors"), F.array_sort(F.collect_list(F.struct("output_vector_hash", "members"))).alias("vectors"))
    return groups.where("distinct_vectors > 1")


def embedding_families(rows: DataFrame) -> DataFrame:
    """One row: how many model families the vectors come from, whether they mix spaces, and how many inputs drift."""
    families = rows.where("model IS NOT NULL").select("provider", "model", "revision").distinct().agg(F.count("*").alias("distinct_families"))
    drift = drift_vectors(rows).select(*PROVENANCE, "input_content_hash").distinct().agg(F.count("*").alias("drifting_inputs"))
    return families.join(drift).select("distinct_families", (F.col("distinct_families") > 1).alias("mixing_vector_spaces"), "drifting_inputs", (F.col("drifting_inputs") > 0).alias("drift_detected"))


def field_info(states: DataFrame, actors: DataFrame) -> DataFrame:
    """kind, name and n: memories and actors in all, and memories per custody status and field state."""
    per = states.groupBy("custody_status", "field_state").agg(F.count("*").alias("n"))
    parts = [per.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("name")).agg(F.sum("n").alias("n")) for kind in ("custody_status", "field_state")]
    totals = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("memories").alias("name"), "n")
    registered = actors.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("actors").alias("name"), "n")
    return totals.unionByName(registered).unionByName(parts[0]).unionByName(parts[1])


def distribution(states: DataFrame, column: str) -> DataFrame:
    return states.groupBy(column).agg(F.count("*").alias("n"))


LEAVES = 4096


def merkle_of(hashes: list[str]) -> str:
    """The root over leaf hashes in order; an odd one out moves up alone."""
    if not hashes:
        return digest(profile().empty_heads)
    while len(hashes) > 1:
        pairs = [digest(a + b) for a, b in zip(hashes[::2], hashes[1::2], strict=False)]
        hashes = pairs + hashes[-1:] * (len(hashes) % 2)
    return hashes[0]


def heads_merkle_of(heads: dict[str, str]) -> str:
    return merkle_of([digest(f"{k}:{heads[k]}") for k in sorted(heads)])


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with place, 0, 1, 2, ... along order, whose values differ.

    A prefix sum in two steps over a written table: rows are numbered inside their range, and
    ranges begin where those before them end. The ranges are written with the rows, so a lost executor cannot move them.
    """
    laid = ranged(rows, [order])
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return laid.withColumn("_i", inside).join(sizes.select("_range", begin.alias("_begin")), "_range").withColumn("place", (F.col("_begin") + F.col("_i")).cast("long")).drop("_range", "_i", "_begin")


def _run_paths(leaves: int):
    """Of an aligned run of leaves: for each, the run's root and the path to it, which are the hashes
    beside the way, L or R for the side they are on. One that moves up alone meets none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        places = frame["place"].tolist()
        level, at, paths = frame["hash"].tolist(), list(range(len(frame))), [[] for _ in range(len(frame))]
        while len(level) > 1:
            for leaf, i in enumerate(at):
                if (i ^ 1) < len(level):
                    paths[leaf].append(("L" if i & 1 else "R") + level[i ^ 1])
                at[leaf] = i >> 1
            level = [digest(a + b) for a, b in zip(level[::2], level[1::2], strict=False)] + level[-1:] * (len(level) % 2)
        return pd.DataFrame({"place": places, "run": [places[0] // leaves] * len(places), "root": level * len(places), "path": paths})

    return run


def _leaves(heads: DataFrame, subject: str) -> DataFrame:
    return numbered(heads.select(F.col(subject).alias("id"), F.sha2(F.concat_ws(":", subject, "entry_hash"), 256).alias("hash")), "id")


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """place, run, root and path, for the leaves and then for the roots of their runs, until one run is left.

    Aligned runs of a power of two leaves are whole subtrees, so each becomes its root on its own.
    """
    levels = []
    while True:
        runs = settled(leaves.groupBy(F.floor(F.col("place") / LEAVES).alias("_run")).applyInPandas(_run_paths(LEAVES), "place long, run long, root string, path array<string>"))
        levels.append(runs)
        leaves = runs.where(F.col("place") % LEAVES == 0).select(F.col("run").alias("place"), F.col("root").alias("hash"))
        if runs.where("run > 0").isEmpty():
            return levels


def merkle_root(heads: DataFrame, subject: str) -> str:
    """The root over (subject, entry_hash), in order of the subject."""
    top = merkle_levels(_leaves(heads, subject).select("place", "hash"))[-1].select("root").head()
    return merkle_of([]) if top is None else top["root"]


def merkle_paths(heads: DataFrame, subject: str) -> DataFrame:
    """id, hash (the leaf), place and path of every head: folded from the leaf on, the path gives the root."""
    leaves = settled(_leaves(heads, subject))
    levels = merkle_levels(leaves.select("place", "hash"))
    # from the top down, a run's own path is put behind those of its members: a run has no more than LEAVES
    above = levels[-1].select("place", "path")
    for level in reversed(levels[:-1]):
        run = above.select(F.col("place").alias("run"), F.col("path").alias("_more"))
        above = level.join(run, "run").select("place", F.concat("path", "_more").alias("path"))
    return leaves.join(above, "place").select("id", "hash", "place", "path")


def on_path(leaf: str, path: list[str], root: str) -> bool:
    """Whether a path leads from a leaf to the root."""
    for step in path:
        leaf = digest(step[1:] + leaf if step[0] == "L" else leaf + step[1:])
    return leaf == root
