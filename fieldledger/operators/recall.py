"""Exact, custody-gated recall: gate, seed, graph walk, ranking, and the sealed receipt.

memories has memory_id, vec (whole multiples of 10**-10), custody_status and field_state, and
content where hits should carry it; links has from_id, to_id and link_type. No float takes part
in ranking: sort keys are exact integers as bytes, so top-k is Spark's own bounded sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, digest, vector_json
from ..functions.vectors import display_score, dot, exact_key, multiplier
from ..schema import CUSTODY_STATUSES, DEFAULT_HOPS, DEFAULT_TOP_K, PROTOCOLS
from .walks import walk


@dataclass(frozen=True)
class Hit:
    memory_id: str
    content: str | None
    score: Decimal
    hop_distance: int
    field_state: str
    inhibition_rescued: bool
    rank_key: bytes


@dataclass(frozen=True)
class Receipt:
    query_sha256: str
    seed_memory_id: str | None
    served: tuple[str, ...]
    excluded_custody: int
    excluded_forgotten: int
    excluded_inhibited: int
    top_k: int
    hops: int
    custody_override: tuple[tuple[str, str], ...] = ()
    as_of: str | None = None
    ranking_protocol: str = PROTOCOLS["ranking_protocol"]
    receipt_sha256: str = ""

    def body(self) -> dict:
        fields = {k: v for k, v in self.__dict__.items() if k != "receipt_sha256"}
        return fields | {"served": list(self.served), "custody_override": [list(p) for p in self.custody_override]}

    def sealed(self) -> Receipt:
        return replace(self, receipt_sha256=digest(canonical_json(self.body())))


def literal_vector(query: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(x)).cast("bigint") for x in query])


def effective_status(override: dict[str, str]) -> Column:
    """The custody status with the hypothetical ones in place."""
    if not override:
        return F.col("custody_status")
    known = F.create_map(*[F.lit(x) for pair in sorted(override.items()) for x in pair])
    return F.coalesce(known[F.col("memory_id")], F.col("custody_status"))


def gated(memories: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """The servable memories; with no override the filter reaches the scan."""
    return memories.where(effective_status(override or {}) == "CLEAN")


def exclusions(memories: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """One row: excluded_custody and excluded_forgotten."""
    clean = effective_status(override or {}) == "CLEAN"
    return memories.agg(F.count_if(~clean).alias("excluded_custody"), F.count_if(clean & (F.col("field_state") == "FORGOTTEN")).alias("excluded_forgotten"))


def candidates(memories: DataFrame, query: Sequence[int], override: dict[str, str] | None = None) -> DataFrame:
    """The servable, unforgotten memories with d, the inner product, and n, the squared norm, above zero."""
    rows = gated(memories, override).where("field_state <> 'FORGOTTEN'")
    return rows.withColumn("d", dot(F.col("vec"), literal_vector(query))).withColumn("n", dot(F.col("vec"), F.col("vec"))).where("n > 0")


def seed_of(found: DataFrame) -> DataFrame:
    """The nearest candidate; all at or below zero are equal, and ties go to the smaller id."""
    key = exact_key("d", "n", F.lit("NEUTRAL"), F.lit(-1), F.lit(0))
    return found.withColumn("key", key).orderBy(F.desc("key"), "memory_id").limit(1)


def live_links(links: DataFrame, servable: DataFrame) -> DataFrame:
    """The links both of whose ends are servable."""
    ids = servable.select("memory_id")
    return links.join(ids, F.col("from_id") == F.col("memory_id"), "left_semi").join(ids, F.col("to_id") == F.col("memory_id"), "left_semi")


def scored(found: DataFrame, marks: DataFrame) -> DataFrame:
    """found with hop, resonant, rescued and key, without the inhibited that nothing rescues; marks are those of one walk."""
    marks = marks.select("memory_id", "hop", "resonant", "inhibited")
    out = found.join(marks, "memory_id", "left").withColumn("hop", F.coalesce("hop", F.lit(-1))).withColumn("resonant", F.coalesce("resonant", F.lit(0)))
    return ranked_marks(out)


def ranked_marks(rows: DataFrame) -> DataFrame:
    """rows (hop, resonant, inhibited) with rescued and key, without the inhibited that nothing rescues."""
    out = rows.withColumn("rescued", F.coalesce("inhibited", F.lit(False)) & (F.col("field_state") == "REINFORCED"))
    out = out.where(~F.coalesce("inhibited", F.lit(False)) | F.col("rescued")).drop("inhibited")
    return out.withColumn("key", exact_key("d", "n", "field_state", "hop", "resonant"))


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("key"), "memory_id").limit(k)


def recall(
    memories: DataFrame, links: DataFrame, query: Sequence[int], top_k: int = DEFAULT_TOP_K, hops: int = DEFAULT_HOPS,
    override: dict[str, str] | None = None, as_of: str | None = None,
) -> tuple[list[Hit], Receipt]:
    """The hits and the sealed receipt. For as_of, memories and links are already those of the instant."""
    override = override or {}
    if wrong := sorted(set(override.values()) - set(CUSTODY_STATUSES)):
        raise ValueError(f"unknown custody statuses {wrong}")
    n_query = sum(x * x for x in query)
    if not n_query:
        raise ValueError("the query vector is zero")
    unknown = missing(memories, override)
    if unknown:
        raise ValueError(f"the override names unknown memories {unknown}")
    odd = gated(memories, override).where(F.size("vec") != len(query)).select("memory_id", F.size("vec").alias("width")).orderBy("memory_id").head()
    if odd is not None:
        raise ValueError(f"the query has {len(query)} components and {odd['memory_id']} has {odd['width']}")
    counts = exclusions(memories, override).head()
    query_sha = digest(vector_json([Decimal(x).scaleb(-10) for x in query]))
    base = Receipt(query_sha, None, (), counts["excluded_custody"], counts["excluded_forgotten"], 0, top_k, hops, tuple(sorted(override.items())), as_of)
    found = candidates(memories, query, override)
    first = seed_of(found).head()
    if first is None:
        return [], base.sealed()
    seed = first["memory_id"]
    marks = walk(live_links(links, gated(memories, override)), seed, hops)
    rows = scored(found, marks)
    lost = found.where("field_state <> 'REINFORCED'").join(marks.where("inhibited"), "memory_id", "left_semi").count()
    best = top(rows, top_k).select("memory_id", *(["content"] if "content" in rows.columns else []), "d", "n", "hop", "resonant", "field_state", "rescued", "key").collect()
    hits = [
        Hit(r["memory_id"], r["content"] if "content" in r else None, display_score(int(r["d"]), int(r["n"]), n_query, multiplier(r["field_state"], r["hop"], r["resonant"])), r["hop"], r["field_state"], r["rescued"], bytes(r["key"]))
        for r in best
    ]
    return hits, replace(base, seed_memory_id=seed, served=tuple(h.memory_id for h in hits), excluded_inhibited=lost).sealed()


def missing(memories: DataFrame, ids: Iterable[str]) -> list[str]:
    """The ids that name no memory."""
    wanted = sorted(set(ids))
    if not wanted:
        return []
    have = {r["memory_id"] for r in memories.where(F.col("memory_id").isin(wanted)).select("memory_id").collect()}
    return [i for i in wanted if i not in have]


def widening(memories: DataFrame, override: dict[str, str]) -> list[str]:
    """The memories that an override would make servable though the gate does not."""
    opened = sorted(m for m, s in override.items() if s == "CLEAN")
    rows = memories.where(F.col("memory_id").isin(opened) & (F.col("custody_status") != "CLEAN")) if opened else memories.limit(0)
    return sorted(r["memory_id"] for r in rows.select("memory_id").collect())


def receipt_seals(receipts: DataFrame) -> DataFrame:
    """receipt_sha256 and whether it recomputes from the row's own columns, one row per receipt.

    Works on the stored JSON texts, whose lists are already canonical.
    """
    from ..functions.canonical import json_object, json_text

    def text_or_null(c: str) -> Column:
        return F.coalesce(json_text(c), F.lit("null"))

    def inner(c: str, key: str) -> Column:
        return F.regexp_extract(F.col(c), rf'^\{{"{key}":(.*)\}}$', 1)

    body = json_object(
        query_sha256=json_text("query_sha256"), seed_memory_id=text_or_null("seed_memory_id"), served=inner("served_json", "served"),
        excluded_custody=F.col("excluded_custody").cast("string"), excluded_forgotten=F.col("excluded_forgotten").cast("string"), excluded_inhibited=F.col("excluded_inhibited").cast("string"),
        top_k=F.col("top_k").cast("string"), hops=F.col("hops").cast("string"), ranking_protocol=json_text("ranking_protocol"),
        custody_override=inner("custody_override_json", "override"), as_of=text_or_null("as_of"),
    )
    return receipts.select("receipt_sha256", F.coalesce(F.sha2(body, 256) == F.col("receipt_sha256"), F.lit(False)).alias("ok"))
