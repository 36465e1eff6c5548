"""Queries over authority chains, decisions and their consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embedding import FINE, WIDTH, embedded_texts
from ..functions.limits import cut_text
from ..operators import causality, replay
from . import views as v

# --- authority chains: a customer's orders, in time, are the events on its chain ------------

ACTS_SQL = """
ordered AS (
  SELECT o_orderkey AS k, 'c-' || lpad(o_custkey::VARCHAR, 6, '0') AS subject_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq
  FROM orders
),
led AS (
  SELECT *, CASE WHEN seq = 0 THEN 'ACTOR_REGISTERED' WHEN (k // 8) % 4 = 0 THEN 'GRANTED' WHEN (k // 8) % 4 = 1 THEN 'REVOKED' WHEN (k // 8) % 4 = 2 THEN 'ACTOR_QUARANTINED' ELSE 'ACTOR_REINSTATED' END AS event_type
  FROM ordered
),
marks AS (
  SELECT *, lag(event_type) OVER w AS last_type, lead(event_type) OVER w AS next_type, lead(created_at) OVER w AS next_at
  FROM led WHERE event_type IN ('ACTOR_QUARANTINED', 'ACTOR_REINSTATED') WINDOW w AS (PARTITION BY subject_id ORDER BY seq)
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    turn = F.floor(key / 8) % 4
    kind = F.when(F.col("seq") == 0, "ACTOR_REGISTERED").when(turn == 0, "GRANTED").when(turn == 1, "REVOKED").when(turn == 2, "ACTOR_QUARANTINED").otherwise("ACTOR_REINSTATED")
    rows = v.read(spark, sf_dir, "orders").withColumn("seq", seq.cast("int")).withColumn("event_type", kind)
    grant = F.concat(F.lit('"grant_id":"g-'), (key % 64).cast("string"), F.lit('"'))
    payload = F.when(F.col("event_type") == "GRANTED", F.concat(F.lit('{"capabilities":["STORE"],'), grant, F.lit(',"root":false}'))).when(F.col("event_type") == "REVOKED", F.concat(F.lit("{"), grant, F.lit("}"))).otherwise("{}")
    return rows.select(v.ident("c-", F.col("o_custkey")).alias("subject_id"), "seq", "event_type", F.lit("root").alias("issuer_id"), v.instant(F.col("o_orderdate")).alias("created_at"), payload.alias("payload_json"))


def authority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-authority: every subject's status and grants."""
    return replay.authority_states(ledger(spark, sf_dir)).select("subject_id", "status", "registered_at", F.col("n_grants").cast("long").alias("n_grants"))


STATUS_SQL = f"""WITH {ACTS_SQL}
SELECT subject_id, CASE WHEN arg_max(event_type, seq) FILTER (WHERE event_type IN ('ACTOR_QUARANTINED', 'ACTOR_REINSTATED')) = 'ACTOR_QUARANTINED' THEN 'QUARANTINED' ELSE 'ACTIVE' END AS status,
  max(created_at) FILTER (WHERE seq = 0) AS registered_at, count(DISTINCT k % 64) FILTER (WHERE event_type = 'GRANTED') AS n_grants
FROM led GROUP BY subject_id"""


def quarantine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-qint: half-open windows from a quarantine to the reinstatement that follows it."""
    return replay.quarantine_windows(ledger(spark, sf_dir))


WINDOWS_SQL = f"""WITH {ACTS_SQL}
SELECT subject_id, created_at AS from_at, CASE WHEN next_type = 'ACTOR_REINSTATED' THEN next_at END AS to_at FROM marks WHERE event_type = 'ACTOR_QUARANTINED'"""


def authority_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-authority's errors: reused and unknown grants, quarantines of the quarantined, and the like."""
    return replay.authority_errors(ledger(spark, sf_dir))


AUTH_ERRORS_SQL = f"""WITH {ACTS_SQL},
made AS (SELECT subject_id, k % 64 AS g, seq, row_number() OVER (PARTITION BY subject_id, k % 64 ORDER BY seq) AS nth FROM led WHERE event_type = 'GRANTED'),
ended AS (SELECT subject_id, k % 64 AS g, seq, row_number() OVER (PARTITION BY subject_id, k % 64 ORDER BY seq) AS nth FROM led WHERE event_type = 'REVOKED')
SELECT subject_id, seq, 'grant_reused' AS error FROM made WHERE nth > 1
UNION ALL SELECT e.subject_id, e.seq, CASE WHEN m.seq IS NULL OR m.seq > e.seq THEN 'revoked_unknown' ELSE 'revoked_twice' END
  FROM ended AS e LEFT JOIN made AS m ON m.subject_id = e.subject_id AND m.g = e.g AND m.nth = 1 WHERE m.seq IS NULL OR m.seq > e.seq OR e.nth > 1
UNION ALL SELECT subject_id, seq, CASE event_type WHEN 'ACTOR_QUARANTINED' THEN 'quarantined_from' ELSE 'reinstated_from' END
  FROM marks WHERE event_type = coalesce(last_type, 'ACTOR_REINSTATED')"""

# --- decisions: decision j rests on recall j, which served three memories --------------------

CAUSES_SQL = """
n AS (SELECT count(*) AS n, count(*) // 2 AS half FROM embeddings),
ids AS (SELECT vec_id AS j FROM embeddings, n WHERE vec_id < half),
served AS (SELECT j, unnest([j, (3 * j + 1) % n, (5 * j + 2) % n]) AS m FROM ids, n),
used AS (SELECT j, j AS m FROM ids UNION SELECT j, (3 * j + 1) % n FROM ids, n UNION SELECT j, (9 * j + 4) % n FROM ids, n WHERE j % 6 = 0),
succ AS (SELECT vec_id AS m, vec_id + 17 AS s FROM embeddings, n WHERE vec_id % 5 = 0 AND vec_id + 17 < n),
born AS (SELECT vec_id AS m, vec_id * 7 % half AS j, vec_id % 3 = (vec_id * 7 % half) % 3 AS attested FROM embeddings, n WHERE vec_id % 4 = 1)"""


def causes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ids = v.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"))
    n = ids.count()
    half = n // 2
    j = F.col("j")
    some = ids.where(j < half)
    m = lambda c: v.ident("m-", c)
    decision, actor = F.concat(F.lit("d-"), j.cast("string")), F.concat(F.lit("a-"), (j % 3).cast("string"))
    uses = F.array_distinct(F.when(j % 6 == 0, F.array(j, (3 * j + 1) % n, (9 * j + 4) % n)).otherwise(F.array(j, (3 * j + 1) % n)))
    by = j * 7 % half
    return {
        "served": some.select(F.concat(F.lit("r-"), j.cast("string")).alias("receipt_sha256"), F.explode(F.array(j, (3 * j + 1) % n, (5 * j + 2) % n)).alias("m")).select("receipt_sha256", m(F.col("m")).alias("memory_id")),
        "used": some.select(decision.alias("decision_id"), actor.alias("actor_id"), F.concat(F.lit("r-"), j.cast("string")).alias("receipt_sha256"), F.explode(uses).alias("m")).select("decision_id", "actor_id", "receipt_sha256", m(F.col("m")).alias("memory_id")),
        "lineage": ids.where((j % 5 == 0) & (j + 17 < n)).select(m(j).alias("memory_id"), m(j + 17).alias("successor_id")),
        "descent": ids.where(j % 4 == 1).select(m(j).alias("memory_id"), F.concat(F.lit("d-"), by.cast("string")).alias("decision_id"), F.concat(F.lit("a-"), (j % 3).cast("string")).alias("declarant")),
    }


def stored(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The decisions and receipts as a field stores them, their lists as JSON."""
    def listed(rows: DataFrame, key: str, name: str, *more: str) -> DataFrame:
        per = rows.groupBy(key, *more).agg(F.array_sort(F.collect_set("memory_id")).alias("m"))  # what one recall serves or one decision uses
        return per.select(key, *more, F.concat(F.lit(f'{{"{name}":["'), F.array_join("m", '","'), F.lit('"]}')).alias(f"{name}_json"))

    return listed(parts["used"], "decision_id", "used", "actor_id", "receipt_sha256"), listed(parts["served"], "receipt_sha256", "served")


def decision_subset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-subset, JN-receipt: uses that the cited recall never served, out of the stored lists."""
    decisions, receipts = stored(causes(spark, sf_dir))
    return causality.unserved(decisions, receipts)


SUBSET_SQL = f"WITH {CAUSES_SQL} SELECT 'd-' || j::VARCHAR AS decision_id, 'm-' || lpad(m::VARCHAR, 6, '0') AS memory_id FROM used WHERE NOT EXISTS (SELECT 1 FROM served WHERE served.j = used.j AND served.m = used.m)"


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-impact, JN-descent, FLT-superseded: everything that memory 5 reached, by level and kind."""
    parts = causes(spark, sf_dir)
    edges, _ = causality.impact("m-000005", parts["served"], parts["used"], parts["lineage"], parts["descent"], v.edges(spark, sf_dir))
    return edges


IMPACT_SQL = f"""WITH RECURSIVE {CAUSES_SQL},
reach AS (
  SELECT 'm' AS what, 5::BIGINT AS id
  UNION
  SELECT t.what, t.id FROM reach AS r, LATERAL (
    SELECT 'm' AS what, s::BIGINT AS id FROM succ WHERE r.what = 'm' AND succ.m = r.id
    UNION ALL SELECT 'd', j::BIGINT FROM used WHERE r.what = 'm' AND used.m = r.id
    UNION ALL SELECT 'm', m::BIGINT FROM born WHERE r.what = 'd' AND born.j = r.id
  ) AS t
),
mem AS (SELECT DISTINCT id FROM reach WHERE what = 'm'), dec AS (SELECT DISTINCT id FROM reach WHERE what = 'd'),
e AS (
  SELECT 'DIRECT' AS level, 'SERVED_BY' AS kind, 'm5' AS src, 'r' || j::VARCHAR AS dst FROM served WHERE m = 5
  UNION SELECT 'DIRECT', 'USED_BY', 'm5', 'd' || j::VARCHAR FROM used WHERE m = 5
  UNION SELECT 'DERIVED', 'SUPERSEDED_BY', 'm' || m::VARCHAR, 'm' || s::VARCHAR FROM succ JOIN mem ON m = id
  UNION SELECT 'DERIVED', 'USED_BY', 'm' || m::VARCHAR, 'd' || j::VARCHAR FROM used JOIN mem ON m = id WHERE m <> 5
  UNION SELECT CASE WHEN attested THEN 'DERIVED' ELSE 'DERIVED_UNATTESTED' END, 'DERIVED_FROM_DECISION', 'd' || j::VARCHAR, 'm' || m::VARCHAR FROM born JOIN dec ON j = id
  UNION SELECT 'POSSIBLE', 'CO_SERVED', 'm5', 'm' || b.m::VARCHAR FROM served AS a JOIN served AS b ON a.j = b.j WHERE a.m = 5 AND b.m <> 5
  UNION SELECT 'POSSIBLE', 'RESONANT_NEIGHBOUR', 'm5', 'm' || ((7 * 5 + 3) % n)::VARCHAR FROM n WHERE (7 * 5 + 3) % n <> 5
)
SELECT level, kind, CASE WHEN src[1] = 'm' THEN 'm-' || lpad(src[2:], 6, '0') ELSE src[1] || '-' || src[2:] END AS src, CASE WHEN dst[1] = 'm' THEN 'm-' || lpad(dst[2:], 6, '0') ELSE dst[1] || '-' || dst[2:] END AS dst FROM e"""


def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-impact for all memories: how many memories and decisions each has reached."""
    parts = causes(spark, sf_dir)
    return causality.reach_counts(parts["used"], parts["lineage"], parts["descent"])


COUNTS_SQL = f"""WITH RECURSIVE {CAUSES_SQL},
e AS (SELECT 'm' || m::VARCHAR AS src, 'm' || s::VARCHAR AS dst FROM succ UNION SELECT 'm' || m::VARCHAR, 'd' || j::VARCHAR FROM used UNION SELECT 'd' || j::VARCHAR, 'm' || m::VARCHAR FROM born),
reach AS (SELECT src AS root, dst AS at_ FROM e WHERE src[1] = 'm' UNION SELECT r.root, e.dst FROM reach AS r JOIN e ON e.src = r.at_)
SELECT 'm-' || lpad(root[2:], 6, '0') AS memory_id, count(*) FILTER (WHERE at_[1] = 'm') AS derived_memories, count(*) FILTER (WHERE at_[1] = 'd') AS derived_decisions FROM reach GROUP BY root"""


def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-embedding: the deterministic vector of every document, all 384 components in units of 10**-10."""
    docs = v.read(spark, sf_dir, "documents")
    return docs.select("doc_id", embedded_texts(F.coalesce("text", F.lit(""))).alias("vector"))


EMBED_SQL = f"""WITH heads AS (
  SELECT doc_id, i, ('0x' || substr(sha256(unhex(sha256(coalesce(text, ''))) || unhex(lpad(printf('%x', i), 4, '0'))), 1, 8))::BIGINT AS head FROM documents, range({WIDTH}) AS r(i)
),
scaled AS (SELECT doc_id, i, ((head::DOUBLE / 2147483647.5::DOUBLE - 1.0::DOUBLE) * {FINE}::DOUBLE)::HUGEINT * 10000000000 AS x FROM heads),
split AS (SELECT doc_id, i, (x - ((x % {FINE}) + {FINE}) % {FINE}) // {FINE} AS q, ((x % {FINE}) + {FINE}) % {FINE} AS r FROM scaled)
SELECT doc_id, string_agg((q + CASE WHEN 2 * r > {FINE} OR (2 * r = {FINE} AND q % 2 <> 0) THEN 1 ELSE 0 END)::VARCHAR, ',' ORDER BY i) AS vector FROM split GROUP BY doc_id"""


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a service takes it in, here in at most 2,000 characters."""
    text = cut_text(F.coalesce("text", F.lit("")), 2000)
    return v.read(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"))


CUT_SQL = """SELECT doc_id, length(t) AS length, sha256(t) AS sha256
FROM (SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 2000 THEN substr(text, 1, 1999) || '...' ELSE coalesce(text, '') END AS t FROM documents)"""

QUERIES = {
    "authority_status": (authority_status, STATUS_SQL), "quarantine_windows": (quarantine_windows, WINDOWS_SQL), "authority_errors": (authority_errors, AUTH_ERRORS_SQL),
    "decision_subset_violations": (decision_subset_violations, SUBSET_SQL), "impact_edges": (impact_edges, IMPACT_SQL), "impact_counts": (impact_counts, COUNTS_SQL), "text_embedding": (text_embedding, EMBED_SQL), "cut_texts": (cut_texts, CUT_SQL),
}
