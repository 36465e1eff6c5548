"""A field laid over the driver's tables, in Spark and, with the same arithmetic, in SQL.

memories are embeddings, custody events are events by user, documents are evidence, customers
are actors whose orders grant and revoke, conversations are decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import scaled
from ..schema import OWN, TS_FORMAT


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0"))


def instant(ts: Column) -> Column:
    return F.date_format(ts, TS_FORMAT)


# --- memories and their vectors ------------------------------------------------------------

VEC_SQL = """
vec AS (
  SELECT vec_id, 'm-' || lpad(vec_id::VARCHAR, 6, '0') AS memory_id, label,
    list_transform(embedding, lambda x: round_even(x::DOUBLE * 1e10, 0)::BIGINT) AS vec,
    CASE vec_id % 10 WHEN 0 THEN 'TAINT_FLAGGED' WHEN 1 THEN 'QUARANTINED' WHEN 2 THEN 'SUPERSEDED' ELSE 'CLEAN' END AS custody_status,
    CASE vec_id % 7 WHEN 0 THEN 'REINFORCED' WHEN 1 THEN 'FORGOTTEN' ELSE 'NEUTRAL' END AS field_state
  FROM embeddings
)"""
QUERY_ID = 3


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("vec_id") % 10 == 0, "TAINT_FLAGGED").when(F.col("vec_id") % 10 == 1, "QUARANTINED").when(F.col("vec_id") % 10 == 2, "SUPERSEDED").otherwise("CLEAN")
    state = F.when(F.col("vec_id") % 7 == 0, "REINFORCED").when(F.col("vec_id") % 7 == 1, "FORGOTTEN").otherwise("NEUTRAL")
    return read(spark, sf_dir, "embeddings").select("vec_id", ident("m-", F.col("vec_id")).alias("memory_id"), "label", scaled("embedding").alias("vec"), status.alias("custody_status"), state.alias("field_state"))


def query_vector(memories: DataFrame, vec_id: int = QUERY_ID) -> list[int]:
    return list(memories.where(F.col("vec_id") == vec_id).select("vec").head()["vec"])


# DOT(a, b) is written out so that DuckDB adds whole numbers of 128 bits.
def dot_sql(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1]::HUGEINT * p[2]::HUGEINT), lambda s, x: s + x)"


EDGES_SQL = """
n AS (SELECT count(*) AS n FROM embeddings),
res AS (SELECT vec_id AS f, (7 * vec_id + 3) % n AS t FROM embeddings, n WHERE vec_id <> (7 * vec_id + 3) % n),
inh AS (SELECT vec_id AS f, (11 * vec_id + 5) % n AS t FROM embeddings, n WHERE vec_id % 5 = 0 AND vec_id <> (11 * vec_id + 5) % n),
edges AS (
  SELECT 'm-' || lpad(f::VARCHAR, 6, '0') AS from_id, 'm-' || lpad(t::VARCHAR, 6, '0') AS to_id, 'RESONANT' AS link_type FROM res
  UNION ALL
  SELECT 'm-' || lpad(f::VARCHAR, 6, '0'), 'm-' || lpad(t::VARCHAR, 6, '0'), 'INHIBITORY' FROM inh
  WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.f = inh.f AND res.t = inh.t)
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings").select("vec_id")
    n = ids.count()

    def links(times: int, plus: int, kind: str) -> DataFrame:
        to = (F.col("vec_id") * times + plus) % n
        return ids.where(F.col("vec_id") != to).select(ident("m-", F.col("vec_id")).alias("from_id"), ident("m-", to).alias("to_id"), F.lit(kind).alias("link_type"), (F.col("vec_id") % 5).alias("five"))

    res = links(7, 3, "RESONANT")
    inh = links(11, 5, "INHIBITORY").where("five = 0").join(res.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return res.drop("five").unionByName(inh.drop("five").select("from_id", "to_id", "link_type"))


# a denser graph: memory 0 leads to two thirds of all memories, which inhibit one another in places
DENSE_SQL = """
dense AS (
  SELECT 'm-' || lpad(f::VARCHAR, 6, '0') AS from_id, 'm-' || lpad(t::VARCHAR, 6, '0') AS to_id, min(kind) AS link_type FROM (
    SELECT vec_id AS f, unnest([(vec_id * 7 + 3) % n, (vec_id * 13 + 1) % n, (vec_id + 1 + vec_id % 3) % n]) AS t, unnest(['RESONANT', 'RESONANT', CASE WHEN vec_id % 2 = 0 THEN 'INHIBITORY' ELSE 'RESONANT' END]) AS kind
    FROM embeddings, (SELECT count(*) AS n FROM embeddings)
    UNION ALL SELECT 0, vec_id, 'RESONANT' FROM embeddings WHERE vec_id % 3 > 0
  ) WHERE f <> t GROUP BY f, t
)"""


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "embeddings").select("vec_id")
    n = ids.count()
    f = F.col("vec_id")

    def link(to: Column, kind: Column) -> Column:
        return F.struct(to.cast("long").alias("t"), kind.alias("kind"))

    res = F.lit("RESONANT")
    out = F.explode(F.array(link((f * 7 + 3) % n, res), link((f * 13 + 1) % n, res), link((f + 1 + f % 3) % n, F.when(f % 2 == 0, "INHIBITORY").otherwise("RESONANT"))))
    rows = ids.select(f.alias("f"), out.alias("l")).select("f", "l.t", "l.kind").unionByName(ids.where("vec_id % 3 > 0").select(F.lit(0).cast("long").alias("f"), f.alias("t"), res.alias("kind")))
    rows = rows.where("f <> t").groupBy("f", "t").agg(F.min("kind").alias("link_type"))
    return rows.select(ident("m-", F.col("f")).alias("from_id"), ident("m-", F.col("t")).alias("to_id"), "link_type")


# --- custody chains ------------------------------------------------------------------------

CHAIN_SQL = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events
),
typed AS (
  SELECT 'm-' || lpad(user_id::VARCHAR, 6, '0') AS memory_id, seq::INTEGER AS seq, event_id, ts, event_type AS reason, props,
    CASE WHEN seq = 0 THEN 'STORED' ELSE CASE event_type WHEN 'click' THEN 'REINFORCED' WHEN 'view' THEN 'DECISION_USED_MEMORY'
      WHEN 'purchase' THEN 'TAINT_FLAGGED' WHEN 'error' THEN 'CONTRADICTED_BY' ELSE 'REHABILITATED' END END AS event_type,
    'a-' || (event_id % 17)::VARCHAR AS actor_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at
  FROM numbered
),
chain AS (
  SELECT *, CASE event_type
      WHEN 'STORED' THEN '{"content_sha256":"' || sha256(props) || '"}'
      WHEN 'TAINT_FLAGGED' THEN '{"quarantined_actor":"' || actor_id || '","sweep_id":"s-' || (event_id % 17)::VARCHAR || '"}'
      WHEN 'DECISION_USED_MEMORY' THEN '{"decision_id":"d-' || (event_id % 53)::VARCHAR || '"}' ELSE '{}' END AS payload_json
  FROM typed
)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custody events of every user, without hashes."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    et, kind = F.col("event_type"), F.col("kind")
    rows = read(spark, sf_dir, "events").withColumn("seq", seq.cast("int"))
    named = F.when(et == "click", "REINFORCED").when(et == "view", "DECISION_USED_MEMORY").when(et == "purchase", "TAINT_FLAGGED").when(et == "error", "CONTRADICTED_BY").otherwise("REHABILITATED")
    rows = rows.withColumn("kind", F.when(F.col("seq") == 0, "STORED").otherwise(named)).withColumn("actor_id", F.concat(F.lit("a-"), (F.col("event_id") % 17).cast("string")))
    payload = (
        F.when(kind == "STORED", F.concat(F.lit('{"content_sha256":"'), F.sha2("props", 256), F.lit('"}')))
        .when(kind == "TAINT_FLAGGED", F.concat(F.lit('{"quarantined_actor":"'), "actor_id", F.lit('","sweep_id":"s-'), (F.col("event_id") % 17).cast("string"), F.lit('"}')))
        .when(kind == "DECISION_USED_MEMORY", F.concat(F.lit('{"decision_id":"d-'), (F.col("event_id") % 53).cast("string"), F.lit('"}')))
        .otherwise("{}")
    )
    return rows.select(ident("m-", F.col("user_id")).alias("memory_id"), "seq", kind.alias("event_type"), "actor_id", et.alias("reason"), instant(F.col("ts")).alias("created_at"), payload.alias("payload_json"))


ENVELOPE_SQL = """'{"actor_id":"' || actor_id || '","created_at":"' || created_at || '","event_type":"' || event_type || '","memory_id":"' || memory_id || '","payload":' || payload_json || ',"reason":"' || reason || '","seq":' || seq::VARCHAR || '}'"""
HEADS_SQL = f"""
heads AS (
  SELECT memory_id, count(*)::INTEGER AS length,
    list_reduce(list({ENVELOPE_SQL} ORDER BY seq), lambda a, x: sha256(a || x), sha256('{OWN.custody}' || memory_id)) AS entry_hash
  FROM chain GROUP BY memory_id
)"""
ASOF = "2024-01-15T00:00:00.000000+00:00"

# --- actors, grants and windows ------------------------------------------------------------

LEDGER_SQL = """
acts AS (
  SELECT o_orderkey, 'c-' || lpad(o_custkey::VARCHAR, 6, '0') AS subject_id, 'c-' || lpad((o_custkey / 2)::BIGINT::VARCHAR, 6, '0') AS issuer, o_orderdate,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at_
  FROM orders
),
grants AS (
  SELECT subject_id, 'g-' || o_orderkey::VARCHAR AS grant_id, at_ AS granted_at,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 200 DAY, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS revoked_at,
    CASE o_orderkey % 4 WHEN 0 THEN ['ASSERT', 'STORE'] WHEN 1 THEN ['REINFORCE', 'STORE'] WHEN 2 THEN ['GRANT'] ELSE ['DECIDE', 'GRANT'] END AS capabilities
  FROM acts WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
),
windows AS (
  SELECT subject_id, at_ AS from_at,
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS to_at
  FROM acts WHERE o_orderkey % 35 = 0 OR o_orderkey % 49 = 0
)"""
LEDGER_AT = "1996-06-01T00:00:00.000000+00:00"


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", ident("c-", F.col("o_custkey")).alias("subject_id"), "o_orderdate", instant(F.col("o_orderdate")).alias("at"))


def later(days: int) -> Column:
    return instant(F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAY"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    lists = (["ASSERT", "STORE"], ["REINFORCE", "STORE"], ["GRANT"], ["DECIDE", "GRANT"])
    caps = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (key % 4 + 1).cast("int"))
    rows = acts(spark, sf_dir).where((key % 2 == 0) | (key % 3 == 0))
    return rows.select("subject_id", F.concat(F.lit("g-"), key.cast("string")).alias("grant_id"), F.col("at").alias("granted_at"), F.when(key % 3 == 0, later(200)).alias("revoked_at"), caps.alias("capabilities"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = acts(spark, sf_dir).where((key % 35 == 0) | (key % 49 == 0))
    return rows.select("subject_id", F.col("at").alias("from_at"), F.when(key % 5 == 0, later(90)).alias("to_at"))


# --- claims --------------------------------------------------------------------------------

CLAIMS_SQL = """
claim AS (
  SELECT doc_id, 'k-' || lpad(doc_id::VARCHAR, 6, '0') AS claim_id, lang AS topic, source AS asserted_by, sha256(text) AS statement_sha256,
    CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'VALIDATED' WHEN toxic = 1 THEN 'REFUTED' ELSE 'ASSERTED' END AS state
  FROM documents LEFT JOIN labels USING (doc_id)
),
member AS (
  SELECT 'set-' || lpad((doc_id // 3)::VARCHAR, 6, '0') AS set_id,
    CASE (doc_id // 3) % 3 WHEN 0 THEN 'AT_MOST_ONE' WHEN 1 THEN 'EXACTLY_ONE' ELSE 'INCOMPATIBLE' END AS constraint_type, claim_id, state
  FROM claim
)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "VALIDATED").when(F.col("toxic") == 1, "REFUTED").otherwise("ASSERTED")
    return both.select("doc_id", ident("k-", F.col("doc_id")).alias("claim_id"), F.col("lang").alias("topic"), F.col("source").alias("asserted_by"), F.sha2("text", 256).alias("statement_sha256"), state.alias("state"))


def members(claims: DataFrame) -> DataFrame:
    group = F.floor(F.col("doc_id") / 3)
    kind = F.when(group % 3 == 0, "AT_MOST_ONE").when(group % 3 == 1, "EXACTLY_ONE").otherwise("INCOMPATIBLE")
    return claims.select(ident("set-", group).alias("set_id"), kind.alias("constraint_type"), "claim_id", "state")
