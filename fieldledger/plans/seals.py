"""Queries over what is sealed, and over checks that bundles and ledgers rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authority, causality, chains, claims, recall, replay, taint
from ..schema import CUSTODY, PROTOCOLS
from . import authority as ledgers
from . import reports
from . import views as v

_AT = "2024-02-01T00:00:00.000000+00:00"
RANKING = PROTOCOLS["ranking_protocol"]


def receipt_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-receipt, Q-verify-receipts: receipts of three served memories, every fifth with a forged seal."""
    parts = reports.causes(spark, sf_dir)
    _, served = reports.stored(parts)
    j = F.substring("receipt_sha256", 3, 12).cast("long")
    rows = served.withColumn("j", j).select(
        "j", "served_json", F.sha2(F.concat(F.lit("query"), F.col("j").cast("string")), 256).alias("query_sha256"), F.when(F.col("j") % 3 > 0, v.ident("m-", F.col("j"))).alias("seed_memory_id"),
        (F.col("j") % 4).cast("int").alias("excluded_custody"), F.lit(1).alias("excluded_forgotten"), F.lit(0).alias("excluded_inhibited"), F.lit(3).alias("top_k"), F.lit(2).alias("hops"), F.lit(RANKING).alias("ranking_protocol"),
        F.lit('{"override":[["m-1","CLEAN"]]}').alias("custody_override_json"), F.when(F.col("j") % 2 == 0, _AT).alias("as_of"),
    )
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    body = F.concat(
        F.lit('{"as_of":'), quoted("as_of"), F.lit(',"custody_override":[["m-1","CLEAN"]],"excluded_custody":'), F.col("excluded_custody").cast("string"), F.lit(',"excluded_forgotten":1,"excluded_inhibited":0,"hops":2,"query_sha256":'), quoted("query_sha256"),
        F.lit(f',"ranking_protocol":"{RANKING}","seed_memory_id":'), quoted("seed_memory_id"), F.lit(',"served":'), F.expr("substring(served_json, 11, length(served_json) - 11)"), F.lit(',"top_k":3}'),
    )
    return recall.receipt_seals(rows.withColumn("receipt_sha256", F.sha2(F.when(F.col("j") % 5 == 0, F.col("j").cast("string")).otherwise(body), 256)))


RECEIPTS_SQL = f"""WITH {reports.CAUSES_SQL},
lists AS (SELECT j, '["' || string_agg(DISTINCT 'm-' || lpad(m::VARCHAR, 6, '0'), '","' ORDER BY 'm-' || lpad(m::VARCHAR, 6, '0')) || '"]' AS served FROM served GROUP BY j)
SELECT sha256(CASE WHEN j % 5 = 0 THEN j::VARCHAR ELSE '{{"as_of":' || CASE WHEN j % 2 = 0 THEN '"{_AT}"' ELSE 'null' END || ',"custody_override":[["m-1","CLEAN"]],"excluded_custody":' || (j % 4)::VARCHAR || ',"excluded_forgotten":1,"excluded_inhibited":0,"hops":2,"query_sha256":"'
  || sha256('query' || j::VARCHAR) || '","ranking_protocol":"{RANKING}","seed_memory_id":' || CASE WHEN j % 3 > 0 THEN '"m-' || lpad(j::VARCHAR, 6, '0') || '"' ELSE 'null' END || ',"served":' || served || ',"top_k":3}}' END) AS receipt_sha256, j % 5 > 0 AS ok FROM lists"""


def decision_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-verify-decisions: records of what was used, every seventh with a forged seal."""
    decisions, _ = reports.stored(reports.causes(spark, sf_dir))
    rows = decisions.withColumn("j", F.substring("decision_id", 3, 12).cast("long")).withColumns({"decision_sha256": F.sha2("decision_id", 256), "policy_version": F.lit("v1"), "reason": F.lit('so "it" goes'), "created_at": F.lit(_AT)})
    body = F.concat(
        F.lit('{"actor_id":"'), "actor_id", F.lit(f'","created_at":"{_AT}","decision_id":"'), "decision_id", F.lit('","decision_sha256":"'), "decision_sha256",
        F.lit('","policy_version":"v1","reason":"so \\"it\\" goes","receipt_sha256":"'), "receipt_sha256", F.lit('","used_memory_ids":'), F.expr("substring(used_json, 9, length(used_json) - 9)"), F.lit("}"),
    )
    return causality.decision_seals(rows.withColumn("record_sha256", F.sha2(F.when(F.col("j") % 7 == 0, F.col("decision_id")).otherwise(body), 256)))


DECISIONS_SQL = f"WITH {reports.CAUSES_SQL} SELECT 'd-' || j::VARCHAR AS decision_id, j % 7 > 0 AS ok FROM ids"


def standings_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-standing: what can be said of every claim from clean evidence, and the seal over it. Claim k leans on memory 7k,
    and against memory 11k, modulo one and a half times the memories there are, and supports claim k + 1."""
    memories, found = v.vec(spark, sf_dir), v.claims(spark, sf_dir)
    most = memories.count() * 3 // 2
    doc = F.col("doc_id")
    relation = F.struct(F.lit("SUPPORTS").alias("relation"), F.lit("OUT").alias("direction"), v.ident("k-", doc + 1).alias("other"))
    states = found.withColumns({"supports": F.array(v.ident("m-", doc * 7 % most)), "contradicts": F.array(v.ident("m-", doc * 11 % most)), "relations": F.array(relation), "sets": F.array().cast("array<string>")})
    sets = v.members(found).groupBy("set_id", "constraint_type").agg(F.to_json(F.struct(F.array_sort(F.collect_list("claim_id")).alias("members"))).alias("members_json"))
    return claims.standing_seals(claims.standings(states, memories, sets)).select("claim_id", "standing_sha256")


STANDINGS_SQL = f"""WITH {v.CLAIMS_SQL}, {v.VEC_SQL}, most AS (SELECT count(*) * 3 // 2 AS most FROM vec),
ev AS (
  SELECT claim_id, kind, m AS memory_id, coalesce(custody_status, 'MISSING') AS status FROM (
    SELECT claim_id, 's' AS kind, 'm-' || lpad((doc_id * 7 % most)::VARCHAR, 6, '0') AS m FROM claim, most UNION ALL SELECT claim_id, 'c', 'm-' || lpad((doc_id * 11 % most)::VARCHAR, 6, '0') FROM claim, most
  ) LEFT JOIN vec ON vec.memory_id = m
),
c AS (SELECT set_id, constraint_type, count(*) AS n, count(*) FILTER (WHERE state = 'VALIDATED') AS held, count(*) FILTER (WHERE state = 'ASSERTED') AS open FROM member GROUP BY 1, 2),
verdicts AS (
  SELECT set_id, CASE WHEN constraint_type <> 'INCOMPATIBLE' AND held > 1 THEN 'VIOLATED' WHEN constraint_type = 'EXACTLY_ONE' AND held = 0 THEN CASE WHEN open = 0 THEN 'VIOLATED' ELSE 'UNDETERMINED' END
    WHEN constraint_type = 'INCOMPATIBLE' AND held = n THEN 'VIOLATED' WHEN open = 0 THEN 'SATISFIED' ELSE 'UNDETERMINED' END AS status FROM c
),
told AS (
  SELECT claim_id, coalesce(string_agg(DISTINCT '"' || memory_id || '"', ',') FILTER (WHERE status = 'CLEAN' AND kind = 's'), '') AS pro, coalesce(string_agg(DISTINCT '"' || memory_id || '"', ',') FILTER (WHERE status = 'CLEAN' AND kind = 'c'), '') AS con,
    coalesce(string_agg('["' || memory_id || '","' || status || '"]', ',' ORDER BY memory_id, status) FILTER (WHERE status <> 'CLEAN'), '') AS withheld FROM ev GROUP BY claim_id
)
SELECT claim_id, sha256('{{"claim_id":"' || claim_id || '","contradicting":[' || con || '],"relations":[["SUPPORTS","OUT","k-' || lpad((doc_id + 1)::VARCHAR, 6, '0') || '"]],"sets":[["' || set_id || '","' || status || '"]],"state":"' || claim.state
  || '","statement_sha256":"' || statement_sha256 || '","supporting":[' || pro || '],"withheld_evidence":[' || withheld || ']}}') AS standing_sha256
FROM claim JOIN told USING (claim_id) JOIN member USING (claim_id) JOIN verdicts USING (set_id)"""


def sweep_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-verify-sweep: recorded sweeps with a wrong count (every fourth), a wrong seal (the next), or nothing flagged."""
    chain = v.chain(spark, sf_dir)
    n = F.substring("sweep_id", 3, 4).cast("int") % 4
    sweeps = taint.sweep_seals(chain).withColumn("flagged_count", F.col("flagged_count") + F.when(n == 0, 1).otherwise(0)).withColumn("flagged_ids_sha256", F.when(n == 1, F.reverse("flagged_ids_sha256")).otherwise(F.col("flagged_ids_sha256")))
    empty = spark.range(1).select(F.lit("s-none").alias("sweep_id"), F.lit(0).alias("flagged_count"), F.sha2(F.lit('{"memory_ids":[]}'), 256).alias("flagged_ids_sha256"))
    return taint.verify_sweeps(sweeps.unionByName(empty), chain)


SWEEP_FAULTS_SQL = f"""WITH {v.CHAIN_SQL}, s AS (SELECT DISTINCT payload_json->>'$.sweep_id' AS sweep_id FROM chain WHERE event_type = 'TAINT_FLAGGED')
SELECT sweep_id, CASE substr(sweep_id, 3)::INTEGER % 4 WHEN 0 THEN 'count' ELSE 'seal' END AS error FROM s WHERE substr(sweep_id, 3)::INTEGER % 4 < 2"""


def capability_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-holders, Q-roots: who could grant at an instant, and whether by a root grant (every eleventh)."""
    grants = v.grants(spark, sf_dir).withColumn("root", F.substring("grant_id", 3, 12).cast("long") % 11 == 0)
    held = authority.holders(grants, v.windows(spark, sf_dir), v.LEDGER_AT)
    return held.join(authority.roots(grants).withColumn("root", F.lit(True)), "subject_id", "left").select("subject_id", F.coalesce("root", F.lit(False)).alias("root"))


HOLDERS_SQL = f"""WITH {v.LEDGER_SQL}, roots AS (SELECT DISTINCT subject_id FROM grants WHERE substr(grant_id, 3)::BIGINT % 11 = 0)
SELECT DISTINCT subject_id, subject_id IN (SELECT subject_id FROM roots) AS root FROM grants WHERE {ledgers._LIVE} AND list_contains(capabilities, 'GRANT') AND subject_id NOT IN ({ledgers._SHUT})"""


def claim_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-claim's errors: moves that the state before does not allow, and evidence without a known stance."""
    return replay.claim_errors(ledgers.claim_chain(spark, sf_dir))


CLAIM_ERRORS_SQL = f"WITH {ledgers.CLAIM_CHAIN_SQL} SELECT claim_id, seq::INTEGER AS seq, CASE WHEN state IS NULL THEN 'evidence' ELSE 'state_from' END AS error FROM judged WHERE wrong"

SUMMARY_AT = "1996-06-01T00:00:00.000000+00:00"


def authority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-authsummary: every subject's status, grants, and capabilities at an instant."""
    found = authority.summary(ledgers.delegation(spark, sf_dir), SUMMARY_AT)
    return found.select("subject_id", "status", F.col("n_grants").cast("long").alias("n_grants"), F.array_join("capabilities", ",").alias("capabilities"))


_WHOM = f"(SELECT DISTINCT subject_id, 0 AS seq, subject_id AS holder, '{SUMMARY_AT}' AS at_ FROM led)"
SUMMARY_SQL = f"""WITH {ledgers.DELEGATION_SQL.format(asks_by_seq=_WHOM, asks_by_time=_WHOM)}
SELECT subject_id, CASE WHEN (SELECT arg_max(m.event_type, m.seq) FROM marks AS m WHERE m.subject_id = t.subject_id) = 'ACTOR_QUARANTINED' THEN 'QUARANTINED' ELSE 'ACTIVE' END AS status,
  (SELECT count(*) FROM made AS g WHERE g.subject_id = t.subject_id) AS n_grants, coalesce(array_to_string(held, ','), '') AS capabilities FROM by_time AS t"""


def chain_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-birth, CH-genesis, AGG-min-ts: the first event of each chain, sealed and linked to its genesis, and when it was."""
    born = chains.births(chains.build(v.chain(spark, sf_dir), CUSTODY), CUSTODY)
    return born.select("memory_id", "created_at", "prev_hash", "entry_hash", F.get_json_object("payload_json", "$.content_sha256").alias("content_sha256"))


BIRTHS_SQL = f"""WITH {v.CHAIN_SQL}
SELECT memory_id, created_at, sha256('{v.OWN.custody}' || memory_id) AS prev_hash, sha256(sha256('{v.OWN.custody}' || memory_id) || {v.ENVELOPE_SQL}) AS entry_hash, sha256(props) AS content_sha256 FROM chain WHERE seq = 0"""

QUERIES = {
    "receipt_seals": (receipt_seals, RECEIPTS_SQL), "decision_seals": (decision_seals, DECISIONS_SQL), "standings_sealed": (standings_sealed, STANDINGS_SQL), "sweep_faults": (sweep_faults, SWEEP_FAULTS_SQL),
    "capability_holders": (capability_holders, HOLDERS_SQL), "claim_errors": (claim_errors, CLAIM_ERRORS_SQL), "authority_summary": (authority_summary, SUMMARY_SQL), "chain_births": (chain_births, BIRTHS_SQL),
}
