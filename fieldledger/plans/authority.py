"""Queries over actors, grants and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import authority, claims, graph, replay
from . import views as v


def grants_live_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-grant-asof at one instant."""
    return authority.grants_live_at(v.grants(spark, sf_dir), v.LEDGER_AT).select("subject_id", "grant_id", "granted_at", "revoked_at")


_LIVE = f"granted_at <= '{v.LEDGER_AT}' AND (revoked_at IS NULL OR revoked_at > '{v.LEDGER_AT}')"
_SHUT = f"SELECT subject_id FROM windows WHERE from_at <= '{v.LEDGER_AT}' AND (to_at IS NULL OR to_at > '{v.LEDGER_AT}')"
LIVE_SQL = f"WITH {v.LEDGER_SQL} SELECT subject_id, grant_id, granted_at, revoked_at FROM grants WHERE {_LIVE}"


def capabilities_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-caps, Q-quarantined, JN-quarantine."""
    return authority.capabilities_at(v.grants(spark, sf_dir), v.windows(spark, sf_dir), v.LEDGER_AT)


CAPS_SQL = f"WITH {v.LEDGER_SQL} SELECT DISTINCT subject_id, unnest(capabilities) AS capability FROM grants WHERE {_LIVE} AND subject_id NOT IN ({_SHUT})"


def conferring_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-grant: the smallest live grant by which a subject may store."""
    return authority.conferring_grant(v.grants(spark, sf_dir), v.windows(spark, sf_dir), "STORE", v.LEDGER_AT)


CONFER_SQL = f"WITH {v.LEDGER_SQL} SELECT subject_id, min(grant_id) AS grant_id FROM grants WHERE {_LIVE} AND list_contains(capabilities, 'STORE') AND subject_id NOT IN ({_SHUT}) GROUP BY 1"


def unauthorized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-grant-asof, JN-quarantine over all events: line items are acts under their orders' grants."""
    orders = v.acts(spark, sf_dir)
    kinds = ["STORED", "REINFORCED", "DECISION_USED_MEMORY"]
    items = v.read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    events = items.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("subject_id").alias("actor_id"),
        F.when(F.col("l_linenumber") != 5, F.concat(F.lit("g-"), F.col("l_orderkey").cast("string"))).alias("grant_id"), v.instant(F.col("l_shipdate")).alias("created_at"), kind.alias("event_type"),
    )
    events = events.withColumn("needed", authority.required(F.col("event_type"), authority.CUSTODY_CAPABILITY)).drop("event_type")
    return authority.unauthorized(events, v.grants(spark, sf_dir), v.windows(spark, sf_dir)).select("order_key", "line", "error")


UNAUTHORIZED_SQL = f"""WITH {v.LEDGER_SQL},
ev AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line, subject_id, CASE WHEN l_linenumber <> 5 THEN 'g-' || l_orderkey::VARCHAR END AS grant_id,
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at_, CASE l_linenumber % 3 WHEN 0 THEN 'STORE' WHEN 1 THEN 'REINFORCE' ELSE 'DECIDE' END AS needed
  FROM lineitem JOIN acts ON l_orderkey = o_orderkey
)
SELECT order_key, line, CASE WHEN ev.grant_id IS NULL THEN 'no_grant'
  WHEN EXISTS (SELECT 1 FROM windows AS w WHERE w.subject_id = ev.subject_id AND w.from_at <= ev.at_ AND (w.to_at IS NULL OR w.to_at > ev.at_)) THEN 'quarantined'
  WHEN g.grant_id IS NULL OR g.granted_at > ev.at_ OR g.revoked_at <= ev.at_ THEN 'not_active'
  WHEN NOT list_contains(g.capabilities, needed) THEN 'not_conferred' END AS error
FROM ev LEFT JOIN grants AS g ON g.subject_id = ev.subject_id AND g.grant_id = ev.grant_id
WHERE error IS NOT NULL"""


def delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority chains whose issuers are the subject itself, the customer of half the number, or nobody known."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    chain = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    turn = F.floor(key / 8) % 4
    rows = v.read(spark, sf_dir, "orders").withColumn("seq", (F.row_number().over(chain) - 1).cast("int"))
    rows = rows.withColumn("event_type", F.when(F.col("seq") == 0, "ACTOR_REGISTERED").when(turn <= 1, "GRANTED").when(turn == 2, F.when(key % 2 == 0, "REVOKED").otherwise("ACTOR_QUARANTINED")).otherwise("ACTOR_REINSTATED"))
    rows = rows.withColumn("last", F.last(F.when(F.col("event_type") == "GRANTED", key), ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    caps = F.element_at(F.array(F.lit('["GRANT","STORE"]'), F.lit('["GRANT","QUARANTINE_ACTOR","REVOKE"]'), F.lit('["STORE"]'), F.lit('["DECIDE"]')), (F.floor(key / 32) % 4 + 1).cast("int"))
    payload = (
        F.when(F.col("event_type") == "GRANTED", F.concat(F.lit('{"capabilities":'), caps, F.lit(',"grant_id":"g-'), key.cast("string"), F.lit('","root":false}')))
        .when(F.col("event_type") == "REVOKED", F.concat(F.lit('{"grant_id":"g-'), F.coalesce(F.col("last").cast("string"), F.lit("none")), F.lit('"}'))).otherwise("{}")
    )
    issuer = F.when(key % 3 == 0, v.ident("c-", cust)).when(key % 3 == 1, v.ident("c-", F.floor(cust / 2))).otherwise("nobody")
    return rows.select(v.ident("c-", cust).alias("subject_id"), "seq", "event_type", issuer.alias("issuer_id"), v.instant(F.col("o_orderdate")).alias("created_at"), payload.alias("payload_json"))


DELEGATION_SQL = """
ordered AS (
  SELECT o_orderkey AS k, 'c-' || lpad(o_custkey::VARCHAR, 6, '0') AS subject_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at_,
    CASE o_orderkey % 3 WHEN 0 THEN 'c-' || lpad(o_custkey::VARCHAR, 6, '0') WHEN 1 THEN 'c-' || lpad((o_custkey // 2)::VARCHAR, 6, '0') ELSE 'nobody' END AS issuer,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders
),
led AS (
  SELECT *, CASE WHEN seq = 0 THEN 'ACTOR_REGISTERED' WHEN (k // 8) % 4 <= 1 THEN 'GRANTED' WHEN (k // 8) % 4 = 3 THEN 'ACTOR_REINSTATED' WHEN k % 2 = 0 THEN 'REVOKED' ELSE 'ACTOR_QUARANTINED' END AS event_type,
    [['GRANT', 'STORE'], ['GRANT', 'QUARANTINE_ACTOR', 'REVOKE'], ['STORE'], ['DECIDE']][(k // 32) % 4 + 1] AS caps FROM ordered
),
aimed AS (SELECT *, last_value(CASE WHEN event_type = 'GRANTED' THEN k END IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM led),
ends AS (SELECT subject_id, target, at_, seq, row_number() OVER (PARTITION BY subject_id, target ORDER BY seq) AS nth FROM aimed WHERE event_type = 'REVOKED'),
made AS (
  SELECT g.subject_id, g.caps, g.at_ AS granted_at, g.seq AS granted_seq, e.at_ AS revoked_at, e.seq AS revoked_seq
  FROM led AS g LEFT JOIN ends AS e ON e.subject_id = g.subject_id AND e.target = g.k AND e.nth = 1 WHERE g.event_type = 'GRANTED'
),
marks AS (
  SELECT *, lag(event_type) OVER w AS last_type, lead(event_type) OVER w AS next_type, lead(at_) OVER w AS next_at
  FROM led WHERE event_type IN ('ACTOR_QUARANTINED', 'ACTOR_REINSTATED') WINDOW w AS (PARTITION BY subject_id ORDER BY seq)
),
wrong AS (
  SELECT subject_id, seq FROM ends WHERE target IS NULL OR nth > 1
  UNION SELECT subject_id, seq FROM marks WHERE event_type = coalesce(last_type, 'ACTOR_REINSTATED')
),
asks AS (SELECT subject_id, seq, issuer AS holder, at_, issuer = subject_id AS own, event_type, caps FROM led),
by_seq AS (
  SELECT a.subject_id, a.seq, CASE WHEN EXISTS (SELECT 1 FROM wrong AS x WHERE x.subject_id = a.holder AND x.seq < a.seq) THEN []
      WHEN (SELECT arg_max(event_type, m.seq) FROM marks AS m WHERE m.subject_id = a.holder AND m.seq < a.seq) = 'ACTOR_QUARANTINED' THEN []
      ELSE (SELECT list_sort(list_distinct(flatten(list(g.caps)))) FROM made AS g WHERE g.subject_id = a.holder AND g.granted_seq < a.seq AND (g.revoked_seq IS NULL OR g.revoked_seq >= a.seq)) END AS held
  FROM {asks_by_seq} AS a
),
by_time AS (
  SELECT a.subject_id, a.seq, CASE WHEN EXISTS (SELECT 1 FROM marks AS m WHERE m.subject_id = a.holder AND m.event_type = 'ACTOR_QUARANTINED' AND m.at_ <= a.at_ AND (m.next_type IS DISTINCT FROM 'ACTOR_REINSTATED' OR m.next_at > a.at_)) THEN []
      ELSE (SELECT list_sort(list_distinct(flatten(list(g.caps)))) FROM made AS g WHERE g.subject_id = a.holder AND g.granted_at <= a.at_ AND (g.revoked_at IS NULL OR g.revoked_at > a.at_)) END AS held
  FROM {asks_by_time} AS a
)"""


def capabilities_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-capsbefore, JN-issuer-before: what each subject held before each event of its own chain, by number and by instant."""
    chain = delegation(spark, sf_dir)
    asks = chain.select("subject_id", "seq", F.col("subject_id").alias("holder"), F.col("created_at").alias("at"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    found = authority.held_before(asks, chain)
    return found.select("subject_id", "seq", "own", F.array_join("held", ",").alias("held"))


_SELF = "(SELECT subject_id, seq, subject_id AS holder, at_ FROM led)"
BEFORE_SQL = f"""WITH {DELEGATION_SQL.format(asks_by_seq=_SELF, asks_by_time=_SELF)}
SELECT subject_id, seq::INTEGER AS seq, true AS own, coalesce(array_to_string(held, ','), '') AS held FROM by_seq
UNION ALL SELECT subject_id, seq::INTEGER, false, coalesce(array_to_string(held, ','), '') FROM by_time"""


def amplified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-issuer-before, Q-capsbefore: authority events that their issuer could not make, or by which it gave what it lacked."""
    return authority.amplified(delegation(spark, sf_dir)).withColumn("lacking", F.array_join("lacking", ","))


AMPLIFIED_SQL = f"""WITH {DELEGATION_SQL.format(asks_by_seq="(SELECT * FROM asks WHERE own)", asks_by_time="(SELECT * FROM asks WHERE NOT own)")},
joint AS (SELECT * FROM by_seq UNION ALL SELECT * FROM by_time),
judged AS (
  SELECT a.subject_id, a.seq, coalesce(b.held, []) AS held, a.holder IN (SELECT subject_id FROM led) AS known,
    CASE a.event_type WHEN 'REVOKED' THEN 'REVOKE' WHEN 'ACTOR_REGISTERED' THEN 'GRANT' WHEN 'GRANTED' THEN 'GRANT' ELSE 'QUARANTINE_ACTOR' END AS needed,
    CASE a.event_type WHEN 'GRANTED' THEN a.caps ELSE [] END AS conferred
  FROM asks AS a JOIN joint AS b ON b.subject_id = a.subject_id AND b.seq = a.seq
)
SELECT subject_id, seq::INTEGER AS seq, array_to_string(list_sort(list_filter(conferred, lambda c: NOT list_contains(held, c))), ',') AS lacking,
  CASE WHEN NOT known THEN 'issuer_unknown' WHEN NOT list_contains(held, needed) THEN 'not_held' WHEN len(list_filter(conferred, lambda c: NOT list_contains(held, c))) > 0 THEN 'amplified' END AS error
FROM judged WHERE error IS NOT NULL"""


def claim_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, by the day they were shipped, as the events of claims, which are orders."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    kinds = ["CLAIM_VALIDATED", "CLAIM_REFUTED", "CLAIM_WITHDRAWN", "EVIDENCE_LINKED", "EVIDENCE_LINKED", "CLAIM_VALIDATED"]
    part = F.col("l_partkey")
    rows = v.read(spark, sf_dir, "lineitem").withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
    kind = F.when(F.col("seq") == 0, "CLAIM_ASSERTED").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (part % 6 + 1).cast("int")))
    stance = F.when(part % 5 == 0, "DOUBTS").otherwise("SUPPORTS")
    payload = F.when(kind == "CLAIM_ASSERTED", F.concat(F.lit('{"statement_sha256":"'), F.sha2(F.col("l_orderkey").cast("string"), 256), F.lit('"}'))).when(kind == "EVIDENCE_LINKED", F.concat(F.lit('{"memory_id":"m","stance":"'), stance, F.lit('"}'))).otherwise("{}")
    return rows.select(F.concat(F.lit("k-"), F.col("l_orderkey").cast("string")).alias("claim_id"), "seq", kind.alias("event_type"), F.lit("a").alias("actor_id"), v.instant(F.col("l_shipdate")).alias("created_at"), payload.alias("payload_json"))


CLAIM_CHAIN_SQL = """
events_ AS (
  SELECT 'k-' || l_orderkey::VARCHAR AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS seq, l_partkey AS p, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at_ FROM lineitem
),
moved AS (SELECT *, CASE WHEN seq > 0 THEN ['VALIDATED', 'REFUTED', 'WITHDRAWN', NULL, NULL, 'VALIDATED'][p % 6 + 1] END AS state FROM events_),
told AS (
  SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY claim_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ASSERTED') AS before FROM moved
),
judged AS (
  SELECT *, CASE WHEN state IN ('VALIDATED', 'WITHDRAWN') THEN before <> 'ASSERTED' WHEN state = 'REFUTED' THEN before NOT IN ('ASSERTED', 'VALIDATED') ELSE seq > 0 AND p % 6 IN (3, 4) AND p % 5 = 0 END AS wrong FROM told
)"""
_STATE = "CASE WHEN coalesce(bool_or(j.wrong), false) THEN 'ASSERTED' ELSE coalesce(arg_max(j.state, j.seq) FILTER (WHERE j.state IS NOT NULL), 'ASSERTED') END"


def claim_states_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-before: every claim's state strictly before the instant of each of its events."""
    chain = claim_chain(spark, sf_dir)
    return replay.claim_states_before(chain, chain.select("claim_id", F.col("created_at").alias("at")))


STATES_BEFORE_SQL = f"""WITH {CLAIM_CHAIN_SQL}, asked AS (SELECT DISTINCT claim_id, at_ FROM events_)
SELECT a.claim_id, a.at_ AS "at", {_STATE} AS state FROM asked AS a LEFT JOIN judged AS j ON j.claim_id = a.claim_id AND j.at_ < a.at_ GROUP BY a.claim_id, a.at_"""


def set_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-reqcap-set: what binding the claims of eight orders into a set costs, eighty days after the first of them."""
    orders = v.acts(spark, sf_dir)
    members = orders.select(F.concat(F.lit("s-"), F.floor(F.col("o_orderkey") / 32).cast("string")).alias("set_id"), F.concat(F.lit("k-"), F.col("o_orderkey").cast("string")).alias("claim_id"), "o_orderdate")
    asks = members.groupBy("set_id").agg(F.min("o_orderdate").alias("o_orderdate")).select("set_id", v.later(80).alias("at"))
    return replay.set_capabilities(claim_chain(spark, sf_dir), members, asks)


SET_CAPS_SQL = f"""WITH {CLAIM_CHAIN_SQL},
members AS (SELECT 's-' || (o_orderkey // 32)::VARCHAR AS set_id, 'k-' || o_orderkey::VARCHAR AS claim_id, o_orderdate FROM orders),
asks AS (SELECT set_id, strftime(min(o_orderdate) + INTERVAL 80 DAY, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at_ FROM members GROUP BY set_id),
each AS (SELECT a.set_id, a.at_, m.claim_id, {_STATE} AS state FROM asks AS a JOIN members AS m USING (set_id) LEFT JOIN judged AS j ON j.claim_id = m.claim_id AND j.at_ < a.at_ GROUP BY a.set_id, a.at_, m.claim_id)
SELECT set_id, at_ AS "at", CASE WHEN bool_or(state = 'VALIDATED') THEN 'ADJUDICATE' ELSE 'ASSERT' END AS needed FROM each GROUP BY set_id, at_"""


def issuer_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-closure: the chain of issuers above every customer in debt; an issuer has half the number."""
    c = v.read(spark, sf_dir, "customer")
    edges = c.where("c_custkey > 1").select(v.ident("c-", F.col("c_custkey")).alias("child"), v.ident("c-", F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return graph.closure(edges, c.where("c_acctbal < 0").select(v.ident("c-", F.col("c_custkey")).alias("id")))


CLOSURE_SQL = """WITH RECURSIVE up AS (
  SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0
  UNION SELECT k // 2 FROM up WHERE k > 1
) SELECT 'c-' || lpad(k::VARCHAR, 6, '0') AS id FROM up"""


def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-evalconstraint, Q-evalset, AGG-setstates."""
    found = v.claims(spark, sf_dir)
    return claims.evaluated(v.members(found), found).select("set_id", "constraint_type", "n", "held", "open", "status")


SET_SQL = f"""WITH {v.CLAIMS_SQL},
c AS (SELECT set_id, constraint_type, count(*) AS n, count(*) FILTER (WHERE state = 'VALIDATED') AS held, count(*) FILTER (WHERE state = 'ASSERTED') AS open FROM member GROUP BY 1, 2)
SELECT *, CASE WHEN constraint_type <> 'INCOMPATIBLE' AND held > 1 THEN 'VIOLATED'
  WHEN constraint_type = 'EXACTLY_ONE' AND held = 0 THEN CASE WHEN open = 0 THEN 'VIOLATED' ELSE 'UNDETERMINED' END
  WHEN constraint_type = 'INCOMPATIBLE' AND held = n THEN 'VIOLATED' WHEN open = 0 THEN 'SATISFIED' ELSE 'UNDETERMINED' END AS status FROM c"""


def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-claim over claim chains of four kinds of event, built from the state that each document should end in."""
    from ..operators.replay import claim_states as replayed

    found = v.claims(spark, sf_dir)
    born = found.select("claim_id", F.lit(0).alias("seq"), F.lit("CLAIM_ASSERTED").alias("event_type"), F.col("asserted_by").alias("actor_id"), F.lit("").alias("created_at"), F.concat(F.lit('{"statement_sha256":"'), "statement_sha256", F.lit('","topic":"'), "topic", F.lit('"}')).alias("payload_json"))
    rest = found.where("state <> 'ASSERTED'").select("claim_id", F.explode(F.when(F.col("state") == "VALIDATED", F.array(F.lit("CLAIM_VALIDATED"))).otherwise(F.array(F.lit("CLAIM_VALIDATED"), F.lit("CLAIM_REFUTED")))).alias("event_type"), F.col("asserted_by").alias("actor_id"))
    rest = rest.select("claim_id", F.when(F.col("event_type") == "CLAIM_VALIDATED", 1).otherwise(2).alias("seq"), "event_type", "actor_id", F.lit("").alias("created_at"), F.lit("{}").alias("payload_json"))
    return replayed(born.unionByName(rest)).select("claim_id", "state", "statement_sha256", "topic", "asserted_by")


STATES_SQL = f"WITH {v.CLAIMS_SQL} SELECT claim_id, state, statement_sha256, topic, asserted_by FROM claim"


def standing_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-evidence: a claim's evidence, and what its memory's custody makes of it. Claim k leans on
    memory 7k and against memory 11k, modulo one and a half times the memories there are."""
    memories = v.vec(spark, sf_dir)
    most = memories.count() * 3 // 2
    found = v.claims(spark, sf_dir)
    at = lambda k: F.array(v.ident("m-", F.col("doc_id") * k % most))
    return claims.evidence(found.withColumn("supports", at(7)).withColumn("contradicts", at(11)), memories)


STANDING_SQL = f"""WITH {v.CLAIMS_SQL}, {v.VEC_SQL}, most AS (SELECT count(*) * 3 // 2 AS most FROM vec),
ev AS (SELECT claim_id, 'm-' || lpad((doc_id * 7 % most)::VARCHAR, 6, '0') AS memory_id, 'SUPPORTS' AS stance FROM claim, most
  UNION ALL SELECT claim_id, 'm-' || lpad((doc_id * 11 % most)::VARCHAR, 6, '0'), 'CONTRADICTS' FROM claim, most)
SELECT claim_id, ev.memory_id, stance, coalesce(custody_status, 'MISSING') AS status FROM ev LEFT JOIN vec ON vec.memory_id = ev.memory_id"""


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-contradict, FLT-topic: how many memories on the same topic disagree with each; topics are customers, claims order states."""
    births = v.acts(spark, sf_dir).join(v.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return claims.contradictions(births.select(F.col("o_orderkey").cast("string").alias("memory_id"), F.col("subject_id").alias("topic"), F.col("o_orderstatus").alias("claim")))


CONTRADICT_SQL = f"""WITH {v.LEDGER_SQL}, b AS (SELECT o_orderkey::VARCHAR AS memory_id, subject_id AS topic, o_orderstatus AS claim FROM acts JOIN orders USING (o_orderkey))
SELECT x.memory_id, x.topic, count(*) AS against FROM b AS x JOIN b AS y ON x.topic = y.topic AND x.claim <> y.claim GROUP BY 1, 2"""


def relation_mirror_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-mirror: relations only one side records. Claim k names claim k + 1; one in nine does not name it back."""
    docs = v.read(spark, sf_dir, "documents").select("doc_id")
    out = docs.select(v.ident("k-", F.col("doc_id")).alias("claim_id"), F.lit("CONTRADICTS").alias("relation"), F.lit("OUT").alias("direction"), v.ident("k-", F.col("doc_id") + 1).alias("other"))
    back = docs.where("doc_id % 9 <> 0").select(v.ident("k-", F.col("doc_id") + 1).alias("claim_id"), F.lit("CONTRADICTS").alias("relation"), F.lit("IN").alias("direction"), v.ident("k-", F.col("doc_id")).alias("other"))
    return claims.unmirrored(out.unionByName(back))


MIRROR_SQL = """SELECT 'k-' || lpad(doc_id::VARCHAR, 6, '0') AS claim_id, 'CONTRADICTS' AS relation, 'OUT' AS direction, 'k-' || lpad((doc_id + 1)::VARCHAR, 6, '0') AS other
FROM documents WHERE doc_id % 9 = 0"""


def membership_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-membership, PRD-subset: one record in seven is lacking, and one in eleven names the next set."""
    declared = v.members(v.claims(spark, sf_dir))
    k = F.substring("claim_id", 3, 12).cast("long")
    recorded = declared.where(k % 7 != 0).select("claim_id", F.when(k % 11 == 0, F.concat("set_id", F.lit("x"))).otherwise(F.col("set_id")).alias("set_id"))
    return claims.membership_faults(declared, recorded)


MEMBER_SQL = f"""WITH {v.CLAIMS_SQL}, k AS (SELECT set_id, claim_id, substr(claim_id, 3)::BIGINT AS n FROM member)
SELECT set_id, claim_id, 'UNRECORDED' AS problem FROM k WHERE n % 7 = 0 OR n % 11 = 0
UNION ALL SELECT set_id || 'x', claim_id, 'UNDECLARED' FROM k WHERE n % 7 <> 0 AND n % 11 = 0"""


def lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successions that only one of the two memories records. Document k replaces k - 1 where 5 divides k."""
    docs = v.read(spark, sf_dir, "documents").where("doc_id > 0 AND doc_id % 5 = 0").select("doc_id")
    up = docs.where("doc_id % 15 <> 0").select(v.ident("k-", F.col("doc_id") - 1).alias("memory_id"), v.ident("k-", F.col("doc_id")).alias("successor_id"))
    down = docs.where("doc_id % 20 <> 0").select(v.ident("k-", F.col("doc_id") - 1).alias("memory_id"), v.ident("k-", F.col("doc_id")).alias("successor_id"))
    only_up = up.join(down, ["memory_id", "successor_id"], "left_anti").withColumn("problem", F.lit("NOT_DECLARED"))
    return only_up.unionByName(down.join(up, ["memory_id", "successor_id"], "left_anti").withColumn("problem", F.lit("NOT_RETIRED")))


LINEAGE_SQL = """SELECT 'k-' || lpad((doc_id - 1)::VARCHAR, 6, '0') AS memory_id, 'k-' || lpad(doc_id::VARCHAR, 6, '0') AS successor_id,
  CASE WHEN doc_id % 15 = 0 THEN 'NOT_RETIRED' ELSE 'NOT_DECLARED' END AS problem
FROM documents WHERE doc_id > 0 AND doc_id % 5 = 0 AND (doc_id % 15 = 0) <> (doc_id % 20 = 0)"""

QUERIES = {
    "grants_live_at": (grants_live_at, LIVE_SQL), "capabilities_at": (capabilities_at, CAPS_SQL), "conferring_grant": (conferring_grant, CONFER_SQL), "capabilities_before": (capabilities_before, BEFORE_SQL), "amplified_events": (amplified_events, AMPLIFIED_SQL), "claim_states_before": (claim_states_before, STATES_BEFORE_SQL),
    "set_capabilities": (set_capabilities, SET_CAPS_SQL), "unauthorized_events": (unauthorized_events, UNAUTHORIZED_SQL),
    "issuer_closure": (issuer_closure, CLOSURE_SQL), "set_status": (set_status, SET_SQL), "claim_states": (claim_states, STATES_SQL), "standing_partition": (standing_partition, STANDING_SQL),
    "contradictions": (contradictions, CONTRADICT_SQL), "relation_mirror_violations": (relation_mirror_violations, MIRROR_SQL), "membership_violations": (membership_violations, MEMBER_SQL), "lineage_violations": (lineage_violations, LINEAGE_SQL),
}
