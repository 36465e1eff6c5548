"""Queries over event chains: hashing, verification, replay, sweeps and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, inventory, replay, taint
from ..schema import CUSTODY, OWN
from . import views as v


def chain_genesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-genesis."""
    return v.chain(spark, sf_dir).where("seq = 0").select("memory_id", chains.genesis(CUSTODY, "memory_id").alias("genesis"))


GENESIS_SQL = f"WITH {v.CHAIN_SQL} SELECT memory_id, sha256('{OWN.custody}' || memory_id) AS genesis FROM chain WHERE seq = 0"


def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-append, CH-hash, WIN-head: every chain built by streaming, and its head."""
    built = chains.build(v.chain(spark, sf_dir), CUSTODY)
    return chains.heads(built, CUSTODY)


CHAIN_HEADS_SQL = f"WITH {v.CHAIN_SQL}, {v.HEADS_SQL} SELECT memory_id, entry_hash FROM heads"


def chain_heads_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-append as a fold inside the JVM."""
    return chains.folded_heads(v.chain(spark, sf_dir), CUSTODY)


FOLDED_SQL = f"WITH {v.CHAIN_SQL}, {v.HEADS_SQL} SELECT memory_id, entry_hash, length FROM heads"


#: What is planted in the chains of users whose number leaves this remainder by twelve.
PLANTED = ("seq", "vocabulary", "birth", "rebirth", "link", "payload", "hash", "timestamp", "backwards", "seal")


def forged_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custody chains with one forgery each in ten of twelve. All but two kinds are sealed again, so that nothing else is wrong."""
    rows = v.chain(spark, sf_dir).withColumn("_u", F.substring("memory_id", 3, 6).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in (*PLANTED, "", "")]), F.col("_u") % 12 + 1)
    early = kind.isin("birth", "seal")
    here = F.col("seq") == F.when(early, 0).otherwise(1 + F.floor(F.col("_u") / 12) % 3)
    rows = rows.withColumn("_kind", F.when(here, kind).otherwise(""))

    def forge(column: str, **by: str) -> DataFrame:
        value = F.col(column)
        for name, text in by.items():
            value = F.when(F.col("_kind") == name, text).otherwise(value)
        return rows.withColumn(column, value)

    rows = forge("event_type", vocabulary="INVENTED", birth="REINFORCED", rebirth="STORED")
    rows = forge("payload_json", payload='{"a": 1}', seal='{"content_sha256":"none"}')
    rows = forge("created_at", timestamp="2024-01-15 00:00:00", backwards="2000-01-01T00:00:00.000000+00:00")
    marks = rows.select("memory_id", "seq", "_kind")
    built = chains.build(rows.drop("_u", "_kind"), CUSTODY).join(marks, ["memory_id", "seq"])
    built = built.where("_kind <> 'seq'").withColumn("reason", F.when(F.col("_kind") == "hash", "forged").otherwise(F.col("reason")))
    return built.withColumn("prev_hash", F.when(F.col("_kind") == "link", F.sha2("prev_hash", 256)).otherwise(F.col("prev_hash"))).drop("_kind")


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-verify, WIN-dense, WIN-link, WIN-mono, WIN-firsterr, PRD-vocab: the first fault of each chain, of ten kinds."""
    return chains.verify(forged_chain(spark, sf_dir), CUSTODY)


# what was planted is what is found, where the chain is long enough; a missing event shows in the next one
VERIFY_SQL = f"""WITH {v.CHAIN_SQL},
long AS (SELECT memory_id AS subject, substr(memory_id, 3)::INTEGER AS u, count(*) AS n FROM chain GROUP BY memory_id),
placed AS (SELECT *, {list(PLANTED)}[u % 12 + 1] AS error, CASE WHEN u % 12 IN (2, 9) THEN 0 ELSE 1 + (u // 12) % 3 END + CASE WHEN u % 12 = 0 THEN 1 ELSE 0 END AS seq FROM long WHERE u % 12 < 10)
SELECT subject, seq::INTEGER AS seq, error FROM placed WHERE seq < n"""


_STATUS = """
marks AS (SELECT memory_id, seq, event_type FROM part),
sets AS (SELECT memory_id, max(seq) AS s FROM marks WHERE event_type = 'REHABILITATED' GROUP BY 1),
flags AS (SELECT memory_id, max(seq) AS f FROM marks WHERE event_type = 'TAINT_FLAGGED' GROUP BY 1),
status AS (
  SELECT b.memory_id, CASE WHEN f > coalesce(s, -1) THEN 'TAINT_FLAGGED' ELSE 'CLEAN' END AS custody_status
  FROM (SELECT DISTINCT memory_id FROM marks) AS b LEFT JOIN sets USING (memory_id) LEFT JOIN flags USING (memory_id)
)"""


def replay_custody_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-custody."""
    return replay.custody_statuses(v.chain(spark, sf_dir))


# here the state machine is folded event by event
REPLAY_SQL = f"""WITH {v.CHAIN_SQL}
SELECT memory_id, list_reduce(list(event_type ORDER BY seq), lambda s, e: CASE WHEN e = 'REHABILITATED' THEN 'CLEAN'
  WHEN e = 'TAINT_FLAGGED' AND s = 'CLEAN' THEN 'TAINT_FLAGGED' ELSE s END, 'CLEAN') AS custody_status
FROM chain GROUP BY memory_id"""


def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-asof, FLT-asof, FLT-born."""
    return replay.states_at(v.chain(spark, sf_dir), v.ASOF).select("memory_id", "custody_status")


ASOF_SQL = f"WITH {v.CHAIN_SQL}, part AS (SELECT * FROM chain WHERE created_at <= '{v.ASOF}'), {_STATUS} SELECT * FROM status WHERE memory_id IN (SELECT memory_id FROM part WHERE seq = 0)"


def replay_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP-custody's errors: rehabilitations of what was not flagged, reinforcements that do not add up."""
    return replay.custody_errors(v.chain(spark, sf_dir))


ERRORS_SQL = f"""WITH {v.CHAIN_SQL},
run AS (
  SELECT memory_id, seq, event_type, coalesce(max(seq) FILTER (WHERE event_type = 'REHABILITATED') OVER w, -1) AS s, coalesce(max(seq) FILTER (WHERE event_type = 'TAINT_FLAGGED') OVER w, -1) AS f
  FROM chain WINDOW w AS (PARTITION BY memory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT memory_id, seq, 'rehabilitated_from' AS error FROM run WHERE event_type = 'REHABILITATED' AND NOT f > s
UNION ALL SELECT memory_id, seq, unnest(['confidence_before', 'confidence_after']) FROM run WHERE event_type = 'REINFORCED'"""


def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-count, AGG-status-dist."""
    return inventory.distribution(replay.custody_statuses(v.chain(spark, sf_dir)), "custody_status")


DIST_SQL = f"WITH {v.CHAIN_SQL}, part AS (SELECT * FROM chain), {_STATUS} SELECT custody_status, count(*) AS n FROM status GROUP BY 1"


def state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-status-dist over field states."""
    return inventory.distribution(v.vec(spark, sf_dir), "field_state")


STATES_SQL = f"WITH {v.VEC_SQL} SELECT field_state, count(*) AS n FROM vec GROUP BY 1"


def taint_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-sweep, FLT-influence, AGG-sweepgroup: what a sweep of each actor would flag, sealed."""
    return taint.ids_seals(taint.influenced(v.chain(spark, sf_dir)), "actor_id")


_SEAL = """sha256('{"memory_ids":[' || string_agg('"' || memory_id || '"', ',' ORDER BY memory_id) || ']}')"""
SWEEP_SQL = f"""WITH {v.CHAIN_SQL}, hit AS (SELECT DISTINCT actor_id, memory_id FROM chain WHERE event_type NOT IN ('CONTRADICTED_BY', 'DECISION_USED_MEMORY'))
SELECT actor_id, count(*)::INTEGER AS flagged_count, {_SEAL} AS flagged_ids_sha256 FROM hit GROUP BY actor_id"""


def sweep_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-sweep-flag: the recorded sweeps, recounted and resealed from their flags."""
    return taint.sweep_seals(v.chain(spark, sf_dir))


SEALS_SQL = f"""WITH {v.CHAIN_SQL}, hit AS (SELECT DISTINCT payload_json->>'$.sweep_id' AS sweep_id, memory_id FROM chain WHERE event_type = 'TAINT_FLAGGED')
SELECT sweep_id, count(*)::INTEGER AS flagged_count, {_SEAL} AS flagged_ids_sha256 FROM hit GROUP BY sweep_id"""


def sweep_rederive_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-sweep-rederive: flags that the actor's influence before the sweep does not explain, and the reverse."""
    return taint.rederived(_sweeps(v.chain(spark, sf_dir)), v.chain(spark, sf_dir))


def _sweeps(chain: DataFrame) -> DataFrame:
    n = F.substring("actor_id", 3, 2).cast("int")
    return chain.select("actor_id").distinct().select(F.concat(F.lit("s-"), n.cast("string")).alias("sweep_id"), F.col("actor_id").alias("quarantined_actor"), F.concat(F.lit("2024-01-"), F.lpad((n + 5).cast("string"), 2, "0"), F.lit("T00:00:00.000000+00:00")).alias("created_at"))


REDERIVE_SQL = f"""WITH {v.CHAIN_SQL},
sweeps AS (SELECT DISTINCT 's-' || substr(actor_id, 3) AS sweep_id, actor_id, '2024-01-' || lpad((substr(actor_id, 3)::INTEGER + 5)::VARCHAR, 2, '0') || 'T00:00:00.000000+00:00' AS at_ FROM chain),
due AS (SELECT DISTINCT sweep_id, memory_id FROM sweeps JOIN chain USING (actor_id) WHERE created_at <= at_ AND event_type NOT IN ('CONTRADICTED_BY', 'DECISION_USED_MEMORY')),
hit AS (SELECT DISTINCT payload_json->>'$.sweep_id' AS sweep_id, memory_id FROM chain WHERE event_type = 'TAINT_FLAGGED')
SELECT sweep_id, memory_id, CASE WHEN hit.memory_id IS NULL THEN 'MISSED' ELSE 'STRAY' END AS problem
FROM due FULL JOIN hit USING (sweep_id, memory_id) WHERE due.memory_id IS NULL OR hit.memory_id IS NULL"""


def embedding_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-inventory: memories per declared provenance, the undeclared on a row of their own."""
    return inventory.embedding_inventory(_provenance(spark, sf_dir))


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as births: sources are providers, languages models; one in seven declares nothing, and a
    model's vector depends on more than its text."""
    known = F.col("doc_id") % 7 != 0

    def if_known(c) -> F.Column:
        return F.when(known, c)

    docs = v.read(spark, sf_dir, "documents")
    return docs.select(
        v.ident("k-", F.col("doc_id")).alias("memory_id"), if_known(F.col("source")).alias("provider"), if_known(F.col("lang")).alias("model"),
        if_known((F.col("doc_id") % 2).cast("string")).alias("revision"), if_known(F.lit("none")).alias("preprocessing"),
        if_known(F.sha2("text", 256)).alias("input_content_hash"), if_known(F.sha2(F.concat("text", (F.col("doc_id") % 3).cast("string")), 256)).alias("output_vector_hash"),
    )


_PROV_SQL = """prov AS (
  SELECT 'k-' || lpad(doc_id::VARCHAR, 6, '0') AS memory_id, CASE WHEN doc_id % 7 <> 0 THEN source END AS provider, CASE WHEN doc_id % 7 <> 0 THEN lang END AS model,
    CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 2)::VARCHAR END AS revision, CASE WHEN doc_id % 7 <> 0 THEN 'none' END AS preprocessing,
    CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS input_content_hash, CASE WHEN doc_id % 7 <> 0 THEN sha256(text || (doc_id % 3)::VARCHAR) END AS output_vector_hash
  FROM documents
)"""
INVENTORY_SQL = f"WITH {_PROV_SQL} SELECT provider, model, revision, preprocessing, count(*) AS memories FROM prov GROUP BY ALL"


def _one_provider(rows: DataFrame) -> DataFrame:
    """Inputs are compared across providers and revisions."""
    return rows.withColumn("provider", F.when(F.col("provider").isNotNull(), "p")).withColumn("revision", F.when(F.col("provider").isNotNull(), "r"))


def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-drift: one input, one model, several vectors; inputs are compared across providers here."""
    return inventory.embedding_drift(_one_provider(_provenance(spark, sf_dir))).select("model", "input_content_hash", "distinct_vectors", F.array_sort(F.flatten("vectors.members")).alias("members"))


DRIFT_SQL = f"""WITH {_PROV_SQL}
SELECT model, input_content_hash, count(DISTINCT output_vector_hash) AS distinct_vectors, list_sort(list(memory_id)) AS members
FROM prov WHERE provider IS NOT NULL GROUP BY model, input_content_hash HAVING count(DISTINCT output_vector_hash) > 1"""


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-merkle over the heads of all chains."""
    root = inventory.merkle_root(chains.folded_heads(v.chain(spark, sf_dir), CUSTODY), "memory_id")
    return spark.createDataFrame([(root,)], "root string")


# levels of pairs, the odd one moving up, until one is left
MERKLE_SQL = f"""WITH RECURSIVE {v.CHAIN_SQL}, {v.HEADS_SQL},
tree AS (
  SELECT list(sha256(memory_id || ':' || entry_hash) ORDER BY memory_id) AS h FROM heads
  UNION ALL
  SELECT list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h) THEN sha256(h[2 * i + 1] || h[2 * i + 2]) ELSE h[2 * i + 1] END) FROM tree WHERE len(h) > 1
)
SELECT h[1] AS root FROM tree WHERE len(h) = 1"""


def merkle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-merkle with inclusion proofs: for every head, its place and the hashes beside its way to the root."""
    paths = inventory.merkle_paths(chains.folded_heads(v.chain(spark, sf_dir), CUSTODY), "memory_id")
    return paths.select(F.col("id").alias("memory_id"), "place", F.array_join("path", ",").alias("path"))


PATHS_SQL = f"""WITH RECURSIVE {v.CHAIN_SQL}, {v.HEADS_SQL},
tree AS (
  SELECT 0 AS level, list(sha256(memory_id || ':' || entry_hash) ORDER BY memory_id) AS h FROM heads
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h) THEN sha256(h[2 * i + 1] || h[2 * i + 2]) ELSE h[2 * i + 1] END) FROM tree WHERE len(h) > 1
),
leaf AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id) - 1 AS place FROM heads),
step AS (SELECT memory_id, place, level, h, place >> level AS p, xor(place >> level, 1) AS s FROM leaf, tree WHERE len(h) > 1)
SELECT memory_id, place, coalesce(string_agg(CASE WHEN s < p THEN 'L' ELSE 'R' END || h[s + 1], ',' ORDER BY level) FILTER (WHERE s < len(h)), '') AS path FROM step GROUP BY memory_id, place"""


def drift_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-drift: the vectors that one input became, with how many memories hold each."""
    return inventory.drift_vectors(_one_provider(_provenance(spark, sf_dir))).select("model", "input_content_hash", "distinct_vectors", "output_vector_hash", "memories", "first_memory")


_VECTORS_SQL = """
per AS (SELECT model, input_content_hash, output_vector_hash, count(*) AS memories, min(memory_id) AS first_memory FROM prov WHERE provider IS NOT NULL GROUP BY ALL),
vectors AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY model, input_content_hash) AS distinct_vectors FROM per) WHERE distinct_vectors > 1)"""
DRIFT_VECTORS_SQL = f"WITH {_PROV_SQL}, {_VECTORS_SQL} SELECT model, input_content_hash, distinct_vectors, output_vector_hash, memories, first_memory FROM vectors"


def drift_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-drift: every memory whose input drifts, with the first that holds the same vector."""
    return inventory.drift_members(_one_provider(_provenance(spark, sf_dir)))


DRIFT_MEMBERS_SQL = f"""WITH {_PROV_SQL}, {_VECTORS_SQL}
SELECT memory_id, first_memory, p.output_vector_hash FROM prov AS p JOIN vectors AS v ON v.model IS NOT DISTINCT FROM p.model AND v.input_content_hash = p.input_content_hash AND v.output_vector_hash = p.output_vector_hash
WHERE provider IS NOT NULL"""


def decision_use_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-used-events, PRD-subset: uses that only one side records. Decision k claims the memories of users divisible by k + 2."""
    from ..operators.causality import one_sided

    chain = v.chain(spark, sf_dir)
    ids = chain.select("memory_id").distinct().select("memory_id", F.substring("memory_id", 3, 6).cast("int").alias("u"))
    divisors = F.filter(F.sequence(F.lit(0), F.lit(52)), lambda k: F.col("u") % (k + 2) == 0)
    used = ids.withColumn("k", F.explode(divisors)).select(F.concat(F.lit("d-"), F.col("k").cast("string")).alias("decision_id"), "memory_id")
    return one_sided(used, chain)


USE_SQL = f"""WITH {v.CHAIN_SQL},
claimed AS (SELECT DISTINCT 'd-' || k::VARCHAR AS decision_id, memory_id FROM chain, range(53) AS r(k) WHERE substr(memory_id, 3)::INTEGER % (k + 2) = 0),
events_ AS (SELECT DISTINCT payload_json->>'$.decision_id' AS decision_id, memory_id FROM chain WHERE event_type = 'DECISION_USED_MEMORY')
SELECT decision_id, memory_id, CASE WHEN e.memory_id IS NULL THEN 'UNRECORDED' ELSE 'UNCLAIMED' END AS problem
FROM claimed AS c FULL JOIN events_ AS e USING (decision_id, memory_id) WHERE c.memory_id IS NULL OR e.memory_id IS NULL"""


def embedding_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-families: model families, mixing of vector spaces, and drift, over the declared provenance."""
    return inventory.embedding_families(_provenance(spark, sf_dir))


FAMILIES_SQL = f"""WITH {_PROV_SQL},
families AS (SELECT count(*) AS n FROM (SELECT DISTINCT provider, model, revision FROM prov WHERE model IS NOT NULL)),
drifting AS (
  SELECT count(*) AS n FROM (
    SELECT 1 FROM prov WHERE provider IS NOT NULL AND input_content_hash IS NOT NULL
    GROUP BY provider, model, revision, preprocessing, input_content_hash HAVING count(DISTINCT output_vector_hash) > 1)
)
SELECT families.n AS distinct_families, families.n > 1 AS mixing_vector_spaces, drifting.n AS drifting_inputs, drifting.n > 0 AS drift_detected FROM families, drifting"""


def field_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-info: counts that describe a field."""
    chain = v.chain(spark, sf_dir)
    return inventory.field_info(replay.custody_states(chain), chain.select("actor_id").distinct())


INFO_SQL = f"""WITH {v.CHAIN_SQL}, part AS (SELECT * FROM chain), {_STATUS}
SELECT 'custody_status' AS kind, custody_status AS name, count(*)::BIGINT AS n FROM status GROUP BY 2
UNION ALL SELECT 'field_state', 'NEUTRAL', count(*) FROM status
UNION ALL SELECT 'total', 'memories', count(*) FROM status
UNION ALL SELECT 'total', 'actors', count(DISTINCT actor_id) FROM chain"""


QUERIES = {
    "embedding_families": (embedding_families, FAMILIES_SQL), "field_info": (field_info, INFO_SQL),
    "chain_genesis": (chain_genesis, GENESIS_SQL), "chain_heads": (chain_heads, CHAIN_HEADS_SQL), "chain_heads_folded": (chain_heads_folded, FOLDED_SQL), "chain_verify": (chain_verify, VERIFY_SQL),
    "replay_custody_status": (replay_custody_status, REPLAY_SQL), "asof_status": (asof_status, ASOF_SQL), "replay_errors": (replay_errors, ERRORS_SQL),
    "status_distribution": (status_distribution, DIST_SQL), "state_distribution": (state_distribution, STATES_SQL), "taint_sweep": (taint_sweep, SWEEP_SQL), "sweep_seals": (sweep_seals, SEALS_SQL),
    "sweep_rederive_mismatch": (sweep_rederive_mismatch, REDERIVE_SQL), "embedding_inventory": (embedding_inventory, INVENTORY_SQL), "embedding_drift": (embedding_drift, DRIFT_SQL),
    "merkle_root": (merkle_root, MERKLE_SQL), "merkle_paths": (merkle_paths, PATHS_SQL), "drift_vectors": (drift_vectors, DRIFT_VECTORS_SQL), "drift_members": (drift_members, DRIFT_MEMBERS_SQL), "decision_use_violations": (decision_use_violations, USE_SQL),
}
