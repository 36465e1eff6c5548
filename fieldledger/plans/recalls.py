"""Queries over vectors and links: recall, its parts, exposure and counterfactuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import batch_recall, counterfactual, graph, recall, taint, walks
from . import views as v

TOP = 20


def _query(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    memories = v.vec(spark, sf_dir)
    return memories, v.query_vector(memories)


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("d", F.col("d").cast("string")).withColumn("n", F.col("n").cast("string"))


def recall_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-rank, Q-dot: the gate, the exact products and the exact order, without a walk."""
    memories, query = _query(spark, sf_dir)
    rows = recall.candidates(memories, query).withColumn("key", v_key())
    best = recall.top(rows, TOP).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"), "memory_id")))
    return _numbers(best).select("rank", "memory_id", "d", "n")


def v_key():
    from ..functions.vectors import exact_key

    return exact_key("d", "n", F.lit("NEUTRAL"), F.lit(-1), F.lit(0))


_FOUND = f"""
WITH {v.VEC_SQL}, q AS (SELECT vec AS qv FROM vec WHERE vec_id = {v.QUERY_ID}),
found AS (
  SELECT vec.*, {v.dot_sql("vec", "qv")} AS d, {v.dot_sql("vec", "vec")} AS n
  FROM vec, q WHERE custody_status = 'CLEAN' AND field_state <> 'FORGOTTEN'
)"""
_SIM = "CASE WHEN d <= 0 THEN 0 ELSE d::DOUBLE / sqrt(n::DOUBLE) END"

RECALL_SQL = f"""{_FOUND}
SELECT row_number() OVER (ORDER BY {_SIM} DESC, memory_id)::INTEGER AS rank, memory_id, d::VARCHAR AS d, n::VARCHAR AS n
FROM found WHERE n > 0 QUALIFY rank <= {TOP}
"""


def recall_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-gate, FLT-forgotten, AGG-excl, with a hypothetical status in place for one memory."""
    return recall.exclusions(v.vec(spark, sf_dir), {"m-000010": "CLEAN", "m-000013": "QUARANTINED"})


GATE_SQL = f"""WITH {v.VEC_SQL},
world AS (SELECT CASE memory_id WHEN 'm-000010' THEN 'CLEAN' WHEN 'm-000013' THEN 'QUARANTINED' ELSE custody_status END AS s, field_state FROM vec)
SELECT count(*) FILTER (WHERE s <> 'CLEAN') AS excluded_custody, count(*) FILTER (WHERE s = 'CLEAN' AND field_state = 'FORGOTTEN') AS excluded_forgotten FROM world
"""


def seed_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-argmax."""
    memories, query = _query(spark, sf_dir)
    return _numbers(recall.seed_of(recall.candidates(memories, query))).select("memory_id", "d", "n")


SEED_SQL = f"{_FOUND} SELECT memory_id, d::VARCHAR AS d, n::VARCHAR AS n FROM found ORDER BY {_SIM} DESC, memory_id LIMIT 1"


def recall_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-recall, JN-bfs, AGG-boost, Q-bfs, Q-rescue, Q-score: the whole recall with two hops."""
    memories, query = _query(spark, sf_dir)
    links = v.edges(spark, sf_dir)
    found = recall.candidates(memories, query)
    seed = recall.seed_of(found).head()["memory_id"]
    marks = recall.walk(recall.live_links(links, recall.gated(memories)), seed, 2)
    best = recall.top(recall.scored(found, marks), TOP)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"), "memory_id"))).select("rank", "memory_id", "hop", "resonant", "rescued")


# two hops written out level by level; within a level the earlier id suppresses the later
HOPS_SQL = f"""{_FOUND}, {v.EDGES_SQL},
seed AS (SELECT memory_id AS id FROM found ORDER BY {_SIM} DESC, memory_id LIMIT 1),
servable AS (SELECT memory_id FROM vec WHERE custody_status = 'CLEAN'),
live AS (SELECT * FROM edges WHERE from_id IN (SELECT memory_id FROM servable) AND to_id IN (SELECT memory_id FROM servable)),
o0 AS (SELECT to_id, link_type FROM live, seed WHERE from_id = seed.id),
i0 AS (SELECT to_id FROM o0 WHERE link_type = 'INHIBITORY'),
l1 AS (SELECT DISTINCT to_id AS id FROM o0, seed WHERE link_type = 'RESONANT' AND to_id <> seed.id AND to_id NOT IN (SELECT to_id FROM i0)),
v1 AS (SELECT id FROM l1),
o1 AS (SELECT from_id, to_id, link_type FROM live JOIN v1 ON from_id = v1.id),
i1 AS (SELECT to_id FROM i0 UNION SELECT to_id FROM o1 WHERE link_type = 'INHIBITORY'),
l2 AS (SELECT DISTINCT to_id AS id FROM o1, seed WHERE link_type = 'RESONANT' AND to_id <> seed.id AND to_id NOT IN (SELECT id FROM v1) AND to_id NOT IN (SELECT to_id FROM i1)),
o2 AS (SELECT from_id, to_id, link_type FROM live JOIN l2 ON from_id = l2.id),
i2 AS (SELECT to_id FROM i1 UNION SELECT to_id FROM o2 WHERE link_type = 'INHIBITORY'),
hop AS (SELECT id, 0 AS hop FROM seed UNION ALL SELECT id, 1 FROM v1 UNION ALL SELECT id, 2 FROM l2),
boost AS (
  SELECT to_id, count(*) AS k FROM (SELECT to_id, link_type FROM o0 UNION ALL SELECT to_id, link_type FROM o1 UNION ALL SELECT to_id, link_type FROM o2)
  WHERE link_type = 'RESONANT' GROUP BY to_id
),
marked AS (
  SELECT found.*, coalesce(hop.hop, -1) AS hop, coalesce(k, 0) AS k,
    memory_id IN (SELECT to_id FROM i2) AND memory_id <> (SELECT id FROM seed) AS inhibited
  FROM found LEFT JOIN hop ON hop.id = memory_id LEFT JOIN boost ON boost.to_id = memory_id WHERE n > 0
)
SELECT row_number() OVER (ORDER BY CASE WHEN d <= 0 THEN 0 ELSE d::DOUBLE / sqrt(n::DOUBLE)
    * (CASE field_state WHEN 'REINFORCED' THEN 1.5 ELSE 1.0 END * CASE WHEN hop > 0 THEN power(0.86, hop) ELSE 1 END + 0.5 * k) END DESC, memory_id)::INTEGER AS rank,
  memory_id, hop::INTEGER AS hop, k::INTEGER AS resonant, inhibited AS rescued
FROM marked WHERE NOT inhibited OR field_state = 'REINFORCED' QUALIFY rank <= {TOP}
"""


def ordered_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-bfs, Q-bfs: ordered walks of 0, 2 and 4 hops from every fiftieth memory, the hub of a third of the links among them."""
    links = v.dense_edges(spark, sf_dir)
    seeds = v.vec(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("memory_id").alias("walk"), "memory_id")
    found = [walks.walks(links, seeds, hops).withColumn("hops", F.lit(hops)) for hops in (0, 2, 4)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def walk_sql(name: str, hops: str, links: str, seeds: str) -> str:
    """The walk node by node: a queue in order, what lies ahead, what is visited, and what is inhibited."""
    return f"""
{name}_adj AS MATERIALIZED (
  SELECT from_id, list(to_id) FILTER (WHERE link_type = 'INHIBITORY') AS inh, list(to_id) FILTER (WHERE link_type <> 'INHIBITORY') AS next, list(to_id) FILTER (WHERE link_type = 'RESONANT') AS res
  FROM {links} GROUP BY from_id
),
{name}_run(walk, depth, todo, ahead, seen, at_hop, inhibited, res) USING KEY (walk) AS (
  SELECT walk, 0, [memory_id], []::VARCHAR[], []::VARCHAR[], []::INTEGER[], []::VARCHAR[], []::VARCHAR[] FROM {seeds}
  UNION
  SELECT walk, CASE WHEN len(todo) = 0 THEN depth + 1 ELSE depth END,
    CASE WHEN len(todo) = 0 THEN list_sort(list_filter(list_distinct(ahead), lambda x: NOT list_contains(seen, x) AND NOT list_contains(inhibited, x))) ELSE todo[2:] END,
    CASE WHEN len(todo) = 0 THEN [] WHEN fresh THEN ahead || coalesce(a.next, []) ELSE ahead END, CASE WHEN fresh THEN seen || [todo[1]] ELSE seen END, CASE WHEN fresh THEN at_hop || [depth] ELSE at_hop END,
    CASE WHEN fresh THEN inhibited || coalesce(a.inh, []) ELSE inhibited END, CASE WHEN fresh THEN s.res || coalesce(a.res, []) ELSE s.res END
  FROM (SELECT *, len(todo) > 0 AND NOT list_contains(seen, todo[1]) AND NOT list_contains(inhibited, todo[1]) AS fresh FROM {name}_run) AS s LEFT JOIN {name}_adj AS a ON a.from_id = todo[1]
  WHERE len(todo) > 0 OR (len(ahead) > 0 AND depth < {hops})
),
{name} AS (
  SELECT walk, memory_id, max(hop)::INTEGER AS hop, sum(r)::INTEGER AS resonant, max(i) = 1 AND max(hop) <> 0 AS inhibited FROM (
    SELECT walk, unnest(seen) AS memory_id, unnest(at_hop) AS hop, 0 AS r, 0 AS i FROM {name}_run
    UNION ALL SELECT walk, unnest(res), -1, 1, 0 FROM {name}_run UNION ALL SELECT walk, unnest(inhibited), -1, 0, 1 FROM {name}_run
    UNION ALL SELECT walk, unnest(a.next), -1, 0, 0 FROM (SELECT walk, unnest(seen) AS id FROM {name}_run) JOIN {name}_adj AS a ON a.from_id = id
  ) GROUP BY walk, memory_id
)"""


WALK_SQL = f"""WITH RECURSIVE {v.VEC_SQL}, {v.DENSE_SQL}, seeds AS (SELECT memory_id AS walk, memory_id FROM vec WHERE vec_id % 50 = 0),
{walk_sql("w0", "0", "dense", "seeds")}, {walk_sql("w2", "2", "dense", "seeds")}, {walk_sql("w4", "4", "dense", "seeds")}
SELECT *, 0 AS hops FROM w0 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 4 FROM w4"""


def recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-recall, SRT-rank, Q-score for every twentieth memory as a query: whole recalls with two hops, at once."""
    memories = v.vec(spark, sf_dir)
    queries = memories.where("vec_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "vec")
    found = batch_recall.recall_all(memories, v.dense_edges(spark, sf_dir), queries, TOP, 2)
    return _numbers(found).select("query_id", "rank", "memory_id", "d", "n", "hop", "resonant", "rescued")


_SCORE = f"""CASE WHEN d <= 0 THEN 0 ELSE d::DOUBLE / sqrt(n::DOUBLE)
    * (CASE field_state WHEN 'REINFORCED' THEN 1.5 ELSE 1.0 END * CASE WHEN hop > 0 THEN power(0.86, hop) ELSE 1 END + 0.5 * resonant) END"""

BATCH_SQL = f"""WITH RECURSIVE {v.VEC_SQL}, {v.DENSE_SQL},
q AS (SELECT memory_id AS query_id, vec AS qv FROM vec WHERE vec_id % 20 = 0),
found AS MATERIALIZED (
  SELECT query_id, memory_id, field_state, {v.dot_sql("vec", "qv")} AS d, {v.dot_sql("vec", "vec")} AS n FROM vec, q WHERE custody_status = 'CLEAN' AND field_state <> 'FORGOTTEN'
),
seeds AS (SELECT query_id AS walk, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, memory_id) AS r FROM found WHERE n > 0) WHERE r = 1),
clean AS (SELECT memory_id FROM vec WHERE custody_status = 'CLEAN'),
live AS (SELECT * FROM dense WHERE from_id IN (SELECT memory_id FROM clean) AND to_id IN (SELECT memory_id FROM clean)),
{walk_sql("w", "2", "live", "seeds")},
marked AS (
  SELECT found.*, coalesce(w.hop, -1) AS hop, coalesce(w.resonant, 0) AS resonant, coalesce(w.inhibited, false) AS inhibited
  FROM found LEFT JOIN w ON w.walk = query_id AND w.memory_id = found.memory_id WHERE n > 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE} DESC, memory_id)::INTEGER AS rank, memory_id, d::VARCHAR AS d, n::VARCHAR AS n, hop::INTEGER AS hop, resonant::INTEGER AS resonant, inhibited AS rescued
FROM marked WHERE NOT inhibited OR field_state = 'REINFORCED' QUALIFY rank <= {TOP}
"""


def embedding_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float ingestion: every component as a whole multiple of 10**-10."""
    return v.vec(spark, sf_dir).select("memory_id", F.posexplode("vec").alias("place", "units"))


QUANTIZE_SQL = f"WITH {v.VEC_SQL} SELECT memory_id, (generate_subscripts(vec, 1) - 1)::INTEGER AS place, unnest(vec) AS units FROM vec"


def link_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-linkgate: links both of whose ends are servable."""
    return recall.live_links(v.edges(spark, sf_dir), recall.gated(v.vec(spark, sf_dir)))


LINK_SQL = f"""WITH {v.VEC_SQL}, {v.EDGES_SQL}, ok AS (SELECT memory_id FROM vec WHERE custody_status = 'CLEAN')
SELECT * FROM edges WHERE from_id IN (SELECT memory_id FROM ok) AND to_id IN (SELECT memory_id FROM ok)"""


def influence_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-exposure, Q-level, AGG-maxpath: graded exposure to all that is flagged or quarantined."""
    memories = v.vec(spark, sf_dir)
    return graph.graded(memories, v.edges(spark, sf_dir), graph.tainted(memories))


EXPOSURE_SQL = f"""WITH RECURSIVE {v.VEC_SQL}, {v.EDGES_SQL},
src AS (SELECT memory_id FROM vec WHERE custody_status IN ('TAINT_FLAGGED', 'QUARANTINED')),
reach AS (
  SELECT memory_id AS id, 0 AS depth FROM src
  UNION SELECT to_id, depth + 1 FROM reach JOIN edges ON from_id = id WHERE link_type = 'RESONANT' AND depth < 6
),
best AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)
SELECT memory_id, CASE WHEN depth = 0 THEN 'DIRECT_TAINT' WHEN depth > 0 THEN 'EXPOSED' ELSE 'CLEAN' END AS level,
  CASE WHEN depth > 0 THEN '1/' || (1 << depth)::VARCHAR END AS budget
FROM vec LEFT JOIN best ON id = memory_id"""


def resonant_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-neighbours: one resonant link away from what is flagged, and not flagged."""
    flagged = v.vec(spark, sf_dir).where("custody_status = 'TAINT_FLAGGED'").select("memory_id")
    return taint.resonant_neighbours(v.edges(spark, sf_dir), flagged)


NEIGHBOURS_SQL = f"""WITH {v.VEC_SQL}, {v.EDGES_SQL}, flagged AS (SELECT memory_id FROM vec WHERE custody_status = 'TAINT_FLAGGED')
SELECT DISTINCT to_id AS memory_id FROM edges WHERE link_type = 'RESONANT'
  AND from_id IN (SELECT memory_id FROM flagged) AND to_id NOT IN (SELECT memory_id FROM flagged)"""


def counterfactual_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-worlds: what changes if the four nearest memories were quarantined."""
    memories, query = _query(spark, sf_dir)
    key = F.row_number().over(Window.orderBy(F.desc("key"), "memory_id")) - 1

    def world(override: dict[str, str]) -> DataFrame:
        rows = recall.candidates(memories, query, override).withColumn("key", v_key())
        return recall.top(rows, TOP).select("memory_id", key.cast("int").alias("rank"), F.col("d").cast("string").alias("score"))

    near = [r["memory_id"] for r in world({}).where("rank < 4").collect()]
    return counterfactual.difference(world({}), world({m: "QUARANTINED" for m in near}))


DELTA_SQL = f"""{_FOUND},
a AS (SELECT memory_id, d, row_number() OVER (ORDER BY {_SIM} DESC, memory_id) - 1 AS r FROM found QUALIFY r < {TOP}),
b AS (SELECT memory_id, d, row_number() OVER (ORDER BY {_SIM} DESC, memory_id) - 1 AS r FROM found WHERE memory_id NOT IN (SELECT memory_id FROM a WHERE r < 4) QUALIFY r < {TOP})
SELECT CASE WHEN b.r IS NULL THEN 'REMOVED' WHEN a.r IS NULL THEN 'ENTERED' ELSE 'RANK_CHANGED' END AS change, coalesce(a.memory_id, b.memory_id) AS memory_id,
  CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN a.r::VARCHAR END AS a, CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN b.r::VARCHAR END AS b
FROM a FULL JOIN b ON a.memory_id = b.memory_id WHERE a.r IS DISTINCT FROM b.r"""


WORLD_A, WORLD_B = {"m-000010": "CLEAN", "m-000017": "QUARANTINED"}, {"m-000003": "QUARANTINED", "m-000011": "CLEAN", "m-000024": "SUPERSEDED"}


def worlds_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-compare: two worlds gated, walked and ranked in one plan; what is served, claimed and rested upon differs. Labels are topics."""
    memories, query = _query(spark, sf_dir)
    births = memories.select("memory_id", F.concat(F.lit("t-"), F.col("label").cast("string")).alias("topic"), F.col("memory_id").alias("claim"))
    used = memories.select(F.concat(F.lit("d-"), F.floor(F.col("vec_id") / 3).cast("string")).alias("decision_id"), "memory_id")
    found = counterfactual.compared(memories, v.dense_edges(spark, sf_dir), births, used, query, WORLD_A, WORLD_B, TOP, 2)
    shown = F.col("change") != "SCORE_CHANGED"  # scores are shown at ten places, which SQL has not
    return found.select("change", "subject", F.when(shown, F.col("a")).alias("a"), F.when(shown, F.col("b")).alias("b"))


def _world_sql(name: str, override: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in override.items())
    return f"""
{name}_status AS (SELECT *, CASE memory_id {cases} ELSE custody_status END AS status FROM vec),
{name}_found AS MATERIALIZED (SELECT w.*, {v.dot_sql("vec", "qv")} AS d, {v.dot_sql("vec", "vec")} AS n FROM {name}_status AS w, q WHERE status = 'CLEAN' AND field_state <> 'FORGOTTEN'),
{name}_seed AS (SELECT '{name}' AS walk, memory_id FROM {name}_found WHERE n > 0 ORDER BY {_SIM} DESC, memory_id LIMIT 1),
{name}_clean AS (SELECT memory_id FROM {name}_status WHERE status = 'CLEAN'),
{name}_live AS (SELECT * FROM dense WHERE from_id IN (SELECT memory_id FROM {name}_clean) AND to_id IN (SELECT memory_id FROM {name}_clean)),
{walk_sql(f"{name}_walk", "2", f"{name}_live", f"{name}_seed")},
{name}_marked AS (SELECT f.*, coalesce(w.hop, -1) AS hop, coalesce(w.resonant, 0) AS resonant, coalesce(w.inhibited, false) AS inhibited FROM {name}_found AS f LEFT JOIN {name}_walk AS w ON w.memory_id = f.memory_id WHERE n > 0),
{name} AS (
  SELECT memory_id, label, d, hop, resonant, row_number() OVER (ORDER BY {_SCORE} DESC, memory_id) - 1 AS r FROM {name}_marked WHERE NOT inhibited OR field_state = 'REINFORCED' QUALIFY r < {TOP}
),
{name}_won AS (SELECT 't-' || label::VARCHAR AS topic, arg_min(memory_id, r) AS claim FROM {name} GROUP BY label)"""


WORLDS_SQL = f"""WITH RECURSIVE {v.VEC_SQL}, {v.DENSE_SQL}, q AS (SELECT vec AS qv FROM vec WHERE vec_id = {v.QUERY_ID}), {_world_sql("wa", WORLD_A)}, {_world_sql("wb", WORLD_B)},
pairs AS (
  SELECT coalesce(a.memory_id, b.memory_id) AS subject, a.r AS ra, b.r AS rb, CASE WHEN b.r IS NULL THEN 'REMOVED' WHEN a.r IS NULL THEN 'ENTERED' WHEN a.r <> b.r THEN 'RANK_CHANGED'
    WHEN a.d > 0 AND (greatest(a.hop, 0), a.resonant) <> (greatest(b.hop, 0), b.resonant) THEN 'SCORE_CHANGED' END AS change FROM wa AS a FULL JOIN wb AS b ON a.memory_id = b.memory_id
)
SELECT change, subject, CASE WHEN change = 'RANK_CHANGED' THEN ra::VARCHAR END AS a, CASE WHEN change = 'RANK_CHANGED' THEN rb::VARCHAR END AS b FROM pairs WHERE change IS NOT NULL
UNION ALL SELECT 'CLAIM_CHANGED', coalesce(a.topic, b.topic), coalesce(a.claim, ''), coalesce(b.claim, '') FROM wa_won AS a FULL JOIN wb_won AS b ON a.topic = b.topic WHERE a.claim IS DISTINCT FROM b.claim
UNION ALL SELECT DISTINCT 'DECISION', 'd-' || (a.vec_id // 3)::VARCHAR, NULL, NULL FROM wa_status AS a JOIN wb_status AS b ON a.memory_id = b.memory_id WHERE (a.status = 'CLEAN') <> (b.status = 'CLEAN')"""


def worlds_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-servable: the memories that exactly one of two worlds serves."""
    return counterfactual.moved(v.vec(spark, sf_dir), {"m-000010": "CLEAN"}, {"m-000013": "QUARANTINED", "m-000014": "CLEAN"})


MOVED_SQL = f"""WITH {v.VEC_SQL}
SELECT memory_id FROM vec WHERE (CASE memory_id WHEN 'm-000010' THEN 'CLEAN' ELSE custody_status END = 'CLEAN')
  <> (CASE memory_id WHEN 'm-000013' THEN 'QUARANTINED' WHEN 'm-000014' THEN 'CLEAN' ELSE custody_status END = 'CLEAN')"""


def claim_topic_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-claimwin, WIN-topicwin: the first served memory's claim on each topic; labels are topics."""
    from ..operators.claims import topic_winners

    memories, query = _query(spark, sf_dir)
    best = recall.top(recall.candidates(memories, query).withColumn("key", v_key()), TOP)
    rank = F.row_number().over(Window.orderBy(F.desc("key"), "memory_id"))
    return topic_winners(best.select(rank.alias("rank"), F.concat(F.lit("t-"), F.col("label").cast("string")).alias("topic"), "memory_id").withColumnRenamed("memory_id", "claim"))


TOPIC_SQL = f"""{_FOUND}, best AS (SELECT memory_id, label, row_number() OVER (ORDER BY {_SIM} DESC, memory_id) AS r FROM found QUALIFY r <= {TOP})
SELECT 't-' || label::VARCHAR AS topic, arg_min(memory_id, r) AS claim FROM best GROUP BY label"""

QUERIES = {
    "recall_topk_exact": (recall_topk_exact, RECALL_SQL), "recall_gate_counts": (recall_gate_counts, GATE_SQL), "seed_argmax": (seed_argmax, SEED_SQL),
    "recall_hops": (recall_hops, HOPS_SQL), "ordered_walk": (ordered_walk, WALK_SQL), "recall_batch": (recall_batch, BATCH_SQL), "embedding_quantize": (embedding_quantize, QUANTIZE_SQL), "link_gate": (link_gate, LINK_SQL),
    "influence_exposure": (influence_exposure, EXPOSURE_SQL), "resonant_neighbours": (resonant_neighbours, NEIGHBOURS_SQL),
    "counterfactual_delta": (counterfactual_delta, DELTA_SQL), "worlds_moved": (worlds_moved, MOVED_SQL), "worlds_compared": (worlds_compared, WORLDS_SQL), "claim_topic_winner": (claim_topic_winner, TOPIC_SQL),
}
