"""The queries of this subpackage, as __spark_entry__.py registers them.

Each applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, conversation_repair, hamming, line_dedup, mixing, near_dup, packing, pii, secret_scan, sharding, token_count, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rotated_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op11_exponion_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("scanned")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(conversations), conversations)


def op13_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(length(keyed.k) >= 10 AND owner < keyed.doc_id, false) AS lost
  FROM keyed LEFT JOIN owners ON keyed.k = owners.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':1') AS k FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS w, s * 2.0::DOUBLE AS cap, (sum(s) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM per),
stepped AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS rest FROM weighed WINDOW o AS (ORDER BY cap / w, place)),
held AS (SELECT *, caps + (cap / w) * rest <= total AS capped FROM stepped),
target AS (
  SELECT source, s, place, total, CASE WHEN capped THEN cap
    ELSE w * ((total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER ()) END AS target FROM held
), queue AS (
  SELECT doc_id, size, k, s, place, total, target, sum(size) OVER (PARTITION BY place ORDER BY k) AS done
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source
), stream AS (
  SELECT *, CASE WHEN target > 0 THEN (done + s * copy)::DOUBLE / target ELSE 0.0 END AS finish FROM queue, (VALUES (0), (1)) AS c(copy)
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, copy, k ROWS UNBOUNDED PRECEDING) AS spent FROM stream
)
SELECT doc_id, size, s AS source_size, target, sum(CASE WHEN target > 0 AND spent <= floor(total) THEN size ELSE 0 END)::BIGINT AS taken
FROM served GROUP BY doc_id, size, s, target, k, place
"""

USABLE_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, max(v) AS v FROM fine GROUP BY vec_id)"""

NEAREST_SQL = USABLE_SQL + """
, scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i]), lambda a, b: a + b) AS score
  FROM u AS q JOIN u AS x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

HAMMING_SQL = USABLE_SQL + """
, scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         len(list_filter(range(1, len(q.v) + 1), lambda i: (q.v[i] > 0) <> (x.v[i] > 0)))::INTEGER AS distance
  FROM u AS q JOIN u AS x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 20
"""


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
  WHERE c * 10 >= 8 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS doc, doc_id AS root FROM documents
  UNION
  SELECT links.b AS doc, reached.root FROM reached JOIN links ON links.a = reached.doc
)
SELECT doc AS doc_id, min(root) AS class_id, (SELECT count(*) FROM links WHERE links.a = doc) AS n_links
FROM reached GROUP BY doc
"""


#: kind and expression of each rule, in order, with the least length of what counts.
SECRET_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
    ("github", r"(gh[oprsu]_[A-Za-z0-9]+)", 40),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 15),
    ("stripe", r"(sk_live_[A-Za-z0-9]+)", 24),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 27),
)


def _secret_rule(place: int, kind: str, pattern: str, least: int) -> str:
    """Matches with their places: what lies before a match and the matches before it add up to its start."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, row, {place} AS place, '{kind}' AS kind, start, start + length(hit) AS "end" FROM (
    SELECT doc_id, row, unnest(hits) AS hit, unnest(parts) AS part,
      unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)))::BIGINT AS start
    FROM (SELECT doc_id, row, regexp_extract_all(x, '{quoted}') AS hits, regexp_extract_all(x, '{quoted}', 1) AS parts, string_split_regex(x, '{quoted}') AS gaps FROM texts)
  ) WHERE length(part) >= {least}"""


SECRET_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS x FROM documents),
found AS ({" UNION ALL ".join(_secret_rule(i, *rule) for i, rule in enumerate(SECRET_RULES))}),
per AS (
  SELECT row, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) AS spans
  FROM found GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (row)
"""


def _round_sql(n: int) -> str:
    """Assignment n to the centroids of step n - 1, and the centroids of step n, by floored means."""
    return f"""
, a{n} AS MATERIALIZED (
  SELECT row, arg_min(struct_pack(d := d, cluster := cluster), struct_pack(d := d, cluster := cluster)) AS best FROM (
    SELECT row, cluster, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM kept, c{n - 1}
  ) GROUP BY row
), c{n} AS MATERIALIZED (
  SELECT old.cluster, coalesce(new.c, old.c) AS c FROM c{n - 1} AS old LEFT JOIN (
    SELECT cluster, list(m ORDER BY place) AS c FROM (
      SELECT cluster, place, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT best.cluster AS cluster, unnest(x)::BIGINT AS v, generate_subscripts(x, 1) AS place FROM kept JOIN a{n} USING (row)) GROUP BY cluster, place
    ) GROUP BY cluster
  ) AS new ON new.cluster = old.cluster
)"""


CENTROID_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 64)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c0 AS MATERIALIZED (
  SELECT cluster, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster FROM kept) WHERE cluster < 16
){"".join(map(_round_sql, (1, 2, 3, 4)))}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(list_reduce(list_transform(c3.c, lambda v: v::VARCHAR), lambda p, q: p || ',' || q)) AS centroid_sha256
FROM kept JOIN a4 USING (row) JOIN c3 ON c3.cluster = best.cluster
"""


REPAIR_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), codes AS (
  SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(key, '.'), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM (SELECT DISTINCT key FROM raw)
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw JOIN codes USING (key) WHERE fault <> 0
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), seen AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS duplicate, right(body, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before FROM numbered
), turns AS MATERIALIZED (SELECT *, blank OR duplicate AS must, cut AND NOT blank AND NOT duplicate AS truncated FROM seen),
grammar(q, kind, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 2, 2), (3, 3, 0), (3, 2, 1), (3, 3, 2)),
acts AS (
  SELECT q, r, kind, 'K' AS letter, 0 AS price FROM grammar UNION ALL SELECT q, r, kind, 'R', 3 FROM grammar WHERE kind <> 's' UNION ALL SELECT DISTINCT p, p, '', 'D', 4 FROM inserts
), walk(c, n, state, best) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, struct_pack(cost := 0::BIGINT, audit := '') FROM turns
  UNION ALL
  SELECT w.c, w.n + 1, a.r, min(struct_pack(cost := (w.best.cost + 3 * i.k + a.price + CASE WHEN t.truncated AND a.letter <> 'D' THEN 3 ELSE 0 END)::BIGINT, audit := w.best.audit || repeat('I', i.k) || a.letter))
  FROM walk AS w JOIN turns AS t ON t.c = w.c AND t.n = w.n + 1 JOIN inserts AS i ON i.p = w.state JOIN acts AS a ON a.q = i.q AND (a.letter = 'D' OR NOT t.must AND (a.letter = 'R' OR a.kind = t.initial))
  GROUP BY w.c, w.n, a.r
), facts AS (
  SELECT c, conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c, conv_id
), chosen AS (
  SELECT f.c, min(struct_pack(cost := (w.best.cost + 3 * i.k)::BIGINT, audit := w.best.audit || repeat('I', i.k))) AS best
  FROM facts AS f JOIN walk AS w ON w.c = f.c AND w.n = f.rows JOIN inserts AS i ON i.p = w.state AND i.q IN (0, 3) GROUP BY f.c
), letters AS (SELECT c, unnest(regexp_extract_all(best.audit, '.')) AS letter, generate_subscripts(regexp_extract_all(best.audit, '.'), 1) AS pos FROM chosen),
placed AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER o AS n, count(*) FILTER (WHERE letter <> 'D') OVER o AS place FROM letters WINDOW o AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
), kept AS (
  SELECT p.c, p.pos, p.letter, p.place, t.role, t.text, max(CASE WHEN p.place = 1 AND p.letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.c) AS lead
  FROM placed AS p LEFT JOIN turns AS t ON t.c = p.c AND t.n = p.n AND p.letter <> 'I' WHERE p.letter <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS text FROM kept GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen ON chosen.c = facts.c LEFT JOIN repaired ON repaired.c = facts.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_rotated_bit_search": NEAREST_SQL, "op5_ngram_jaccard_join": JACCARD_SQL, "op6_source_mixing": MIX_SQL, "op7_secret_scan": SECRET_SQL, "op9_multi_index_hamming": HAMMING_SQL, "op10_line_dedup": LINE_SQL, "op11_exponion_clustering": CENTROID_SQL, "op12_conversation_repair": REPAIR_SQL}
