"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import chunk_codec, decontamination, hard_negatives, kd_clusters, licences, line_dedup, lm_scoring, near_dedup, quality
from quillstack.llm import secret_scan, suffix_dedup, token_files, toxicity
from quillstack.llm.common import scratch_path, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.round_trip(table(spark, sf_dir, "documents"), word_bpe())


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def op5_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op10_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=2)
    return token_files.read_index(spark, path)


def op11_pq_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op13_kd_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.report(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_compression_bands, op2_benchmark_decontamination, op3_bpe_chunk_reuse, op4_licence_scan, op5_brown_class_bigrams,
        op6_nnpu_toxicity, op7_secret_scan, op8_line_dedup, op9_probminhash_near_dedup, op10_simple8b_token_files,
        op11_pq_hard_negatives, op12_suffix_dedup, op13_kd_tree_clusters, pipeline,
    ]
    return {f.__name__: f for f in own}


#: One window per position, in the contract's words; items of fewer than 13 words are one window.
OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
starts AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, sizes WHERE len(w) >= k),
found AS (
  SELECT r, p, k, item FROM (SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win FROM places) JOIN windows USING (k, win)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP8_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10))
  AS lines FROM documents),
parts AS (SELECT r, d, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM docs),
keyed AS (
  SELECT r, d, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS k
  FROM parts),
losers AS (SELECT k, max(d) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT d) >= 3),
kept AS (SELECT keyed.*, losers.k IS NOT NULL AND d <> keeper AS gone FROM keyed LEFT JOIN losers USING (k)),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10)
  ORDER BY p) FILTER (WHERE NOT gone), '') AS t FROM kept GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(t) AS kept_sha256 FROM docs JOIN joined USING (r)
"""


#: Every anchor with every row, scores as exact sums.
OP11_SQL = """
WITH fine AS (
  SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM fine),
pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM pos p JOIN pairs n ON p.a = n.a WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""


def kd_sql(k: int = 40, rounds: int = 5, length: int = 64) -> str:
    """Plain rounds: every vector with every centroid. DuckDB's // cuts off towards zero, so the floor is taken by the remainder."""
    near = """
a{i} AS MATERIALIZED (
  SELECT r, q, c.n AS cluster, list_sum(list_transform(range(1, {length} + 1), lambda i: (q[i] - c.c[i]) * (q[i] - c.c[i]))) AS d
  FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.n) = 1)"""
    step = """
s{i} AS (SELECT cluster, p, sum(x) AS t, count(*) AS m FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, {length} + 1)) AS p FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT cluster, list(CAST((t - (((t % m) + m) % m)) // m AS BIGINT) ORDER BY p) AS c FROM s{i} GROUP BY cluster),
c{j} AS MATERIALIZED (SELECT n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON n = cluster)"""
    head = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS n, q AS c FROM v QUALIFY n < {k})"""
    tail = """
SELECT v.vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.n = a.cluster"""
    parts = [head] + [near + "," + step for _ in range(rounds)] + [near]
    made = [p.format(i=max(0, n - 1), j=n, k=k, length=length) for n, p in enumerate(parts)]
    return ",".join(made) + tail.format(rounds=rounds)


#: Every string of 100 bytes by its md5, over hexadecimal digits; texts are cut first, as a place far inside one is slow to reach.
OP12_SQL = r"""WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT r, doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM docs),
cut AS (SELECT r, h, unnest(range(0, n, 512)) AS c, n FROM sized WHERE n >= 100),
piece AS (SELECT r, c, n, substr(h, 2 * c + 1, 2 * (512 + 99)) AS h FROM cut),
w AS (SELECT r, c + i AS p, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT r, c, h, unnest(range(0, least(512, n - 99 - c))) AS i FROM piece)),
f AS (SELECT k, min(r * 1099511627776 + p) AS least FROM w GROUP BY k HAVING count(*) > 1),
rep AS (SELECT r, p FROM w JOIN f USING (k) WHERE r * 1099511627776 + p > least),
marked AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS s FROM (
  SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM rep)),
spans AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM marked GROUP BY r, s),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head, max(b) AS last
  FROM gaps JOIN sized USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM sized LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    own = {"op11_pq_hard_negatives": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_kd_tree_clusters": kd_sql()}
    return own | {"op2_benchmark_decontamination": OP2_SQL, "op8_line_dedup": OP8_SQL}
