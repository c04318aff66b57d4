"""One query for each operator of this subpackage, over whole tables with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm import anchor_tree, best_fit, centroids, cover_tree, language_id, neighbour_vote, orc_tokens, permutation_index, piece_codec, simhash, url_trust, viterbi_count, wu_manber
from placewise.llm.shared import crc_of, new_folder, table

ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs, language_id.train(docs)).select("doc_id", held_out, "lang_pred", "score", "accepted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(table(spark, sf_dir, "documents"))


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-orc")
    orc_tokens.write(table(spark, sf_dir, "documents"), folder)
    return orc_tokens.catalogue(spark, folder)


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_viterbi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_count.counts(table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.classes(table(spark, sf_dir, "embeddings"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.classes(table(spark, sf_dir, "documents")))


def op10_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    model = neighbour_vote.train(docs, table(spark, sf_dir, "labels"))
    return neighbour_vote.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op11_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anchor_tree.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.clustered(table(spark, sf_dir, "embeddings")))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_trust, op2_language_id, op3_best_fit_packing, op4_orc_tokens, op5_permutation_index,
        op6_viterbi_count, op7_cover_tree, op8_piece_codec, op9_simhash, op10_neighbour_vote,
        op11_anchor_tree, op12_centroids, op13_wu_manber,
    )
}

_OP11 = """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

_ROUND = """, a{r} AS MATERIALIZED (
  SELECT v.n, v.vec_id, v.x, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]), k := c.k)) AS best
  FROM v CROSS JOIN c{r} c GROUP BY v.n, v.vec_id, v.x
), m{s} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT best.k AS k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY best.k, i
  ) GROUP BY k
), c{s} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{s} m USING (k))"""

_OP12 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INTEGER) AS k, x FROM v QUALIFY k < 40
)""" + "".join(_ROUND.format(r=r, s=r + 1) for r in range(6)) + """
SELECT vec_id, a5.best.k AS cluster, CAST(a5.best.d AS BIGINT) AS distance, CAST(sum(a5.best.d) OVER (PARTITION BY a5.best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a5.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.k = a5.best.k
"""

_OP13 = r"""
WITH words AS (
  SELECT kind, n, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (
    SELECT 'd' AS kind, row_number() OVER () AS n, doc_id AS id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
  )
), patterns AS MATERIALIZED (
  SELECT DISTINCT id AS item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT id, w, least(10, len(w)) AS k FROM words WHERE kind = 'b' AND len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), places AS (
  SELECT n, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT n, w, k FROM words, (SELECT DISTINCT k FROM patterns) WHERE kind = 'd' AND len(w) >= k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), found AS MATERIALIZED (SELECT n, i, k, item_id FROM places JOIN patterns USING (k, s)
), hits AS (SELECT n, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT n, i, k FROM found), LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY n
), items AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY n)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hits USING (n) LEFT JOIN items USING (n) WHERE kind = 'd'
"""

SQL: dict[str, str] = {"op11_anchor_tree": _OP11, "op12_centroids": _OP12, "op13_wu_manber": _OP13}
