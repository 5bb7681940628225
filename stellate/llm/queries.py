"""The queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, cluster, knn, mixing, sentences, spaces


def _points(spark: SparkSession, d: str):
    return table(spark, d, "points"), spaces.read_params(table(spark, d, "vector_params"), table(spark, d, "search_params"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster.clusters(*_points(spark, d)).select("cluster_id", "id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.describe(cluster.clusters(*_points(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(*_points(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p2_found": p2_found, "p2_clusters": p2_clusters, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_shares": p7_shares, "p7_mixture": p7_mixture}

_VALID = """valid AS (
  SELECT id, collection_name AS coll, distance, top_k, score_threshold AS lim, vector::DOUBLE[] AS v FROM (
    SELECT id, max_by(collection_name, version) AS collection_name, arg_max_null(vector, version) AS vector FROM points GROUP BY id)
  JOIN vector_params USING (collection_name) JOIN search_params USING (collection_name)
  WHERE vector IS NOT NULL AND len(vector) = size AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""

_SCORED = """scored AS (
  SELECT a.id, b.id AS near, a.distance IN ('Cosine', 'Dot') AS larger, a.top_k, a.lim, round(CASE a.distance
      WHEN 'Cosine' THEN list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))
      WHEN 'Dot' THEN list_inner_product(a.v, b.v) WHEN 'Euclid' THEN list_distance(a.v, b.v)
      ELSE list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) END, 6) AS score
  FROM valid a JOIN valid b ON a.coll = b.coll AND a.id <> b.id)"""

ORACLES = {
    "p2_found": f"""WITH {_VALID}, {_SCORED}, near AS (
  SELECT id, least(id, min(near)) AS cluster_id FROM scored WHERE CASE WHEN larger THEN score >= lim ELSE score <= lim END GROUP BY id)
SELECT cluster_id, id FROM near""",
    "p5_found": f"""WITH {_VALID}, {_SCORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN larger THEN -score ELSE score END, near) AS n FROM scored)
SELECT DISTINCT least(id, near) AS id_low, greatest(id, near) AS id_high FROM ranked
WHERE n <= top_k AND CASE WHEN larger THEN score >= lim ELSE score <= lim END""",
}
