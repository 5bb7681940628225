"""The queries of the general data pipeline operators (problems 1, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.changefeed import apply_changes, changes_once
from .operators.copydiff import Compare, diff_copies, paired_copies
from .operators.shred import COUNTRIES, current_rows, shred, tables
from .session import table

POINT_FIELDS = [Compare("vector", "vector", 0.00001), Compare("sparse_text", "sparse"), Compare("payload", "json")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return diff_copies(table(spark, d, "points"), table(spark, d, "points_replica"), "id", POINT_FIELDS, "version", ("only_points", "only_replica"))


def p1_row_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All rows of both copies, old versions too: by id, how many rows pair up with differences and how many stay alone."""
    pairs = paired_copies(table(spark, d, "points"), table(spark, d, "points_replica"), "id", POINT_FIELDS)
    count = lambda side: F.count_if(F.col("side") == side)
    return pairs.groupBy("id").agg(count("both").alias("pairs"), count("left").alias("only_points"), count("right").alias("only_replica"), F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("differing_fields"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = apply_changes(table(spark, d, "update_ops"))
    value = lambda k: F.get_json_object("payload", f"$.{k}")
    return points.select(
        "point_id", F.coalesce(value("city"), F.lit("")).alias("city"), F.coalesce(value("color"), F.lit("")).alias("color"),
        F.coalesce(value("count").cast("long"), F.lit(-1)).alias("item_count"),
        F.coalesce(F.round(F.try_element_at("vector", F.lit(1)).cast("double") * 1000).cast("long"), F.lit(-1)).alias("vec0_milli"),
    )


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many changes of each kind are left once repeated deliveries are dropped."""
    return changes_once(table(spark, d, "update_ops")).groupBy("operation").agg(F.count("*").alias("n"))


def _nodes(spark: SparkSession, d: str, only: set[str] | None = None, leaves: bool = True) -> DataFrame:
    return shred(current_rows(table(spark, d, "nested_points"), "id", "version", ["payload", "wire"]), COUNTRIES, only=only, leaves=leaves)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, leaves=False).select("id", "node_path", "parent_path", "node_name")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All tables in one pass: written partitioned by table, they are the four tables."""
    return _nodes(spark, d)


def _p4_table(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return tables(_nodes(spark, d, {name}), COUNTRIES)[name]

    return query


QUERIES = {
    "p1_found": p1_found, "p1_row_pairs": p1_row_pairs, "p3_found": p3_found, "p3_changes": p3_changes, "p4_found": p4_found, "p4_nodes": p4_nodes,
    **{f"p4_{n}": _p4_table(n) for n in ("countries", "cities", "districts", "sights")},
}

_ONCE = """once AS (
  SELECT *, row_number() OVER (PARTITION BY point_id, clock_tag IS NULL, clock_tag.peer_id, clock_tag.clock_id,
    coalesce(clock_tag.clock_tick, op_seq) ORDER BY op_seq) AS rank
  FROM update_ops WHERE coalesce(clock_tag.clock_tick, -1) <> 0)"""

ORACLES = {
    "p3_found": f"""WITH {_ONCE}, ops AS (
  SELECT *, CASE WHEN clock_tag IS NULL THEN op_seq - 1000000000000 ELSE clock_tag.clock_tick END AS ord FROM once WHERE rank = 1),
life AS (SELECT point_id, max_by(operation, ord) AS last, max(ord) AS born FROM ops
  WHERE operation IN ('upsert_points', 'delete_points') GROUP BY 1),
alive AS (SELECT point_id, born FROM life WHERE last = 'upsert_points'),
vec AS (SELECT o.point_id, arg_max_null(CASE WHEN operation = 'delete_vectors' THEN NULL ELSE vector END, ord) AS vector
  FROM ops o JOIN alive a USING (point_id) WHERE ord >= born AND operation IN ('upsert_points', 'update_vectors', 'delete_vectors') GROUP BY 1),
whole AS (SELECT o.point_id, max(ord) AS since,
    max_by(CASE WHEN operation = 'clear_payload' THEN '{{}}' ELSE coalesce(payload, '{{}}') END, ord) AS payload
  FROM ops o JOIN alive a USING (point_id) WHERE ord >= born AND operation IN ('upsert_points', 'overwrite_payload', 'clear_payload') GROUP BY 1),
keys AS (SELECT unnest(['city', 'color', 'count']) AS k),
touch AS (
  SELECT point_id, since AS ord, k, json_extract_string(payload, k) AS v FROM whole, keys
  UNION ALL
  SELECT o.point_id, ord, k, CASE WHEN operation = 'set_payload' THEN json_extract_string(o.payload, k) END
  FROM ops o JOIN whole w USING (point_id), keys
  WHERE ord > since AND (operation = 'set_payload' AND list_contains(json_keys(o.payload), k)
    OR operation = 'delete_payload' AND list_contains(payload_keys, k))),
state AS (SELECT point_id, k, arg_max_null(v, ord) AS v FROM touch GROUP BY 1, 2)
SELECT point_id, coalesce(max(v) FILTER (WHERE k = 'city'), '') AS city, coalesce(max(v) FILTER (WHERE k = 'color'), '') AS color,
  coalesce(CAST(max(v) FILTER (WHERE k = 'count') AS BIGINT), -1) AS item_count,
  coalesce(CAST(round(CAST(any_value(vector[1]) AS DOUBLE) * 1000) AS BIGINT), -1) AS vec0_milli
FROM state JOIN vec USING (point_id) GROUP BY point_id""",
    "p3_changes": f"WITH {_ONCE} SELECT operation, count(*) AS n FROM once WHERE rank = 1 GROUP BY 1",
}
