"""A query for each operator of the engine, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection, Dense, Sparse
from .functions.text import TextIndex, bm25_embedding, bm25_weights, tokens
from .operators import aggregate, batch, ivf, mutate, quantize, recall, scroll, sparse
from .operators.shred import plain_json
from .plans.query import discover, query, query_batch, recommend
from .session import table
from .sources.catalog import newest_versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, made: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = made
    if sql is not None:
        ORACLES[name] = sql


# Collections -------------------------------------------------------------------------------------------------------------


def embeddings(spark: SparkSession, d: str, distance: str = "Cosine") -> Collection:
    return Collection(table(spark, d, "embeddings"), "vec_id", {"": Dense("embedding", 64, distance)})


def points(spark: SparkSession, d: str, vectors: bool = False, idf: bool = False, **index) -> Collection:
    """The current rows of all collections of points; their payload is JSON. A version's row is chosen as a whole, so only what is used is read."""
    df = newest_versions(table(spark, d, "points").select("id", "version", "payload", *(["vector", "sparse_text"] if vectors else [])))
    dense, sparse_ = ({"": Dense("vector", 64)}, {"text": Sparse("sparse_text", idf)}) if vectors else ({}, {})
    return Collection(df, "id", dense, sparse_, "payload", index=index)


def multi(spark: SparkSession, d: str) -> Collection:
    """Points of several vectors each: embeddings put together by the rest of their ids."""
    rows = table(spark, d, "embeddings").withColumn("id", F.col("vec_id") % 50)
    df = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return Collection(df, "id", {"": Dense("vectors", 64, "Cosine", multi=True)})


def _vectors(c: Collection, ids: list[int]) -> dict[int, list[float]]:
    column = c.vector("").column
    return {r[0]: list(r[1]) for r in c.df.where(F.col(c.id).isin(ids)).select(c.id, column).collect()}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 5) for n in names or ("score",)})


_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_P = "p AS (SELECT id, max_by(payload, version) AS payload FROM (SELECT id, version, coalesce(payload, 'null') AS payload FROM points) GROUP BY id)"
_SIM = {
    "Cosine": "(list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})))",
    "Dot": "list_inner_product({a}, {b})",
    "Euclid": "list_distance({a}, {b})",
    "Manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
}


def _cos(n: int) -> str:
    """SQL of the similarity to one embedding."""
    return _SIM["Cosine"].format(a="e.v", b=f"(SELECT v FROM e WHERE id = {n})")


_FS, _SIG = "({x}) / (1 + abs({x}))", "0.5 * (({x}) / (1 + abs({x})) + 1)"
_LABELS = {"must": [{"key": "label", "match": {"any": [1, 2, 3]}}]}

# Nearest, thresholds, pages ----------------------------------------------------------------------------------------------

for _d in _SIM:
    _order = "score DESC, id DESC" if _d in ("Cosine", "Dot") else "score, id"
    _add(
        f"v1_nearest_{_d.lower()}",
        lambda s, d, k=_d: _rounded(query(embeddings(s, d, k), {"query": 0, "filter": _LABELS, "limit": 10})),
        f"WITH {_E}, s AS (SELECT id, {_SIM[_d].format(a='e.v', b='(SELECT v FROM e WHERE id = 0)')} AS score FROM e WHERE label IN (1, 2, 3) AND id <> 0) SELECT id, round(score, 5) AS score FROM s ORDER BY {_order} LIMIT 10",
    )
_add("t3_offset", lambda s, d: _rounded(query(embeddings(s, d), {"query": 0, "limit": 5, "offset": 5})), f"WITH {_E}, s AS (SELECT id, {_cos(0)} AS score FROM e WHERE id <> 0) SELECT id, round(score, 5) AS score FROM s ORDER BY score DESC, id DESC LIMIT 5 OFFSET 5")
_add("t6_score_threshold", lambda s, d: _rounded(query(embeddings(s, d), {"query": 0, "limit": None, "score_threshold": 0.1})), f"WITH {_E} SELECT id, round({_cos(0)}, 5) AS score FROM e WHERE id <> 0 AND {_cos(0)} > 0.1")
_add("p4_with_payload", lambda s, d: _rounded(query(embeddings(s, d), {"query": 3, "limit": 7, "with_payload": True})), f"WITH {_E}, s AS (SELECT id, {_cos(3)} AS score, label FROM e WHERE id <> 3) SELECT id, round(score, 5) AS score, label FROM s ORDER BY score DESC, id DESC LIMIT 7")
QUERIES["r1_with_payload"], ORACLES["r1_with_payload"] = QUERIES.pop("p4_with_payload"), ORACLES.pop("p4_with_payload")
_add("r2_nearest_batch", lambda s, d: _rounded(batch.nearest_batch(embeddings(s, d), _vectors(embeddings(s, d), list(range(20))), 5)), f"WITH {_E}, q AS (SELECT id AS query_id, v AS qv FROM e WHERE id < 20), s AS (SELECT query_id, id, {_SIM['Cosine'].format(a='e.v', b='qv')} AS score FROM e, q) SELECT query_id, id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 5")


def _nearest_all(spark: SparkSession, d: str) -> DataFrame:
    c = embeddings(spark, d)
    return _rounded(batch.nearest_join(c, c.df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5))


_add("r2_nearest_batch_all", _nearest_all, ORACLES["r2_nearest_batch"].replace("id < 20", "id % 50 = 0"))

# Objectives --------------------------------------------------------------------------------------------------------------


def _best(sql: str, ids: str, k: int = 10, order: str = "score DESC, id DESC", extra: str = "") -> str:
    return f"WITH {_E}{extra}, s AS (SELECT id, {sql} AS score FROM e WHERE id NOT IN ({ids})) SELECT id, round(score, 5) AS score FROM s ORDER BY {order} LIMIT {k}"


_AVG = ", mean AS (SELECT list(2 * (a.v[i] + b.v[i]) / 2 - c.v[i] ORDER BY i) AS v FROM (SELECT v FROM e WHERE id = 1) a, (SELECT v FROM e WHERE id = 2) b, (SELECT v FROM e WHERE id = 3) c, range(1, 65) t(i))"
_add("v5_reco_average", lambda s, d: _rounded(recommend(embeddings(s, d), [1, 2], [3])), _best(_SIM["Cosine"].format(a="e.v", b="(SELECT v FROM mean)"), "1, 2, 3", extra=_AVG))
_pos, _neg = f"greatest({_cos(1)}, {_cos(2)})", f"greatest({_cos(3)}, {_cos(4)})"
_add("v6_reco_best_score", lambda s, d: _rounded(recommend(embeddings(s, d), [1, 2], [3, 4], "best_score")), _best(f"CASE WHEN {_pos} > {_neg} THEN {_SIG.format(x=_pos)} ELSE -({_SIG.format(x=_neg)}) END", "1, 2, 3, 4"))
_add("v7_reco_sum_scores", lambda s, d: _rounded(recommend(embeddings(s, d), [1, 2], [3, 4], "sum_scores")), _best(f"{_cos(1)} + {_cos(2)} - {_cos(3)} - {_cos(4)}", "1, 2, 3, 4"))
_PAIRS = [{"positive": 1, "negative": 2}, {"positive": 3, "negative": 4}]
_add("v8_discover", lambda s, d: _rounded(discover(embeddings(s, d), 0, _PAIRS)), _best(f"sign({_cos(1)} - {_cos(2)}) + sign({_cos(3)} - {_cos(4)}) + {_SIG.format(x=_cos(0))}", "0, 1, 2, 3, 4"))
_far = [f"least({_cos(a)} - {_cos(b)} - 1.1920928955078125e-07, 0)" for a, b in ((1, 2), (3, 4))]
_add("v9_context", lambda s, d: _rounded(discover(embeddings(s, d), None, _PAIRS, limit=None)), f"WITH {_E} SELECT id, round({' + '.join(_FS.format(x=x) for x in _far)}, 5) AS score FROM e WHERE id NOT IN (1, 2, 3, 4)")
_FEED = {"relevance_feedback": {"target": 0, "feedback": [{"example": 1, "score": 0.9}, {"example": 2, "score": 0.5}, {"example": 3, "score": 0.1}], "strategy": {"naive": {"a": 1.0, "b": 0.5, "c": 0.25}}}}
_add("v10_relevance_feedback", lambda s, d: _rounded(query(embeddings(s, d), {"query": _FEED})), _best(f"{_cos(0)} + 0.25 * (pow(0.4, 0.5) * ({_cos(1)} - {_cos(2)}) + pow(0.8, 0.5) * ({_cos(1)} - {_cos(3)}) + pow(0.4, 0.5) * ({_cos(2)} - {_cos(3)}))", "0, 1, 2, 3"))
_add("v19_no_query", lambda s, d: query(embeddings(s, d), {"filter": _LABELS, "limit": 25}), "SELECT vec_id AS id, 1.0::DOUBLE AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY id LIMIT 25")
_add("v18_sample", lambda s, d: query(embeddings(s, d), {"query": {"sample": "random"}, "limit": 10, "seed": 1}))
_LIKE = _SIM["Cosine"].format(a="c.v", b="{}.v")
_add(
    "v13_mmr",
    lambda s, d: _rounded(query(embeddings(s, d), {"query": {"nearest": 0, "mmr": {"diversity": 0.4, "candidates_limit": 50}}, "limit": 3})),
    f"""WITH {_E}, c AS (SELECT id, v, {_cos(0)} AS score FROM e WHERE id <> 0 ORDER BY score DESC, id DESC LIMIT 50),
x AS (SELECT * FROM c ORDER BY score DESC LIMIT 1),
y AS (SELECT c.* FROM c, x WHERE c.id <> x.id ORDER BY 0.6 * c.score - 0.4 * {_LIKE.format('x', 'x', 'x')} DESC LIMIT 1),
z AS (SELECT c.* FROM c, x, y WHERE c.id NOT IN (x.id, y.id)
  ORDER BY 0.6 * c.score - 0.4 * greatest({_LIKE.format('x', 'x', 'x')}, {_LIKE.format('y', 'y', 'y')}) DESC LIMIT 1)
SELECT id, round(score, 5) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z)""",
)

# Prefetch, fusion, formula -----------------------------------------------------------------------------------------------

_TWO = [{"query": 0, "limit": 30}, {"query": 1, "limit": 20, "filter": _LABELS}]
_LISTS = f"""{_E}, a AS (SELECT id, {_cos(0)} AS score FROM e WHERE id NOT IN (0, 1) ORDER BY score DESC, id DESC LIMIT 30),
b AS (SELECT id, {_cos(1)} AS score FROM e WHERE id NOT IN (0, 1) AND label IN (1, 2, 3) ORDER BY score DESC, id DESC LIMIT 20)"""


def _fused(part_a: str, part_b: str) -> str:
    rank = "row_number() OVER (ORDER BY score DESC, id DESC) - 1"
    return f"""WITH {_LISTS}, ra AS (SELECT *, {rank} AS pos, avg(score) OVER () AS m, stddev_samp(score) OVER () AS sd FROM a),
rb AS (SELECT *, {rank} AS pos, avg(score) OVER () AS m, stddev_samp(score) OVER () AS sd FROM b),
u AS (SELECT id, {part_a} AS part FROM ra UNION ALL SELECT id, {part_b} AS part FROM rb), f AS (SELECT id, sum(part) AS score FROM u GROUP BY id)
SELECT id, round(score, 5) AS score FROM f ORDER BY f.score DESC, id LIMIT 10"""


_add("v15_rrf", lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": _TWO, "query": {"fusion": "rrf"}})), _fused("1.0 / (pos + 1 + 1)", "1.0 / (pos + 1 + 1)"))
_add("v15_rrf_weighted", lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": _TWO, "query": {"rrf": {"k": 60, "weights": [3.0, 1.0]}}})), _fused("1.0 / ((pos + 1) / 3.0 + 59)", "1.0 / ((pos + 1) / 1.0 + 59)"))
_DB = "(score - (m - 3 * sd)) / (6 * sd)"
_add("v16_dbsf", lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": _TWO, "query": {"fusion": "dbsf"}})), _fused(_DB, _DB))
_add("t8_rescore", lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": _TWO, "query": 2})), f"WITH {_LISTS.replace('NOT IN (0, 1)', 'NOT IN (0, 1, 2)')}, s AS (SELECT id, {_cos(2)} AS score FROM e WHERE id IN (SELECT id FROM a UNION SELECT id FROM b)) SELECT id, round(score, 5) AS score FROM s ORDER BY score DESC, id DESC LIMIT 10")
_FORMULA = {"formula": {"sum": ["$score", {"mult": [0.5, {"key": "label", "match": {"any": [1, 2]}}]}, {"neg": {"div": {"left": "label", "right": {"sum": ["label", 1]}}}}, {"abs": {"sqrt": {"pow": {"base": "$score[1]", "exponent": 2}}}}, {"exp_decay": {"x": "label", "target": 3, "scale": 2}}, {"gauss_decay": {"x": "label", "scale": 4, "midpoint": 0.25}}, {"lin_decay": {"x": "label", "target": 5, "scale": 8}}, {"ln": {"exp": 0.1}}, {"log10": 100}]}}
_FSQL = "coalesce(sa, 0) + 0.5 * (label IN (1, 2))::INT - label / (label + 1.0) + abs(sqrt(pow(coalesce(sb, 0), 2))) + exp(ln(0.5) / 2 * abs(label - 3)) + exp(ln(0.25) / 16 * label * label) + greatest(0, 1 - 0.5 / 8 * abs(label - 5)) + 0.1 + 2"
_add("v14_formula", lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": _TWO, "query": _FORMULA, "limit": 60, "score_threshold": 1.0})), f"WITH {_LISTS}, j AS (SELECT id, max(sa) AS sa, max(sb) AS sb FROM (SELECT id, score AS sa, NULL::DOUBLE AS sb FROM a UNION ALL SELECT id, NULL, score FROM b) GROUP BY id), f AS (SELECT id, {_FSQL} AS score FROM j JOIN e USING (id)) SELECT id, round(score, 5) AS score FROM f WHERE f.score >= 1.0")
_add(
    "t9_nested_prefetch",
    lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": [{"prefetch": _TWO, "query": {"fusion": "rrf"}, "limit": 15}], "query": 5, "limit": 8})),
    _fused("1.0 / (pos + 2)", "1.0 / (pos + 2)").replace("NOT IN (0, 1)", "NOT IN (0, 1, 5)").replace("SELECT id, round(score, 5) AS score FROM f ORDER BY f.score DESC, id LIMIT 10", "")
    + f""", g AS (SELECT id FROM f ORDER BY f.score DESC, id LIMIT 15), s AS (SELECT id, {_cos(5)} AS score FROM e JOIN g USING (id))
SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id DESC LIMIT 8""",
)
_add(
    "v17_order_by",
    lambda s, d: query(embeddings(s, d), {"query": {"order_by": {"key": "label", "direction": "desc"}}, "limit": 30}),
    "SELECT vec_id AS id, 1.0::DOUBLE AS score, label::DOUBLE AS order_value FROM embeddings ORDER BY label DESC, id DESC LIMIT 30",
)
# A prefetch in another order takes part by its places.
_add(
    "v17_order_by_fused",
    lambda s, d: _rounded(query(embeddings(s, d), {"prefetch": [_TWO[0], {"query": {"order_by": "label"}, "limit": 40}], "query": {"fusion": "rrf"}})),
    _fused("1.0 / (pos + 2)", "1.0 / (pos + 2)")
    .replace(f"b AS (SELECT id, {_cos(1)} AS score FROM e WHERE id NOT IN (0, 1) AND label IN (1, 2, 3) ORDER BY score DESC, id DESC LIMIT 20)", "b AS (SELECT id, -label::DOUBLE AS score FROM e WHERE id <> 0 ORDER BY label, id LIMIT 40)")
    .replace("NOT IN (0, 1)", "NOT IN (0)")
    .replace("rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) - 1", "rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1"),
)

# Groups, facets, matrices ------------------------------------------------------------------------------------------------

_GROUPS = f"""{_E}, h AS (SELECT label::VARCHAR AS group_key, id, {_cos(0)} AS score FROM e WHERE id <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, id DESC) AS hit_rank FROM h),
g AS (SELECT group_key, row_number() OVER (ORDER BY score DESC, id DESC) AS group_rank FROM r WHERE hit_rank = 1)"""
_add("r3_query_groups", lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"query": 0}, "label", 4, 5)), f"WITH {_GROUPS} SELECT group_key, group_rank, hit_rank, id, round(score, 5) AS score FROM r JOIN g USING (group_key) WHERE hit_rank <= 4 AND group_rank <= 5")
_add("r3_group_lookup", lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"query": 0}, "label", 2, 6, Collection(table(s, d, "nation"), "n_nationkey"), ["n_name"])), f"WITH {_GROUPS} SELECT group_key, group_rank, hit_rank, id, round(score, 5) AS score, n_nationkey AS lookup_id, n_name AS lookup_n_name FROM r JOIN g USING (group_key) LEFT JOIN nation ON n_nationkey::VARCHAR = group_key WHERE hit_rank <= 2 AND group_rank <= 6")


def _grouped(hits: str, order: str = "score DESC, id DESC", size: int = 3, most: int = 6, extra: str = "") -> str:
    """SQL of groups from hits h (group_key, id, score); the best groups by their best hit."""
    return f"""WITH {hits}, r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {order}) AS hit_rank FROM h),
g AS (SELECT group_key, row_number() OVER (ORDER BY {order}, group_key) AS group_rank FROM r WHERE hit_rank = 1)
SELECT group_key, group_rank, hit_rank, id, round(score, 5) AS score FROM r JOIN g USING (group_key) WHERE hit_rank <= {size} AND group_rank <= {most}"""


_H = "h AS (SELECT label::VARCHAR AS group_key, id, {} AS score FROM e WHERE {})"
# Groups are complete whatever makes the hits: prefetches of all points, fusion, another order, examples.
_add(
    "r3_groups_prefetch",
    lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"prefetch": [{"query": 0, "limit": 1_000_000}], "query": 2}, "label", 3, 20)),
    _grouped(f"{_E}, {_H.format(_cos(2), 'id NOT IN (0, 2)')}", most=20),
)
_add(
    "r3_groups_fusion",
    lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"prefetch": _TWO, "query": {"fusion": "rrf"}}, "label", 3, 6)),
    _grouped(_fused("1.0 / (pos + 2)", "1.0 / (pos + 2)").split("SELECT id, round(score, 5) AS score FROM f")[0].removeprefix("WITH ") + ", h AS (SELECT label::VARCHAR AS group_key, id, f.score FROM f JOIN e USING (id))", "score DESC, id"),
)
_add(
    "r3_groups_order_by",
    lambda s, d: aggregate.query_groups(embeddings(s, d), {"query": {"order_by": {"key": "vec_id", "direction": "desc"}}, "filter": _LABELS}, "label", 2, 6),
    _grouped(f"{_E}, {_H.format('1.0::DOUBLE', 'label IN (1, 2, 3)')}", "id DESC", 2),
)
_add(
    "r6_recommend_groups",
    lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"query": {"recommend": {"positive": [1, 2], "negative": [3, 4], "strategy": "sum_scores"}}}, "label", 3, 6)),
    _grouped(f"{_E}, {_H.format(f'{_cos(1)} + {_cos(2)} - {_cos(3)} - {_cos(4)}', 'id NOT IN (1, 2, 3, 4)')}"),
)
_add(
    "r7_discover_groups",
    lambda s, d: _rounded(aggregate.query_groups(embeddings(s, d), {"query": {"discover": {"target": 0, "context": _PAIRS}}}, "label", 3, 6)),
    _grouped(f"{_E}, {_H.format(f'sign({_cos(1)} - {_cos(2)}) + sign({_cos(3)} - {_cos(4)}) + {_SIG.format(x=_cos(0))}', 'id NOT IN (0, 1, 2, 3, 4)')}"),
)
# Batches: searches of one vector share a scan, whatever their depth, threshold and examples.
_BATCH = [
    {"query": 0, "limit": 5}, {"query": {"nearest": 7}, "limit": 4, "offset": 2}, {"query": {"recommend": {"positive": [1, 2], "negative": [3]}}, "limit": 6},
    {"query": 0, "limit": 40, "score_threshold": 0.2}, {"query": {"discover": {"target": 0, "context": _PAIRS}}, "limit": 5},
]


def _batch_sql() -> str:
    parts = []
    for n, (score, named, skip, most, least) in enumerate([(_cos(0), "0", 0, 5, -9), (_cos(7), "7", 2, 4, -9), (_SIM["Cosine"].format(a="e.v", b="(SELECT v FROM mean)"), "1, 2, 3", 0, 6, -9), (_cos(0), "0", 0, 40, 0.2), (f"sign({_cos(1)} - {_cos(2)}) + sign({_cos(3)} - {_cos(4)}) + {_SIG.format(x=_cos(0))}", "0, 1, 2, 3, 4", 0, 5, -9)]):
        parts.append(f"SELECT * FROM (SELECT {n} AS query_id, id, {score} AS score FROM e WHERE id NOT IN ({named}) ORDER BY score DESC, id DESC LIMIT {most} OFFSET {skip}) WHERE score > {least}")
    return f"WITH {_E}{_AVG} SELECT query_id, id, round(score, 5) AS score FROM ({' UNION ALL '.join(parts)})"


_add("r2_query_batch", lambda s, d: _rounded(query_batch(embeddings(s, d), _BATCH)), _batch_sql())
_add("r11_facet", lambda s, d: aggregate.facet(embeddings(s, d), "label", limit=5, kind="integer"), "SELECT label AS value, count(*) AS count FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")


def _items(key: str) -> str:
    """SQL of a payload field's values, an array's elements."""
    return f"CASE json_type(payload, '$.{key}') WHEN 'ARRAY' THEN json_extract(payload, '$.{key}[*]') WHEN NULL THEN [] ELSE [json_extract(payload, '$.{key}')] END"


def _some(key: str, kinds: str, test: str) -> str:
    kind = " AND ".join(["json_type(x) IN (" + ", ".join(f"'{k}'" for k in kinds.split()) + ")"])
    return f"coalesce(len(list_filter({_items(key)}, lambda x: x IS NOT NULL AND {kind} AND coalesce({test}, false))) > 0, false)"


_S, _N = "json_extract_string(x, '$')", "CAST(CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(x, '$') END AS DOUBLE)"
_NUM, _INT = "UBIGINT BIGINT DOUBLE", "UBIGINT BIGINT"
_add("r11_facet_payload", lambda s, d: aggregate.facet(points(s, d), "city", {"must": [{"key": "color", "match": {"value": "teal"}}]}, 20), f"""WITH {_P}, t AS (SELECT id, payload FROM p WHERE {_some('color', 'VARCHAR', f"{_S} = 'teal'")}),
y AS (SELECT id, unnest({_items('city')}) AS x FROM t), u AS (SELECT DISTINCT id, {_S} AS value FROM y WHERE json_type(x) = 'VARCHAR')
SELECT value, count(*) AS count FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
_add(
    "r3_groups_json",
    lambda s, d: aggregate.query_groups(points(s, d), {}, "multiId", 3, 30),
    _grouped(f"""{_P}, k AS (SELECT id, {_items('multiId')} AS items FROM p),
h AS (SELECT DISTINCT x AS group_key, id, 1.0::DOUBLE AS score FROM (
  SELECT id, unnest(list_transform(items, lambda x: json_extract_string(x, '$'))) AS x FROM k WHERE len(list_filter(items, lambda x: json_type(x) NOT IN ('VARCHAR', 'UBIGINT', 'BIGINT'))) = 0) WHERE x IS NOT NULL)""", "id", 3, 30),
)
_MATRIX = f"""{_E}, n AS (SELECT * FROM e WHERE id < 40), s AS (SELECT a.id AS a, b.id AS b, {_SIM['Cosine'].format(a='a.v', b='b.v')} AS score FROM n a, n b WHERE a.id <> b.id),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) <= 3)"""
_add("r12_matrix_pairs", lambda s, d: _rounded(aggregate.matrix_pairs(embeddings(s, d), 40, 3, ids=list(range(40)))), f"WITH {_MATRIX} SELECT a, b, round(score, 5) AS score FROM m")
_add("r12_matrix_offsets", lambda s, d: _rounded(aggregate.matrix_offsets(aggregate.matrix_pairs(embeddings(s, d), 40, 3, ids=list(range(40))))), f"WITH {_MATRIX}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT a AS id FROM m UNION SELECT b FROM m)) SELECT x.n AS row, y.n AS col, round(score, 5) AS score FROM m JOIN i x ON x.id = a JOIN i y ON y.id = b")
# A sample of all rows by a hash of the id that SQL can say too.
_DRAWN = "(id % 2147483648) * 1103515245 % 2147483648"
_SAMPLED = _MATRIX.replace("SELECT * FROM e WHERE id < 40", f"SELECT * FROM e ORDER BY {_DRAWN}, id LIMIT 40")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.matrix_pairs(embeddings(spark, d), 40, 3, draw=F.expr(_DRAWN))


_add("r12_matrix_pairs_sampled", lambda s, d: _rounded(_sampled(s, d)), ORACLES["r12_matrix_pairs"].replace(_MATRIX, _SAMPLED))
_add("r12_matrix_offsets_sampled", lambda s, d: _rounded(aggregate.matrix_offsets(_sampled(s, d))), ORACLES["r12_matrix_offsets"].replace(_MATRIX, _SAMPLED))
_add("v20_matrix_sample", lambda s, d: _rounded(aggregate.matrix_pairs(embeddings(s, d), 10, 3, seed=4)))

# Reading -----------------------------------------------------------------------------------------------------------------


def orders(spark: SparkSession, d: str) -> Collection:
    return Collection(table(spark, d, "orders"), "o_orderkey", index={"o_orderdate": "datetime", "o_totalprice": "float"})


_add("r8_scroll", lambda s, d: scroll.scroll(orders(s, d), {"must": [{"key": "o_orderstatus", "match": {"value": "F"}}]}, 50, 100, with_payload=["o_totalprice"]), "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 100 ORDER BY 1 LIMIT 50")
_add("t5_order_by", lambda s, d: scroll.scroll(orders(s, d), None, 40, order_by={"key": "o_totalprice", "direction": "desc", "start_from": 100000.0}, with_payload=False), "SELECT o_orderkey AS id, o_totalprice AS order_value FROM orders WHERE o_totalprice <= 100000.0 ORDER BY 2 DESC, 1 DESC LIMIT 40")
_add("t5_order_by_values", lambda s, d: scroll.scroll(points(s, d, price="float"), None, 200, order_by={"key": "price", "start_from": 20}, with_payload=False), f"WITH {_P}, u AS (SELECT id, unnest({_items('price')}) AS x FROM p) SELECT id, {_N} AS order_value FROM u WHERE {_N} >= 20 ORDER BY 2, 1 LIMIT 200")
_add("r9_retrieve", lambda s, d: scroll.retrieve(orders(s, d), [7, 3, 1, -5, 32, 2], ["o_custkey"]), "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey IN (7, 3, 1, 32, 2)")
_add("r10_count", lambda s, d: scroll.count(points(s, d), {"must_not": [{"is_empty": {"key": "city"}}]}), f"WITH {_P} SELECT count(*) AS count FROM p WHERE coalesce(len(list_filter({_items('city')}, lambda x: true)) > 0 AND json_type(payload, '$.city') <> 'NULL', false)")
_add("a11_newest_versions", lambda s, d: newest_versions(table(s, d, "points").select("id", "version", "shard_key")), "SELECT id, max(version) AS version, arg_max_null(shard_key, version) AS shard_key FROM points GROUP BY id")

# Filters -----------------------------------------------------------------------------------------------------------------


def _filter(name: str, spec: dict, sql: str | None, **index) -> None:
    _add(name, lambda s, d: points(s, d, **index).where(spec).select("id"), None if sql is None else f"WITH {_P} SELECT id FROM p WHERE {sql}")


def _key(key: str, **test) -> dict:
    return {"key": key, **test}


_city, _color = _key("city", match={"value": "Abyfenquin"}), _key("color", match={"value": "teal"})
_citysql, _colorsql = _some("city", "VARCHAR", f"{_S} = 'Abyfenquin'"), _some("color", "VARCHAR", f"{_S} = 'teal'")
_cheap, _cheapsql = _key("price", range={"lt": 10}), _some("price", _NUM, f"{_N} < 10")
_filter("f1_must", {"must": [_city, _color]}, f"{_citysql} AND {_colorsql}")
_filter("f2_should", {"should": [_city, _color]}, f"{_citysql} OR {_colorsql}")
_filter("f3_must_not", {"must_not": [_city, _color]}, f"NOT {_citysql} AND NOT {_colorsql}")
_filter("f4_min_should", {"min_should": {"conditions": [_city, _color, _cheap], "min_count": 2}}, f"{_citysql}::INT + {_colorsql}::INT + {_cheapsql}::INT >= 2")
_filter("f5_nested_filter", {"must": [_color, {"should": [_city, {"must_not": [_cheap]}]}]}, f"{_colorsql} AND ({_citysql} OR NOT {_cheapsql})")
_filter("f6_match_integer", {"must": [_key("count", match={"value": 1})]}, _some("count", _INT, f"{_N} = 1"))
_filter("f6_match_bool", {"must": [_key("boolean", match={"value": True})]}, _some("boolean", "BOOLEAN", f"{_S} = 'true'"))
_filter("f7_match_any", {"must": [_key("color", match={"any": ["red", "blue", "ochre"]})]}, _some("color", "VARCHAR", f"{_S} IN ('red', 'blue', 'ochre')"))
_filter("f7_match_any_integers", {"must": [_key("count", match={"any": [0, 2, 17]})]}, _some("count", _INT, f"{_N} IN (0, 2, 17)"))
_filter("f8_match_except", {"must": [_key("city", match={"except": ["Abyfenquin", "Abygar"]})]}, f"coalesce(len(list_filter({_items('city')}, lambda x: json_type(x) <> 'NULL' AND NOT (json_type(x) = 'VARCHAR' AND {_S} IN ('Abyfenquin', 'Abygar')))) > 0, false)")
_filter("f9_text_substring", {"must": [_key("title", match={"text": "res"})]}, _some("title", "VARCHAR", f"contains({_S}, 'res')"))
_WORDS = f"list_filter(regexp_split_to_array(lower({_S}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_filter("f9_text_tokens", {"must": [_key("title", match={"text": "Plain"})]}, _some("title", "VARCHAR", f"list_contains({_WORDS}, 'plain')"), title=TextIndex())
_filter("f10_text_any", {"must": [_key("title", match={"text_any": "plain Café notes"})]}, _some("title", "VARCHAR", f"list_has_any({_WORDS}, ['plain', 'café', 'notes'])"), title=TextIndex())
_filter("f11_phrase_substring", {"must": [_key("title", match={"phrase": "n pres"})]}, _some("title", "VARCHAR", f"contains({_S}, 'n pres')"))
_filter("f9_text_stems", {"must": [_key("title", match={"text": "Plains"})]}, _some("title", "VARCHAR", f"list_contains({_WORDS}, 'plain')"), title=TextIndex(stemmer="english"))


def _phrase(spark: SparkSession, d: str) -> DataFrame:
    """The last two words of the first title, as a phrase."""
    c = points(spark, d, title=TextIndex(phrase_matching=True))
    title = c.df.select("id", F.get_json_object("payload", "$.title").alias("t")).where("t like '% % %'").orderBy("id").limit(1).collect()
    return c.where({"must": [_key("title", match={"phrase": " ".join(title[0][1].split()[-2:]) if title else "-"})]}).select("id")


_add("f11_phrase_tokens", _phrase, f"""WITH {_P}, t AS (SELECT array_to_string(list_slice(string_split(json_extract_string(payload, '$.title'), ' '), -2, -1), ' ') AS t
  FROM p WHERE json_extract_string(payload, '$.title') LIKE '% % %' ORDER BY id LIMIT 1)
SELECT id FROM p, t WHERE {_some('title', 'VARCHAR', f"contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' ' || lower(t.t) || ' ')")}""".replace("lambda t: t <> ''", "lambda w: w <> ''"))
_filter("f12_prefix", {"must": [_key("city", match={"prefix": "Aby"})]}, _some("city", "VARCHAR", f"starts_with({_S}, 'Aby')"))
_filter("f13_range", {"must": [_key("price", range={"gte": 10, "lt": 20})]}, _some("price", _NUM, f"{_N} >= 10 AND {_N} < 20"))
_filter("f14_datetime_range", {"must": [_key("date_rfc3339", range={"gte": "2025-01-01", "lt": "2025-07-01T12:00:00Z"})]}, _some("date_rfc3339", "VARCHAR", f"CAST({_S} AS TIMESTAMPTZ) >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND CAST({_S} AS TIMESTAMPTZ) < TIMESTAMPTZ '2025-07-01 12:00:00+00'"))
_LON, _LAT = "CAST(json_extract(x, '$.lon') AS DOUBLE)", "CAST(json_extract(x, '$.lat') AS DOUBLE)"
_filter("f15_geo_bounding_box", {"must": [_key("location", geo_bounding_box={"top_left": {"lon": 100, "lat": 40}, "bottom_right": {"lon": -100, "lat": -40}})]}, _some("location", "OBJECT", f"({_LON} > 100 OR {_LON} < -100) AND {_LAT} < 40 AND {_LAT} > -40"))
_HAV = f"2 * 6371008.8 * asin(sqrt(pow(sin((radians(10.0) - radians({_LAT})) / 2), 2) + cos(radians({_LAT})) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians({_LON})) / 2), 2)))"
_filter("f16_geo_radius", {"must": [_key("location", geo_radius={"center": {"lon": 20.0, "lat": 10.0}, "radius": 4_000_000.0})]}, _some("location", "OBJECT", f"{_HAV} < 4000000"))
_RING = [(-60, -50), (80, -40), (60, 50), (-70, 30)]
_HOLE = [(-10, -10), (10, -10), (0, 20)]


def _ring(points_: list) -> dict:
    return {"points": [{"lon": x, "lat": y} for x, y in [*points_, points_[0]]]}


def _inside(ring: list) -> str:
    edges = zip(ring, [*ring[1:], ring[0]])
    return "(" + " + ".join(f"(({y1} > {_LAT}) <> ({y2} > {_LAT}) AND {_LON} < ({_LAT} - ({y1})) * {(x2 - x1) / (y2 - y1)!r} + ({x1}))::INT" for (x1, y1), (x2, y2) in edges if y1 != y2) + ") % 2 = 1"


_filter("f17_geo_polygon", {"must": [_key("location", geo_polygon={"exterior": _ring(_RING), "interiors": [_ring(_HOLE)]})]}, _some("location", "OBJECT", f"{_inside(_RING)} AND NOT {_inside(_HOLE)}"))
_filter("f18_values_count", {"must": [_key("city", values_count={"gte": 2, "lt": 4})]}, "coalesce(json_array_length(payload, '$.city'), 0) >= 2 AND json_array_length(payload, '$.city') < 4")
_filter("f18_values_count_none", {"must": [_key("city", values_count={"lt": 1})]}, "coalesce(json_type(payload, '$.city') = 'NULL', true) OR json_type(payload, '$.city') = 'ARRAY' AND json_array_length(payload, '$.city') = 0")
_filter("f19_field_is_empty", {"must": [_key("city", is_empty=False)]}, "coalesce(json_type(payload, '$.city') <> 'NULL' AND (json_type(payload, '$.city') <> 'ARRAY' OR json_array_length(payload, '$.city') > 0), false)")
_filter("f20_field_is_null", {"must": [_key("city", is_null=True)]}, f"coalesce(len(list_filter({_items('city')}, lambda x: json_type(x) = 'NULL')) > 0, false)")
_filter("f21_is_empty", {"must": [{"is_empty": {"key": "city"}}]}, "coalesce(json_type(payload, '$.city') = 'NULL' OR json_type(payload, '$.city') = 'ARRAY' AND json_array_length(payload, '$.city') = 0, true)")
_filter("f22_is_null", {"must": [{"is_null": {"key": "price"}}]}, "coalesce(json_type(payload, '$.price') = 'NULL', false)")
_filter("f23_has_id", {"must": [{"has_id": [5, 10, 15, 20, 25, 200, 2000]}]}, "id IN (5, 10, 15, 20, 25, 200, 2000)")
_add("f24_has_vector", lambda s, d: points(s, d, True).where({"must": [{"has_vector": "text"}], "must_not": [{"has_vector": ""}]}).select("id"), "SELECT id FROM (SELECT id, arg_max_null(vector, version) AS v, arg_max_null(sparse_text, version) AS t FROM points GROUP BY id) WHERE v IS NULL AND t IS NOT NULL")
_filter("f25_slice", {"must": [{"slice": {"total": 4, "index": 1}}]}, None)
_filter("f28_alternatives", {"must": [_key("price", range={"lt": 5}, match={"value": 79})]}, f"{_some('price', _NUM, _N + ' < 5')} OR {_some('price', _INT, _N + ' = 79')}")


def nested(spark: SparkSession, d: str, every: bool = False) -> Collection:
    """The current nested points in plain JSON; with every those of all wire formats, decoded."""
    df = newest_versions(table(spark, d, "nested_points"))
    df = df.withColumn("payload", plain_json("payload", "wire")) if every else df.where("wire = 'rest'")
    return Collection(df, "id", payload="payload")


_CITIES = {"must": [{"nested": {"key": "country.cities", "filter": {"must": [_key("population", range={"gt": 1.0}), _key("sightseeing", values_count={"gte": 2})]}}}]}
_add("f26_nested_all", lambda s, d: nested(s, d, True).where(_CITIES).select("id"))
_add("f26_nested", lambda s, d: nested(s, d).where(_CITIES).select("id"), """WITH n AS (SELECT id, arg_max_null(wire, version) AS wire, arg_max_null(payload, version) AS payload FROM nested_points GROUP BY id),
c AS (SELECT id, unnest(CASE WHEN json_type(payload, '$.country.cities') = 'ARRAY' THEN json_extract(payload, '$.country.cities[*]') ELSE [] END) AS x FROM n WHERE wire = 'rest' AND json_valid(payload))
SELECT DISTINCT id FROM c WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.population') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(x, '$.population') AS DOUBLE) > 1 AND json_type(x, '$.sightseeing') = 'ARRAY' AND json_array_length(x, '$.sightseeing') >= 2""")
_add("f13_typed_columns", lambda s, d: Collection(table(s, d, "lineitem"), "l_orderkey").where({"must": [_key("l_quantity", range={"gte": 30}), _key("l_returnflag", match={"any": ["A", "R"]}), _key("l_shipdate", range={"lt": "1996-06-01"})]}).groupBy("l_returnflag").agg(F.count("*").alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1")


def _sharded(spark: SparkSession, d: str) -> DataFrame:
    """The points of the first three shard keys, as the fallback of one that has none."""
    df = newest_versions(table(spark, d, "points").select("id", "version", "shard_key"))
    keys = [r[0] for r in df.select("shard_key").where("shard_key is not null").distinct().orderBy("shard_key").limit(3).collect()]
    return query(Collection(df, "id", shard_key="shard_key"), {"shard_key": {"target": "no such key", "fallback": keys}, "limit": None}).select("id")


_add("f30_shard_key", _sharded, """WITH c AS (SELECT id, arg_max_null(shard_key, version) AS shard_key FROM points GROUP BY id)
SELECT id FROM c WHERE shard_key IN (SELECT DISTINCT shard_key FROM c WHERE shard_key IS NOT NULL ORDER BY 1 LIMIT 3)""")

# Sparse vectors, several vectors, text -----------------------------------------------------------------------------------

_SP = "c AS (SELECT id, arg_max_null(sparse_text, version) AS t FROM points GROUP BY id), w AS (SELECT id, unnest(t.indices) AS dim, unnest(t.values)::DOUBLE AS weight FROM c WHERE t IS NOT NULL)"


def _sparse_query(c: Collection) -> dict:
    """Half the dimensions of the first ten vectors, each weighing 1."""
    rows = c.df.where("sparse_text IS NOT NULL AND id % 7 = 0").orderBy("id").limit(10).select("sparse_text").collect()
    dims = sorted({i for r in rows for i in r[0]["indices"]})
    return {"indices": dims, "values": [1.0] * len(dims)}


_SQ = f"{_SP}, f AS (SELECT id FROM c WHERE t IS NOT NULL AND id % 7 = 0 ORDER BY id LIMIT 10), q AS (SELECT DISTINCT dim FROM w JOIN f USING (id))"


def _sparse(spark: SparkSession, d: str, idf: bool) -> DataFrame:
    c = points(spark, d, True, idf)
    return _rounded(query(c, {"query": _sparse_query(c), "using": "text", "limit": None}))


_add("v2_sparse_nearest", lambda s, d: _sparse(s, d, False), f"WITH {_SQ} SELECT id, round(sum(weight), 5) AS score FROM w JOIN q USING (dim) GROUP BY id")
_add("v3_sparse_idf", lambda s, d: _sparse(s, d, True), f"WITH {_SQ}, n AS (SELECT count(*) AS n FROM c WHERE t IS NOT NULL), g AS (SELECT dim, count(*) AS df FROM w GROUP BY dim), i AS (SELECT dim, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM g, n) SELECT id, round(sum(weight * idf), 5) AS score FROM w JOIN q USING (dim) JOIN i USING (dim) GROUP BY id")
_add("a9_document_frequency", lambda s, d: sparse.document_frequencies(points(s, d, True).df.where("sparse_text IS NOT NULL"), "id", "sparse_text"), f"WITH {_SP} SELECT dim, count(*) AS df FROM w GROUP BY dim")
_add("r2_sparse_batch", lambda s, d: _rounded(sparse.batch_products(points(s, d, True).df.where("sparse_text IS NOT NULL"), "id", "sparse_text", sparse.postings(points(s, d, True).df.where("sparse_text IS NOT NULL AND id % 50 = 0"), "id", "sparse_text").withColumnRenamed("id", "query_id"), 5)), f"WITH {_SP}, s AS (SELECT a.id AS query_id, b.id, sum(a.weight * b.weight) AS score FROM w a JOIN w b USING (dim) WHERE a.id % 50 = 0 GROUP BY 1, 2) SELECT query_id, id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id DESC) <= 5")
_MULTI = f"{_E}, m AS (SELECT id % 50 AS id, v FROM e), q AS (SELECT id AS qid, v AS qv FROM e WHERE id IN (3, 4)), x AS (SELECT m.id, qid, max({_SIM['Cosine'].format(a='m.v', b='qv')}) AS best FROM m, q GROUP BY 1, 2)"


def _max_sim(spark: SparkSession, d: str) -> DataFrame:
    two = _vectors(embeddings(spark, d), [3, 4])
    return _rounded(query(multi(spark, d), {"query": {"nearest": [two[3], two[4]]}, "limit": 20}))


_add("v4_max_similarity", _max_sim, f"WITH {_MULTI}, s AS (SELECT id, sum(best) AS score FROM x GROUP BY id) SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id DESC LIMIT 20")


def _multi_reco(spark: SparkSession, d: str) -> DataFrame:
    two = _vectors(embeddings(spark, d), [3, 4])
    return _rounded(query(multi(spark, d), {"query": {"recommend": {"positive": [[two[3]]], "negative": [[two[4]]], "strategy": "sum_scores"}}, "limit": 20}))


_add("v12_multi_recommend", _multi_reco, f"WITH {_MULTI}, s AS (SELECT id, sum(CASE qid WHEN 3 THEN best ELSE -best END) AS score FROM x GROUP BY id) SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id DESC LIMIT 20")


def _sparse_reco(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d, True)
    x = _sparse_query(c)
    return _rounded(query(c, {"query": {"recommend": {"positive": [x], "negative": [], "strategy": "sum_scores"}}, "using": "text", "limit": None}))


_add("v11_sparse_recommend", _sparse_reco, f"WITH {_SQ}, s AS (SELECT id, sum(weight) AS score FROM w JOIN q USING (dim) GROUP BY id) SELECT c.id, round(coalesce(score, 0), 5) AS score FROM c LEFT JOIN s USING (id) WHERE t IS NOT NULL")
_DOCS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_add("text_word_tokens", lambda s, d: table(s, d, "points").select("id", F.explode(tokens(F.get_json_object("payload", "$.title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), f"SELECT token, count(*) AS n FROM (SELECT unnest({_DOCS.replace('text', 'json_extract_string(payload, ' + chr(39) + '$.title' + chr(39) + ')')}) AS token FROM points WHERE json_type(payload, '$.title') = 'VARCHAR') GROUP BY 1")
_add("text_prefix_tokens", lambda s, d: table(s, d, "points").select(F.explode(tokens(F.get_json_object("payload", "$.title"), TextIndex("prefix", min_token_len=2, max_token_len=4))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), f"SELECT left(t, n) AS token, count(*) AS n FROM (SELECT unnest({_DOCS.replace('text', 'json_extract_string(payload, ' + chr(39) + '$.title' + chr(39) + ')')}) AS t FROM points WHERE json_type(payload, '$.title') = 'VARCHAR'), range(2, 5) r(n) WHERE length(t) >= n GROUP BY 1")
_add("text_bm25_weights", lambda s, d: table(s, d, "points").where("payload like '%title%'").select("id", "version", F.explode(bm25_weights(tokens(F.get_json_object("payload", "$.title")))).alias("w")).groupBy("w.token").agg(F.round(F.sum("w.weight"), 4).alias("weight")), f"WITH t AS (SELECT payload, {_DOCS.replace('text', 'json_extract_string(payload, ' + chr(39) + '$.title' + chr(39) + ')')} AS ws FROM points WHERE json_type(payload, '$.title') = 'VARCHAR'), u AS (SELECT ws, unnest(list_distinct(ws)) AS token FROM t), c AS (SELECT token, len(ws) AS size, len(list_filter(ws, lambda x: x = token)) AS n FROM u) SELECT token, round(sum(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 256.0))), 4) AS weight FROM c GROUP BY 1")
_add("text_bm25_embedding", lambda s, d: table(s, d, "points").select("id", "version", bm25_embedding(tokens(F.get_json_object("payload", "$.title"))).alias("vector")))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """A document as a query's input: titles as sparse vectors of BM25, those nearest to a text."""
    c = points(spark, d)
    df = c.df.withColumn("title", F.get_json_object("payload", "$.title")).where("title is not null").withColumn("words", bm25_embedding(tokens(F.col("title"))))
    return _rounded(query(Collection(df.select("id", "words"), "id", {}, {"words": Sparse("words")}), {"query": {"text": "Plain notes, spare notes"}, "using": "words", "limit": None}))


_add("text_document_query", _documents, f"""WITH {_P}, t AS (SELECT id, {_DOCS.replace('text', 'json_extract_string(payload, ' + chr(39) + '$.title' + chr(39) + ')')} AS ws FROM p WHERE json_type(payload, '$.title') = 'VARCHAR'),
u AS (SELECT id, ws, unnest(list_distinct(ws)) AS token FROM t), c AS (SELECT id, token, len(ws) AS size, len(list_filter(ws, lambda x: x = token)) AS n FROM u)
SELECT id, round(sum((n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 256.0)))::FLOAT::DOUBLE), 5) AS score FROM c WHERE token IN ('plain', 'notes', 'spare') GROUP BY id""")
_add("text_english_stems", lambda s, d: table(s, d, "part").select("p_partkey", tokens(F.col("p_name"), TextIndex(stemmer="english")).alias("stems")))

# Payload selection, changes ----------------------------------------------------------------------------------------------


def _changed(df: DataFrame) -> DataFrame:
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return df.select("id", get("color").alias("color"), get("count").alias("count"), get("extra.mark").alias("mark"), get("title").alias("title"))


def _state(color: str = "json_extract_string(payload, '$.color')", count: str = "json_extract_string(payload, '$.count')", mark: str = "NULL::VARCHAR", title: str = "json_extract_string(payload, '$.title')", where: str = "true") -> str:
    return f"WITH {_P} SELECT id, {color} AS color, {count} AS count, {mark} AS mark, {title} AS title FROM p WHERE {where}"


def _case(test: str, value: str, other: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE json_extract_string(payload, '$.{other}') END"


_TEAL = {"must": [_color]}
_add("p2_include_payload", lambda s, d: _changed(query(points(s, d), {"limit": None, "with_payload": {"include": ["color", "title"]}})), _state(count="NULL::VARCHAR"))
_add("p3_exclude_payload", lambda s, d: _changed(query(points(s, d), {"limit": None, "with_payload": {"exclude": ["color"]}})), _state(color="NULL::VARCHAR"))
for _n in ("p2_include_payload", "p3_exclude_payload"):
    QUERIES["payload" + _n[2:]], ORACLES["payload" + _n[2:]] = QUERIES.pop(_n), ORACLES.pop(_n)
_add("r16_set_payload", lambda s, d: _changed(mutate.set_payload(points(s, d), {"color": None, "count": 5}, filter=_TEAL).df), _state(_case(_colorsql, "NULL", "color"), _case(_colorsql, "'5'", "count")))
_add("r16_set_payload_at_path", lambda s, d: _changed(mutate.set_payload(points(s, d), {"mark": "new"}, filter=_TEAL, key="extra").df), _state(mark=f"CASE WHEN {_colorsql} THEN 'new' END"))
_add("r16_overwrite_payload", lambda s, d: _changed(mutate.overwrite_payload(points(s, d), {"color": "grey"}, filter=_TEAL).df), _state(_case(_colorsql, "'grey'", "color"), _case(_colorsql, "NULL", "count"), title=_case(_colorsql, "NULL", "title")))
_add("r16_delete_payload", lambda s, d: _changed(mutate.delete_payload(points(s, d), ["title"], filter=_TEAL).df), _state(title=_case(_colorsql, "NULL", "title")))
_add("r16_clear_payload", lambda s, d: _changed(mutate.clear_payload(points(s, d), filter=_TEAL).df), _state(_case(_colorsql, "NULL", "color"), _case(_colorsql, "NULL", "count"), title=_case(_colorsql, "NULL", "title")))


def _new(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 3 = 0").select((F.col("vec_id") * 2).alias("vec_id"), "embedding", F.lit(-1).alias("label"))


def _labels(c: Collection) -> DataFrame:
    return c.df.select("vec_id", "label", F.col("embedding").isNotNull().alias("has_vector"))


_NEW = "n AS (SELECT vec_id * 2 AS vec_id, -1 AS label, true AS has_vector FROM embeddings WHERE vec_id % 3 = 0), o AS (SELECT vec_id, label, true AS has_vector FROM embeddings)"
_add("r13_upsert", lambda s, d: _labels(mutate.upsert(embeddings(s, d), _new(s, d))), f"WITH {_NEW} SELECT * FROM o WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n")
_add("r13_insert_only", lambda s, d: _labels(mutate.upsert(embeddings(s, d), _new(s, d), "insert_only")), f"WITH {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE vec_id NOT IN (SELECT vec_id FROM o)")
_add("r13_update_only", lambda s, d: _labels(mutate.upsert(embeddings(s, d), _new(s, d), "update_only", _LABELS)), f"WITH {_NEW}, k AS (SELECT * FROM n WHERE vec_id IN (SELECT vec_id FROM o WHERE label IN (1, 2, 3))) SELECT * FROM o WHERE vec_id NOT IN (SELECT vec_id FROM k) UNION ALL SELECT * FROM k")
_add("r13_sync_points", lambda s, d: _labels(mutate.sync_points(embeddings(s, d), _new(s, d), 100, 300)), f"WITH {_NEW} SELECT * FROM o WHERE vec_id < 100 OR vec_id >= 300 UNION ALL SELECT * FROM n WHERE vec_id >= 100 AND vec_id < 300")
_add("r14_delete", lambda s, d: _labels(mutate.delete(embeddings(s, d), [0, 1, 2], _LABELS)), "SELECT vec_id, label, true AS has_vector FROM embeddings WHERE vec_id NOT IN (0, 1, 2) AND label NOT IN (1, 2, 3)")
_add("r15_delete_vectors", lambda s, d: _labels(mutate.delete_vectors(embeddings(s, d), [""], filter=_LABELS)), "SELECT vec_id, label, label NOT IN (1, 2, 3) AS has_vector FROM embeddings")
_add("r15_update_vectors", lambda s, d: mutate.update_vectors(embeddings(s, d), table(s, d, "embeddings").where("vec_id < 50").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))).df.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first")), "SELECT vec_id, round(CASE WHEN vec_id < 50 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 5) AS first FROM embeddings")
_add("r17_update_batch", lambda s, d: _changed(mutate.update_batch(points(s, d), [("delete", {"filter": {"must": [_cheap]}}), ("set_payload", {"payload": {"count": 1}, "filter": _TEAL}), ("delete_payload", {"keys": ["color"], "filter": _TEAL})]).df), _state(_case(_colorsql, "NULL", "color"), _case(_colorsql, "'1'", "count"), where=f"NOT {_cheapsql}"))

# Compressed vectors ------------------------------------------------------------------------------------------------------


def _compressed(fit: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = embeddings(spark, d)
        model = fit(c)
        return _rounded(quantize.search(quantize.encode_column(c, model, "codes"), model, "codes", _vectors(c, [0])[0], 10, 8.0))

    return run


_add("v23_scalar_quantised", _compressed(lambda c: quantize.Scalar.fit(c.df, "embedding")), _best(_cos(0), "-1"))


def _binary(spark: SparkSession, d: str) -> DataFrame:
    c = embeddings(spark, d)
    coded = quantize.encode_column(c, quantize.Binary(), "codes")
    candidates, _ = recall.bits_needed(coded, "codes")
    return _rounded(quantize.search(coded, quantize.Binary(), "codes", _vectors(c, [0])[0], 10, (candidates + 0.5) / 10))


_add("v25_binary_quantised", _binary)
_add("v24_product_quantised", _compressed(lambda c: quantize.Product.fit(c.df, "embedding")))
_add("v26_rotated_quantised", _compressed(lambda c: quantize.Rotated(4)))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    c = embeddings(spark, d)
    model = ivf.Cells.fit(c, 16)
    indexed = ivf.index(c, model)
    probes, _ = recall.cells_needed(indexed, model)
    return _rounded(ivf.search(indexed, model, _vectors(c, [0])[0], 10, probes))


_add("v22_approximate_cells", _cells)


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    """Whether each kind of approximate search, as the queries above use it, finds 0.9 of the ten best of the ids divisible by 50."""
    c = embeddings(spark, d)
    model = ivf.Cells.fit(c, 16)
    found = {
        "cells": recall.cells_needed(ivf.index(c, model), model)[1],
        "binary": recall.bits_needed(quantize.encode_column(c, quantize.Binary(), "codes"), "codes")[1],
        "scalar": recall.quantised_recall(c, quantize.Scalar.fit(c.df, "embedding")),
        "product": recall.quantised_recall(c, quantize.Product.fit(c.df, "embedding")),
        "rotated": recall.quantised_recall(c, quantize.Rotated(4)),
    }
    return spark.createDataFrame([(n, bool(x >= 0.9)) for n, x in found.items()], "method string, enough boolean")


_add("v22_recall_of_approximate", _recalls, "SELECT * FROM (VALUES ('cells', true), ('binary', true), ('scalar', true), ('product', true), ('rotated', true)) t(method, enough)")
