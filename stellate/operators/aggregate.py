"""Facets, grouped results and distance matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection
from ..plans.query import Query, payload_columns, vector_columns


def facet(c: Collection, key: str, filter: dict | None = None, limit: int = 10, kind: str | None = None) -> DataFrame:
    """(value, count): how many points have each value of a field, most first, equal counts by value. A point counts once for a value."""
    kind = kind or c.index.get(key, "keyword")
    values = c.with_df(c.where(filter)).values(key).scalars(kind if isinstance(kind, str) else "keyword")
    rows = c.where(filter).select(F.explode(F.array_distinct(values)).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value").limit(limit)


def group_keys(c: Collection, key: str):
    """The values of a field to group by, as texts. One value that is neither a text nor an integer excludes the point."""
    from ..functions.values import ColumnValues

    values = c.values(key)
    if isinstance(values, ColumnValues):
        items = values.scalars("keyword")
        return F.transform(F.filter(F.array_distinct(items), lambda x: x.isNotNull()), lambda x: x.cast("string"))
    good = F.forall(values.elements, lambda x: F.schema_of_variant(x).isin("STRING", "BIGINT"))
    return F.when(good, F.array_distinct(F.transform(values.elements, lambda x: x.try_cast("string"))))


def query_groups(c: Collection, request: dict, group_by: str, group_size: int = 3, limit: int = 10, lookup: Collection | None = None, lookup_payload=True, lookup_vectors=False, others: dict | None = None) -> DataFrame:
    """(group_key, group_rank, hit_rank, id, score): the best groups by their best hit, and of each its best hits.

    Groups are complete, and equal ones stand by their key. A point of several values may be in several groups. With lookup, the point of that collection whose id is the key
    is added to each of its hits.
    """
    from ..filters import merge_filters

    request = {k: v for k, v in request.items() if k not in ("limit", "offset")}
    q = Query(c, {**request, "limit": None}, others)
    if request.get("prefetch"):
        # All that the prefetches give, which they bound themselves.
        ranked = q.ranked()
        keys = q.c.df.select(F.col(c.id).alias("_id"), F.explode(group_keys(c, group_by)).alias("group_key"))
        hits = keys.join(ranked.df, F.col("id") == F.col("_id")).drop("_id")
    else:
        condition = request.get("filter")
        if q.named:
            condition = merge_filters(condition, {"must_not": [{"has_id": sorted(q.named, key=str)}]})
        ranked = q.scored(q.c.where(condition), request, (group_keys(c, group_by).alias("group_keys"),))
        ranked = ranked.over(request.get("score_threshold"))
        hits = ranked.df.select("*", F.explode("group_keys").alias("group_key")).drop("group_keys")
    order = ranked.order()
    best = hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("group_key").orderBy(*order))).where(F.col("hit_rank") <= group_size)
    # A row for each group with its few hits; the shuffle of the ranking serves both.
    groups = best.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct("hit_rank", "id", "score", F.col(ranked.key).alias("_key")))).alias("hits"))
    groups = groups.withColumn("id", F.col("hits")[0]["id"]).withColumn(ranked.key, F.col("hits")[0]["_key"]).orderBy(*order, "group_key").limit(limit)
    groups = groups.withColumn("group_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, "group_key")))
    result = groups.select("group_key", "group_rank", F.explode("hits").alias("hit")).select("group_key", "group_rank", "hit.hit_rank", "hit.id", "hit.score")
    if lookup is not None:
        extra = payload_columns(lookup, lookup_payload) + vector_columns(lookup, lookup_vectors)
        found = lookup.df.select(F.col(lookup.id).cast("string").alias("group_key"), F.col(lookup.id).alias("lookup_id"), *[x.alias(f"lookup_{n}") for x, n in zip(extra, lookup.df.select(*extra).columns)])
        result = result.join(found, "group_key", "left")
    return result.orderBy("group_rank", "hit_rank")


def matrix_pairs(c: Collection, sample: int = 10, limit: int = 3, using: str = "", filter: dict | None = None, seed: int | None = None, ids: list | None = None, draw: Column | None = None) -> DataFrame:
    """(a, b, score): of a random sample of points (or of the given ids, or those first by draw, a hash of the id), each with its nearest others in the sample.

    The sample, bounded by the request, comes to the driver as vectors; each of its rows is compared with all in one pass.
    """
    if sample < 2 or limit < 1:
        raise ValueError("a matrix has two points at least")
    target = c.vector(using)
    rows = c.where(filter).where(F.col(target.column).isNotNull()).select(F.col(c.id).alias("id"), F.col(target.column).alias("v"))
    chosen = rows.where(F.col("id").isin(ids)) if ids is not None else rows.orderBy(*([F.rand(seed)] if draw is None else [draw, "id"])).limit(sample)
    found = sorted(((r[0], r[1]) for r in chosen.collect()), key=lambda x: x[0])
    from ..functions import metrics

    spark, kind = c.df.sparkSession, c.df.schema[c.id].dataType.simpleString()
    import numpy as np

    out = []
    if len(found) > 1:
        m = np.array([x[1] for x in found], np.float64)
        like = metrics.similarity_matrix(m, m, target.distance)
        sign = 1 if metrics.larger_better(target.distance) else -1
        for n, (a, _) in enumerate(found):
            order = sorted((x for x in range(len(found)) if x != n), key=lambda x: (-like[n, x], -sign * found[x][0] if not isinstance(a, str) else found[x][0]))
            for x in order[:limit]:
                s = float(like[n, x])
                out.append((a, found[x][0], s if sign > 0 else abs(s) ** 0.5 if target.distance == "Euclid" else abs(s)))
    return spark.createDataFrame(out, f"a {kind}, b {kind}, score double")


def matrix_offsets(pairs: DataFrame) -> DataFrame:
    """(row, col, score): the pairs by the places of their ids among all that occur, from 0."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    place = ids.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("id")) - 1)
    a, b = place.select(F.col("id").alias("a"), F.col("place").alias("row")), place.select(F.col("id").alias("b"), F.col("place").alias("col"))
    return pairs.join(a, "a").join(b, "b").select("row", "col", "score")
