"""Many dense queries at once, each with its k best points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection, Dense
from ..functions import metrics
from ..session import parallelism, spread


#: Queries of a block: what a task holds of them at a time.
_BLOCK = 1024


def nearest_batch(c: Collection, queries: dict[int, list[float]], k: int = 10, using: str = "", filter: dict | None = None) -> DataFrame:
    """(query_id, id, score). The queries, given with the request, go to each task; every part of the points sends on its k best alone."""
    target = c.vector(using)
    assert isinstance(target, Dense)
    names, wanted = list(queries), np.asarray(list(queries.values()), np.float64)
    larger = metrics.larger_better(target.distance)

    def best(batches):
        held: list = [None] * len(names)  # of each query the best ids and similarities of the part so far, ties with the last included
        for batch in batches:
            rows, m = metrics.matrix_of(batch.column(1), target.size)
            if not len(rows):
                continue
            like = metrics.similarity_matrix(m, wanted, target.distance)
            ids = batch.column(0).take(pa.array(rows))
            for n in range(len(names)):
                score, place = like[:, n], np.arange(len(rows))
                if held[n] is not None and len(held[n][1]) >= k:
                    place = np.flatnonzero(score >= held[n][1].min())
                    if not len(place):
                        continue
                elif len(rows) > k:
                    place = np.flatnonzero(score >= np.partition(score, -k)[-k])
                new = ids.take(pa.array(place)), score[place]
                if held[n] is not None:
                    new = pa.concat_arrays([held[n][0], new[0]]), np.concatenate([held[n][1], new[1]])
                if len(new[1]) > k:
                    top = np.flatnonzero(new[1] >= np.partition(new[1], -k)[-k])
                    new = new[0].take(pa.array(top)), new[1][top]
                held[n] = new
        for name, some in zip(names, held):
            if some is not None:
                s = some[1] if larger else np.sqrt(np.abs(some[1])) if target.distance == "Euclid" else np.abs(some[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), name, np.int64)), some[0], pa.array(s)], names=["query_id", "id", "score"])

    kind = c.df.schema[c.id].dataType.simpleString()
    found = spread(c.where(filter).select(c.id, target.column)).mapInArrow(best, f"query_id long, id {kind}, score double")
    order = [F.col("score").desc(), F.col("id").desc()] if larger else [F.col("score"), F.col("id")]
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("_n") <= k).drop("_n")


def nearest_join(c: Collection, queries: DataFrame, k: int = 10, using: str = "", filter: dict | None = None, block: int = _BLOCK) -> DataFrame:
    """(query_id, id, score) of any number of queries (query_id, vector), which stay a DataFrame.

    They are dealt in blocks, each of which meets all parts of the points; a meeting sends on its k best alone, which are merged.
    """
    target = c.vector(using)
    assert isinstance(target, Dense)
    larger = metrics.larger_better(target.distance)
    spark, kind = c.df.sparkSession, c.df.schema[c.id].dataType.simpleString()
    name = queries.schema["query_id"].dataType.simpleString()
    wanted = queries.where(F.size("vector") == target.size)
    rows = c.where(filter).select(F.col(c.id).alias("id"), F.col(target.column).alias("vector")).where(F.size("vector") == target.size)
    blocks, parts = max(1, -(-wanted.count() // block)), parallelism(spark)
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = wanted.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), each(parts, "p"), "query_id", none("id", kind), "vector")
    right = rows.select(each(blocks, "b"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), none("query_id", name), "id", "vector")

    def best(table: pa.Table) -> pa.Table:
        asked = pc.is_valid(table.column("query_id"))
        q, x = table.filter(asked), table.filter(pc.invert(asked))
        (at, m), (place, v) = (metrics.matrix_of(t.column("vector").combine_chunks(), target.size) for t in (q, x))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(m) if len(v) else 0, 64):
            like = metrics.similarity_matrix(v, m[a : a + 64].astype(np.float64), target.distance)
            most = min(k, len(v))
            for n in range(like.shape[1]):
                # Ties with the last are kept, so that the merge decides them by id.
                top = np.flatnonzero(like[:, n] >= np.partition(like[:, n], -most)[-most])
                found.append((np.full(len(top), at[a + n]), place[top], like[top, n]))
        which, of, s = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        s = s if larger else np.sqrt(np.abs(s)) if target.distance == "Euclid" else np.abs(s)
        return pa.table({"query_id": q.column("query_id").take(pa.array(which)), "id": x.column("id").take(pa.array(of)), "score": pa.array(s)})

    found = left.unionByName(right).groupBy("b", "p").applyInArrow(best, f"query_id {name}, id {kind}, score double")
    order = [F.col("score").desc(), F.col("id").desc()] if larger else [F.col("score"), F.col("id")]
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("_n") <= k).drop("_n")
