"""How far an approximate search has to look: measured against brute force over some of the collection's own points."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import Collection, Dense
from ..functions import metrics
from ..session import spread
from . import batch, ivf, quantize


def drawn_queries(c: Collection, using: str = "", every: int = 50, most: int = 500) -> dict[int, list[float]]:
    """Vectors of the ids divisible by every, by a hash of the id no more than most: a measure's sample, not a search's."""
    column = c.vector(using).column
    rows = c.df.where((F.col(c.id) % every == 0) & F.col(column).isNotNull()).select(c.id, column)
    return {r[0]: list(r[1]) for r in rows.orderBy(F.xxhash64(c.id)).limit(most).collect()}


def truth(c: Collection, queries: dict[int, list[float]], limit: int, using: str = "") -> DataFrame:
    """(query_id, id): the best others of each query by brute force."""
    others = batch.nearest_batch(c, queries, limit + 1, using).where("query_id <> id")
    larger = metrics.larger_better(c.vector(using).distance)
    order = [F.col("score").desc(), F.col("id").desc()] if larger else [F.col("score"), F.col("id")]
    ranked = others.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("_n") <= limit).select("query_id", "id")


def _least(ranks: list[int], wanted: float) -> tuple[int, float]:
    """The smallest depth at which the wanted share of ranks (from 1) is reached, and the share there."""
    ranks = sorted(ranks)
    depth = ranks[math.ceil(wanted * len(ranks)) - 1] if ranks else 1
    return depth, sum(r <= depth for r in ranks) / max(1, len(ranks))


def cells_needed(indexed: Collection, model: ivf.Cells, limit: int = 10, wanted: float = 0.9, using: str = "", column: str = "cell") -> tuple[int, float]:
    """(probes, recall): how many cells a query has to read for the wanted recall."""
    queries = drawn_queries(indexed, using)
    cells = indexed.df.select(F.col(indexed.id).alias("id"), column)
    rows = truth(indexed, queries, limit, using).join(cells, "id").select("query_id", column).collect()
    order = {q: {cell: n + 1 for n, cell in enumerate(model.probes(v, len(model.centres)))} for q, v in queries.items()}
    return _least([order[q][cell] for q, cell in rows], wanted)


def bits_needed(coded: Collection, codes: str, limit: int = 10, wanted: float = 0.9, using: str = "") -> tuple[int, float]:
    """(candidates, recall): how many points of the nearest codes by sign bits have to be scored for the wanted recall."""
    queries, target = drawn_queries(coded, using), coded.vector(using)
    names, model = list(queries), quantize.Binary()
    if not names:
        return limit, 0.0
    m = np.asarray(list(queries.values()), np.float64)
    wanted_codes = model.encode(metrics.normalised(m) if target.distance == "Cosine" else m)

    def counts(batches):
        total = np.zeros((len(names), 8 * wanted_codes.shape[1] + 1), np.int64)
        for b in batches:
            for part in b.column(0).drop_null().to_pylist():
                apart = np.unpackbits(wanted_codes ^ np.frombuffer(part, np.uint8), axis=1).sum(axis=1)
                total[np.arange(len(names)), apart] += 1
        q, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(total[q, d])], names=["q", "apart", "n"])

    histogram = np.zeros((len(names), 8 * wanted_codes.shape[1] + 1), np.int64)
    for q, d, n in spread(coded.df.select(codes)).mapInArrow(counts, "q long, apart long, n long").groupBy("q", "apart").agg(F.sum("n")).collect():
        histogram[q, d] = n
    within, place = histogram.cumsum(axis=1), {name: n for n, name in enumerate(names)}
    rows = truth(coded, queries, limit, using).join(coded.df.select(F.col(coded.id).alias("id"), codes), "id").select("query_id", codes).collect()
    ranks = []
    for name, code in rows:
        apart = int(np.unpackbits(wanted_codes[place[name]] ^ np.frombuffer(code, np.uint8)).sum())
        ranks.append(int(within[place[name], apart]))
    return _least(ranks, wanted)


def quantised_recall(c: Collection, model, limit: int = 10, oversampling: float = 8.0, using: str = "") -> float:
    """The share of the true best that are among the limit times oversampling best by codes, which are then scored by their vectors."""
    target, queries = c.vector(using), drawn_queries(c, using)
    coded = quantize.encode_column(c, model, "codes", using).df

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def decoded(data: pa.Array) -> pa.Array:
        rows = np.flatnonzero(data.is_valid())
        codes = np.frombuffer(b"".join(data.drop_null().to_pylist()), np.uint8).reshape(len(rows), -1)
        m = (model.decode(codes) if isinstance(model, quantize.Scalar) else model.decode(codes, target.size)).astype(np.float32) if len(rows) else np.empty((0, target.size), np.float32)
        size, mask = np.zeros(len(data) + 1, np.int32), np.ones(len(data), bool)
        size[rows + 1], mask[rows] = target.size, False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(m.ravel()), mask=pa.array(mask))

    unit = target.distance == "Cosine"
    asked = {q: metrics.normalised(np.asarray([v], np.float64))[0].tolist() if unit else v for q, v in queries.items()}
    rough = Collection(coded.select(F.col(c.id).alias("id"), decoded("codes").alias("v")), "id", {"": Dense("v", target.size, "Dot" if unit else target.distance)})
    best = batch.nearest_batch(rough, asked, int(limit * oversampling) + 1).select("query_id", "id")
    wanted = truth(c, queries, limit, using)
    found = wanted.join(best.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.count("*"), F.sum("hit")).first()
    return (found[1] or 0) / max(1, found[0])
