"""Approximate search by cells: points are kept by the nearest of some centres, and a query reads the cells nearest to it.

Written with partitionBy("cell"), a table's other cells aren't even opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import Collection, Dense
from ..functions import metrics
from ..plans.query import Query


@dataclass(frozen=True)
class Cells:
    """Centres, fitted on at most sample rows; directions for Cosine, else places."""

    centres: np.ndarray
    distance: str

    @staticmethod
    def fit(c: Collection, cells: int, using: str = "", sample: int = 20_000, rounds: int = 12, seed: int = 9) -> Cells:
        target = c.vector(using)
        assert isinstance(target, Dense)
        rows = c.df.where(F.size(target.column) == target.size).select(target.column).orderBy(F.xxhash64(target.column, F.lit(seed))).limit(sample).collect()
        m = np.array([r[0] for r in rows], np.float64).reshape(-1, target.size)
        m = metrics.normalised(m) if target.distance == "Cosine" else m
        centres = m[np.random.default_rng(seed).permutation(len(m))[:cells]].copy()
        for _ in range(rounds):
            near = _near(m, centres)
            for n in np.unique(near):
                centres[n] = m[near == n].mean(axis=0)
        return Cells(centres, target.distance)

    def of(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return _near(metrics.normalised(v) if self.distance == "Cosine" else v, self.centres)

    def probes(self, vector: list[float], most: int) -> list[int]:
        """The cells to read, nearest first; for Dot those whose centres have the greatest products."""
        like = metrics.similarity_matrix(np.asarray([vector]), self.centres, self.distance)[0]
        return [int(n) for n in np.argsort(-like, kind="stable")[:most]]


def _near(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * m @ centres.T).argmin(1) if len(centres) else np.zeros(len(m), np.int64)


def index(c: Collection, model: Cells, using: str = "", column: str = "cell") -> Collection:
    """Adds each point's cell; null without a vector of the right size."""
    target = c.vector(using)
    assert isinstance(target, Dense)

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        rows, m = metrics.matrix_of(vectors, target.size)
        out, mask = np.zeros(len(vectors), np.int32), np.ones(len(vectors), bool)
        out[rows], mask[rows] = model.of(m), False
        return pa.array(out, mask=mask)

    return c.with_df(c.df.withColumn(column, cell(F.col(target.column))))


def search(c: Collection, model: Cells, vector: list[float], limit: int = 10, probes: int = 8, using: str = "", filter: dict | None = None, column: str = "cell") -> DataFrame:
    """(id, score) of the best in the cells nearest to the query."""
    part = c.with_df(c.df.where(F.col(column).isin(model.probes(vector, probes))))
    return Query(part, {"query": vector, "using": using, "limit": limit, "filter": filter}).result()
