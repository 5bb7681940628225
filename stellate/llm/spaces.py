"""Collections of vectors under several distances, brought into Euclidean spaces of which neighbours are searched.

Cosine: vectors of unit length. Euclid and Manhattan: as they are (a Manhattan distance is no less than the Euclidean).
Dot: vectors are grouped by length into bands and get one more component that brings all of a band to its greatest
length; a query is scaled to that length, so that a larger product is a smaller distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_counted

#: Bands of the Dot distance: so many for each doubling of a vector's length.
_BANDS = 2


@dataclass(frozen=True)
class Params:
    """How a collection is searched. limit: the score that must be reached."""

    size: int
    distance: str
    top_k: int
    limit: float

    @property
    def larger_better(self) -> bool:
        return self.distance in ("Cosine", "Dot")


def read_params(vector_params: DataFrame, search_params: DataFrame) -> dict[str, Params]:
    """By collection; these tables have a row for each collection's vector, whatever the number of points."""
    rows = vector_params.join(search_params, "collection_name").select("collection_name", "size", "distance", "top_k", "score_threshold")
    return {r[0]: Params(int(r[1]), r[2], int(r[3]), float(r[4])) for r in rows.collect() if None not in r}


def fitting(rows: DataFrame, params: dict[str, Params]) -> DataFrame:
    """Rows with columns coll and vector whose vector has its collection's size and isn't null, all zeros or without a number in some place."""
    fits = F.lit(False)
    for name, p in params.items():
        fits = fits | ((F.col("coll") == name) & (F.size("vector") == p.size))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fits).where(~bad & F.exists("vector", lambda x: x != 0))


def valid_points(points: DataFrame, params: dict[str, Params]) -> DataFrame:
    """(id, coll, vector) of the current rows that fit."""
    newest = F.max_by(F.struct("collection_name", "vector"), F.coalesce("version", F.lit(-(2**63))))
    rows = points.where("id is not null").groupBy("id").agg(newest.alias("row")).select("id", F.col("row.collection_name").alias("coll"), "row.vector")
    return fitting(rows, params)


def classes(points: DataFrame, most: int) -> DataFrame:
    """Groups of exact copies: (coll, ids, vector) with the group's smallest ids in order, most + 2 at most.

    So a group of any size weighs as one row in a search, and one with more than most + 1 ids is known to have more
    members than are listed; overflow_members gives these.
    """
    order = Window.partitionBy("coll", "h").orderBy("id")
    first = points.select("coll", _hash().alias("h"), "id", "vector").withColumn("n", F.row_number().over(order)).where(f"n <= {most + 2}")
    return first.groupBy("coll", "h").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")).select("coll", "ids", "vector")


def _hash():
    """128 bits of a vector; 0.0 and -0.0 are alike."""
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))
    return F.struct(F.xxhash64(plain), F.xxhash64(F.lit("second"), plain))


def overflow_members(points: DataFrame, most: int, more: DataFrame) -> DataFrame:
    """All members of those groups of exact copies that have more than most + 1: (coll, rep, member) and the columns that
    more has for (coll, rep); rep is the smallest id. A group of any size isn't shuffled to one task."""
    keyed = points.select("coll", _hash().alias("h"), "id")
    large = keyed.groupBy("coll", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where(f"n > {most + 1}").join(more, ["coll", "rep"])
    return join_counted(keyed, large, ["coll", "h"], "n").withColumnRenamed("id", "member").drop("h", "n")


def bands(vectors: np.ndarray, p: Params) -> np.ndarray:
    """The band of each vector; 0 but for Dot."""
    if p.distance != "Dot":
        return np.zeros(len(vectors), np.int32)
    return np.floor(np.log2(np.linalg.norm(vectors.astype(np.float64), axis=1)) * _BANDS).astype(np.int32)


def stored(vectors: np.ndarray, p: Params, most: float) -> np.ndarray:
    """Vectors of one band in Euclidean space; most is the band's greatest length."""
    v = vectors.astype(np.float64)
    if p.distance == "Cosine":
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    if p.distance == "Dot":
        rest = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", v, v)))
        return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)
    return vectors.astype(np.float32, copy=False)


def asked(vectors: np.ndarray, p: Params, most: float) -> np.ndarray:
    """Vectors as queries to a band."""
    if p.distance != "Dot":
        return stored(vectors, p, most)
    v = vectors.astype(np.float64)
    v *= most / np.linalg.norm(v, axis=1, keepdims=True)
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1).astype(np.float32)


def squared_reach(score: np.ndarray, lengths: np.ndarray, p: Params, most: float) -> np.ndarray:
    """The greatest squared distance that what scores no worse can have; negative if nothing can. Rounded up a little, for ties."""
    if p.distance == "Cosine":
        return 2.0 - 2.0 * score + 4e-6
    if p.distance == "Dot":
        # Lengths are those of the queries before they were scaled.
        scale = most / lengths
        return 2.0 * most * most - 2.0 * scale * score + 4e-6 * scale
    return (score + 2e-6) ** 2


def scores(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Scores of pairs of rows in double precision, rounded to six decimals."""
    if p.distance == "Cosine":
        s = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    elif p.distance == "Dot":
        s = np.einsum("ij,ij->i", a, b)
    elif p.distance == "Euclid":
        a = a - b
        s = np.sqrt(np.einsum("ij,ij->i", a, a))
    else:
        s = np.abs(a - b).sum(axis=1)
    return np.round(s, 6)


def reaches(score: np.ndarray, p: Params) -> np.ndarray:
    return score >= p.limit if p.larger_better else score <= p.limit


def chi_square_cdf(x: float, freedom: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = freedom / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 10.0 * freedom + 100.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high
