"""Similarities of vectors. Within the engine greater is closer; shown scores have the distance's own sense.

A point's vectors are compared with all vectors of a request in one pass of matrix arithmetic in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTANCES = ("Cosine", "Dot", "Euclid", "Manhattan")


def larger_better(distance: str) -> bool:
    return distance in ("Cosine", "Dot")


def normalised(v: np.ndarray) -> np.ndarray:
    """Of unit length, but for zeros."""
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, length, out=v.astype(np.float64).copy(), where=length > 0)


def similarity_matrix(a: np.ndarray, b: np.ndarray, distance: str) -> np.ndarray:
    """Of rows of a with rows of b."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if distance == "Cosine":
        return normalised(a) @ normalised(b).T
    if distance == "Dot":
        return a @ b.T
    power = (lambda x: x * x) if distance == "Euclid" else np.abs
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, a.shape[1]))
    for j in range(len(b)):
        for n in range(0, len(a), step):
            out[n : n + step, j] = -power(a[n : n + step] - b[j]).sum(axis=1)
    return out


def shown(similarity: Column, distance: str) -> Column:
    return similarity if larger_better(distance) else F.sqrt(F.abs(similarity)) if distance == "Euclid" else F.abs(similarity)


def matrix_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that hold a vector of this size, and these as a matrix."""
    fits = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) == size
    rows = np.flatnonzero(fits)
    part = column if len(rows) == len(column) else column.take(pa.array(rows))
    return rows, part.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def similarities(vector: Column, examples: list[list[float]], distance: str) -> Column:
    """An array with the similarity to each example; null without a vector of their size.

    It isn't declared deterministic, so that a filter on scores doesn't have them computed twice: make it a column once.
    """
    wanted = np.asarray(examples, np.float64)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(column: pa.Array) -> pa.Array:
        rows, m = matrix_of(column, wanted.shape[1])
        found = similarity_matrix(m, wanted, distance).ravel()
        counts = np.zeros(len(column) + 1, np.int32)
        counts[rows + 1] = len(wanted)
        mask = np.ones(len(column), bool)
        mask[rows] = False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(found), mask=pa.array(mask))

    return score.asNondeterministic()(vector)


def max_similarities(vectors: Column, examples: list[list[list[float]]], distance: str) -> Column:
    """For points of several vectors: of each example, itself several, the sum of its vectors' best similarities."""
    wanted = [np.asarray(e, np.float64) for e in examples]
    every = np.concatenate(wanted)
    size, bounds = every.shape[1], np.cumsum([0, *map(len, wanted)])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(column: pa.Array) -> pa.Array:
        inner, length = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(column)), length)
        rows, m = matrix_of(inner, size)
        owner = owner[rows]
        if not len(rows):
            return pa.nulls(len(column), pa.list_(pa.float64()))
        # All vectors of all points in one product, then the greatest of each point's.
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.maximum.reduceat(similarity_matrix(m, every, distance), start, axis=0)
        sums = np.add.reduceat(best, bounds[:-1], axis=1)
        counts, mask = np.zeros(len(column) + 1, np.int32), np.ones(len(column), bool)
        counts[owner[start] + 1], mask[owner[start]] = len(wanted), False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(sums.ravel()), mask=pa.array(mask))

    return score.asNondeterministic()(vectors)


def sparse_product(vector: Column, indices: list[int], values: list[float]) -> Column:
    """The product over common indices; null without any."""
    if not indices:
        return F.lit(None).cast("double")
    keys, place = np.unique(np.asarray(indices, np.int64), return_inverse=True)
    weights = np.bincount(place, np.asarray(values, np.float64))

    @F.arrow_udf(T.DoubleType())
    def product(dims: pa.Array, entries: pa.Array) -> pa.Array:
        length = dims.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(dims)), length)
        dim, entry = (x.flatten().to_numpy(zero_copy_only=False) for x in (dims, entries))
        at = np.minimum(np.searchsorted(keys, dim), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == dim)
        total = np.bincount(owner[hit], weights[at[hit]] * entry[hit].astype(np.float64), len(dims))
        return pa.array(total, mask=np.bincount(owner[hit], minlength=len(dims)) == 0)

    return product.asNondeterministic()(vector["indices"], vector["values"])
