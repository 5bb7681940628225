"""Compressed vectors, scanned for candidates that are scored again with the originals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import Collection, Dense
from ..functions import metrics
from ..plans.query import Ranked


@dataclass(frozen=True)
class Scalar:
    """A byte for each component: its place between two quantiles of all components."""

    low: float
    high: float

    @staticmethod
    def fit(df: DataFrame, column: str, quantile: float = 0.99, sample: int = 10_000, seed: int = 3) -> Scalar:
        """From at most sample vectors, by a hash."""
        edge = (1 - quantile) / 2
        rows = df.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column, F.lit(seed))).limit(sample)
        low, high = rows.select(F.explode(column).alias("x")).select(F.percentile_approx("x", [edge, 1 - edge], 10000)).first()[0]
        return Scalar(float(low), float(high))

    def encode(self, v: np.ndarray) -> np.ndarray:
        span = (self.high - self.low) or 1.0
        return np.clip(np.rint((v - self.low) / span * 255), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.float64) / 255 * (self.high - self.low) + self.low


@dataclass(frozen=True)
class Binary:
    """A bit for each component: its sign. Similar vectors differ in few bits."""

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(v > 0, axis=1)


@dataclass(frozen=True)
class Product:
    """For each part of a vector the number of the nearest of up to 256 centres, fitted on a sample of at most sample rows."""

    centres: np.ndarray  # parts x centres x components

    @staticmethod
    def fit(df: DataFrame, column: str, part: int = 8, centres: int = 256, sample: int = 10_000, rounds: int = 15, seed: int = 3) -> Product:
        rows = df.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column, F.lit(seed))).limit(sample).collect()
        m = np.array([r[0] for r in rows], np.float64)
        rng, out = np.random.default_rng(seed), []
        for a in range(0, m.shape[1], part):
            x = m[:, a : a + part]
            c = x[rng.permutation(len(x))[: min(centres, len(x))]].copy()
            for _ in range(rounds):
                near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
                for n in np.unique(near):
                    c[n] = x[near == n].mean(axis=0)
            out.append(np.pad(c, ((0, 0), (0, part - c.shape[1]))))
        return Product(np.stack(out))

    def encode(self, v: np.ndarray) -> np.ndarray:
        parts, _, size = self.centres.shape
        v = np.pad(v, ((0, 0), (0, parts * size - v.shape[1])))
        near = [((self.centres[n] ** 2).sum(1)[None] - 2 * v[:, n * size : (n + 1) * size] @ self.centres[n].T).argmin(1) for n in range(parts)]
        return np.stack(near, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([self.centres[n][codes[:, n]] for n in range(len(self.centres))], axis=1)[:, :size]


@dataclass(frozen=True)
class Rotated:
    """After a random rotation the components of any vector are spread like a normal variable: each gets one of 2 ** bits levels.

    bits is 1, 2 or 4; the vector's length is kept beside the codes.
    """

    bits: int = 4
    seed: int = 5

    def _rotation(self, size: int) -> np.ndarray:
        return np.linalg.qr(np.random.default_rng((self.seed, size)).standard_normal((size, size)))[0]

    def _levels(self) -> np.ndarray:
        """The levels that are nearest to a normal variable in the mean square, by iteration on a fine grid."""
        grid = np.linspace(-6, 6, 20_001)
        mass = np.exp(-grid * grid / 2)
        levels = np.linspace(-2, 2, 1 << self.bits)
        for _ in range(200):
            near = np.searchsorted((levels[1:] + levels[:-1]) / 2, grid)
            levels = np.bincount(near, mass * grid, len(levels)) / np.maximum(np.bincount(near, mass, len(levels)), 1e-300)
        return levels

    def encode(self, v: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(v, axis=1)
        spread = metrics.normalised(v) @ self._rotation(v.shape[1]).T * np.sqrt(v.shape[1])
        levels = self._levels()
        codes = np.searchsorted((levels[1:] + levels[:-1]) / 2, spread).astype(np.uint8)
        bits = (codes[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return np.concatenate([length.astype("<f4").view(np.uint8).reshape(len(v), 4), np.packbits(bits.reshape(len(v), -1), axis=1)], axis=1)

    def decode(self, codes: np.ndarray, size: int) -> np.ndarray:
        length = np.ascontiguousarray(codes[:, :4]).view("<f4").astype(np.float64)
        bits = np.unpackbits(codes[:, 4:], axis=1)[:, : size * self.bits].reshape(len(codes), size, self.bits)
        spread = self._levels()[bits @ (1 << np.arange(self.bits))]
        return spread @ self._rotation(size) / np.sqrt(size) * length


def encode_column(c: Collection, model, column: str, using: str = "") -> Collection:
    """Adds a column of codes."""
    target = c.vector(using)
    assert isinstance(target, Dense)
    unit = target.distance == "Cosine"

    @F.arrow_udf(T.BinaryType())
    def codes(vectors: pa.Array) -> pa.Array:
        rows, m = metrics.matrix_of(vectors, target.size)
        found = model.encode(metrics.normalised(m) if unit else m.astype(np.float64))
        out: list = [None] * len(vectors)
        for n, row in zip(rows.tolist(), found):
            out[n] = row.tobytes()
        return pa.array(out, pa.binary())

    return c.with_df(c.df.withColumn(column, codes(F.col(target.column))))


def search(c: Collection, model, column: str, vector: list[float], limit: int = 10, oversampling: float = 3.0, using: str = "", filter: dict | None = None, rescore: bool = True) -> DataFrame:
    """(id, score): the best by their codes, limit times oversampling of them, of which the best by the vectors themselves."""
    target = c.vector(using)
    wanted = np.asarray([vector], np.float64)
    unit = metrics.normalised(wanted) if target.distance == "Cosine" else wanted

    @F.arrow_udf(T.DoubleType())
    def rough(data: pa.Array) -> pa.Array:
        rows = [n for n, x in enumerate(data.is_valid().to_pylist()) if x]
        out = np.full(len(data), np.nan)
        if rows:
            codes = np.frombuffer(b"".join(data.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
            if isinstance(model, Binary):
                out[rows] = -np.unpackbits(codes ^ model.encode(unit), axis=1).sum(axis=1).astype(np.float64)
            else:
                decoded = model.decode(codes) if isinstance(model, Scalar) else model.decode(codes, target.size)
                out[rows] = metrics.similarity_matrix(decoded, unit, "Dot" if target.distance == "Cosine" else target.distance)[:, 0]
        return pa.array(out, mask=np.isnan(out))

    many = max(limit, int(limit * oversampling)) if rescore else limit
    rows = c.where(filter).select(F.col(c.id).alias("id"), F.col(target.column).alias("v"), rough.asNondeterministic()(F.col(column)).alias("score")).where("score IS NOT NULL")
    best = rows.orderBy(F.col("score").desc(), F.col("id").desc()).limit(many)
    if rescore:
        best = best.select("id", metrics.similarities(F.col("v"), [vector], target.distance).alias("s"))
        best = best.select("id", metrics.shown(F.get("s", F.lit(0)), target.distance).alias("score"))
    return Ranked(best.select("id", "score"), metrics.larger_better(target.distance) or not rescore).top(limit).df
