"""Scores of a point from its similarities to the examples of a request; greater is better in all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the smallest step from 1 in single precision.
EPSILON = 1.1920928955078125e-07


def fast_sigmoid(x: Column) -> Column:
    return x / (1.0 + F.abs(x))


def scaled_sigmoid(x: Column) -> Column:
    return 0.5 * (fast_sigmoid(x) + 1.0)


def _most(xs: list[Column]) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(float("-inf"))


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs, F.lit(0.0))


def best_score(positive: list[Column], negative: list[Column]) -> Column:
    p, n = _most(positive), _most(negative)
    return F.when(p > n, scaled_sigmoid(p)).otherwise(-scaled_sigmoid(n))


def sum_scores(positive: list[Column], negative: list[Column]) -> Column:
    return _sum(positive) - _sum(negative)


def discover(target: Column, pairs: list[tuple[Column, Column]]) -> Column:
    """In how many pairs the positive example is the nearer one, less those with the negative; then the target decides."""
    return _sum([F.signum(p - n) for p, n in pairs]) + scaled_sigmoid(target)


def context(pairs: list[tuple[Column, Column]]) -> Column:
    """Zero where all pairs are on the positive side, else how far off."""
    return _sum([fast_sigmoid(F.least(p - n - EPSILON, F.lit(0.0))) for p, n in pairs])


def feedback(target: Column, pairs: list[tuple[Column, Column, float]], a: float, b: float, c: float) -> Column:
    """pairs: a better and a worse example, and by how much."""
    return a * target + _sum([(p - n) * (confidence**b * c) for p, n, confidence in pairs])
