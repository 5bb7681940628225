"""Putting ranked lists together. A list has the columns id and score; lists come in their order of rank or with scores to rank by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _positions(ranked: DataFrame, larger: bool) -> DataFrame:
    """The place of each row in its list, from 0; lists are bounded by their limit."""
    order = [F.col("score").desc(), F.col("id").desc()] if larger else [F.col("score"), F.col("id")]
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def reciprocal_rank(lists: list[tuple[DataFrame, bool]], k: int = 2, weights: list[float] | None = None) -> DataFrame:
    """The sum of 1 / ((place + 1) / weight + k - 1) over the lists; a weight of 0 or less gives nothing."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists")
    parts = []
    for (frame, larger), w in zip(lists, weights):
        part = 1.0 / ((F.col("pos") + 1.0) / w + (k - 1.0)) if w > 0 else F.lit(0.0)
        parts.append(_positions(frame, larger).select("id", part.alias("part")))
    return _union(parts).groupBy("id").agg(F.sum("part").alias("score"))


def score_distribution(lists: list[tuple[DataFrame, bool]]) -> DataFrame:
    """The sum of scores, each scaled to its list's mean and three standard deviations around it; 0.5 where these are 0."""
    parts = []
    for frame, larger in lists:
        every = Window.partitionBy(F.lit(1))
        mean, spread = F.avg("score").over(every), F.stddev_samp("score").over(every)
        scaled = F.when(F.coalesce(spread, F.lit(0.0)) == 0, F.lit(0.5)).otherwise((F.col("score") - (mean - 3 * spread)) / (6 * spread))
        parts.append(frame.select("id", scaled.alias("part")))
    return _union(parts).groupBy("id").agg(F.sum("part").alias("score"))
