"""Sparse vectors as postings, and how frequent their dimensions are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(df: DataFrame, id_: str, column: str) -> DataFrame:
    """(dim, id, weight): a row for each entry of each vector."""
    return df.select(F.col(id_).alias("id"), F.explode(F.arrays_zip(F.col(column)["indices"], F.col(column)["values"])).alias("e")).select(F.col("e.indices").alias("dim"), "id", F.col("e.values").cast("double").alias("weight"))


def document_frequencies(df: DataFrame, id_: str, column: str) -> DataFrame:
    """(dim, df): in how many vectors each dimension occurs."""
    return postings(df, id_, column).groupBy("dim").agg(F.count("*").alias("df"))


def idf(n: float, df: float) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1.0)


def inverse_frequencies(corpus: DataFrame, column: str, dims: list[int]) -> dict[int, float]:
    """The weight of each of the query's dimensions, from the corpus of points that have the vector."""
    rows = corpus.where(F.col(column).isNotNull())
    wanted = F.array(*[F.lit(int(d)).cast("long") for d in dims])
    # One pass: a row for each of the query's dimensions that a vector has, and one of no dimension for the vector itself.
    each = F.concat(F.array_intersect(F.col(column)["indices"], wanted), F.array(F.lit(None).cast("long")))
    counts = dict(rows.select(F.explode(each).alias("dim")).groupBy("dim").agg(F.count("*")).collect())
    return {d: idf(counts.get(None, 0), counts.get(int(d), 0)) for d in dims}


def batch_products(df: DataFrame, id_: str, column: str, queries: DataFrame, k: int, query_weight: Column | None = None) -> DataFrame:
    """(query_id, id, score): the k best of many sparse queries (query_id, dim, weight), by joining postings on dimensions."""
    from pyspark.sql import Window

    q = queries.withColumnRenamed("weight", "query_weight")
    found = postings(df, id_, column).join(q, "dim").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc())
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
