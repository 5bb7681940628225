"""Reading points in order, by ids, counting and sampling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.values import parse_time
from ..plans.query import FEW, payload_columns, vector_columns


def _shown(c: Collection, with_payload, with_vectors) -> list:
    return payload_columns(c, with_payload) + vector_columns(c, with_vectors)


def order_values(c: Collection, order_by: dict) -> Column:
    """A point's values of the field as an array, those not before start_from."""
    kind = c.index.get(order_by["key"], "float")
    if kind not in ("integer", "float", "datetime"):
        raise ValueError("only numbers and times have an order")
    values, start = c.values(order_by["key"]).scalars(kind), order_by.get("start_from")
    if start is None:
        return values
    bound = parse_time(F.lit(start)) if isinstance(start, str) else F.lit(start)
    return F.filter(values, lambda x: x <= bound if order_by.get("direction") == "desc" else x >= bound)


def ordered(c: Collection, order_by: dict) -> DataFrame:
    """(id, order_value): a row for each value of the field, not before start_from; points without it are left out."""
    return c.df.select(F.col(c.id).alias("id"), F.explode(order_values(c, order_by)).alias("order_value"))


def scroll(c: Collection, filter: dict | None = None, limit: int = 10, offset=None, order_by: dict | str | None = None, with_payload=True, with_vectors=False) -> DataFrame:
    """A page of points by id from offset on, or by a payload field. The id that follows is the next page's offset: next_offset gives it."""
    if limit < 1:
        raise ValueError("limit is 1 at least")
    c = c.with_df(c.where(filter))
    if order_by is not None:
        if offset is not None:
            raise ValueError("pages in another order begin with start_from")
        spec = order_by if isinstance(order_by, dict) else {"key": order_by}
        down = spec.get("direction") == "desc"
        order = [F.col("order_value").desc(), F.col("id").desc()] if down else [F.col("order_value"), F.col("id")]
        page = ordered(c, spec).orderBy(*order).limit(limit)
        extra = _shown(c, with_payload, with_vectors)
        if extra:
            page = c.df.select(F.col(c.id).alias("_id"), *extra).join(F.broadcast(page) if limit <= FEW else page, F.col("_id") == F.col("id")).drop("_id").orderBy(*order)
        return page
    rows = c.df if offset is None else c.df.where(F.col(c.id) >= F.lit(offset))
    return rows.select(F.col(c.id).alias("id"), *_shown(c, with_payload, with_vectors)).orderBy("id").limit(limit)


def next_offset(c: Collection, filter: dict | None = None, limit: int = 10, offset=None):
    """Where the page behind this one begins, or None."""
    rows = c.where(filter) if offset is None else c.where(filter).where(F.col(c.id) >= F.lit(offset))
    last = rows.select(F.col(c.id).alias("id")).orderBy("id").limit(limit + 1).offset(limit).collect()
    return last[0][0] if last else None


def retrieve(c: Collection, ids: list, with_payload=True, with_vectors=False) -> DataFrame:
    """Points by their ids, in the order asked for; ids that don't exist are left out."""
    spark = c.df.sparkSession
    kind = c.df.schema[c.id].dataType.simpleString()
    wanted = spark.createDataFrame([(x, n) for n, x in enumerate(ids)], f"_id {kind}, ordinal int")
    rows = c.df.join(F.broadcast(wanted) if len(ids) <= FEW else wanted, F.col(c.id) == F.col("_id"))
    return rows.select(F.col(c.id).alias("id"), "ordinal", *_shown(c, with_payload, with_vectors)).orderBy("ordinal").drop("ordinal")


def count(c: Collection, filter: dict | None = None) -> DataFrame:
    return c.where(filter).agg(F.count("*").alias("count"))


def sample(c: Collection, limit: int = 10, filter: dict | None = None, seed: int | None = None) -> DataFrame:
    """Some points at random: (id, score 1.0)."""
    return c.where(filter).select(F.col(c.id).alias("id"), F.rand(seed).alias("_r")).orderBy("_r").limit(limit).select("id", F.lit(1.0).alias("score"))
