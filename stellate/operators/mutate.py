"""Changes of points and payloads. Each gives a new collection; tables are never changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection, Dense
from ..functions import jsonops


def _chosen(c: Collection, ids: list | None, filter: dict | None) -> Column:
    if ids is None and filter is None:
        raise ValueError("ids or a filter are needed")
    by_id = F.col(c.id).isin(list(ids)) if ids else F.lit(False)
    return F.coalesce(by_id | (c.condition(filter) if filter is not None else F.lit(False)), F.lit(False))


def upsert(c: Collection, points: DataFrame, mode: str = "upsert", filter: dict | None = None) -> Collection:
    """Puts whole points: what they don't give is dropped. Of points alike in id the last wins, by a column _order;
    without that column, ids that occur twice are an error when the result is read.

    mode: upsert (with a filter, existing points that fail it stay), insert_only (existing ones stay), update_only
    (only existing ones that meet the filter).
    """
    names = c.df.columns
    given = points.columns
    if "_order" in given:
        last = Window.partitionBy(c.id).orderBy(F.col("_order").desc())
        points = points.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    else:
        again = F.count("*").over(Window.partitionBy(c.id)) > 1
        kind = points.schema[c.id].dataType
        points = points.withColumn("_n", again).withColumn(c.id, F.when(F.col("_n"), F.raise_error(F.lit("points alike in id need a column _order")).cast(kind)).otherwise(F.col(c.id)))
    new = points.select(*[F.col(n) if n in given else F.lit(None).cast(c.df.schema[n].dataType).alias(n) for n in names])
    old, key = c.df, c.id
    if mode == "insert_only":
        return c.with_df(old.unionByName(new.join(old.select(key), key, "left_anti").select(*names)))
    state = old.select(key, c.condition(filter).alias("_ok"))
    if mode == "update_only":
        new = new.join(state.where("_ok").select(key), key, "left_semi")
    elif mode != "upsert":
        raise ValueError(f"unknown mode {mode!r}")
    elif filter is not None:
        new = new.join(state.where("NOT _ok").select(key), key, "left_anti")
    return c.with_df(old.join(new.select(key), key, "left_anti").select(*names).unionByName(new.select(*names)))


def sync_points(c: Collection, points: DataFrame, from_id=None, to_id=None) -> Collection:
    """Makes the points whose ids are from from_id up to, without it, to_id exactly those given; no bound on a side if None."""
    inside = F.lit(True)
    if from_id is not None:
        inside = inside & (F.col(c.id) >= F.lit(from_id))
    if to_id is not None:
        inside = inside & (F.col(c.id) < F.lit(to_id))
    outside = c.df.where(~inside)
    empty = c.with_df(c.df.where(F.lit(False)))
    return c.with_df(outside.unionByName(upsert(empty, points.where(inside)).df))


def delete(c: Collection, ids: list | None = None, filter: dict | None = None) -> Collection:
    return c.with_df(c.df.where(~_chosen(c, ids, filter)))


def update_vectors(c: Collection, vectors: DataFrame) -> Collection:
    """vectors: the id and columns of vectors; those that are null stay as they are. Unknown ids are an error when the result is read."""
    columns = [n for n in vectors.columns if n != c.id]
    new = vectors.select(F.col(c.id).alias("_id"), *[F.col(n).alias(f"_new_{n}") for n in columns])
    both = c.df.join(new, F.col(c.id) == F.col("_id"), "full_outer")
    checked = F.when(F.col(c.id).isNull(), F.raise_error(F.concat(F.lit("no point "), F.col("_id").cast("string"))).cast(c.df.schema[c.id].dataType)).otherwise(F.col(c.id))
    return c.with_df(both.select(*[checked.alias(n) if n == c.id else F.coalesce(f"_new_{n}", n).alias(n) if n in columns else F.col(n) for n in c.df.columns]))


def delete_vectors(c: Collection, names: list[str], ids: list | None = None, filter: dict | None = None) -> Collection:
    chosen = _chosen(c, ids, filter)
    gone = {c.vector(n).column for n in names}
    return c.with_df(c.df.select(*[F.when(~chosen, F.col(n)).alias(n) if n in gone else F.col(n) for n in c.df.columns]))


def _payload(c: Collection, new: Column, ids: list | None, filter: dict | None) -> Collection:
    if c.payload is None:
        raise ValueError("the collection has no JSON payload")
    changed = F.when(_chosen(c, ids, filter), new).otherwise(F.col(c.payload)).alias(c.payload)
    return c.with_df(c.df.select(*[changed if n == c.payload else F.col(n) for n in c.df.columns]))


def set_payload(c: Collection, payload: dict, ids: list | None = None, filter: dict | None = None, key: str | None = None) -> Collection:
    """Merges keys into the payload, or into the object at a path; null removes a key."""
    return _payload(c, jsonops.set_payload(F.col(c.payload), payload, key), ids, filter)


def overwrite_payload(c: Collection, payload: dict, ids: list | None = None, filter: dict | None = None) -> Collection:
    import json

    return _payload(c, F.lit(json.dumps(payload, separators=(",", ":"))), ids, filter)


def delete_payload(c: Collection, keys: list[str], ids: list | None = None, filter: dict | None = None) -> Collection:
    return _payload(c, jsonops.delete_keys(F.col(c.payload), keys), ids, filter)


def clear_payload(c: Collection, ids: list | None = None, filter: dict | None = None) -> Collection:
    return _payload(c, F.lit("{}"), ids, filter)


_OPERATIONS = {f.__name__: f for f in (upsert, sync_points, delete, update_vectors, delete_vectors, set_payload, overwrite_payload, delete_payload, clear_payload)}


def update_batch(c: Collection, operations: list[tuple[str, dict]]) -> Collection:
    """Operations by name with their arguments, one after the other."""
    return reduce(lambda state, op: _OPERATIONS[op[0]](state, **op[1]), operations, c)


def create_index(c: Collection, key: str, kind) -> Collection:
    from dataclasses import replace

    return replace(c, index={**c.index, key: kind})


def delete_index(c: Collection, key: str) -> Collection:
    from dataclasses import replace

    return replace(c, index={k: v for k, v in c.index.items() if k != key})


def create_vector(c: Collection, name: str, params: Dense) -> Collection:
    from dataclasses import replace

    kind = "array<array<float>>" if params.multi else "array<float>"
    return replace(c, df=c.df.withColumn(params.column, F.lit(None).cast(kind)), vectors={**c.vectors, name: params})


def delete_vector(c: Collection, name: str) -> Collection:
    from dataclasses import replace

    return replace(c, df=c.df.drop(c.vector(name).column), vectors={k: v for k, v in c.vectors.items() if k != name}, sparse={k: v for k, v in c.sparse.items() if k != name})
