"""A log of inserts, updates and deletes, in any order and repeated, turned into the table that it leaves.

Repeated deliveries of a change are dropped by its identifier. A change is then split into what it touches of a point
(its life, its vector, its payload as a whole, single payload keys), the latest change of each is kept by window
ranking on the log's order, and what is left is merged into the base, dropping deleted points. As only the latest of a
kind counts, the ranking drops rows before the shuffle, and a point with any number of changes is no hot spot.

Defined results: an operation that is null or unknown does nothing; so do changes without a point id. A payload that is
null or no JSON object is empty. An empty log gives the base, an empty base that of the log alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLOT = "array<struct<slot:string,k:string,text:string,vector:array<float>>>"
_MAP = "map<string,variant>"


def _slot(name: str, k=None, text=None, vector=None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(name).alias("slot"), (null if k is None else k).cast("string").alias("k"), (null if text is None else text).cast("string").alias("text"), (null if vector is None else vector).cast("array<float>").alias("vector"))


def _entries(payload: Column) -> Column:
    """(key, JSON text of the value) of an object's entries."""
    entries = F.map_entries(F.from_json(payload, _MAP, {"mode": "PERMISSIVE"}))
    return F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("text")))


def _touched() -> Column:
    """What an operation touches. slot: life (text: does it exist after), vector, payload (text: the whole), key (text null: removed)."""
    payload, vector = F.coalesce("payload", F.lit("{}")), F.col("vector")
    by_key = lambda keys, text: F.transform(keys, lambda e: F.struct(F.lit("key").alias("slot"), text(e)[0].alias("k"), text(e)[1].cast("string").alias("text"), F.lit(None).cast("array<float>").alias("vector")))
    whole = {
        "upsert_points": F.array(_slot("life", text=F.lit("y")), _slot("vector", vector=vector), _slot("payload", text=payload)),
        "delete_points": F.array(_slot("life", text=F.lit("n"))),
        "overwrite_payload": F.array(_slot("payload", text=payload)),
        "clear_payload": F.array(_slot("payload", text=F.lit("{}"))),
        "update_vectors": F.array(_slot("vector", vector=vector)),
        "delete_vectors": F.array(_slot("vector")),
        "set_payload": by_key(_entries(payload), lambda e: (e["k"], F.when(e["text"] != "null", e["text"]))),
        "delete_payload": by_key(F.filter(F.coalesce("payload_keys", F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: (k, F.lit(None))),
    }
    result = F.array().cast(_SLOT)
    for name, slots in whole.items():
        result = F.when(F.col("operation") == name, slots.cast(_SLOT)).otherwise(result)
    return result


def changes_once(ops: DataFrame) -> DataFrame:
    """Each change once, with its place in the log's order.

    Changes alike in peer, clock, tick and point are one, of which the first to arrive is kept; those without a tag are
    told apart by op_seq. Tick 0 never applies. Untagged changes come first, by op_seq, then the tagged by tick.
    """
    tag = F.col("clock_tag")
    tagged = tag["clock_tick"].isNotNull()
    named = ops.where("point_id is not null").select(
        "point_id", "operation", "payload", "payload_keys", "vector", "op_seq", tagged.alias("tagged"),
        F.when(tagged, tag["peer_id"]).alias("peer"), F.when(tagged, tag["clock_id"]).alias("clock"),
        F.when(tagged, tag["clock_tick"]).otherwise(F.col("op_seq")).alias("at"),
    )
    first = Window.partitionBy("point_id", "tagged", "peer", "clock", "at").orderBy("op_seq")
    once = named.where("not tagged or at <> 0").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return once.select("point_id", "operation", "payload", "payload_keys", "vector", F.struct(F.col("tagged"), F.col("at"), F.col("op_seq")).alias("ord"))


def apply_changes(ops: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The points that exist after ops: (point_id, payload as JSON text, vector). base has these columns too, each id once.

    The log is reduced to one row for each point it touches before that meets the base, of which each row is shuffled once.
    """
    slots = changes_once(ops).select("point_id", "ord", F.explode(_touched()).alias("s")).select("point_id", "ord", "s.*")
    newest = Window.partitionBy("point_id", "slot", "k").orderBy(F.col("ord").desc())
    last = slots.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")

    of = lambda slot, what: F.max(F.when(F.col("slot") == slot, F.struct("ord", what))).alias(slot)
    keys = F.collect_list(F.when(F.col("slot") == "key", F.struct("k", "ord", "text"))).alias("keys")
    points = last.groupBy("point_id").agg(of("life", "text"), of("payload", "text"), of("vector", "vector"), keys)
    if base is not None:
        oldest = F.struct(F.lit(False).alias("tagged"), F.lit(-(2**63)).alias("at"), F.lit(-(2**63)).alias("op_seq")).alias("ord")
        old = base.where("point_id is not null").select("point_id", F.struct(oldest, F.lit("y").alias("text")).alias("was"), F.struct(oldest, F.coalesce("payload", F.lit("{}")).alias("text")).alias("old_payload"), F.struct(oldest, F.col("vector").alias("vector")).alias("old_vector"))
        points = old.join(points, "point_id", "full_outer").select(
            "point_id", F.coalesce("life", "was").alias("life"), F.coalesce("payload", "old_payload").alias("payload"), F.coalesce("vector", "old_vector").alias("vector"),
            F.coalesce("keys", F.array().cast(points.schema["keys"].dataType)).alias("keys"),
        )
    points = points.where("life.text = 'y'")

    later = F.filter("keys", lambda e: e["ord"] > F.col("payload.ord"))
    gone = F.transform(later, lambda e: e["k"])
    kept = F.filter(_entries(F.col("payload.text")), lambda e: ~F.array_contains(gone, e["k"]))
    put = F.transform(F.filter(later, lambda e: e["text"].isNotNull()), lambda e: F.struct(e["k"].alias("k"), e["text"].alias("text")))
    quoted = lambda k: F.to_json(F.array(k))
    text = F.array_join(F.transform(F.array_sort(F.concat(kept, put)), lambda e: F.concat(F.regexp_replace(quoted(e["k"]), r"^\[|\]$", ""), F.lit(":"), e["text"])), ",")
    return points.select("point_id", F.concat(F.lit("{"), text, F.lit("}")).alias("payload"), F.col("vector.vector").alias("vector"))
