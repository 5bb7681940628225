"""Differences between two copies of a table, field by field.

Identical rows cancel by multiplicity. What is left of a key on both sides is paired so that the paired
rows differ in as few names (fields, or keys of a payload) as possible in all: a minimum-cost assignment. A pair that
differs in nothing, as vectors within the tolerance do, cancels too. The rest is missing on one side.

A key of up to EXACT_LIMIT unmatched rows a side is paired by one assignment. Beyond, no matrix of all pairs fits in a task:
rows are dealt to parts in which like ones meet, each part is paired by an assignment of the same costs, and the pairs are
dealt out and assigned again in other ways, ROUNDS times. Each round leaves the total cost as it is or lowers it.

Defined results: a key of null is a key like any other; fields that are null on both sides are equal;
repeated rows count as often as they occur; an empty table makes every row of the other one missing; columns
besides the key, the version and the compared fields are ignored, so their names may clash. A payload that isn't
a JSON object is compared as text, under the field's own name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical_json import top_level
from ..session import checkpoint

#: Up to so many unmatched rows a side, a key is paired by one assignment; larger ones in so many rounds.
EXACT_LIMIT, ROUNDS = 1024, 8


@dataclass(frozen=True)
class Compare:
    """How a field is compared. kind: value (as is), vector (components within tolerance), sparse (indices to values), json (by top-level key)."""

    field: str
    kind: str = "value"
    tolerance: float = 0.0


_ENTRIES = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))
_PAIRS = T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())]))


@F.arrow_udf(_ENTRIES)
def _entries(payloads: pa.Array) -> pa.Array:
    """Of each JSON text its canonical top-level entries; one entry without a key of what isn't an object."""
    offsets, keys, values = [0], [], []
    for text in payloads.to_pylist():
        found = top_level(text)
        for k, v in [(None, text)] if found is None else found:
            keys.append(k if k is None or k.isascii() else k.encode("utf-8", "backslashreplace").decode())
            values.append(v)
        offsets.append(len(keys))
    entries = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["k", "v"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def _canonical(how: Compare) -> Column:
    c = F.col(how.field)
    if how.kind == "sparse":
        return F.when(c.isNotNull(), F.array_sort(F.array_distinct(F.arrays_zip(c["indices"], c["values"]))))
    return _entries(c) if how.kind == "json" else c


def _differing(how: Compare, left: Column, right: Column) -> Column:
    """The names of what differs in this field, as an array."""
    if how.kind == "json":
        only = F.array_union(F.array_except(left, right), F.array_except(right, left))
        names = F.transform(only, lambda e: F.when(e["k"].isNull(), F.lit(how.field)).otherwise(F.concat(F.lit(f"{how.field}."), e["k"])))
        return F.array_distinct(names)
    if how.kind == "vector":
        apart = F.exists(
            F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")) > how.tolerance),
            lambda x: F.coalesce(x, F.lit(False)),
        )
        nulls = F.exists(F.zip_with(left, right, lambda a, b: a.isNull() != b.isNull()), lambda x: x)
        equal = (left.isNull() & right.isNull()) | (left.isNotNull() & right.isNotNull() & (F.size(left) == F.size(right)) & ~apart & ~nulls)
        return F.when(F.coalesce(equal, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(how.field)))
    return F.when(left.eqNullSafe(right), F.array().cast("array<string>")).otherwise(F.array(F.lit(how.field)))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix with no more rows than columns, the column of a cheapest assignment.

    Shortest augmenting paths with dual prices, a row at a time, from a start where rows that have a cheapest column to
    themselves take it.
    """
    rows, columns = cost.shape
    row_price, column_price = cost.min(axis=1) if columns else np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    open_rows = []
    for start in range(rows):
        free = np.flatnonzero((cost[start] == row_price[start]) & (owner < 0))
        if len(free):
            owner[free[0]] = start
        else:
            open_rows.append(start)
    for start in open_rows:
        reach = np.full(columns, np.inf)
        via = np.full(columns, -1)
        done = np.zeros(columns, bool)
        row, last, so_far = start, -1, 0.0
        while True:
            slack = so_far + cost[row] - row_price[row] - column_price
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            via[better] = last
            nearest = int(np.argmin(np.where(done, np.inf, reach)))
            so_far, last = reach[nearest], nearest
            done[nearest] = True
            if owner[nearest] < 0:
                break
            row = owner[nearest]
        seen = np.flatnonzero(done & (owner >= 0))
        row_price[start] += so_far
        row_price[owner[seen]] += so_far - reach[seen]
        column_price[done] -= so_far - reach[done]
        while last >= 0:
            owner[last] = owner[via[last]] if via[last] >= 0 else start
            last = via[last]
    chosen = np.full(rows, -1)
    taken = np.flatnonzero(owner >= 0)
    chosen[owner[taken]] = taken
    return chosen


def _costs(fields: list[Compare], rows: list[dict], left: list[int], right: list[int]) -> np.ndarray:
    """In how many names each left row differs from each right one; as _differing. Values are coded as numbers."""
    total = np.zeros((len(left), len(right)), np.int32)

    def unequal(values: list) -> np.ndarray:
        code: dict = {}
        made = np.array([code.setdefault(v, len(code)) for v in values], np.int64)
        return made[left][:, None] != made[right][None]

    for n, how in enumerate(fields):
        values = [r[f"f{n}"] for r in rows]
        if how.kind == "json":
            entries = [{e["k"]: e["v"] for e in v or ()} for v in values]
            for key in {k for e in entries for k in e}:
                total += unequal([(e[key],) if key in e else None for e in entries])
            continue
        apart = unequal([_plain(v) for v in values])
        if how.kind == "vector" and how.tolerance > 0:
            for size in {len(v) for v in values if v}:
                here = lambda side: np.array([i for i, r in enumerate(side) if values[r] and len(values[r]) == size and None not in values[r]], np.int64)
                a, b = here(left), here(right)
                if len(a) and len(b):
                    y = np.array([values[right[i]] for i in b])
                    for i in a:
                        x = np.array(values[left[i]])
                        with np.errstate(invalid="ignore"):
                            same = (x == y) | (np.abs(x - y) <= how.tolerance) | np.isnan(x) & np.isnan(y)
                        apart[i, b[same.all(axis=1)]] = False
        total += apart
    return total


def _plain(value):
    """A value that can be a key."""
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return tuple(map(_plain, value)) if isinstance(value, list) else "nan" if isinstance(value, float) and value != value else value


def _pairer(fields: list[Compare]):
    """An UDF from the unmatched rows of a key to pairs of places in that list, -1 where a partner is missing."""

    @F.arrow_udf(_PAIRS)
    def pairs(groups: pa.Array) -> pa.Array:
        result = []
        for rows in groups.to_pylist():
            if rows is None:
                result.append(None)
                continue
            left, right = ([i for i, x in enumerate(rows) if sign * x["net"] > 0] for sign in (1, -1))
            cost = _costs(fields, rows, left, right)
            # Rows that occur several times stand for as many.
            few, many = (np.repeat(np.arange(len(side)), [abs(rows[i]["net"]) for i in side]) for side in (left, right))
            flip = len(few) > len(many)
            cost = cost[np.ix_(few, many)]
            to = assignment((cost.T if flip else cost).astype(float)) if len(few) and len(many) else np.empty(0, np.int64)
            at = np.arange(len(to))
            l, r = (to, at) if flip else (at, to)
            out = [(left[few[i]], right[many[j]]) for i, j in zip(l, r)]
            out += [(left[few[i]], -1) for i in np.setdiff1d(np.arange(len(few)), l)] + [(-1, right[many[j]]) for j in np.setdiff1d(np.arange(len(many)), r)]
            result.append([{"l": i, "r": j} for i, j in out])
        return pa.array(result, pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))

    return pairs


def _unmatched(left: DataFrame, right: DataFrame, key: str, fields: list[Compare], version: str | None) -> DataFrame:
    """(key, net, f0, f1 ...): canonical rows that one side has more often, net times."""
    def canon(df: DataFrame, side: int) -> DataFrame:
        extra = [F.coalesce(F.col(version).cast("long"), F.lit(-(2**63))).alias("version")] if version else []
        return df.select(F.col(key).alias("key"), *extra, F.lit(side).alias("side"), *[_canonical(f).alias(f"f{n}") for n, f in enumerate(fields)])

    names = [f"f{n}" for n in range(len(fields))]
    sides = canon(left, 1).unionByName(canon(right, -1))
    if version:
        row = F.struct(*names)
        newest = [F.max_by(F.when(F.col("side") == s, row), F.when(F.col("side") == s, F.col("version"))).alias(n) for s, n in ((1, "l"), (-1, "r"))]
        kept = F.filter(F.array(F.struct(F.lit(1).alias("side"), F.col("l").alias("row")), F.struct(F.lit(-1).alias("side"), F.col("r").alias("row"))), lambda x: x["row"].isNotNull())
        sides = sides.groupBy("key").agg(*newest).select("key", F.explode(kept).alias("x")).select("key", "x.side", "x.row.*")
    return sides.groupBy("key", *names).agg(F.sum("side").cast("int").alias("net")).where("net <> 0")


def _pair_small(rows: DataFrame, fields: list[Compare]) -> DataFrame:
    """Pairs of the unmatched rows of each key, (key, l, r) with the canonical rows or null; keys with few rows each."""
    names = [f"f{n}" for n in range(len(fields))]
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("net", *names)).alias("rows"))
    left, right = F.filter("rows", lambda x: x["net"] > 0), F.filter("rows", lambda x: x["net"] < 0)
    simple = F.forall("rows", lambda x: F.abs(x["net"]) == 1) & (F.size(left) <= 1) & (F.size(right) <= 1)
    place = lambda sign: (F.array_position(F.transform("rows", lambda x: F.signum(x["net"]).cast("int")), F.lit(sign)) - 1).cast("int")
    trivial = F.array(F.struct(place(1).alias("l"), place(-1).alias("r")))
    pairs = groups.withColumn("p", F.explode(F.coalesce(_pairer(fields)(F.when(~simple, F.col("rows"))), trivial)))
    at = lambda side: F.when(F.col(f"p.{side}") >= 0, F.get("rows", F.col(f"p.{side}"))).alias(side)
    return pairs.select("key", at("l"), at("r"))


def _signs(fields: list[Compare], row: str, turn: int) -> Column:
    """Hashes of all that a row has, one for each name; a vector's is that of its place on a grid, which moves with the turn."""
    parts = []
    for n, how in enumerate(fields):
        c = F.col(f"{row}.f{n}")
        if how.kind == "json":
            parts.append(F.transform(F.coalesce(c, F.array().cast(_ENTRIES)), lambda y, n=n: F.xxhash64(F.lit(n), y["k"], y["v"])))
        elif how.kind == "vector" and how.tolerance > 0:
            mean = F.aggregate(c, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0))) / F.size(c)
            cell = F.when(F.abs(mean) < how.tolerance * 2.0**60, F.floor(mean / (4 * how.tolerance) + 0.5 * (turn % 2)))
            parts.append(F.array(F.xxhash64(F.lit(n), F.size(c), cell)))
        else:
            parts.append(F.array(F.xxhash64(F.lit(n), c)))
    return F.concat(*parts)


def _pair_large(rows: DataFrame, fields: list[Compare], limit: int, rounds: int = ROUNDS) -> DataFrame:
    """As _pair_small, for keys with any number of rows, in parts of about limit rows a side at most.

    In a round, rows and pairs are put in the order of the least of their hashes under the round's seed, by which rows come
    together as likely as they are alike, and are cut into parts of as many of either side as all have. After the rounds,
    what is left on both sides of a key is paired in further ones.
    """
    names = [f"f{n}" for n in range(len(fields))]
    row = F.struct(*names)
    units = rows.select("key", "net", row.alias("row"), F.explode(F.sequence(F.lit(1), F.abs("net"))))
    units = checkpoint(units.select("key", F.when(F.col("net") > 0, F.col("row")).alias("l"), F.when(F.col("net") < 0, F.col("row")).alias("r")))
    turn = 0
    while True:
        side = F.when(F.col("l").isNull(), 2).when(F.col("r").isNull(), 1).otherwise(0).alias("side")
        # A pair goes by one of its rows, in turns.
        by = {s: F.array_min(F.transform(_signs(fields, s, turn), lambda y: F.xxhash64(F.lit(turn), y))) for s in "lr"}
        order = ("lr", "rl")[turn // 2 % 2]
        like = F.when(F.col(order[0]).isNotNull(), by[order[0]]).otherwise(by[order[1]])
        placed = units.withColumns({"side": side, "like": like, "mixed": F.xxhash64(F.lit(turn), "l", "r")}).withColumn("salt", F.shiftright("like", 54))
        if turn >= rounds:
            left = placed.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b")).where("a > 0 and b > 0")
            if left.isEmpty():
                break
            placed = placed.withColumn("like", F.when(F.col("side") > 0, F.col("mixed")).otherwise(F.col("like"))).withColumn("salt", F.shiftright("like", 54))
        # The place of a row among those of its kind: what comes before in other salts, and in its own.
        counts = checkpoint(placed.groupBy("key", "side", "salt").count())
        before = Window.partitionBy("key", "side").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        kinds = counts.groupBy("key").agg(*[F.sum(F.when(F.col("side") == n, F.col("count")).otherwise(0)).alias(f"n{n}") for n in range(3)])
        skip = counts.select("key", "side", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
        skip = _same(skip, kinds, ["key"]).withColumn("parts", F.ceil((F.col("n0") + F.greatest("n1", "n2")) / limit))
        place = F.row_number().over(Window.partitionBy("key", "side", "salt").orderBy("like", "mixed")) - 1
        dealt = _same(placed.withColumn("place", place), skip, ["key", "side", "salt"])
        mine = F.when(F.col("side") == 0, F.col("n0")).when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n2"))
        part = F.floor((F.col("place") + F.col("skip")) * F.col("parts") / mine).alias("part")
        rows_of = F.filter(F.array(*[F.struct(F.lit(net).alias("net"), *[F.col(f"{s}.{n}").alias(n) for n in names], F.col(s).isNotNull().alias("there")) for net, s in ((1, "l"), (-1, "r"))]), lambda x: x["there"])
        groups = dealt.groupBy("key", part).agg(F.flatten(F.collect_list(rows_of)).alias("rows"))
        paired = groups.withColumn("p", F.explode(_pairer(fields)("rows")))
        at = lambda s: F.when(F.col(f"p.{s}") >= 0, F.struct(*[F.get("rows", F.col(f"p.{s}"))[n].alias(n) for n in names])).alias(s)
        units = checkpoint(paired.select("key", at("l"), at("r")))
        turn += 1
    return units


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """An inner join where a key of null is a key."""
    b = b.select(*[F.col(n).alias(f"_{n}") for n in on], *[n for n in b.columns if n not in on])
    match = F.lit(True)
    for n in on:
        match = match & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return a.join(b, match).drop(*[f"_{n}" for n in on])


def paired_copies(left: DataFrame, right: DataFrame, key: str, fields: list[Compare], version: str | None = None, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """One row for each row that isn't in both copies, or pair of such rows of a key that differ: (key, side, fields).

    side is 'both', 'left' or 'right'; fields names what differs in a pair. With version, only the row of a key's
    highest version counts, of which each side has one at most.
    """
    rows = _unmatched(left, right, key, fields, version)
    if version:
        pairs = _pair_small(rows, fields)
    else:
        rows = checkpoint(rows)
        size = rows.groupBy("key").agg((F.greatest(F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0)), -F.sum(F.when(F.col("net") < 0, F.col("net")).otherwise(0))) > exact_limit).alias("large"))
        large = size.where("large").select(F.col("key").alias("hot"))
        few = rows.join(large, F.col("key").eqNullSafe(F.col("hot")), "left_anti")
        pairs = _pair_small(few, fields).select("key", *[F.when(F.col(s).isNotNull(), F.struct(*[F.col(f"{s}.f{n}") for n in range(len(fields))])).alias(s) for s in "lr"])
        if not large.isEmpty():
            pairs = pairs.unionByName(_pair_large(rows.join(large, F.col("key").eqNullSafe(F.col("hot")), "left_semi"), fields, max(exact_limit, 2)))
    names = F.concat(*[_differing(f, F.col(f"l.f{n}"), F.col(f"r.f{n}")) for n, f in enumerate(fields)])
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    found = pairs.select(F.col("key").alias(key), side.alias("side"), F.when(side == "both", names).alias("fields"))
    # What differs in nothing cancels.
    return found.where((F.col("side") != "both") | (F.size("fields") > 0))


def diff_copies(left: DataFrame, right: DataFrame, key: str, fields: list[Compare], version: str | None = None, only: tuple[str, str] = ("only_left", "only_right")) -> DataFrame:
    """(key, diff_field): a row for each field in which a pair differs, or one naming the side that alone has a row."""
    pairs = paired_copies(left, right, key, fields, version)
    one = F.when(F.col("side") == "left", F.array(F.lit(only[0]))).when(F.col("side") == "right", F.array(F.lit(only[1]))).otherwise(F.col("fields"))
    return pairs.select(key, F.explode(one).alias("diff_field"))
