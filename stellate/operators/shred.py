"""Deeply nested records as flat tables that keep the links between parents and children.

A record is shredded into columns, one for each leaf path of a declared tree, with a repetition level (at which
repeated ancestor the path goes on) and a definition level (how much of the path is there) for each value. The table of
every repeated ancestor is made again from these level sequences alone: counting repetition levels gives positions,
comparing definition levels tells which nodes there are and which of their leaves. Only columns of the tables asked for
are shredded; shred makes all tables in one pass.

Defined results: a record that is null, cut off, no JSON object or lacks the root gives no rows. A single value in place
of an array is its element 0; a null element holds its position without being a node; a string is a node of that name;
numbers, booleans and arrays within an array are no nodes. Lone surrogates in names become '?'. A leaf that is absent, null
or of another type than declared is null. What a node has beyond its name, leaves of their type and children that are all
nodes stands in rest, as JSON, so that assemble gives back every node as it was; rest of a string is null.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """A value of a node: its column, its keys from the node on, its type: string or double."""

    name: str
    path: tuple[str, ...]
    kind: str = "string"

    def fits(self, value) -> bool:
        if self.kind == "string":
            return isinstance(value, str)
        return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 2**53


@dataclass(frozen=True)
class Repeated:
    """A repeated node: its key in the parent, the letter of its positions, its table, its children, its leaves, the key of its name."""

    key: str
    letter: str
    table: str
    children: tuple[Repeated, ...] = ()
    leaves: tuple[Leaf, ...] = ()
    label: str = "name"


#: The two spellings of a dynamically typed value's kinds, and what they hold.
_KINDS = {"nullValue": "null", "null_value": "null", "numberValue": "number", "number_value": "number", "doubleValue": "number", "double_value": "number", "integerValue": "number", "integer_value": "number", "stringValue": "plain", "string_value": "plain", "boolValue": "plain", "bool_value": "plain", "structValue": "struct", "struct_value": "struct", "listValue": "list", "list_value": "list"}


def _refuse(name: str):
    raise ValueError(name)


_load = json.JSONDecoder(parse_constant=_refuse).decode


def is_typed(value) -> bool:
    """Whether a decoded value has the form of a dynamically typed one."""
    return isinstance(value, dict) and (not value or len(value) == 1 and next(iter(value)) in _KINDS)


def untyped(value):
    """The plain form of a dynamically typed value; what hasn't that form stays as it is."""
    if not is_typed(value):
        return value
    if not value:
        return None
    ((kind, inner),) = value.items()
    of = _KINDS[kind]
    if of == "plain":
        return inner
    if of == "number":  # which may be written as a text
        return float(inner) if isinstance(inner, str) else inner
    if of == "null" or inner is None:
        return None
    if of == "list":
        items = inner.get("values") if isinstance(inner, dict) else inner
        return [untyped(x) for x in items] if isinstance(items, list) else []
    fields = inner.get("fields") if isinstance(inner, dict) else None
    return {k: untyped(x) for k, x in fields.items()} if isinstance(fields, dict) else {}


def record(text: str | None, wire: str | None) -> dict | None:
    """The decoded object of a payload. Of an unknown wire format the form decides: typed if every value has that form."""
    if text is None:
        return None
    try:
        found = _load(text)
        if not isinstance(found, dict):
            return None
        if wire == "grpc" or wire != "rest" and found and all(map(is_typed, found.values())):
            return {k: untyped(v) for k, v in found.items()}
    except (ValueError, RecursionError):
        return None
    return found


def _finite(value):
    """What JSON can't write is null."""
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


@F.arrow_udf(T.StringType())
def plain_json(texts: pa.Array, wires: pa.Array) -> pa.Array:
    """Payloads of any wire format as plain JSON; null of what can't be decoded. Those of rest stay as they are."""
    out: list[str | None] = []
    for text, wire in zip(texts.to_pylist(), wires.to_pylist()):
        found = text if wire == "rest" else record(text, wire)
        out.append(json.dumps(_finite(found)) if isinstance(found, dict) else found)
    return pa.array(out, pa.string())


def _found(value, path: tuple[str, ...]) -> tuple[int, object]:
    """How many keys of a path lead to a value that isn't null, and the last one."""
    for n, key in enumerate(path):
        value = value.get(key) if isinstance(value, dict) else None
        if value is None:
            return n, None
    return len(path), value


def _rest(item: dict, node: Repeated) -> str:
    """JSON of what the columns of a node and its children don't hold."""
    rest = {}
    children = {c.key for c in node.children}
    for key, value in item.items():
        if key == node.label and isinstance(value, str) and value:
            continue
        if key in children and isinstance(value, list) and value and all(isinstance(x, (dict, str)) for x in value):
            continue
        leaves = [x for x in node.leaves if x.path[0] == key]
        if leaves:
            value = _without(value, [(x.path[1:], x) for x in leaves])
            if value is _HELD:
                continue
        rest[key] = value
    return json.dumps(_finite(rest))


_HELD = object()


def _without(value, leaves: list[tuple[tuple[str, ...], Leaf]]):
    """A value without those of the leaves that fit; _HELD if nothing is left."""
    if any(not path and leaf.fits(value) for path, leaf in leaves):
        return _HELD
    if not isinstance(value, dict) or not value:
        return value
    left = {}
    for k, x in value.items():
        below = [(path[1:], leaf) for path, leaf in leaves if path and path[0] == k]
        x = _without(x, below) if below else x
        if x is not _HELD:
            left[k] = x
    return left or _HELD


class Columns:
    """The columns of a tree: for each repeated node wanted its name, rest and leaves, each with a definition level.

    A node and its leaves repeat alike, so they share the repetition levels.
    """

    def __init__(self, root: Repeated, only: set[str] | None = None, leaves: bool = True):
        self.paths: list[tuple[Repeated, ...]] = []
        self.below: set[tuple[Repeated, ...]] = set()  # paths that lead to a wanted node, or are one

        def add(path: tuple[Repeated, ...]) -> bool:
            wanted = only is None or path[-1].table in only
            if wanted:
                self.paths.append(path)
            deeper = [add((*path, child)) for child in path[-1].children]
            if wanted or any(deeper):
                self.below.add(path)
            return wanted or any(deeper)

        add((root,))
        self.leaves = leaves
        self.place = {path: n for n, path in enumerate(self.paths)}
        self.repetition: list[list[int]] = [[] for _ in self.paths]
        self.definition: list[list[int]] = [[] for _ in self.paths]
        self.values: list[list[str | None]] = [[] for _ in self.paths]
        self.rest: list[list[str | None]] = [[] for _ in self.paths]
        self.inner: list[list[tuple[list[int], list]]] = [[([], []) for _ in path[-1].leaves] if leaves else [] for path in self.paths]

    def _put(self, path: tuple[Repeated, ...], r: int, d: int, value: str | None = None, item: dict | None = None) -> None:
        n = self.place.get(path)
        if n is None:
            return
        self.repetition[n].append(r)
        self.definition[n].append(d)
        self.values[n].append(value)
        if self.leaves:
            self.rest[n].append(None if item is None else _rest(item, path[-1]))
            for leaf, (levels, values) in zip(path[-1].leaves, self.inner[n]):
                more, found = _found(item, leaf.path) if item is not None else (0, None)
                levels.append(d + more)
                values.append(found)

    def _absent(self, path: tuple[Repeated, ...], r: int, d: int) -> None:
        """Everything from path on is missing."""
        if path not in self.below:
            return
        self._put(path, r, d)
        for child in path[-1].children:
            self._absent((*path, child), r, d)

    def add(self, parent: dict, path: tuple[Repeated, ...], r: int = 0) -> None:
        """Shreds the values of path's last key in parent. Definition: 2 a level for a node, 1 for a place without one, and 1 for each key of a leaf's path."""
        if path not in self.below:
            return
        depth, node = len(path) - 1, path[-1]
        items = parent.get(node.key)
        if not isinstance(items, list):
            items = [] if items is None and node.key not in parent else [items]
        if not items:
            self._absent(path, r, 2 * depth)
        for item in items:
            if isinstance(item, dict):
                name = item.get(node.label)
                self._put(path, r, 2 * depth + 2, name if isinstance(name, str) else "" if name is None else json.dumps(name, ensure_ascii=False), item)
                for child in node.children:
                    self.add(item, (*path, child), r)
            elif isinstance(item, str):
                self._put(path, r, 2 * depth + 2, item)
                for child in node.children:
                    self._absent((*path, child), r, 2 * depth + 2)
            else:
                self._absent(path, r, 2 * depth + 1)
            r = depth + 1

    def rebuild(self):
        """Of each node: path, record numbers, positions by level, names, rest, values of leaves; only of nodes that are there."""
        for n, path in enumerate(self.paths):
            r, d = np.array(self.repetition[n], np.int64), np.array(self.definition[n], np.int64)
            rows = np.cumsum(r == 0) - 1
            places = np.empty((len(path), len(r)), np.int64)
            for level in range(len(path)):
                # A position goes up where the path repeats at its level and starts again where it repeats further up.
                step = np.cumsum(r == level + 1)
                start = np.maximum.accumulate(np.where(r <= level, np.arange(len(r)), 0)) if len(r) else r
                places[level] = step - step[start]
            there = np.flatnonzero(d == 2 * len(path))
            at = there.tolist()
            inner = []
            for leaf, (levels, values) in zip(path[-1].leaves, self.inner[n]):
                full = 2 * len(path) + len(leaf.path)
                inner.append([values[i] if levels[i] == full and leaf.fits(values[i]) else None for i in at])
            yield path, rows[there], places[:, there], [self.values[n][i] for i in at], [self.rest[n][i] for i in at] if self.leaves else None, inner


def _leaves(root: Repeated) -> dict[str, str]:
    """The columns of all leaves of a tree with their types."""
    found = {leaf.name: leaf.kind for leaf in root.leaves}
    for child in root.children:
        found |= _leaves(child)
    return found


def _text(values: list) -> list:
    return [x if x is None or x.isascii() else x.encode("utf-8", "replace").decode() for x in values]


def shred(records: DataFrame, root: Repeated, key: str = "id", payload: str = "payload", wire: str = "wire", only: set[str] | None = None, leaves: bool = True) -> DataFrame:
    """The nodes of all records: (id, table, node_path, parent_path, node_name), with leaves also rest and a column for each leaf.

    only: the tables wanted, of all if None.
    """
    more = _leaves(root) if leaves else {}
    kinds = {"string": pa.string(), "double": pa.float64()}

    def batches(parts):
        for part in parts:
            columns, kept = Columns(root, only, leaves), []
            ids = part.column(0)
            for n, (text, form) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                found = record(text, form)
                if found is not None and root.key in found:
                    columns.add(found, (root,))
                    kept.append(n)
            owners = np.array(kept, np.int64)
            for path, rows, places, names, rest, inner in columns.rebuild():
                if not len(rows):
                    continue
                at = [""] * len(rows)
                above = at
                for node, level in zip(path, places):
                    above, at = at, [f"{a}.{node.letter}{i}" if a else f"{node.letter}{i}" for a, i in zip(at, level.tolist())]
                made = {"id": ids.take(pa.array(owners[rows])), "table": pa.array([path[-1].table] * len(at), pa.string()), "node_path": pa.array(at, pa.string()), "parent_path": pa.array(above, pa.string()), "node_name": pa.array(_text(names), pa.string())}
                if leaves:
                    made["rest"] = pa.array(rest, pa.string())
                    own = dict(zip([x.name for x in path[-1].leaves], inner))
                    for name, kind in more.items():
                        values = own.get(name, [None] * len(at))
                        made[name] = pa.array(_text(values) if kind == "string" else [None if x is None else float(x) for x in values], kinds[kind])
                yield pa.RecordBatch.from_pydict(made)

    kind = records.schema[key].dataType.simpleString()
    schema = f"id {kind}, table string, node_path string, parent_path string, node_name string"
    if leaves:
        schema += ", rest string" + "".join(f", {n} {k}" for n, k in more.items())
    return records.select(key, payload, wire).mapInArrow(batches, schema)


def tables(nodes: DataFrame, root: Repeated) -> dict[str, DataFrame]:
    """The nodes of one pass as one table each, linked by parent_path, with the leaves of their own. To write all of them in
    that pass, write nodes partitioned by table."""
    found: dict[str, dict[str, str]] = {}

    def walk(node: Repeated) -> None:
        found.setdefault(node.table, {}).update({x.name: x.kind for x in node.leaves})
        for child in node.children:
            walk(child)

    walk(root)
    fixed = ["id", "node_path", "parent_path", "node_name"]
    return {n: nodes.where(F.col("table") == n).select(*fixed, *more, "rest") for n, more in found.items()}


def assemble(rows: list[dict], root: Repeated) -> dict[str, object]:
    """The nodes of one record by path, from its rows: those of root as they were, with all that is below them."""
    made: dict[str, object] = {}
    letters: dict[str, Repeated] = {}

    def walk(node: Repeated) -> None:
        letters[node.letter] = node
        for child in node.children:
            walk(child)

    walk(root)
    order = lambda path: [int(step[1:]) for step in path.split(".")]
    filled: dict[tuple[str, str], list] = {}  # children that rest of the parent doesn't hold
    for row in sorted(rows, key=lambda x: (x["node_path"].count("."), order(x["node_path"]))):
        node = letters[row["node_path"].rsplit(".", 1)[-1][0]]
        item: object = row["node_name"]
        if row["rest"] is not None:
            item = json.loads(row["rest"])
            if row["node_name"]:
                item.setdefault(node.label, row["node_name"])
            for leaf in node.leaves:
                if row[leaf.name] is not None:
                    at = item
                    for step in leaf.path[:-1]:
                        at = at.setdefault(step, {})
                    at[leaf.path[-1]] = row[leaf.name]
        made[row["node_path"]] = item
        parent, child = made.get(row["parent_path"]), (row["parent_path"], node.key)
        if isinstance(parent, dict):
            if child not in filled and node.key not in parent:
                filled[child] = parent[node.key] = []
            if child in filled:
                filled[child].append(item)
    return {path: item for path, item in made.items() if "." not in path}


#: Countries, their cities, the districts of these, and sights of either.
_SIGHT = Repeated("sightseeing", "s", "sights")
_PLACE = (Leaf("population", ("population",), "double"), Leaf("lon", ("location", "lon"), "double"), Leaf("lat", ("location", "lat"), "double"))
COUNTRIES = Repeated("country", "c", "countries", (Repeated("cities", "t", "cities", (_SIGHT, Repeated("districts", "d", "districts", (_SIGHT,))), _PLACE),), (Leaf("capital", ("capital",)),))


def current_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row of each key's highest version, reduced before the shuffle, so that a key with many rows is no hot spot."""
    newest = F.max_by(F.struct(*columns), F.coalesce(F.col(version).cast("long"), F.lit(-(2**63))))
    return df.groupBy(key).agg(newest.alias("row")).select(key, "row.*")
