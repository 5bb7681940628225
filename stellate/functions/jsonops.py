"""Changes and selections of JSON payloads by path."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import parse_path

Steps = list


def merge(target: dict, source: dict) -> None:
    """Top-level keys of source replace those of target; null removes a key."""
    for k, v in source.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = v


def set_at(node, steps: Steps, source: dict):
    """Merges source into what is at the path, making objects where it doesn't exist; places outside an array are ignored."""
    if not steps:
        node = node if isinstance(node, dict) else {}
        merge(node, source)
        return node
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        node = node if isinstance(node, dict) else {}
        node[step] = set_at(node.get(step), rest, source)
        return node
    node = node if isinstance(node, list) else []
    for n in range(len(node)) if step is None else [step] if step < len(node) else []:
        node[n] = set_at(node[n], rest, source)
    return node


def remove_at(node, steps: Steps) -> None:
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        if isinstance(node, dict):
            if rest:
                remove_at(node.get(step), rest)
            else:
                node.pop(step, None)
    elif isinstance(node, list):
        if rest:
            for x in node if step is None else node[step : step + 1]:
                remove_at(x, rest)
        elif step is None:
            node.clear()
        elif step < len(node):
            del node[step]


def _beginning(a: Steps, b: Steps) -> bool:
    """Whether a is a prefix of b; any position matches all elements."""
    return len(a) <= len(b) and all(x == y or not isinstance(x, str) and not isinstance(y, str) and None in (x, y) for x, y in zip(a, b))


def select(node, keep: Callable[[Steps], bool], at: Steps = ()) -> object:
    if isinstance(node, dict):
        return {k: select(v, keep, [*at, k]) for k, v in node.items() if keep([*at, k])}
    if isinstance(node, list):
        return [select(v, keep, [*at, None]) for v in node if keep([*at, None]) or not isinstance(v, (dict, list))]
    return node


def _change(payload: Column, change: Callable[[dict], dict]) -> Column:
    @F.arrow_udf(T.StringType())
    def changed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                found = json.loads(text) if text else {}
            except ValueError:
                found = {}
            out.append(json.dumps(change(found if isinstance(found, dict) else {}), ensure_ascii=True, separators=(",", ":")))
        return pa.array(out, pa.string())

    return changed(payload)


def set_payload(payload: Column, values: dict, path: str | None = None) -> Column:
    steps = parse_path(path) if path else []
    return _change(payload, lambda node: set_at(node, steps, json.loads(json.dumps(values))))


def delete_keys(payload: Column, keys: list[str]) -> Column:
    paths = [parse_path(k) for k in keys]

    def change(node: dict) -> dict:
        for p in paths:
            remove_at(node, p)
        return node

    return _change(payload, change)


def include(payload: Column, keys: list[str]) -> Column:
    paths = [parse_path(k) for k in keys]
    return _change(payload, lambda node: select(node, lambda at: any(_beginning(p, at) or _beginning(at, p) for p in paths)))


def exclude(payload: Column, keys: list[str]) -> Column:
    paths = [parse_path(k) for k in keys]
    return _change(payload, lambda node: select(node, lambda at: not any(_beginning(p, at) for p in paths)))
