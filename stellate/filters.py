"""The filter language, compiled to a column expression. A condition that is null doesn't hold, as in any WHERE.

A filter has the clauses must, should, must_not and min_should; all of them hold together. Conditions are those of a
field (match, range, datetime, geography, number of values, emptiness), of a point (id, vectors, slice), nested filters on
the objects of an array, and filters within filters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import geo
from .functions.siphash import slice_of
from .functions.text import TextIndex, token_list, tokens_of_each
from .functions.values import JsonValues, Values, is_true, parse_time


class Scope:
    """What conditions refer to: fields, the point's id, its vectors; index gives a text field's tokenizer."""

    def __init__(self, field: Callable[[str], Values], index: Callable[[str], TextIndex | str | None] = lambda key: None, id_: Column | None = None, vectors: dict[str, Column] | None = None):
        self.field, self.index, self.id, self.vectors = field, index, id_, vectors

    def of_object(self, value: Column) -> Scope:
        return Scope(lambda key: JsonValues(value, key))


def _list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def compile_filter(spec: dict | None, scope: Scope) -> Column:
    """The condition of a filter; an absent or empty one, or an empty clause, constrains nothing."""
    if not spec:
        return F.lit(True)
    unknown = set(spec) - {"must", "should", "must_not", "min_should"}
    if unknown:
        raise ValueError(f"unknown clauses: {sorted(unknown)}")
    parts = [compile_condition(c, scope) for c in _list(spec.get("must"))]
    if _list(spec.get("should")):
        parts.append(_any([compile_condition(c, scope) for c in _list(spec["should"])]))
    parts += [~is_true(compile_condition(c, scope)) for c in _list(spec.get("must_not"))]
    if spec.get("min_should"):
        least = spec["min_should"]["min_count"]
        if least < 1:
            raise ValueError("min_count is 1 at least")
        hits = [is_true(compile_condition(c, scope)).cast("int") for c in spec["min_should"]["conditions"]]
        parts.append(reduce(lambda a, b: a + b, hits, F.lit(0)) >= least)
    return _all(parts)


def merge_filters(a: dict | None, b: dict | None) -> dict | None:
    """One filter of two: clauses are put together, alternatives as well; min_should takes the greater count."""
    if not a or not b:
        return a or b
    merged = {k: _list(a.get(k)) + _list(b.get(k)) for k in ("must", "should", "must_not") if a.get(k) or b.get(k)}
    least = [x["min_should"] for x in (a, b) if x.get("min_should")]
    if least:
        merged["min_should"] = {"conditions": [c for x in least for c in x["conditions"]], "min_count": max(x["min_count"] for x in least)}
    return merged


def compile_condition(spec: dict, scope: Scope) -> Column:
    if any(k in spec for k in ("must", "should", "must_not", "min_should")):
        return compile_filter(spec, scope)
    if "filter" in spec:
        return compile_filter(spec["filter"], scope)
    if "key" in spec:
        return _field(spec, scope)
    if "is_empty" in spec:
        return scope.field(spec["is_empty"]["key"]).all_empty()
    if "is_null" in spec:
        key = spec["is_null"]["key"]
        return scope.field(key).any_null(inside=scope.index(key) is not None)
    if "nested" in spec:
        key, inner = spec["nested"]["key"], spec["nested"]["filter"]
        return scope.field(key.removesuffix("[]")).nested(lambda x: compile_filter(inner, scope.of_object(x)))
    if scope.id is None and any(k in spec for k in ("has_id", "has_vector", "slice")):
        raise ValueError("conditions on points aren't allowed within nested filters")
    if "has_id" in spec:
        return scope.id.isin(list(spec["has_id"])) if spec["has_id"] else F.lit(False)
    if "has_vector" in spec:
        column = (scope.vectors or {}).get(spec["has_vector"])
        return F.lit(False) if column is None else column.isNotNull()
    if "slice" in spec:
        return slice_of(scope.id, spec["slice"]["total"]) == spec["slice"]["index"]
    raise ValueError(f"unknown condition: {spec}")


def _field(spec: dict, scope: Scope) -> Column:
    """Conditions of one field: count, emptiness and nullness stand before the others, which are alternatives."""
    values = scope.field(spec["key"])
    if spec.get("values_count"):
        return values.count(lambda n: _bounds(n, spec["values_count"]))
    if spec.get("is_empty") is not None:
        wanted = spec["is_empty"]
        return F.when(values.missing(), F.lit(wanted)).otherwise(values.all_empty() == F.lit(wanted))
    if spec.get("is_null") is not None:
        wanted = spec["is_null"]
        return F.when(values.missing(), F.lit(not wanted)).otherwise(values.any_null(inside=True) == F.lit(wanted))
    parts = []
    if spec.get("match"):
        parts.append(_match(spec["match"], values, scope.index(spec["key"])))
    times = spec.get("datetime_range") or (spec["range"] if spec.get("range") and any(isinstance(x, str) for x in spec["range"].values()) else None)
    if times:
        parts.append(values.time(lambda t: _bounds(t, times, lambda x: parse_time(F.lit(x)))))
    elif spec.get("range"):
        parts.append(values.number(lambda x: _bounds(x, spec["range"], lambda v: F.lit(float(v)))))
    if spec.get("geo_bounding_box"):
        parts.append(values.place(lambda lon, lat: geo.in_box(lon, lat, spec["geo_bounding_box"])))
    if spec.get("geo_radius"):
        center = spec["geo_radius"]["center"]
        parts.append(values.place(lambda lon, lat: geo.haversine(lon, lat, center["lon"], center["lat"]) < spec["geo_radius"]["radius"]))
    if spec.get("geo_polygon"):
        parts.append(values.place(lambda lon, lat: geo.in_polygon(lon, lat, spec["geo_polygon"])))
    if not parts:
        raise ValueError(f"a field condition without a condition: {spec}")
    return _any(parts)


def _bounds(x: Column, bounds: dict, to: Callable = F.lit) -> Column:
    tests = {"lt": lambda v: x < v, "gt": lambda v: x > v, "lte": lambda v: x <= v, "gte": lambda v: x >= v}
    return _all([tests[k](to(v)) for k, v in bounds.items() if v is not None])


def _match(spec: dict, values: Values, index: TextIndex | str | None) -> Column:
    if "value" in spec:
        v = spec["value"]
        if isinstance(v, bool):
            return values.boolean(lambda x: x == v)
        if isinstance(v, int):
            return values.integer(lambda x: x == v)
        if index == "uuid":
            return values.string(lambda x: _uuid(x) == _uuid_text(v))
        return values.string(lambda x: x == v)
    if "any" in spec:
        listed = spec["any"]
        if not listed:
            return F.lit(False)
        if index == "uuid":
            return values.string(lambda x: _uuid(x).isin([_uuid_text(v) for v in listed]))
        return values.integer(lambda x: x.isin(listed)) if isinstance(listed[0], int) else values.string(lambda x: x.isin(listed))
    if "except" in spec:
        listed = spec["except"]
        if index == "uuid" and listed:
            return values.string(lambda x: ~_uuid(x).isin([_uuid_text(v) for v in listed]))
        if index == "keyword" and listed and isinstance(listed[0], str):
            return values.string(lambda x: ~x.isin(listed))
        return values.other_than([x for x in listed if isinstance(x, str)], [x for x in listed if isinstance(x, int)])
    if "prefix" in spec:
        return values.string(lambda x: x.startswith(spec["prefix"]))
    kind = next((k for k in ("text", "text_any", "phrase") if k in spec), None)
    if kind is None:
        raise ValueError(f"unknown match: {spec}")
    wanted = spec[kind]
    if not isinstance(index, TextIndex):
        if kind == "text_any":
            return values.string(lambda x: _any([x.contains(t) for t in wanted.split()]))
        return values.string(lambda x: x.contains(wanted))
    # Elements are cut into tokens before any is tested, as stemming can't stand within a lambda.
    found, query = tokens_of_each(values.strings(), index), token_list(wanted, index, query=True)
    if not query:
        return F.lit(False)
    listed = F.array(*[F.lit(t) for t in query])
    if kind == "text_any":
        return F.exists(found, lambda have: F.arrays_overlap(have, listed))
    if kind == "text" or not index.phrase_matching:
        return F.exists(found, lambda have: F.size(F.array_except(listed, have)) == 0)

    def consecutive(have: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(have) - len(query), F.lit(0)))
        return (F.size(have) >= len(query)) & F.exists(starts, lambda n: F.slice(have, n + 1, len(query)) == listed)

    return F.exists(found, consecutive)


def _uuid(x: Column) -> Column:
    """A uuid in one form, whatever its case, dashes and braces."""
    return F.lower(F.regexp_replace(x, "[{}-]", ""))


def _uuid_text(x: str) -> str:
    return x.lower().replace("-", "").strip("{}")
