import json
import os
import random

import pytest
from compare import DATA

from stellate.operators.shred import COUNTRIES, Columns, assemble, current_rows, record, shred, tables


def walk(value, key, letter, parent, inner):
    if key not in value:
        return
    items = value[key] if isinstance(value[key], list) else [value[key]]
    for n, item in enumerate(items):
        if isinstance(item, (dict, str)):
            path = f"{parent}.{letter}{n}" if parent else f"{letter}{n}"
            yield path, parent, item if isinstance(item, str) else item.get("name") or ""
            if isinstance(item, dict):
                for child in inner:
                    yield from walk(item, *child[:2], path, child[2])


TREE = [("cities", "t", [("sightseeing", "s", []), ("districts", "d", [("sightseeing", "s", [])])])]


def random_value(rng, level=0):
    keys = [["name", "cities"], ["name", "sightseeing", "districts"], ["name", "sightseeing"], ["name"]][level]
    choice = rng.random()
    if choice < 0.15:
        return rng.choice([None, "text", 5, True, [], [["x"]]])
    out = {}
    for k in keys:
        if rng.random() < 0.8:
            out[k] = rng.choice(["n", None, "m"]) if k == "name" else [random_value(rng, min(3, level + 1)) for _ in range(rng.randint(0, 3))] if rng.random() < 0.8 else random_value(rng, min(3, level + 1))
    return out


def typed(value, snake):
    name = lambda a, b: b if snake else a
    if value is None:
        return {name("nullValue", "null_value"): None}
    if isinstance(value, bool):
        return {name("boolValue", "bool_value"): value}
    if isinstance(value, str):
        return {name("stringValue", "string_value"): value}
    if isinstance(value, int):
        return {name("integerValue", "integer_value"): str(value)}
    if isinstance(value, list):
        return {name("listValue", "list_value"): {"values": [typed(x, snake) for x in value]}}
    return {name("structValue", "struct_value"): {"fields": {k: typed(v, snake) for k, v in value.items()}}}


def test_random_records_in_both_formats(spark):
    rng, rows, expected = random.Random(9), [], set()
    for n in range(300):
        value = {"country": random_value(rng) if n % 3 else [random_value(rng) for _ in range(3)], "other": 1}
        wire = rng.choice(["rest", "grpc", None])
        form = wire or rng.choice(["rest", "grpc"])
        body = value if form == "rest" else {k: typed(v, n % 2 == 0) for k, v in value.items()}
        rows.append((n, json.dumps(body), wire, "clash"))
        expected |= {(n, *x) for x in walk(value, "country", "c", "", TREE)}
    df = spark.createDataFrame(rows, "id long, payload string, wire string, node_path string")
    nodes = shred(df, COUNTRIES)
    assert {(r["id"], r["node_path"], r["parent_path"], r["node_name"]) for r in nodes.collect()} == expected
    parts = tables(nodes, COUNTRIES)
    assert list(parts) == ["countries", "cities", "sights", "districts"] and sum(p.count() for p in parts.values()) == len(expected)


def test_levels_tell_all():
    """A record's columns alone hold where each place repeats and how far it is defined."""
    columns = Columns(COUNTRIES)
    columns.add({"country": [{"name": "a", "cities": [{"name": "b"}, None]}, {"name": "c"}]}, (COUNTRIES,))
    country, city = columns.paths[0], columns.paths[1]
    assert columns.repetition[columns.place[country]] == [0, 1] and columns.definition[columns.place[country]] == [2, 2]
    (levels, values), = columns.inner[columns.place[country]]
    assert levels == [2, 2] and values == [None, None]
    assert columns.repetition[columns.place[city]] == [0, 2, 1] and columns.definition[columns.place[city]] == [4, 3, 2]


def test_broken_and_missing(spark):
    rows = [(1, None, None), (2, '{"country":', "rest"), (3, "[]", "rest"), (4, "{}", None), (5, '{"country": NaN}', "rest"), (6, '{"country": "\\ud800x"}', "rest"), (7, '{"country": {"name": "%s"}}' % ("long" * 50_000), "rest"), (8, "", "grpc"), (None, '{"country": "x"}', "rest")]
    df = spark.createDataFrame(rows, "id long, payload string, wire string")
    got = {(r["id"], r["node_path"], len(r["node_name"])) for r in shred(df, COUNTRIES).collect()}
    assert got == {(6, "c0", 2), (7, "c0", 200_000), (None, "c0", 1)}
    assert shred(df.limit(0), COUNTRIES).count() == 0 and record('{"a": {"b": 1}}', None) == {"a": {"b": 1}}


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "b"), (1, None, "c"), (2, None, "d"), (None, 1, "e")], "id long, version long, payload string")
    assert sorted(map(tuple, current_rows(df, "id", "version", ["payload"]).collect()), key=str) == [(1, "b"), (2, "d"), (None, "e")]


def nodes_of(value):
    """The root's nodes by path."""
    items = value if isinstance(value, list) else [value]
    return {f"c{n}": x for n, x in enumerate(items) if isinstance(x, (dict, str))}


def test_typed_leaves(spark):
    city = {"name": "b", "population": 5, "location": {"lon": 1.5, "lat": "x", "alt": 3}, "mayor": {"name": "m"}}
    rows = [(1, json.dumps({"country": {"name": "a", "capital": "b", "cities": [city, "d"]}}), "rest"), (2, json.dumps({"country": {"capital": 7, "cities": {"population": True}}}), "rest")]
    df = spark.createDataFrame(rows, "id long, payload string, wire string")
    parts = tables(shred(df, COUNTRIES), COUNTRIES)
    assert [tuple(r) for r in parts["countries"].orderBy("id").collect()] == [(1, "c0", "", "a", "b", "{}"), (2, "c0", "", "", None, '{"capital": 7, "cities": {"population": true}}')]
    found = [(*r[:7], r[7] and json.loads(r[7])) for r in parts["cities"].orderBy("id", "node_path").collect()]
    assert found == [
        (1, "c0.t0", "c0", "b", 5.0, 1.5, None, {"location": {"lat": "x", "alt": 3}, "mayor": {"name": "m"}}),
        (1, "c0.t1", "c0", "d", None, None, None, None),
        (2, "c0.t0", "c0", "", None, None, None, {"population": True}),
    ]
    only = shred(df, COUNTRIES, only={"cities"})
    assert sorted(map(str, only.collect())) == sorted(map(str, shred(df, COUNTRIES).where("table = 'cities'").collect()))


def round_trip(spark, df):
    """How many records come back from the tables as they were."""
    got = {}
    for r in shred(df, COUNTRIES).collect():
        got.setdefault(r["id"], []).append(r.asDict())
    n = 0
    for row in df.collect():
        found = record(row["payload"], row["wire"])
        expected = nodes_of(found["country"]) if found and "country" in found else {}
        assert assemble(got.get(row["id"], []), COUNTRIES) == expected, row
        n += bool(expected)
    return n


def test_round_trip_of_random_records(spark):
    rng, rows = random.Random(4), []
    for n in range(300):
        value = random_value(rng)
        if isinstance(value, dict):
            value["capital"] = rng.choice(["x", None, 3])
            for c in value.get("cities") or [] if isinstance(value.get("cities"), list) else []:
                if isinstance(c, dict):
                    c.update(rng.choice([{"population": 7}, {"population": None}, {"location": {"lon": 1, "lat": 2}}, {"location": {}}, {"location": {"lon": None}}, {"extra": [1]}]))
        rows.append((n, json.dumps({"country": value}), "rest"))
    assert round_trip(spark, spark.createDataFrame(rows, "id long, payload string, wire string")) > 200


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_round_trip_of_every_row(spark):
    assert round_trip(spark, current_rows(spark.read.parquet(f"{DATA}/nested_points.parquet"), "id", "version", ["payload", "wire"])) > 20
