import json

from compare import DATA

from stellate import queries


def _typed(x):
    if isinstance(x, dict):
        return {"structValue": {"fields": {k: _typed(v) for k, v in x.items()}}}
    if isinstance(x, list):
        return {"listValue": {"values": [_typed(v) for v in x]}}
    return {"string_value": x} if isinstance(x, str) else {"integerValue": str(x)} if isinstance(x, int) else {"double_value": x}


def test_payloads_of_all_wire_formats(spark, tmp_path):
    good = {"country": {"cities": [{"population": 8, "sightseeing": ["a", "b"]}]}}
    bad = {"country": {"cities": [{"population": 8, "sightseeing": ["a"]}, {"population": 0.5, "sightseeing": ["a", "b"]}]}}
    typed = lambda x: json.dumps({k: _typed(v) for k, v in x.items()})
    given = [(1, "rest", json.dumps(good)), (2, None, json.dumps(good)), (3, "grpc", typed(good)), (4, None, typed(good)), (5, "rest", json.dumps(bad)), (6, None, json.dumps(bad)), (7, "grpc", typed(bad)), (8, None, None), (9, None, json.dumps(good)[:-3]), (10, "grpc", '{"country": {"numberValue": "NaN"}}')]
    spark.createDataFrame([(*r, 1) for r in given], "id long, wire string, payload string, version long").write.parquet(f"{tmp_path}/nested_points.parquet")
    ids = lambda name: sorted(r["id"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert ids("f26_nested") == [1] and ids("f26_nested_all") == [1, 2, 3, 4]


def test_holds_all_that_the_plain_query_finds(spark):
    some, every = ({r["id"] for r in queries.QUERIES[n](spark, DATA).collect()} for n in ("f26_nested", "f26_nested_all"))
    assert some < every
    print("F26", {n: tuple(queries.QUERIES[n](spark, DATA.replace("sf0.001", "sf0.1")).count() for n in (n,)) for n in ("f26_nested", "f26_nested_all")})
