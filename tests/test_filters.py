import pytest
from pyspark.sql import functions as F

from stellate.collection import Collection, Dense
from stellate.filters import merge_filters
from stellate.functions.siphash import siphash, slice_of
from stellate.functions.text import TextIndex
from stellate.functions.values import parse_path, parse_time

POINTS = [
    (1, '{"city":"Oslo","price":40.0}'), (2, '{"city":["Oslo","Lima"],"price":44.0}'), (3, '{"city":["Oslo","Quito"],"price":38.5}'),
    (4, '{"city":["Lima","Quito"],"price":36}'), (5, '{"count":0}'), (6, None), (7, '{"city":null,"price":null}'), (8, '{"city":[],"price":[]}'),
    (9, '{"a":[{"b":1,"c":"x"},{"b":2},7],"t":"2024-01-02T03:04:05+01:00","loc":{"lon":13.4,"lat":52.5},"u":"550e8400-e29b-41d4-a716-446655440000"}'),
    (10, '{"city":[null,"x"],"text":["big red fox","red"],"flag":true,"a.b":{"c d":5}}'), (11, "broken"),
]


@pytest.fixture(scope="module")
def ids(spark):
    df = spark.createDataFrame([(n, p, [1.0, 2.0] if n < 5 else None) for n, p in POINTS], "id long, payload string, v array<float>")

    def run(spec, **index):
        return [r["id"] for r in Collection(df, "id", {"": Dense("v", 2)}, payload="payload", index=index).where(spec).orderBy("id").collect()]

    return run


def one(key, **test):
    return {"must": [{"key": key, **test}]}


ALL = list(range(1, 12))
CASES = [
    (one("city", match={"value": "Oslo"}), [1, 2, 3]),
    ({"must_not": one("city", match={"value": "Oslo"})["must"]}, [4, 5, 6, 7, 8, 9, 10, 11]),
    ({"should": []}, ALL), ({}, ALL), ({"must": []}, ALL),
    (one("city", match={"any": []}), []), (one("city", match={"any": ["Lima", "x"]}), [2, 4, 10]),
    (one("city", match={"except": ["Oslo"]}), [2, 3, 4, 10]), (one("price", match={"except": [36]}), [1, 2, 3]),
    (one("price", match={"value": 36}), [4]), (one("count", match={"value": 0}), [5]), (one("flag", match={"value": True}), [10]), (one("count", match={"value": False}), []),
    (one("price", range={"gte": 38.5, "lt": 44}), [1, 3]), (one("city", range={"gt": 0}), []),
    ({"must": [{"is_empty": {"key": "city"}}]}, [5, 6, 7, 8, 9, 11]), ({"must": [{"is_null": {"key": "city"}}]}, [7]),
    (one("city", is_empty=True), [5, 6, 7, 8, 9, 11]), (one("city", is_empty=False), [1, 2, 3, 4, 10]),
    (one("city", is_null=True), [7, 10]), (one("city", is_null=False), [1, 2, 3, 4, 5, 6, 8, 9, 11]),
    (one("city", values_count={"gte": 2}), [2, 3, 4, 10]), (one("city", values_count={"lt": 1}), [5, 6, 7, 8, 9, 11]),
    (one("a[].b", match={"value": 2}), [9]), (one("a[1].b", match={"value": 2}), [9]), (one("a.b", match={"value": 2}), []), (one('"a.b"."c d"', match={"value": 5}), [10]),
    ({"must": [{"nested": {"key": "a", "filter": {"must": [{"key": "b", "match": {"value": 1}}, {"key": "c", "match": {"value": "x"}}]}}}]}, [9]),
    ({"must": [{"nested": {"key": "a[]", "filter": {"must": [{"key": "b", "match": {"value": 2}}, {"key": "c", "match": {"value": "x"}}]}}}]}, []),
    (one("t", range={"gte": "2024-01-02 02:04:05", "lte": "2024-01-02T02:04:05Z"}), [9]), (one("t", range={"gt": "2024-01-03"}), []), (one("city", range={"gt": "2024-01-03"}), []),
    (one("loc", geo_radius={"center": {"lon": 13.4, "lat": 52.51}, "radius": 1200.0}), [9]), (one("loc", geo_radius={"center": {"lon": 13.4, "lat": 52.51}, "radius": 1000.0}), []),
    (one("loc", geo_bounding_box={"top_left": {"lon": 170.0, "lat": 60.0}, "bottom_right": {"lon": 14.0, "lat": 50.0}}), [9]),
    (one("loc", geo_polygon={"exterior": {"points": [{"lon": x, "lat": y} for x, y in ((13, 52), (14, 52), (14, 53), (13, 53), (13, 52))]}}), [9]),
    (one("loc", geo_polygon={"exterior": {"points": [{"lon": x, "lat": y} for x, y in ((13.4, 52), (14, 52), (14, 53), (13.4, 53), (13.4, 52))]}}), []),
    (one("price", range={"lt": 37}, match={"value": 44}), [4]),
    ({"must": [{"has_id": [3, 4, 99]}]}, [3, 4]), ({"must": [{"has_vector": ""}], "must_not": [{"has_id": []}]}, [1, 2, 3, 4]), ({"must": [{"has_vector": "none"}]}, []),
    ({"min_should": {"min_count": 2, "conditions": [{"has_id": [1, 2]}, {"has_id": [2, 3]}, {"has_id": [3]}]}}, [2, 3]),
    ({"must": [{"filter": {"should": [{"has_id": [1]}, {"must_not": [{"key": "city", "is_empty": True}]}]}}]}, [1, 2, 3, 4, 10]),
    (one("text", match={"text": "red fo"}), [10]), (one("text", match={"text_any": "cat red"}), [10]), (one("text", match={"prefix": "bi"}), [10]), (one("text", match={"phrase": "g r"}), [10]),
]


@pytest.mark.parametrize("spec,expected", CASES)
def test_conditions(ids, spec, expected):
    assert ids(spec) == expected


def test_indexes_change_what_matches(ids):
    text = TextIndex(phrase_matching=True)
    assert ids(one("text", match={"text": "Fox RED"}), text=text) == [10] and ids(one("text", match={"text": "red fo"}), text=text) == []
    assert ids(one("text", match={"phrase": "red fox"}), text=text) == [10] and ids(one("text", match={"phrase": "fox red"}), text=text) == []
    assert ids({"must": [{"is_null": {"key": "city"}}]}, city="keyword") == [7, 10]
    assert ids(one("price", match={"except": ["x"]}), price="keyword") == [] and ids(one("price", match={"except": ["x"]})) == [1, 2, 3, 4]
    form = "550E8400E29B41D4A716446655440000"
    assert ids(one("u", match={"value": form}), u="uuid") == ids(one("u", match={"any": [form, "0"]}), u="uuid") == [9]
    assert ids(one("u", match={"except": [form]}), u="uuid") == [] and ids(one("u", match={"except": ["0"]}), u="uuid") == [9]
    assert ids(one("text", match={"text": "Foxes"}), text=TextIndex(stemmer="english")) == [10] and ids(one("text", match={"text": "Foxes"}), text=TextIndex()) == []


def test_wrong_filters(ids):
    for spec in ({"musst": []}, {"must": [{"key": "a"}]}, {"must": [{"odd": 1}]}, {"min_should": {"min_count": 0, "conditions": []}}, one("city", match={"odd": 1}), {"must": [{"nested": {"key": "a", "filter": {"must": [{"has_id": [1]}]}}}]}, one("", match={"value": 1})):
        with pytest.raises(ValueError):
            ids(spec)


def test_merging():
    a, b = {"must": [1], "should": [2], "min_should": {"conditions": [1], "min_count": 1}}, {"should": [3], "min_should": {"conditions": [2], "min_count": 2}}
    assert merge_filters(a, b) == {"must": [1], "should": [2, 3], "min_should": {"conditions": [1, 2], "min_count": 2}}
    assert merge_filters(None, a) == a and merge_filters(a, None) == a


def test_columns_as_fields(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], None), (2, None, [], 2.5), (3, "b", None, 0.5)], "id long, s string, n array<int>, x double")
    c = Collection(df)
    run = lambda spec: [r["id"] for r in c.where(spec).orderBy("id").collect()]
    assert run(one("s", match={"value": "a"})) == [1] and run({"must_not": one("s", match={"value": "a"})["must"]}) == [2, 3]
    assert run(one("n", match={"value": 2})) == [1] and run({"must": [{"is_empty": {"key": "n"}}]}) == [2, 3] and run(one("n", values_count={"gte": 1})) == [1]
    assert run(one("x", range={"lt": 1})) == [3] and run(one("s", match={"except": ["a"]})) == [3] and run(one("s", range={"lt": 1})) == []


def test_filters_on_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) x").write.parquet(str(tmp_path / "t"))
    plan = Collection(spark.read.parquet(str(tmp_path / "t"))).where(one("x", range={"gt": 5}))._jdf.queryExecution().toString()
    assert "GreaterThan(x,5.0)" in plan


def test_paths_and_times(spark):
    assert parse_path('a."b.c"[2][].d') == ["a", "b.c", 2, None, "d"]
    times = ["2024-01-02", "2024-01-02 03:04", "2024-01-02T03:04:05.25Z", "2024-01-02T03:04:05+02:00", "2024", "x", None, "2024-13-01"]
    got = [r[0] for r in spark.createDataFrame([(n, t) for n, t in enumerate(times)], "n int, t string").orderBy("n").select(parse_time(F.col("t"))).collect()]
    day = 1704153600000000
    assert got == [day, day + 11_040_000_000, day + 11_045_250_000, day + 3_845_000_000, None, None, None, None]


def scalar_siphash(key: bytes, data: bytes) -> int:
    mask = (1 << 64) - 1
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & mask
    k = [int.from_bytes(key[i : i + 8], "little") for i in (0, 8)]
    v = [c ^ k[n % 2] for n, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))]

    def rounds(n):
        for _ in range(n):
            v[0] = (v[0] + v[1]) & mask
            v[1] = rot(v[1], 13) ^ v[0]
            v[0] = rot(v[0], 32)
            v[2] = (v[2] + v[3]) & mask
            v[3] = rot(v[3], 16) ^ v[2]
            v[0] = (v[0] + v[3]) & mask
            v[3] = rot(v[3], 21) ^ v[0]
            v[2] = (v[2] + v[1]) & mask
            v[1] = rot(v[1], 17) ^ v[2]
            v[2] = rot(v[2], 32)

    padded = data + bytes(7 - len(data) % 8) + bytes([len(data) % 256])
    for i in range(0, len(padded), 8):
        m = int.from_bytes(padded[i : i + 8], "little")
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_slices(spark):
    import numpy as np

    key = bytes(range(16))
    assert scalar_siphash(key, bytes(range(15))) == 0xA129CA6149BE45E5  # the published example
    ids = np.array([0, 1, 77, 2**63, 2**64 - 1], np.uint64)
    assert siphash([ids]).tolist() == [scalar_siphash(bytes(16), int(i).to_bytes(8, "little")) for i in ids]
    counts = [r["count"] for r in spark.range(2000).groupBy(slice_of(F.col("id"), 4).alias("s")).count().collect()]
    assert len(counts) == 4 and sum(counts) == 2000 and min(counts) > 400
