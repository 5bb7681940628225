import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.collection import Collection, Dense, Sparse
from stellate.functions import jsonops, text
from stellate.functions.metrics import similarity_matrix
from stellate.operators import aggregate, ivf, mmr, mutate, quantize, scroll
from stellate.operators.batch import nearest_batch
from stellate.plans.query import average, discover, query, query_batch, recommend, search
from stellate.sources.catalog import Catalog
from stellate.streaming.ingest import nearest_stream, upsert_stream

DENSE = [(1, [0.12, 0.55, 0.62, 0.70]), (2, [0.20, 0.66, 0.71, 0.08]), (3, [0.47, 0.58, 0.33, 0.91]), (4, [0.10, 0.05, 0.77, 0.83]), (5, [0.22, 0.27, 0.31, 0.40]), (6, [0.45, 0.14, 0.09, 0.38]), (7, [0.26, 0.88, 0.21, 0.52]), (8, [0.86, 0.44, 0.63, 0.17]), (9, None), (10, None)]
PAYLOAD = {1: {"city": "Oslo", "price": 40.0}, 2: {"city": ["Oslo", "Lima"], "price": 44.0}, 3: {"city": ["Oslo", "Quito"], "price": 38.5}, 4: {"city": ["Lima", "Quito"], "price": 36}, 5: {"count": 0}, 7: {"city": None}, 8: {"city": [], "loc": {"lon": 1.0, "lat": 2.0}, "when": "2024-01-01T00:00:00Z"}}
SPARSE = {9: ([40, 7], [0.25, 0.5]), 10: ([3, 4, 5], [0.3, 0.4, 0.6])}


def make(spark, distance="Dot", **index):
    rows = [(n, v, SPARSE.get(n), json.dumps(PAYLOAD[n]) if n in PAYLOAD else None) for n, v in DENSE]
    df = spark.createDataFrame(rows, "id long, v array<float>, s struct<indices:array<long>,values:array<float>>, payload string")
    return Collection(df, "id", {"": Dense("v", 4, distance)}, {"text": Sparse("s")}, "payload", index=index)


def got(df):
    return [(r["id"], round(r["score"], 4)) for r in df.collect()]


@pytest.fixture(scope="module")
def c(spark):
    return make(spark)


def test_nearest_and_its_limits(spark, c):
    q = [0.2, 0.1, 0.9, 0.7]
    scores = {n: float(np.dot(np.float32(v), q)) for n, v in DENSE if v}
    order = sorted(scores, key=lambda n: -scores[n])
    assert [x[0] for x in got(search(c, q))] == order
    assert [x[0] for x in got(search(c, q, limit=2, offset=1))] == order[1:3]
    assert [x[0] for x in got(search(c, [1.0, 0.0, 0.0, 0.0], score_threshold=float(np.float32(0.45))))] == [8, 3]  # strictly better
    assert [x[0] for x in got(search(make(spark, "Euclid"), q, score_threshold=0.7))] == [n for n, v in sorted(DENSE[:8], key=lambda x: np.linalg.norm(np.array(x[1]) - q)) if np.linalg.norm(np.array(v) - q) < 0.7]
    assert got(search(make(spark, "Cosine"), [0.0] * 4))[0][1] == 0.0
    named = search(c, 4, filter={"must_not": [{"has_id": [1]}]})
    assert not {1, 4} & {x[0] for x in got(named)}


def test_sparse(c):
    assert got(query(c, {"query": {"indices": [7, 3], "values": [2.0, 1.0]}, "using": "text"})) == [(9, 1.0), (10, 0.3)]
    assert got(query(c, {"query": {"indices": [], "values": []}, "using": "text"})) == []
    assert got(query(c, {"query": 9, "using": "text"})) == []


def test_averages_are_queries(c):
    assert average([[1.0, 2.0], [3.0, 2.0]], [[1.0, 0.0]]) == [3.0, 4.0]
    assert average([{"indices": [1], "values": [1.0]}, {"indices": [2], "values": [1.0]}], []) == {"indices": [1, 2], "values": [0.5, 0.5]}
    assert recommend(c, [1], [2]).count() == 6 and discover(c, 1, [{"positive": 2, "negative": 3}]).count() == 5
    with pytest.raises(ValueError):
        recommend(c, [], [2])


def test_prefetches_inherit_filters_and_exclusions(c):
    inner = {"query": [1.0, 0.0, 0.0, 0.0], "limit": 8}
    found = query(c, {"prefetch": [inner], "query": 2, "filter": {"must": [{"key": "city", "match": {"value": "Oslo"}}]}})
    assert sorted(x[0] for x in got(found)) == [1, 3]
    nested = query(c, {"prefetch": {"prefetch": [inner, {**inner, "limit": 1}], "query": {"fusion": "rrf"}, "limit": 3}, "query": [0.0, 0.0, 0.0, 1.0]})
    assert sorted(x[0] for x in got(nested)) == [3, 6, 8]


def test_fusion(c):
    lists = [{"query": [1.0, 0.0, 0.0, 0.0], "limit": 2}, {"query": [0.0, 0.0, 0.0, 1.0], "limit": 2}]
    assert got(query(c, {"prefetch": lists, "query": {"fusion": "rrf"}})) == [(3, round(1 / 3 + 1 / 2, 4)), (8, 0.5), (4, 0.3333)]
    assert got(query(c, {"prefetch": [{**lists[0], "limit": 1}], "query": {"fusion": "dbsf"}})) == [(8, 0.5)]
    assert got(query(c, {"prefetch": lists, "query": {"rrf": {"k": 1, "weights": [1, 0]}}, "score_threshold": 0.5})) == [(8, 1.0), (3, 0.5)]


def test_formulas(c):
    pre = [{"query": [1.0, 0.0, 0.0, 0.0], "limit": 8}]

    def value(formula, id_=8, **more):
        return dict(got(query(c, {"prefetch": pre, "query": {"formula": formula, **more}})))[id_]

    assert value({"sum": ["$score", 1]}) == 1.86 and value("$score[3]", defaults={"$score[3]": 7.0}) == 7.0 and value("$score[3]") == 0.0
    assert value("price", defaults={"price": 3}) == 3.0 and value({"mult": [0, {"ln": 0}]}) == 0.0
    assert value({"div": {"left": 1, "right": 0, "by_zero_default": 9}}) == 9.0 and value({"key": "loc", "geo_radius": {"center": {"lon": 1.0, "lat": 2.0}, "radius": 5.0}}) == 1.0
    assert value({"geo_distance": {"origin": {"lon": 1.0, "lat": 3.0}, "to": "loc"}}, defaults={"loc": {"lon": 0.0, "lat": 0.0}}) == pytest.approx(111195, abs=1)
    assert value({"sum": [{"datetime_key": "when"}, {"neg": {"datetime": "2023-12-31"}}]}, defaults={"when": "2024-01-01"}) == 86400.0
    for wrong in ({"ln": 0}, {"div": {"left": 1, "right": 0}}, "price", {"sqrt": -1}):
        with pytest.raises(Exception):
            value(wrong)


def test_wrong_requests(c):
    v = [1.0] * 4
    for r in ({"query": {"fusion": "rrf"}}, {"prefetch": [{"query": v}]}, {"prefetch": [{"query": v}], "query": {"fusion": "rrf"}, "using": "x"}, {"score_threshold": 1.0}, {"query": {"order_by": "price"}, "score_threshold": 1}, {"query": v, "limit": 0}, {"query": v, "offset": -1}, {"query": v, "using": "none"}, {"query": [1.0]}, {"query": 9}, {"query": 99}, {"query": {"odd": 1}}, {"query": {"nearest": v, "mmr": {"candidates_limit": 10**6}}}, {"query": v, "limti": 3}, {"query": v, "shard_key": "a"}, {"query": {"text": "a"}}):
        with pytest.raises(ValueError):
            query(c, r)


def test_mmr_against_brute_force(c):
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((12, 5)), rng.standard_normal((1, 5))
    rel, like = similarity_matrix(v, q, "Cosine")[:, 0], similarity_matrix(v, v, "Cosine")
    chosen, left = [int(rel.argmax())], set(range(12)) - {int(rel.argmax())}
    while len(chosen) < 6:
        best = max(left, key=lambda n: 0.7 * rel[n] - 0.3 * max(like[n, m] for m in chosen))
        chosen.append(best)
        left.remove(best)
    assert mmr.rerank(v, rel, "Cosine", 0.3, 6) == chosen
    assert mmr.rerank(v, rel, "Cosine", 0.0, 12) == list(np.argsort(-rel)) and mmr.rerank(v[:1], rel[:1], "Dot") == [0]
    plain = got(query(c, {"query": [1.0, 0.0, 0.0, 0.0], "limit": 8}))
    diverse = got(query(c, {"query": {"nearest": [1.0, 0.0, 0.0, 0.0], "mmr": {"diversity": 0.9}}, "limit": 8}))
    assert sorted(plain) == sorted(diverse) and plain[0] == diverse[0]


def test_groups_and_lookup(spark, c):
    other = Collection(spark.createDataFrame([("Oslo", '{"n":1}')], "id string, payload string"), payload="payload")
    rows = aggregate.query_groups(c, {"query": [1.0, 0.0, 0.0, 0.0]}, "city", 2, 2, other).collect()
    assert [(r["group_key"], r["hit_rank"], r["id"], r["lookup_payload"]) for r in rows] == [("Oslo", 1, 3, '{"n":1}'), ("Oslo", 2, 2, '{"n":1}'), ("Quito", 1, 3, None), ("Quito", 2, 4, None)]


def test_groups_over_a_prefetch_are_complete(spark):
    """A rare key far behind in a long prefetch has its group, as without the prefetch."""
    df = spark.range(30_000).selectExpr("id", "array(cast(1 - id / 30000 as float), 0f) v", "if(id = 29999, 'rare', 'usual') k")
    many = Collection(df, "id", {"": Dense("v", 2, "Dot")})
    plain = {"query": [1.0, 0.0]}
    for request in (plain, {"prefetch": [{**plain, "limit": 30_000}], **plain}, {"prefetch": [{**plain, "limit": 30_000}], "query": {"fusion": "rrf"}}):
        assert [(r["group_key"], r["id"]) for r in aggregate.query_groups(many, request, "k", 1).collect()] == [("usual", 0), ("rare", 29_999)]


def test_facets_matrix_and_pages(c):
    assert [tuple(r) for r in aggregate.facet(c, "city").collect()] == [("Oslo", 3), ("Lima", 2), ("Quito", 2)]
    pairs = aggregate.matrix_pairs(c, ids=[1, 2, 3], limit=1)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 3), (2, 1), (3, 1)]
    assert sorted((r["row"], r["col"]) for r in aggregate.matrix_offsets(pairs).collect()) == [(0, 2), (1, 0), (2, 0)]
    assert [r["id"] for r in scroll.scroll(c, limit=3, offset=4).collect()] == [4, 5, 6] and scroll.next_offset(c, limit=3, offset=4) == 7 and scroll.next_offset(c, limit=30) is None
    assert [(r["id"], r["order_value"]) for r in scroll.scroll(make_ordered(c), order_by={"key": "price", "direction": "desc"}, limit=2, with_payload=False).collect()] == [(2, 44.0), (1, 40.0)]
    assert [r["id"] for r in scroll.retrieve(c, [5, 2, 99]).collect()] == [5, 2] and scroll.count(c).first()[0] == 10 and scroll.sample(c, 3).count() == 3


def make_ordered(c):
    return mutate.create_index(c, "price", "float")


def test_batches(c):
    q = {1: [1.0, 0.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0, 1.0]}
    rows = nearest_batch(c, q, 2).collect()
    assert sorted((r["query_id"], r["id"]) for r in rows) == [(1, 3), (1, 8), (2, 3), (2, 4)]
    both = query_batch(c, [{"query": x, "limit": 2} for x in q.values()]).collect()
    assert sorted((r["query_id"] + 1, r["id"]) for r in both) == [(1, 3), (1, 8), (2, 3), (2, 4)]


def test_changes(spark, c):
    payload = lambda x, n: json.loads(x.df.where(f"id = {n}").first()["payload"] or "{}")
    assert payload(mutate.set_payload(c, {"city": None, "new": {"x": 1}}, [1]), 1) == {"price": 40.0, "new": {"x": 1}}
    assert payload(mutate.set_payload(c, {"x": 1}, [6], key="deep.er"), 6) == {"deep": {"er": {"x": 1}}}
    assert payload(mutate.delete_payload(c, ["city[0]", "none.x"], [2]), 2) == {"city": ["Lima"], "price": 44.0}
    assert payload(mutate.clear_payload(c, filter={"must": [{"key": "count", "match": {"value": 0}}]}), 5) == {}
    new = spark.createDataFrame([(1, '{"n":1}', 1), (1, '{"n":2}', 2), (20, "{}", 3)], "id long, payload string, _order int")
    up = mutate.upsert(c, new)
    assert up.df.count() == 11 and payload(up, 1) == {"n": 2} and up.df.where("id = 1").first()["v"] is None
    assert payload(mutate.upsert(c, new, "insert_only"), 1) == PAYLOAD[1] and mutate.upsert(c, new, "update_only").df.count() == 10
    assert payload(mutate.upsert(c, new, filter={"must": [{"key": "price", "range": {"gt": 40}}]}), 1) == PAYLOAD[1]
    vectors = spark.createDataFrame([(9, [1.0] * 4)], "id long, v array<float>")
    assert mutate.update_vectors(c, vectors).df.where("v IS NOT NULL").count() == 9 and mutate.delete_vectors(c, [""], [1]).df.where("v IS NOT NULL").count() == 7
    with pytest.raises(Exception, match="no point 99"):
        mutate.update_vectors(c, vectors.withColumn("id", F.lit(99).cast("long"))).df.collect()
    with pytest.raises(ValueError):
        mutate.delete(c)
    with pytest.raises(Exception, match="column _order"):
        mutate.upsert(c, new.drop("_order")).df.collect()
    same = mutate.sync_points(c, spark.createDataFrame([(4, "{}"), (50, "{}")], "id long, payload string"), 3, 6).df
    assert [r["id"] for r in same.orderBy("id").collect()] == [1, 2, 4, 6, 7, 8, 9, 10]
    wide = mutate.create_vector(c, "second", Dense("w", 2))
    assert wide.where({"must": [{"has_vector": "second"}]}).count() == 0 and "w" not in mutate.delete_vector(wide, "second").df.columns
    assert mutate.delete_index(make_ordered(c), "price").index == {}


def test_selecting_payload(c):
    rows = query(c, {"query": [1.0, 0.0, 0.0, 0.0], "limit": 2, "with_payload": {"include": ["loc.lon"]}, "with_vectors": True}).collect()
    assert json.loads(rows[0]["payload"]) == {"loc": {"lon": 1.0}} and len(rows[0]["vector"]) == 4
    assert json.loads(query(c, {"query": [1.0, 0.0, 0.0, 0.0], "limit": 1, "with_payload": {"exclude": ["loc.lat", "city"]}}).first()["payload"]) == {"loc": {"lon": 1.0}, "when": "2024-01-01T00:00:00Z"}
    node = {"a": [{"b": 1}, {"b": 2}]}
    jsonops.remove_at(node, ["a", None, "b"])
    assert node == {"a": [{}, {}]} and jsonops.set_at({"a": 5}, ["a", 3], {"x": 1}) == {"a": []}


def test_text():
    assert text.murmur3(b"") == 0 and text.murmur3(b"hello") == 0x248BFA47 and text.murmur3(b"hello, world") == 0x149BBB7F
    for word, stem in {"running": "run", "ponies": "poni", "caresses": "caress", "generously": "generous", "hopping": "hop", "hoping": "hope", "relational": "relat", "skies": "sky", "knightly": "knight", "happy": "happi", "consist": "consist", "consolingly": "consol"}.items():
        assert text.english_stem(word) == stem


def test_tokens(spark):
    assert {"der", "und"} <= text.stop_words("german") and "the" in text.stop_words("english")
    df = spark.createDataFrame([("The Café's 2nd, quick-brown",), (None,), ("",)], "t string")
    one = lambda how, **k: [r[0] for r in df.select(text.tokens(F.col("t"), how, **k)).collect()]
    assert one(text.TextIndex()) == [["the", "café", "s", "2nd", "quick", "brown"], [], []]
    assert one(text.TextIndex("whitespace", lowercase=False))[0] == ["The", "Café's", "2nd,", "quick-brown"]
    assert one(text.TextIndex("prefix", min_token_len=3, max_token_len=4, stopwords=text.ENGLISH))[0] == ["caf", "café", "2nd", "qui", "quic", "bro", "brow"]
    assert one(text.TextIndex(ascii_folding=True, min_token_len=2, max_token_len=5))[0] == ["the", "cafe", "2nd", "quick", "brown"]
    rows = df.select(text.bm25_embedding(text.tokens(F.col("t"))).alias("e")).collect()
    assert len(rows[0]["e"]["indices"]) == 6 and rows[1]["e"]["indices"] == [] and rows[0]["e"]["values"][0] == pytest.approx(2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / 256)), rel=1e-5)


def test_quantised_search_finds_the_best(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 32)).astype(np.float32)
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)] + [(999, None)], "id long, v array<float>")
    c = Collection(df, "id", {"": Dense("v", 32, "Cosine")})
    q = v[5] + 0.2 * rng.standard_normal(32)
    best = [r["id"] for r in search(c, q.tolist()).collect()]
    for model, least in ((quantize.Scalar.fit(df, "v"), 10), (quantize.Product.fit(df, "v", 4, 64), 7), (quantize.Binary(), 5), (quantize.Rotated(4), 10), (quantize.Rotated(2), 9), (quantize.Rotated(1), 5)):
        found = quantize.search(quantize.encode_column(c, model, "codes"), model, "codes", q.tolist(), 10, 8.0).collect()
        assert len({r["id"] for r in found} & set(best)) >= least and found[0]["id"] == 5
    assert quantize.search(quantize.encode_column(c, quantize.Binary(), "codes"), quantize.Binary(), "codes", q.tolist(), 10, rescore=False).count() == 10


def test_cells_find_most_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 3
    v = (centres[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 16))).astype(np.float32)
    df = spark.createDataFrame([(n, x.tolist(), "clash") for n, x in enumerate(v)] + [(5000, None, ""), (5001, [1.0], "")], "id long, v array<float>, other string")
    for distance in ("Cosine", "Euclid"):
        c = Collection(df, "id", {"": Dense("v", 16, distance)})
        model = ivf.Cells.fit(c, 20)
        indexed = ivf.index(c, model)
        indexed.df.write.mode("overwrite").partitionBy("cell").parquet(str(tmp_path / distance))
        stored = indexed.with_df(spark.read.parquet(str(tmp_path / distance)))
        hits = 0
        for n in range(10):
            best = {r["id"] for r in search(c, v[n].tolist()).collect()}
            found = ivf.search(stored, model, v[n].tolist(), 10, 6)
            hits += len(best & {r["id"] for r in found.collect()})
        assert hits >= 90
        assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString() or "PartitionFilters: [cell" in found._jdf.queryExecution().toString()


def test_catalog_and_streams(spark, c, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "store"))
    catalog.create("a", mutate.create_index(c, "t", text.TextIndex(stopwords=frozenset(["x"]))))
    assert catalog.names() == ["a"] and catalog.exists("a") and catalog.get("a").index["t"].stopwords == {"x"}
    with pytest.raises(ValueError):
        catalog.create("a", c)
    catalog.update_aliases([{"create": {"alias": "now", "collection": "a"}}, {"rename": {"old": "now", "new": "b"}}])
    assert catalog.get("b").df.count() == 10 and Catalog(spark, str(tmp_path / "store")).aliases == {"b": "a"}
    for wrong in (lambda: catalog.create("b", c), lambda: catalog.update_aliases([{"create": {"alias": "a", "collection": "a"}}])):
        with pytest.raises(ValueError):
            wrong()
    catalog.snapshot("a", "s1")
    new = spark.createDataFrame([(1, "{}"), (30, "{}")], "id long, payload string")
    new.write.parquet(str(tmp_path / "in"))
    upsert_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), catalog, "b", str(tmp_path / "cp1")).awaitTermination()
    assert catalog.get("a").df.count() == 11 and catalog.snapshots("a") == ["s1"]
    assert catalog.recover("a", "s1").df.count() == 10
    catalog.delete_snapshot("a", "s1")
    assert catalog.snapshots("a") == []
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    asked.write.parquet(str(tmp_path / "q"))
    nearest_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q")), c, 2, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 8]
    assert catalog.delete("a") and catalog.aliases == {} and catalog.names() == []
