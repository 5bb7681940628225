import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.llm import cluster, knn, spaces
from stellate.llm.spaces import Params

SCHEMA = "id long, collection_name string, vector array<float>, version long, coll string, h string, near string"
PARAMS = {"c": Params(16, "Cosine", 3, 0.9), "d": Params(12, "Dot", 2, 0.85), "e": Params(8, "Euclid", 4, 0.6), "m": Params(8, "Manhattan", 3, 1.0)}


def make(seed=1, groups=12, alone=60):
    """Points of groups of like ones, some of them exact copies, among others; with old versions and invalid vectors."""
    rng, rows, n = np.random.default_rng(seed), [], 0
    for name, p in PARAMS.items():
        for g in range(groups + alone):
            centre = rng.standard_normal(p.size) * (1.0 if p.larger_better else 2.0)
            if p.larger_better:
                centre /= np.linalg.norm(centre)
            for _ in range(int(rng.integers(2, 9)) if g < groups else 1):
                v = centre + rng.standard_normal(p.size) * (0.03 if g < groups else 0)
                if p.distance == "Cosine":
                    v *= float(rng.uniform(0.1, 9))
                for _ in range(40 if g == 0 and rng.random() < 0.4 else 1):
                    rows.append((n, name, [float(np.float32(x)) for x in v], 2))
                    n += 1
    old = [(r[0], r[1], [1.0] * PARAMS[r[1]].size, 1) for r in rows[::5]]
    odd = [(n, "c", None, 1), (n + 1, "c", [0.0] * 16, 1), (n + 2, "c", [1.0], 1), (n + 3, "other", [1.0], 1), (n + 4, "e", [float("nan")] * 8, 1), (None, "c", [1.0] * 16, 1), (n + 5, None, [1.0], None)]
    return rows, rows + old + odd + rows[::7]


def scored(rows):
    """Rounded scores of all pairs of a collection, by brute force."""
    for name, p in PARAMS.items():
        some = [r for r in rows if r[1] == name]
        ids, v = [r[0] for r in some], np.array([r[2] for r in some], np.float32).astype(float)
        for i in range(len(ids)):
            s = spaces.scores(np.broadcast_to(v[i], v.shape), v, p)
            yield p, ids[i], [(ids[j], s[j]) for j in range(len(ids)) if j != i]


def neighbours(rows):
    pairs = set()
    for p, a, others in scored(rows):
        best = sorted(others, key=lambda x: (-x[1] if p.larger_better else x[1], x[0]))[: p.top_k]
        pairs |= {(min(a, b), max(a, b)) for b, s in best if (s >= p.limit if p.larger_better else s <= p.limit)}
    return pairs


@pytest.mark.parametrize("options", [{}, {"cell": 60}])
def test_nearest_against_brute_force(spark, options):
    rows, table = make()
    got = {tuple(r) for r in knn.neighbour_pairs(spark.createDataFrame([(*r, "x", "x", "x") for r in table], SCHEMA), PARAMS, **options).collect()}
    expected = neighbours(rows)
    assert len(got & expected) >= 0.99 * len(expected) and len(got - expected) <= 0.01 * len(expected)


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_groups_against_brute_force(spark, block):
    rows, table = make(2)
    members = cluster.clusters(spark.createDataFrame([(*r, "x", "x", "x") for r in table], SCHEMA), PARAMS, block=block).cache()
    label = {}
    for p, a, others in scored(rows):
        like = [b for b, s in others if (s >= p.limit if p.larger_better else s <= p.limit)]
        if like:
            label[a] = min([a, *like])
    got = {r["id"]: r["cluster_id"] for r in members.collect()}
    wrong = [x for x in {*got, *label} if got.get(x) != label.get(x)]
    assert len(wrong) <= 0.01 * len(label)
    described = cluster.describe(members).collect()
    assert sum(r["size"] for r in described) == len(got) and all(0 < len(r["typical"]) <= 3 for r in described)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "c", [1.0] * 16, 1, "", "", "")], SCHEMA)
    for table in (none, one):
        assert knn.neighbour_pairs(table, PARAMS).count() == 0 and cluster.clusters(table, PARAMS).count() == 0


def test_only_copies(spark):
    rows = [(n, "c", [1.0] * 16, 1, "", "", "") for n in range(100)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in knn.neighbour_pairs(table, PARAMS).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(100), 2) if a < 3 or a == 3 and b < 3}
    assert {tuple(r) for r in cluster.clusters(table, PARAMS).select("cluster_id", "id").collect()} == {(0, n) for n in range(100)}


def test_chi_square():
    # Fixed values of the published table.
    for p, freedom, x in ((0.95, 1, 3.841), (0.99, 5, 15.086), (0.999, 16, 39.252), (0.5, 10, 9.342)):
        assert abs(spaces.chi_square_quantile(p, freedom) - x) < 1e-2


def test_modularity():
    """Two triangles with a bridge are two communities."""
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    label = cluster.communities(6, *map(np.array, zip(*edges)), np.ones(7))
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[5]


def test_a_group_of_most_rows_is_split_over_blocks(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    centre /= np.linalg.norm(centre)
    hot, alone = centre + rng.standard_normal((900, 16)) * 0.02, rng.standard_normal((500, 16))
    pairs = np.repeat(rng.standard_normal((40, 16)), 2, axis=0) + rng.standard_normal((80, 16)) * 0.02
    v = np.concatenate([hot, alone, pairs]).astype(np.float32)
    rows = [(n, "c", x.tolist(), 1, "", "", "") for n, x in enumerate(v)]
    plain = [(r[0], r[1], r[2], r[3]) for r in rows]
    table = spark.createDataFrame(rows, SCHEMA)
    label = {}
    for p, a, others in scored(plain):
        like = [b for b, s in others if s >= p.limit]
        if like:
            label[a] = min([a, *like])
    got = {r["id"]: r["cluster_id"] for r in cluster.clusters(table, PARAMS, block=200).collect()}
    assert sum(got.get(x) != label.get(x) for x in {*got, *label}) <= 0.02 * len(label)
    near = {tuple(r) for r in knn.neighbour_pairs(table, PARAMS, cell=200).collect()}
    expected = neighbours(plain)
    # Eight cells, most of them within the group, whose members are all about equally far from each other.
    assert len(near & expected) >= 0.97 * len(expected)
    deal, kind, _ = cluster._deal(table.selectExpr("id", "collection_name coll", "vector"), {"c": len(v)}, PARAMS, 200, 1)
    blocks = table.selectExpr("collection_name coll", "array(id) ids", "vector").mapInArrow(deal, kind).groupBy("round", "block").count().collect()
    assert max(r["count"] for r in blocks) <= 400


@pytest.mark.parametrize("times", [1, 10, 100])
def test_copies_of_a_row_grow_with_the_logarithm_of_cells(spark, times):
    """Routed rows and the size of cells, as if the table had grown: a row goes to one cell of each tree, whatever the limit."""
    rng = np.random.default_rng(3)
    n, cell = 12_000, 12_000 // times
    params = {"c": Params(16, "Cosine", 3, -1.0), "e": Params(16, "Euclid", 3, 1e9), "d": Params(16, "Dot", 3, 0.0)}
    v = rng.standard_normal((n, 16))
    v[: n // 3] = v[0] + 0.01 * v[: n // 3]
    rows = [(i, "ced"[i % 3], x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    table = spark.createDataFrame(rows, "id long, coll string, vector array<float>")
    cuts = knn.fit(table, params, cell=cell)
    routed = table.selectExpr("coll", "array(id) ids", "vector").mapInArrow(knn._route(cuts), knn._ROUTED)
    tasks = {(r[0], r[1], r[2]): (r["d"], r["q"]) for r in routed.groupBy("cut", "cell", "salt").agg(F.count_if(F.expr("role & 1 > 0")).alias("d"), F.count_if(F.expr("role & 2 > 0")).alias("q")).collect()}
    assert max(d for d, _ in tasks.values()) <= 3 * cell and max(q for _, q in tasks.values()) <= 8 * cell
    most = knn.trees_of(-(-n // 3 // cell))
    for name in "ce":
        assert sum(max(d, q) for (cut, _, _), (d, q) in tasks.items() if cuts[cut].space.coll == name) == n // 3 * sum(c.space.coll == name for c in cuts)
        assert sum(c.space.coll == name for c in cuts) <= most <= 14
    bands = len({c.space.band for c in cuts if c.space.coll == "d"})
    assert sum(d + q for (cut, _, _), (d, q) in tasks.items() if cuts[cut].space.coll == "d") <= n // 3 * most * (2 + bands)


def test_a_group_holds_similar_pairs_only(spark):
    """On a chain, where a point is similar to the next ones only, every two of a group are similar."""
    angles = np.arange(400) * 0.13
    v = np.stack([np.cos(angles / 8), np.sin(angles / 8), np.zeros(400), np.zeros(400)], axis=1).astype(np.float32)
    p = Params(4, "Cosine", 3, 0.999)
    table = spark.createDataFrame([(n, "c", x.tolist(), 1) for n, x in enumerate(v)], "id long, collection_name string, vector array<float>, version long")
    groups = {}
    for r in cluster.clusters(table, {"c": p}).collect():
        groups.setdefault(r["cluster_id"], []).append(r["id"])
    assert len(groups) > 20 and sum(map(len, groups.values())) >= 350
    assert all(len(m) > 1 and not cluster._unlike(v[m], v[m], p).any() for m in groups.values())


@pytest.mark.parametrize("distance, limit", [("Cosine", 0.8), ("Euclid", 2.2), ("Manhattan", 7.0), ("Dot", 9.0)])
def test_sets_of_similar_rows(distance, limit):
    rng = np.random.default_rng(5)
    v, p = rng.standard_normal((300, 16)).astype(np.float32) * 0.5 + 0.6, Params(16, distance, 3, limit)
    exact = ~spaces.reaches(np.stack([spaces.scores(np.broadcast_to(x, v.shape).astype(float), v.astype(float), p) for x in v]), p)
    assert (cluster._unlike(v, v, p) == exact).all() and exact.any() and not exact.all()
    label = cluster.cliques(v, np.zeros(300, np.int64), np.arange(300), p)
    label = cluster.unite(v, label, np.arange(300), p)
    for name in set(label.tolist()):
        m = np.flatnonzero(label == name)
        assert not exact[np.ix_(m, m)][~np.eye(len(m), dtype=bool)].any()


def test_neighbour_descent_adds_to_the_forest():
    """Share of the five nearest that are in the graph, of data of few dimensions in a space of more."""
    rng = np.random.default_rng(6)
    v, p = (rng.standard_normal((6000, 8)) @ rng.standard_normal((8, 24))).astype(np.float32), Params(24, "Euclid", 5, 1e9)
    best = np.argsort(((v[:200, None] - v[None]) ** 2).sum(2), axis=1)[:, 1:6]
    wanted = {(min(i, j), max(i, j)) for i in range(200) for j in best[i].tolist()}
    share = []
    for trees, rounds in ((2, 0), (2, 8), (12, 4)):
        i, j, _ = cluster.neighbour_graph(v, p, 8, trees=trees, rounds=rounds)
        share.append(len(wanted & set(zip(i.tolist(), j.tolist()))) / len(wanted))
    assert share[1] > share[0] + 0.1 and share[2] > 0.9, share
