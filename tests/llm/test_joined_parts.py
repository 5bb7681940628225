import numpy as np

from stellate.llm import cluster, knn
from stellate.llm.spaces import Params


def test_two_variants_of_a_group_are_joined(spark):
    """All pairs reach the limit, but the nearest of each head are of its own variant."""
    rng = np.random.default_rng(1)
    centre, gap = rng.standard_normal((2, 64))
    centre /= np.linalg.norm(centre)
    gap -= (gap @ centre) * centre
    gap /= np.linalg.norm(gap)
    v = np.concatenate([centre + s * 0.125 * gap + rng.standard_normal((20, 64)) * 0.005 for s in (-1, 1)] + [rng.standard_normal((5, 64))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    params = {"c": Params(64, "Cosine", 3, 0.9)}
    assert (unit[:40] @ unit[:40].T).min() > 0.9
    heads = spark.createDataFrame([("c", n, float(n % 7), x.tolist()) for n, x in enumerate(v.astype(np.float32))], "coll string, cluster long, w double, vector array<float>")
    few = {"c": Params(64, "Cosine", 8, 0.9)}
    once = knn.search_groups(heads.selectExpr("coll", "array(cluster) ids", "vector"), knn.fit(heads.selectExpr("coll", "cluster id", "vector"), few), cluster.CONFIDENCE)
    one_pass = {r["cluster"]: r["last"] for r in cluster._settled(heads.select("cluster"), once.select("id", "near")).collect()}
    assert len({one_pass[n] for n in range(40)}) == 2
    got = {r["cluster"]: r["last"] for r in cluster._merged(heads.select("cluster"), heads, params).collect()}
    assert got == {**{n: 0 for n in range(40)}, **{n: n for n in range(40, 45)}}
