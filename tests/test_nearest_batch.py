import numpy as np
import pytest
from compare import DATA, check

from stellate import queries
from stellate.collection import Collection, Dense
from stellate.operators import batch


def test_registered_for_every_fiftieth_row(spark, monkeypatch):
    check(spark, queries.QUERIES["r2_nearest_batch_all"], queries.ORACLES["r2_nearest_batch_all"])
    found = queries.QUERIES["r2_nearest_batch_all"](spark, DATA)
    assert {r[0] for r in found.select("query_id").distinct().collect()} == {r[0] for r in queries.embeddings(spark, DATA).df.where("vec_id % 50 = 0").select("vec_id").collect()}


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid", "Manhattan"])
def test_blocks_give_what_one_batch_gives(spark, distance):
    v = np.random.default_rng(2).standard_normal((120, 8)).astype(np.float32)
    v[60:70] = v[0]
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)] + [(500, None), (501, [1.0])], "id long, v array<float>")
    c = Collection(rows, "id", {"": Dense("v", 8, distance)})
    asked = {n: v[n].tolist() for n in range(0, 120, 3)}
    frame = spark.createDataFrame([*asked.items()], "query_id long, vector array<float>")
    plain = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in df.collect())
    assert plain(batch.nearest_join(c, frame, 4, block=7)) == plain(batch.nearest_batch(c, asked, 4))
