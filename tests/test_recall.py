"""Approximate searches reach the demanded recall on the embeddings, measured by brute force over the ids divisible by 50."""

import os

import numpy as np
import pytest
from compare import DATA

from stellate import queries
from stellate.operators import ivf, quantize, recall

FOLDER = DATA.replace("sf0.001", "sf0.1")


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables here")
def test_depths_give_the_demanded_recall(spark):
    c = queries.embeddings(spark, FOLDER)
    rows = c.df.select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes, model = quantize.Binary().encode(v), ivf.Cells.fit(c, 16)
    probes, _ = recall.cells_needed(ivf.index(c, model), model)
    candidates, _ = recall.bits_needed(quantize.encode_column(c, quantize.Binary(), "codes"), "codes")
    cell = model.of(v)

    def found(probes, candidates):
        a = b = total = 0
        for q in np.flatnonzero(ids % 50 == 0):
            order = [x for x in np.argsort(-(v @ v[q]), kind="stable") if x != q][:10]
            read = model.probes(v[q].tolist(), probes)
            apart = np.unpackbits(codes ^ codes[q], axis=1).sum(axis=1)
            best = set(np.lexsort((-ids, apart))[:candidates].tolist())
            a, b, total = a + sum(int(cell[x]) in read for x in order), b + sum(int(x) in best for x in order), total + 10
        return a / total, b / total

    before, after = found(6, 80), found(probes, candidates)
    print("RECALL", probes, candidates, before, after)
    assert max(before) < 0.9 <= min(after)
    # The registered queries look that deep.
    exact = {int(ids[x]) for x in np.argsort(-(v @ v[ids == 0][0]))[:10]}
    for name in ("v22_approximate_cells", "v25_binary_quantised"):
        assert len(exact & {r["id"] for r in queries.QUERIES[name](spark, FOLDER).collect()}) >= 8
