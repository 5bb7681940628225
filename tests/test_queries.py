import os

import pytest
from compare import DATA, check

from stellate import pipeline_queries, queries

NAMES = [(m, n) for m in (pipeline_queries, queries) for n in m.QUERIES]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, module, name):
    check(spark, module.QUERIES[name], module.ORACLES.get(name))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
