import os

import pytest
from compare import DATA, check

from stellate.llm import queries


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES.get(name))
