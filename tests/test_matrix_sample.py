import pytest
from compare import DATA, check

from stellate import queries


@pytest.mark.parametrize("name", ["r12_matrix_pairs_sampled", "r12_matrix_offsets_sampled"])
def test_same_sample_as_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_sample_is_of_the_whole_table(spark):
    ids = {r["a"] for r in queries.QUERIES["r12_matrix_pairs_sampled"](spark, DATA).collect()}
    assert len(ids) == 40 and max(ids) >= 400 and min(ids) < 100
    assert "id < 40" not in queries.ORACLES["r12_matrix_pairs_sampled"]
