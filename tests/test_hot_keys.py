"""Keys with more unmatched rows than one exact assignment takes."""

import random

import pytest

from stellate.operators.copydiff import Compare, paired_copies

FIELDS = [Compare("vector", "vector", 1e-5), Compare("sparse", "sparse"), Compare("payload", "json")]
SCHEMA = "id long, vector array<float>, sparse struct<indices:array<long>,values:array<float>>, payload string"


def cost(spark, left, right):
    """(pairs, names that differ, rows alone)."""
    found = paired_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "id", FIELDS).collect()
    return sum(p["side"] == "both" for p in found), sum(len(p["fields"] or ()) for p in found), sum(p["side"] != "both" for p in found)


def test_payloads_that_differ_in_one_key(spark):
    rng = random.Random(3)
    payload = [{k: rng.randint(0, 9999) for k in "abcdef"} for _ in range(300)]
    text = lambda x: str(x).replace("'", '"')
    left = [(1, None, None, text(p)) for p in payload]
    right = [(1, None, None, text({**p, "abcdef"[n % 6]: -1})) for n, p in enumerate(payload)]
    rng.shuffle(right)
    assert cost(spark, left, right) == (300, 300, 0)


def test_vectors_apart_by_float_noise(spark):
    rng = random.Random(4)
    v = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(300)]
    left = [(1, x, None, '{"a":1}') for x in v] + [(1, None, None, '{"b":1}')]
    right = [(1, [y + rng.uniform(-2e-6, 2e-6) for y in x], None, '{"a":1}') for x in v]
    rng.shuffle(right)
    assert cost(spark, left, right) == (0, 0, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_cost_little_more_than_one_assignment(spark, seed):
    """One key of 120 rows a side without counterparts, the hardest to pair: once in one assignment, once in parts of 24 rows."""
    rng = random.Random(seed)
    make = lambda: (1, [float(rng.randint(0, 2))] * 4, None, str({k: rng.randint(0, 2) for k in "abcd"}).replace("'", '"'))
    left, right = [make() for _ in range(120)], [make() for _ in range(120)]
    tables = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    costs = [sum(len(p["fields"] or ()) for p in paired_copies(*tables, "id", FIELDS, exact_limit=n).collect()) for n in (1024, 24)]
    assert costs[0] <= costs[1] <= 1.15 * costs[0], costs


def test_unequal_sides(spark):
    rng = random.Random(9)
    left = [(None, None, None, '{"a":%d}' % rng.randint(0, 50)) for _ in range(40)]
    right = [(None, None, None, '{"b":%d}' % rng.randint(0, 50)) for _ in range(250)]
    tables = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    sides = [p["side"] for p in paired_copies(*tables, "id", FIELDS, exact_limit=30).collect()]
    assert (sides.count("both"), sides.count("left"), sides.count("right")) == (40, 0, 210)
