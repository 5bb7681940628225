import itertools
import os
import random
from decimal import Decimal

import numpy as np
import pytest
from compare import DATA
from hypothesis import given
from hypothesis import strategies as st

from stellate.functions.canonical_json import normal_number, top_level
from stellate.operators.copydiff import Compare, assignment, diff_copies, paired_copies
from stellate.pipeline_queries import p1_row_pairs

SCHEMA = "id long, vector array<float>, sparse struct<indices:array<long>,values:array<float>>, payload string, version long, key string, f0 string"
FIELDS = [Compare("vector", "vector", 1e-5), Compare("sparse", "sparse"), Compare("payload", "json")]


def rows(spark, *given_):
    return spark.createDataFrame([(*r, "clash", "clash") for r in given_], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@given(st.integers(-(10**30), 10**30), st.integers(-8, 8))
def test_numbers_are_equal_by_value(n, power):
    text = f"{n}e{power}"
    assert normal_number(text) == normal_number(format(Decimal(text), "f"))
    assert normal_number(f"{n}.50") == normal_number(f"{n}.5")


def test_number_spellings():
    assert len({normal_number(x) for x in ("10", "10.0", "1e1", "1E+1", "100e-1")}) == 1
    assert normal_number("-0.0") == normal_number("0") and normal_number("9007199254740993") != normal_number("9007199254740992")


def test_payload_text():
    assert top_level('{"b": 1, "a": "\\u00e9"}') == top_level('{"a":"é","b":1.0}')
    assert top_level(None) == [] and top_level("[1]") is None and top_level('{"a":') is None and top_level('{"a": NaN}') is None
    assert top_level('{"a": [' * 3000) is None and top_level('{"a": 1}') != top_level('{"a": "1"}')


@given(st.lists(st.lists(st.integers(0, 6), min_size=4, max_size=4), min_size=1, max_size=4))
def test_assignment_is_cheapest(costs):
    cost = np.array(costs, float)
    to = assignment(cost)
    assert len(set(to.tolist())) == len(cost)
    best = min(sum(cost[i, p[i]] for i in range(len(cost))) for p in itertools.permutations(range(4), len(cost)))
    assert cost[np.arange(len(cost)), to].sum() == best


def test_current_rows(spark):
    left = rows(spark, (1, [1.0], None, '{"a":1}', 1), (1, [2.0], None, '{"a":2,"b":null}', 2), (2, None, None, None, 5), (3, [1.0, 2.0], None, "{}", 1), (3, [1.0, 2.0], None, "{}", 1), (4, [1.0], ([2, 1], [0.5, 1.0]), "{", 1), (None, [1.0], None, "{}", None), (7, [1.0], None, "{}", 1))
    right = rows(spark, (1, [2.000001], None, '{"a": 2.0}', 9), (2, [1.0], ([1], [1.0]), "{}", 1), (3, [1.0], None, None, 1), (4, [1.0], ([1, 2], [1.0, 0.5]), "{}", 1), (None, [1.0], None, None, 3), (8, [1.0], None, "{}", 1))
    assert found(diff_copies(left, right, "id", FIELDS, "version")) == sorted([(1, "payload.b"), (2, "vector"), (2, "sparse"), (3, "vector"), (4, "payload"), (7, "only_left"), (8, "only_right")], key=str)


def test_empty_tables(spark):
    some, none = rows(spark, (1, [1.0], None, "{}", 1)), rows(spark).limit(0)
    assert found(diff_copies(some, none, "id", FIELDS, "version")) == [(1, "only_left")]
    assert found(diff_copies(none, none, "id", FIELDS)) == [] and found(diff_copies(none, some, "id", FIELDS)) == [(1, "only_right")]


@pytest.mark.parametrize("limit", [256, 0])
def test_repeated_rows_pair_up(spark, limit):
    """With the limit 0 all keys go the way of those with many rows."""
    left = rows(spark, *[(1, [1.0], None, '{"a":1,"b":1}', 1)] * 3, (1, [5.0], None, '{"a":9}', 1), (2, [1.0], None, "{}", 1))
    right = rows(spark, (1, [1.0], None, '{"a":1,"b":1}', 1), (1, [1.0], None, '{"a":1,"b":2}', 1), (1, [5.0], None, '{"a":8}', 1), (2, [1.0], None, "{}", 1))
    pairs = paired_copies(left, right, "id", FIELDS, exact_limit=limit).collect()
    assert sorted((p["side"], tuple(p["fields"] or ())) for p in pairs) == [("both", ("payload.a",)), ("both", ("payload.b",)), ("left", ())]


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    make = lambda: (rng.randint(1, 4), [float(rng.randint(0, 1))], None, '{"a":%d,"b":%d}' % (rng.randint(0, 1), rng.randint(0, 2)), 1)
    a, b = [make() for _ in range(18)], [make() for _ in range(16)]
    got = {}
    for p in paired_copies(rows(spark, *a), rows(spark, *b), "id", FIELDS).collect():
        n, cost = got.get((p["id"], p["side"]), (0, 0))
        got[p["id"], p["side"]] = n + 1, cost + len(p["fields"] or ())

    def price(x, y):
        return (x[1] != y[1]) + len({k for k, _ in set(top_level(x[3])) ^ set(top_level(y[3]))})

    for key in {r[0] for r in a + b}:
        x, y = [r for r in a if r[0] == key], [r for r in b if r[0] == key]
        for r in list(x):
            if r in y:
                x.remove(r)
                y.remove(r)
        few, many = sorted((x, y), key=len)
        best = min((sum(price(f, m) for f, m in zip(few, p)) for p in itertools.permutations(many, len(few))), default=0)
        assert got.get((key, "both"), (0, 0)) == (len(few), best)
        assert got.get((key, "left"), (0, 0))[0] == max(0, len(x) - len(y)) and got.get((key, "right"), (0, 0))[0] == max(0, len(y) - len(x))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_row_pairs_of_all_keys_against_brute_force(spark):
    """p1_row_pairs over its whole tables: as many differing names as in the cheapest of all pairings of each id."""
    got = {r["id"]: (r["pairs"], r["only_points"], r["only_replica"], r["differing_fields"]) for r in p1_row_pairs(spark, DATA).collect()}
    sides = [{}, {}]
    for side, name in zip(sides, ("points", "points_replica")):
        for r in spark.read.parquet(f"{DATA}/{name}.parquet").select("id", "vector", "sparse_text", "payload").collect():
            sparse = None if r[2] is None else tuple(sorted(set(zip(r[2]["indices"], r[2]["values"]))))
            found = top_level(r[3])
            side.setdefault(r[0], []).append((None if r[1] is None else tuple(r[1]), sparse, tuple([(None, r[3])] if found is None else found)))

    def price(x, y):
        close = x[0] == y[0] or x[0] is not None and y[0] is not None and len(x[0]) == len(y[0]) and all(abs(p - q) <= 1e-5 for p, q in zip(x[0], y[0]))
        return (not close) + (x[1] != y[1]) + len({k for k, _ in set(x[2]) ^ set(y[2])})

    expected = {}
    for key in {*sides[0], *sides[1]}:
        x, y = list(sides[0].get(key, [])), list(sides[1].get(key, []))
        for r in list(x):
            if r in y:
                x.remove(r)
                y.remove(r)
        few, many = sorted((x, y), key=len)
        assert len(many) < 9
        options = [[price(f, m) for f, m in zip(few, p)] for p in itertools.permutations(many, len(few))]
        best = min(options, key=sum)
        row = (sum(c > 0 for c in best), max(0, len(x) - len(y)), max(0, len(y) - len(x)), sum(best))
        if any(row):
            expected[key] = row
    assert {k: (v[1], v[2], v[3]) for k, v in got.items()} == {k: (v[1], v[2], v[3]) for k, v in expected.items()}
    assert all(v[0] > 0 for v in got.values() if v[3] > 0)
