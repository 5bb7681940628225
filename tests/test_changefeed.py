import json
import random

from stellate.operators.changefeed import apply_changes

SCHEMA = "op_seq long, clock_tag struct<peer_id:long,clock_id:long,clock_tick:long,token:long,force:boolean>, operation string, point_id long, payload string, payload_keys array<string>, vector array<float>, rank string, ord string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def state(df):
    return {r["point_id"]: (json.loads(r["payload"]), r["vector"]) for r in df.collect()}


def replay(rows):
    once, points = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        tag = r[1]
        if tag is None or tag[2] != 0:
            once.setdefault((r[3], tag[:3] if tag else r[0]), r)
    for _, tag, op, point, payload, keys, vector in sorted(once.values(), key=lambda r: (r[1] is not None, r[1][2] if r[1] else r[0])):
        given = json.loads(payload) if payload else {}
        if op == "upsert_points":
            points[point] = [given, vector]
        elif point in points:
            here = points[point]
            if op == "delete_points":
                del points[point]
            elif op == "set_payload":
                here[0] = {k: v for k, v in {**here[0], **given}.items() if not (k in given and v is None)}
            elif op in ("overwrite_payload", "clear_payload"):
                here[0] = given if op == "overwrite_payload" else {}
            elif op == "delete_payload":
                here[0] = {k: v for k, v in here[0].items() if k not in (keys or [])}
            elif op == "update_vectors":
                here[1] = vector
            elif op == "delete_vectors":
                here[1] = None
    return {k: tuple(v) for k, v in points.items()}


def test_random_logs(spark):
    rng = random.Random(3)
    ops = ["upsert_points", "set_payload", "overwrite_payload", "delete_payload", "clear_payload", "update_vectors", "delete_vectors", "delete_points", "unknown", None]
    rows, ticks = [], {}
    for n in range(600):
        op, point = rng.choice(ops[:1] * 4 + ops), rng.choice([1, 1, 1, rng.randint(2, 30)])
        payload = json.dumps({k: rng.choice([None, 1, "x", [1, 2], {"y": "z"}, True]) for k in rng.sample("abc", rng.randint(0, 3))}) if op in ("upsert_points", "set_payload", "overwrite_payload") and rng.random() < 0.9 else None
        tick = ticks[point] = ticks.get(point, -1) + 1
        tag = None if rng.random() < 0.2 else (1, point % 3, tick, 7, False)
        row = (n, tag, op, point, payload, rng.sample("abc", 2) if op == "delete_payload" and rng.random() < 0.9 else None, [float(n)] if rng.random() < 0.8 else None)
        rows += [row] + ([(n + 1000, tag, op, point, payload, row[5], row[6])] if tag and rng.random() < 0.3 else [])
    rng.shuffle(rows)
    assert state(apply_changes(log(spark, rows))) == replay(rows)


def test_empty_and_base(spark):
    base = spark.createDataFrame([(1, '{"a":1}', [1.0]), (2, None, None)], "point_id long, payload string, vector array<float>")
    none = log(spark, []) if False else log(spark, [(1, None, "upsert_points", 9, None, None, None)]).limit(0)
    assert state(apply_changes(none)) == {}
    assert state(apply_changes(none, base)) == {1: ({"a": 1}, [1.0]), 2: ({}, None)}
    rows = [(1, None, "set_payload", 1, '{"b":2}', None, None), (2, (1, 1, 5, 0, False), "delete_points", 2, None, None, None), (3, None, "upsert_points", None, None, None, None), (4, None, "upsert_points", 3, "no json", None, None)]
    assert state(apply_changes(log(spark, rows), base)) == {1: ({"a": 1, "b": 2}, [1.0]), 3: ({}, None)}
