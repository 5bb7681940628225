from pyspark.sql import functions as F

from stellate.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame([(n, s, t, "clash", "clash") for n, (s, t) in enumerate(rows)], "doc_id long, source string, text string, copy string, rate string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_and_caps(spark):
    rows = [("big", "one two three")] * 400 + [(" Small ", "one two three")] * 20 + [("SMALL", None)] * 3 + [("unlisted", "x")] * 50 + [(None, "x")] * 5
    d, t = docs(spark, rows), targets(spark, [("big", 1.0, 2), ("small", 1.0, 4), ("absent", 2.0, 3), (None, 1.0, 1)])
    own = {r["source"]: (r["own"], r["rate"]) for r in mixing.plan(mixing.sized(d), t).collect()}
    assert own["absent"] == (0, 0.0) and own["small"] == (60, 4.0) and own["big"][0] == 1200
    assert abs(own["big"][1] - 1260 * 0.25 / 1200) < 1e-9
    assert sorted(r[0] for r in mixing.short_sources(mixing.sized(d), t).collect()) == ["absent", "small"]
    used = mixing.mix(d, t)
    assert set(used.columns) == {"doc_id", "source", "text", "copy", "rate"}
    small = used.where("doc_id >= 400 AND doc_id < 423").groupBy("doc_id").count().collect()
    assert len(small) == 23 and all(r["count"] == 4 for r in small)
    big = used.where("doc_id < 400").groupBy("doc_id").count().collect()
    assert 60 < len(big) < 150 and all(r["count"] == 1 for r in big)
    assert used.where("doc_id >= 423").count() == 0
    shares = {r["source"]: r for r in mixing.shares(d, t).collect()}
    assert shares["small"]["used_tokens"] == 240 and abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-9
    assert used.orderBy("doc_id", "copy").collect() == mixing.mix(d.repartition(7), t).orderBy("doc_id", "copy").collect()


def test_rates_are_met_on_average(spark):
    ids = spark.range(20_000)
    for rate in (0.25, 1.5, 3.0):
        n = ids.agg(F.sum(mixing.copies(F.col("id"), F.lit(rate)))).first()[0]
        assert abs(n / 20_000 - rate) < 0.02


def test_empty(spark):
    t = targets(spark, [("a", 1.0, 2)])
    none = docs(spark, [("a", "x")]).limit(0)
    assert mixing.short_sources(mixing.sized(none), t).count() == 0 and mixing.mix(none, t).count() == 0
    assert mixing.shares(none, t).first()["reached_share"] == 0.0
    assert mixing.short_sources(mixing.sized(docs(spark, [("a", "x")])), t.limit(0)).count() == 0
    odd = targets(spark, [("a", None, None), ("A ", -1.0, 1)])
    assert mixing.plan(mixing.sized(docs(spark, [("a", "x")])), odd).count() == 1
