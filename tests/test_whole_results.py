"""Requests without a limit return every row, also of tables beyond any fixed count."""

import pytest
from pyspark.sql import functions as F

from stellate import queries
from stellate.plans.query import query

MANY = 100_300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("many"))
    ids = spark.range(MANY)
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i == 1, F.lit(1.0)).otherwise(F.pmod(F.xxhash64("id", i), F.lit(1000)) / 4000.0).cast("float"))
    ids.select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{d}/embeddings.parquet")
    sparse = F.struct(F.array(F.lit(7).cast("long")).alias("indices"), F.array(F.lit(0.5).cast("float")).alias("values"))
    ids.select("id", F.lit(1).cast("long").alias("version"), F.lit('{"color":"teal","title":"a"}').alias("payload"), F.lit(None).cast("array<float>").alias("vector"), sparse.alias("sparse_text")).write.parquet(f"{d}/points.parquet")
    return d


@pytest.mark.parametrize("name,left_out", [("payload_include_payload", 0), ("payload_exclude_payload", 0), ("v2_sparse_nearest", 0), ("v3_sparse_idf", 0), ("v11_sparse_recommend", 0), ("v9_context", 4), ("t6_score_threshold", 1)])
def test_no_row_is_cut_off(spark, folder, name, left_out):
    found = queries.QUERIES[name](spark, folder)
    assert found.agg(F.count("*"), F.count_distinct("id")).first() == (MANY - left_out, MANY - left_out)


def test_all_rows_in_order_after_an_offset(spark, folder):
    c = queries.embeddings(spark, folder).with_df(queries.embeddings(spark, folder).df.where("vec_id < 50"))
    every = [r["id"] for r in query(c, {"query": 0, "limit": None}).collect()]
    assert every == [r["id"] for r in query(c, {"query": 0, "limit": 49}).collect()] and len(every) == 49
    rest = query(c, {"query": 0, "limit": None, "offset": 5, "with_payload": True})
    assert [r["id"] for r in rest.collect()] == every[5:] and len(query(c, {"query": 0}).collect()) == 10
    with pytest.raises(ValueError):
        query(c, {"query": {"nearest": 0, "mmr": {}}, "limit": None})
