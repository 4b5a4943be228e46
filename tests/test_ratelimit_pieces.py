"""The rate-limit stream gets bounded micro-batches whatever the table's size and ids."""

import os

import __spark_entry__ as E
from pyspark.sql import functions as F

from secstream.plans import q_streaming as Q
from secstream.streaming import ratelimit as R

SF = "/root/testdata/sf0.001"


def test_rows_of_a_trigger_are_bounded_and_results_stay(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "ROWS_PER_TRIGGER", 200)
    monkeypatch.setattr(R, "WALK_ROWS", 7)
    monkeypatch.setattr(Q, "_scratch", lambda *_: str(tmp_path))
    out = Q.stream_rate_limit(spark, SF)
    key = sorted(out.columns)
    assert sorted(map(tuple, out.select(key).collect())) == sorted(
        map(tuple, E.queries()["rate_limit"](spark, SF).select(key).collect()))
    total = out.count()
    assert len([f for f in os.listdir(f"{tmp_path}/ckpt/commits") if f.isdigit()]) == -(-total // 200) > 4


def test_uneven_ids_make_even_pieces(spark, tmp_path):
    df = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.lit(10 ** 12)).otherwise(F.col("id")))
    Q._write_pieces(df, str(tmp_path), "id", 30)
    sizes = spark.read.parquet(f"{tmp_path}/pieces").groupBy("piece").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert sorted((r["piece"], r["n"]) for r in sizes.collect()) == [(0, 25), (1, 25), (2, 25), (3, 25)]
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/src").collect()) == [*range(99), 10 ** 12]
