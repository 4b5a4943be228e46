"""The filtering stages keep every column of a user as it is, whatever its name or type."""

import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from secstream.llm import chunk_dedup, fair_mix, shingle_join

STAGES = {"mix": fair_mix.mix, "near": shingle_join.keep_one_of_each, "exact": chunk_dedup.drop_duplicates}
INSIDE = ["__size", "__rank", "__cum", "__target", "__source", "__hash", "__copies", "__copy", "__n", "__vertex", "__component",
          "__kept", "__key", "__recipe", "__sha256", "__identity", "__text", "vertex", "component", "column0", "column7", "a.b",
          "size", "label", "back`tick"]


def dressed(df):
    """Each row's id again in a column of every inner name, and a map, a struct, an array and bytes."""
    for name in INSIDE:
        df = df.withColumn(name, F.concat(F.lit(name + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return (df.withColumn("a map", F.create_map(F.lit("id"), F.col("doc_id"))).withColumn("bytes", F.encode("text", "UTF-8"))
            .withColumn("nested", F.struct("doc_id", F.array("lang").alias("langs"))))


@pytest.mark.parametrize("stage", STAGES)
def test_user_columns_survive(spark, stage):
    docs = awkward(spark)
    plain, rich = STAGES[stage](docs), STAGES[stage](dressed(docs))
    assert rich.columns == dressed(docs).columns
    back = rich.collect()
    order = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] is None, r["text"])
    assert sorted(map(order, back), key=repr) == sorted(map(order, plain.collect()), key=repr)
    for r in back:
        own = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[name] == f"{name}={own}" for name in INSIDE)
        assert r["a map"] == {"id": r["doc_id"]} and r["nested"]["langs"] == [r["lang"]]
        assert r["bytes"] is None if r["text"] is None else bytes(r["bytes"]).decode() == r["text"]


@pytest.mark.parametrize("stage", STAGES)
def test_an_empty_table_stays_empty(spark, stage):
    out = STAGES[stage](dressed(documents(spark, [])))
    assert out.count() == 0 and "__size" in out.columns


def test_ties_in_an_unorderable_column_are_settled(spark):
    docs = spark.range(4).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same words in every row here").alias("text"),
                                 F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit("s").alias("source"))
    assert [r["m"] for r in chunk_dedup.drop_duplicates(docs).collect()] == [{"k": 3}]
    assert [r["m"] for r in shingle_join.keep_one_of_each(docs).collect()] == [{"k": 0}]


def test_the_text_column_may_have_another_name(spark):
    docs = awkward(spark).withColumnRenamed("text", "body").withColumn("text", F.lit("not this"))
    for name, stage in STAGES.items():
        out = stage(docs, text="body")
        assert out.columns == docs.columns and out.where("text <> 'not this'").count() == 0, name
        assert out.count() == stage(awkward(spark)).count()
