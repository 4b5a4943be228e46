"""The inverted index against the plain scan, and plans that read only the query's terms."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from secstream.operators import postings as P
from secstream.operators import search as S
from secstream.session import checkpoint_dir
from secstream.sources.tables import read_table
from test_doc_store import plan

SF = "/root/testdata/sf0.001"


def build(spark, docs, **options):
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    P.write_index(docs, F.col("text"), path, **options)
    return path


def ranked(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("query", ["password secret token of the", "THE the The", "zzzz-unknown", "", "of"])
def test_scores_equal_those_of_the_scan(spark, query):
    docs = read_table(spark, SF, "documents", "doc_id", "text")
    path = build(spark, docs)
    assert ranked(P.bm25_all(spark, path, query)) == ranked(S.bm25(docs, F.col("text"), query, "doc_id"))
    hits = P.bm25_hits(spark, path, query)
    assert hits.filter("score <= 0").count() == 0
    assert hits.count() == S.bm25(docs, F.col("text"), query, "doc_id").filter("score > 0").count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "-- ..."), (4, "a b a"), (4, "a b a"), (4, "a"), (None, "b b"), (None, "b"),
            (5, "x " * 30000 + "a"), (6, "É é ÉÉ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(9)).withColumn("term", F.lit("q"))
    path = build(spark, docs, parts=3, tasks=4)
    for query in ("a", "b a", "é", "x"):
        assert ranked(P.bm25_all(spark, path, query)) == ranked(S.bm25(docs, F.col("text"), query, "doc_id"))
    stored = {(r["doc_id"], r["term"], r["tf"]) for r in spark.read.parquet(f"{path}/postings").collect()}
    assert (5, "x", 30000) in stored and (5, "a", 1) in stored and (6, "é", 2) in stored


def test_no_documents(spark):
    path = build(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert P.bm25_all(spark, path, "a").count() == 0 and P.bm25_hits(spark, path, "a").count() == 0
    path = build(spark, spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))
    assert [r["score"] for r in P.bm25_all(spark, path, "a").collect()] == [0.0, 0.0]


def test_the_key_reads_the_index_and_only_its_terms(spark):
    text = plan(E.queries()["search_bm25"](spark, SF))
    assert "text" not in [c for x in text.splitlines() if x.startswith("ReadSchema") for c in x.split("<")[1].split(":")]
    pruned = [x for x in text.splitlines() if x.startswith("PartitionFilters") and "part" in x]
    pushed = [x for x in text.splitlines() if x.startswith("PushedFilters") and "In(term" in x]
    assert pruned and pushed
    schemas = [x for x in text.splitlines() if x.startswith("ReadSchema")]
    assert not any("terms" in x for x in schemas)


def test_a_term_of_every_document_is_split_over_tasks(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"))
    path = build(spark, docs, tasks=6)
    rows = spark.read.parquet(f"{path}/postings")
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
