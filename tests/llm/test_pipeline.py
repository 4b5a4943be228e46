import corpus_pipeline
from helpers import awkward

from secstream.llm import queries
from secstream.llm.common import table


def test_stages_keep_columns_and_run(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents").unionByName(awkward(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "/root/testdata/sf0.01", "labels").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [at.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(at.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    mixed = spark.read.parquet(f"{tmp_path}/3").groupBy("doc_id").count().collect()
    tokens = {r.doc_id: r for r in at.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in mixed} == {i: r["count"] for i, r in tokens.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def test_every_operator_has_one_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
