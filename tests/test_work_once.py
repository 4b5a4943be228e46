"""Work that must not grow with repeats: one decode, one encode, one search a text, one sum for rows alike."""

import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_dedup_decodes_each_message_once(spark):
    from secstream.plans.q_ingest import ingest_dedup
    plan = ingest_dedup(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_replayed_rows_are_worked_out_once(spark, tmp_path):
    from secstream.plans.q_streaming import _write_in_order
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def work(x):
        seen.add(1)
        return x

    df = spark.range(40).repartition(2).select("id", work("id").alias("v"))
    _write_in_order(df, str(tmp_path / "src"), "v")
    assert seen.value == 40
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "src")).collect()) == list(range(40))


def test_incidents_with_one_query_text_share_a_search(spark, monkeypatch):
    from secstream.plans import q_context as Q
    searches, real = [], Q.C.retrieve

    def retrieve(queries, *rest):
        searches.append((queries.count(), queries.distinct().count()))
        return real(queries, *rest)

    monkeypatch.setattr(Q.C, "retrieve", retrieve)
    Q.incident_prompt(spark, SF)
    assert searches[0][0] == searches[0][1] < searches[1][0]


def test_rows_alike_are_summed_once_a_tree(monkeypatch):
    from secstream.operators import boosting as B
    from secstream.operators.models import EVIL_PARAMS
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 2, (3_000, 4)).astype(np.uint8)
    y = (rng.random(3_000) < 0.2 + 0.6 * bins[:, 1]).astype(float)
    sizes, real = [], B.histogram
    monkeypatch.setattr(B, "histogram", lambda b, *rest: sizes.append(len(b)) or real(b, *rest))
    trees, scores = B.fit_rows(bins, y, np.ones(3_000), np.arange(3_000), np.arange(3_000) % 5 == 0, EVIL_PARAMS, 3, 30, 1)
    assert max(sizes) <= 32 and len(trees) == 3 and max(scores) > 0.5
