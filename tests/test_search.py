"""Search filters, BM25 and paging (reference contract cases)."""

import math

import pytest
from pyspark.sql import functions as F

from secstream.operators import search as S
from secstream.plans.inputs import event_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return event_docs(spark, SF).persist()


def test_types_sum_to_total(docs):
    total = docs.filter(S.build_predicate(sus=1)).count()
    parts = sum(docs.filter(S.build_predicate(sus=1, log_type=t)).count() for t in ("dns", "deep_kernel", "standard_host"))
    assert total == parts > 0


def test_nothing_given_is_everything(docs):
    assert docs.filter(S.build_predicate()).count() == docs.count()


def test_time_range(docs):
    assert docs.filter(S.build_predicate(timestamp_from="2099-01-01T00:00:00Z")).count() == 0
    some = docs.filter(S.build_predicate(timestamp_from="2024-01-02T00:00:00Z", timestamp_to="2024-01-03T00:00:00Z"))
    assert some.count() > 0
    assert docs.filter(S.build_predicate(timestamp_from="", timestamp_to="")).count() == docs.count()


def test_validation():
    with pytest.raises(ValueError):
        S.build_predicate(log_type="nope")
    with pytest.raises(ValueError):
        S.build_predicate(sus=2)


def test_pages_differ(docs):
    hits = docs.select("doc_id", F.lit(0.0).alias("score"))
    p1 = [r["doc_id"] for r in S.page(hits, 1, 10).collect()]
    p2 = [r["doc_id"] for r in S.page(hits, 2, 10).collect()]
    assert len(p1) == len(p2) == 10 and not set(p1) & set(p2)
    with pytest.raises(ValueError):
        S.page(hits, 0, 10)
    with pytest.raises(ValueError):
        S.page(hits, 1, 501)


def test_bm25_against_formula(spark):
    texts = ["amazonaws com amazonaws", "google com", "other text here", "amazonaws"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in S.bm25(df, F.col("text"), "amazonaws", "doc_id").collect()}
    n, dls = len(texts), [len(t.split()) for t in texts]
    avg = sum(dls) / n
    dfreq = sum("amazonaws" in t.split() for t in texts)
    idf = math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5))
    for i, t in enumerate(texts):
        tf = t.split().count("amazonaws")
        want = idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dls[i] / avg)) if tf else 0.0
        assert abs(got[i] - want) < 1e-12
    assert got[0] > 0 and got[1] == 0.0


def test_filter_pushed_to_scan(spark):
    from secstream.sources.tables import read_table
    d = read_table(spark, SF, "documents", "doc_id", "lang").filter(F.col("lang") == "en")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_recent_flagged_oldest_first(docs):
    out = S.recent_flagged(docs, "2024-01-15T12:00:00Z", 1440, max_events=5).collect()
    times = [r["event_time"] for r in out]
    assert times == sorted(times) and len(out) <= 5
    with pytest.raises(ValueError):
        S.recent_flagged(docs, "2024-01-15T12:00:00Z", 60, min_sus=False, min_evil=False)


def test_forensics_prunes_date_partitions(spark, docs):
    import os
    import uuid

    from secstream.operators.detections import cold_store_write, forensics
    from secstream.session import checkpoint_dir
    path = os.path.join(checkpoint_dir(spark), f"cold-test-{uuid.uuid4().hex[:6]}")
    cold_store_write(docs, path)
    out = forensics(spark, path, "2024-01-20T00:00:00Z", 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "make_date" in plan
    assert all(r["event_name"] == "execve" and r["attributes"]["user_id"] == 0 for r in out.collect())
