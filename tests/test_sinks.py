"""Vector and runbook sinks, rebuilt events, request validation."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from secstream.operators import sinks as S
from secstream.operators import validation as V
from secstream.operators.dedup import read_upserted
from secstream.plans.inputs import event_docs


def test_vector_sink_replays_to_one_row_per_id(spark, tmp_path):
    docs = S.flagged(event_docs(spark, SF)).limit(40).persist()
    encoder = S.fit_document_encoder(docs, 32)
    for _ in range(2):
        S.write_vectors(spark, docs, f"{tmp_path}/v", encoder, batch_id=0)
    S.write_vectors(spark, docs.filter("labels.evil = 1"), f"{tmp_path}/v", encoder, batch_id=1)
    got = read_upserted(spark, f"{tmp_path}/v")
    assert got.count() == docs.select("doc_id").distinct().count()
    assert {len(r["embedding"]) for r in got.collect()} == {32}
    docs.unpersist()


def test_flagged_scan_leaves_null_labels_out(spark):
    df = spark.createDataFrame([("a", (1, 0)), ("b", (None, None)), ("c", (None, 1)), ("d", (0, 0))],
                               "doc_id string, labels struct<sus int, evil int>")
    assert sorted(r["doc_id"] for r in S.flagged(df).collect()) == ["a", "c"]


def test_runbook_sink_replaces_by_stem(spark, tmp_path):
    def rows(title, *names):
        return spark.createDataFrame([(n, title, "low", ["a"], "text") for n in names],
                                     "filename string, title string, severity string, tags array<string>, content string")
    S.write_runbooks(spark, rows("old", "a.b.txt", ".txt", "plain"), f"{tmp_path}/r")
    S.write_runbooks(spark, rows("new", "a.b.txt"), f"{tmp_path}/r")
    got = {r["runbook_id"]: r["title"] for r in read_upserted(spark, f"{tmp_path}/r").collect()}
    assert got == {"a.b": "new", ".txt": "old", "plain": "old"}


def test_stored_events_get_defaults(spark):
    df = spark.createDataFrame([("d", None, None, None, None, None, None)], "doc_id string, log_type string, timestamp "
                               "string, source_file string, attributes struct<host_name string>, "
                               "labels struct<sus int>, features struct<f int>")
    r = S.stored_events(df).first().asDict(True)
    assert r == {"doc_id": "d", "log_type": "", "timestamp": "", "source_file": "", "attributes": {"host_name": None},
                 "labels": {"sus": None}, "features": {"f": None}}


def test_recomputed_features_never_overwrite(spark, tmp_path):
    docs = event_docs(spark, SF).limit(20)
    S.recompute_features(docs, f"{tmp_path}/f")
    with pytest.raises(Exception, match="(?i)exist"):
        S.recompute_features(docs, f"{tmp_path}/f")


@pytest.mark.parametrize("kind,schema,rows", [
    ("search", "log_type string, sus int, evil int, page int, page_size int",
     [((None, None, None, 1, 500), []), (("dns", 1, 0, 1, 1), []), (("x", 2, -1, 0, 501),
      ["log_type", "sus", "evil", "page", "page_size"]), ((None, None, None, None, None), ["page", "page_size"])]),
    ("similar", "log_type string, k int", [(("dns", 20), []), ((None, 21), ["log_type", "k"]), (("dns", 0), ["k"])]),
    ("runbooks", "query string, k int", [(("abc", 10), []), (("ab", 11), ["query", "k"]), (("é" * 1000, 1), []),
                                         (("x" * 1001, None), ["query", "k"])]),
    ("caller", "caller string, temperature double, max_tokens int",
     [(("c", 0.0, 1), []), (("c" * 64, 2.0, 8192), []), (("", 2.1, 8193), ["caller", "temperature", "max_tokens"])]),
    ("analyze", "window_minutes int, events int", [((1, 10000), []), ((1441, 0), ["window_minutes", "events"])]),
    ("recent", "window_minutes int, lookback_minutes int, max_events int",
     [((10, 1440, 5000), []), ((0, 1441, 5001), ["window_minutes", "lookback_minutes", "max_events"])]),
])
def test_request_rules(spark, kind, schema, rows):
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "id int, " + schema)
    got = {r["id"]: r["violations"] for r in V.validate(df, kind).collect()}
    assert got == {i: r[1] for i, r in enumerate(rows)}
    good, bad = V.split_valid(df, kind)
    assert good.count() + bad.count() == len(rows) and "violations" not in good.columns


def test_unknown_kind_of_request_is_refused(spark):
    with pytest.raises(ValueError):
        V.validate(spark.range(1).withColumn("k", F.lit(1)), "nothing")
