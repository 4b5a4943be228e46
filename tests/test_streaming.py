"""Stream = batch for T1-T3, and replay/restart safety of the upsert sink (T5)."""

import os
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
import pytest

from secstream.operators import dedup
from secstream.operators.dedup import read_upserted, upsert_parquet
from secstream.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_stream_equals_batch(spark):
    q = E.queries()
    assert rows(q["stream_rate_limit"](spark, SF)) == rows(q["rate_limit"](spark, SF))
    assert rows(q["stream_ingest"](spark, SF)) == rows(q["ingest_enriched"](spark, SF))


def test_upsert_replay_is_noop_and_last_wins(spark):
    path = os.path.join(checkpoint_dir(spark), f"upsert-test-{uuid.uuid4().hex[:6]}")
    b1 = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "doc_id string, seq int, v string")
    b2 = spark.createDataFrame([("a", 2, "x2"), ("c", 2, "z"), ("c", 3, "z3")], "doc_id string, seq int, v string")
    upsert_parquet(spark, b1, path, "doc_id", "seq", batch_id=0)
    upsert_parquet(spark, b2, path, "doc_id", "seq", batch_id=1)
    upsert_parquet(spark, b2, path, "doc_id", "seq", batch_id=1)  # replayed batch
    got = {r["doc_id"]: r["v"] for r in read_upserted(spark, path).collect()}
    assert got == {"a": "x2", "b": "y", "c": "z3"}


def test_ingest_restart_with_same_checkpoint(spark):
    from secstream.plans.q_streaming import _messages, _write_in_order
    from secstream.streaming.ingest import run_ingest
    base = os.path.join(checkpoint_dir(spark), f"restart-{uuid.uuid4().hex[:6]}")
    _write_in_order(_messages(spark, SF, replay=False), f"{base}/src", "seq", batches=2)
    run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt")
    n1 = read_upserted(spark, f"{base}/docs").count()
    # more files arrive (re-deliveries), the job restarts from its checkpoint
    _write_in_order(_messages(spark, SF, replay=True).filter(F.col("seq") % 2 == 1), f"{base}/src", "seq", batches=1)
    run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt")
    docs = read_upserted(spark, f"{base}/docs")
    assert docs.count() == n1 == docs.select("doc_id").distinct().count()


def _table(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:6]}")


SCHEMA = "doc_id string, seq int, v string"


def test_upsert_stopped_in_its_write_loses_nothing(spark):
    path = _table(spark, "crash")
    upsert_parquet(spark, spark.createDataFrame([("aa1", 1, "x"), ("aa2", 1, "y"), ("bb1", 1, "z")], SCHEMA), path,
                   "doc_id", "seq", batch_id=0, writer="w")
    before = rows(read_upserted(spark, path))
    batch = spark.createDataFrame([("aa1", 2, "x2"), ("cc1", 2, "n")], SCHEMA)
    stopped = batch.withColumn("v", F.when(F.col("doc_id") == "cc1", F.raise_error(F.lit("executor lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="executor lost"):
        upsert_parquet(spark, stopped, path, "doc_id", "seq", batch_id=1, writer="w")
    assert rows(read_upserted(spark, path)) == before
    for _ in range(2):  # the replay, and a replay of it
        upsert_parquet(spark, batch, path, "doc_id", "seq", batch_id=1, writer="w")
    after = {r["doc_id"]: r["v"] for r in read_upserted(spark, path).collect()}
    assert after == {"aa1": "x2", "aa2": "y", "bb1": "z", "cc1": "n"}
    assert dedup.read_batches(spark, path).count() == 5
    dedup.compact(spark, path, f"{path}-compact", "doc_id")
    assert rows(read_upserted(spark, f"{path}-compact")) == rows(read_upserted(spark, path))


def test_batches_of_two_writers_and_new_columns(spark):
    path = _table(spark, "writers")
    upsert_parquet(spark, spark.createDataFrame([(f"{i:02x}", 1, "x") for i in range(64)], SCHEMA), path, "doc_id", "seq")
    upsert_parquet(spark, spark.createDataFrame([], SCHEMA), path, "doc_id", "seq", batch_id=0)
    wider = spark.createDataFrame([("01", 0, "y", 5)], SCHEMA + ", extra int")
    upsert_parquet(spark, wider, path, "doc_id", "seq", batch_id=0, writer="b")
    got = {r["doc_id"]: r for r in read_upserted(spark, path).collect()}
    assert len(got) == 64 and (got["01"]["v"], got["01"]["extra"], got["02"]["extra"]) == ("y", 5, None)


def test_stream_accounts_for_every_message(spark):
    """Documents and dead letters of the stream are those of the batch job, after a restart too."""
    from secstream.operators.ingest import accepted_documents, dead_letters
    from secstream.plans.q_ingest import _damaged_messages
    from secstream.plans.q_streaming import _write_in_order
    from secstream.streaming.ingest import MESSAGE_SCHEMA, read_dead_letters, run_ingest
    base = _table(spark, "dead")
    m = _damaged_messages(spark, SF).withColumn("seq", F.col("event_id")).select(*[f.name for f in MESSAGE_SCHEMA.fields])
    odd = spark.createDataFrame([("k", None, 0, -1), ("k", "", 0, -2), ("k", "{}", 0, -3), ("k", "[1]", 0, -4)], MESSAGE_SCHEMA)
    m = m.unionByName(odd)
    for part in (m.filter("event_id % 2 = 0"), m.filter("event_id % 2 <> 0")):
        _write_in_order(part, f"{base}/src", "seq", batches=1)
        run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt", 2)
    dead, docs = read_dead_letters(spark, f"{base}/docs-dead"), read_upserted(spark, f"{base}/docs")
    assert rows(dead.select("event_id", "value", "reason")) == rows(dead_letters(m).select("event_id", "value", "reason"))
    assert rows(docs.select("doc_id", "event_id")) == rows(accepted_documents(m).select("doc_id", "event_id"))
    assert dead.count() + docs.count() == m.count()


def test_incident_stream_counts_late_and_untimed_events(spark):
    from secstream.operators.incidents import incident_groups
    from secstream.streaming.incidents import LATE, UNTIMED, read_groups, read_kept, run_incident_stream
    base = _table(spark, "late")
    docs = _documents(spark)
    for d in (docs.filter("event_id % 10 <> 3"), docs.filter("event_id % 10 = 3")):
        d.coalesce(1).write.mode("append").parquet(f"{base}/src")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    run_incident_stream(spark, stream, f"{base}/out", f"{base}/ckpt", 60, "1 day")
    assert rows(read_groups(spark, f"{base}/out")) == rows(incident_groups(docs, 60))
    newest = docs.filter("event_id % 10 <> 3").agg(F.max("event_time")).first()[0]
    want = docs.filter("event_id % 10 = 3").filter(F.col("event_time") < F.lit(newest) - F.expr("INTERVAL 1 day"))
    late = read_kept(spark, f"{base}/out", LATE)
    assert late.count() == want.count() > 0
    assert read_kept(spark, f"{base}/out", UNTIMED).count() == docs.filter("event_time IS NULL").count() > 0


def _documents(spark):
    from secstream.plans.inputs import event_docs
    d = event_docs(spark, SF)
    return d.withColumn("event_time", F.when(F.col("event_id") % 40 != 7, F.col("event_time")))
