"""The audit stream equals the batch decisions, after a restart too, and holds no text."""

import os
import uuid

from pyspark.sql import functions as F

from secstream.operators.policy import audit_rows, audit_tail, decide
from secstream.session import checkpoint_dir
from secstream.streaming.audit import request_bodies, run_audit

SCHEMA = "conv_id bigint, turn int, role string, text string"
PER_MINUTE, BURST = 6.0, 2.0


def messages(spark):
    rows = [(i, t, "user", f"request {i} part {t}") for i in range(40) for t in range(i % 3 + 1)]
    rows += [(40, 0, "user", "mail me: someone@example.com"), (41, 0, "robot", "x"), (42, 0, "user", ""),
             (43, 0, None, "x"), (44, 0, "user", None), (45, 0, "user", "y" * 32_001), (46, 0, "user", "y" * 32_000)]
    rows += [(47, t, "user", "a b") for t in range(51)] + [(48, t, "user", "a b") for t in range(50)]
    rows += [(49, 1, "user", "123-45-6789"), (49, 0, "system", "be kind")]
    return spark.createDataFrame(rows, SCHEMA)


def requests(spark):
    """Callers 0..3, one of them null; 50 has no message at all."""
    ids = spark.range(51).withColumnRenamed("id", "conv_id")
    caller = F.when(F.col("conv_id") % 4 < 3, F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")))
    return ids.select("conv_id", caller.alias("caller_id"),
                      F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 4).alias("request_ts"))


def shown(audit):
    return sorted(map(repr, audit.select("ts_utc", "caller_id", "prompt_tokens", "blocked_pii", "pii_types", "success").collect()))


def test_audit_stream_equals_batch_after_a_restart(spark):
    base = os.path.join(checkpoint_dir(spark), f"audit-{uuid.uuid4().hex[:6]}")
    msgs, reqs = messages(spark), requests(spark).where("caller_id IS NOT NULL")
    bodies = request_bodies(reqs, msgs)
    for part in (F.col("conv_id") < 30, F.col("conv_id") >= 30):
        bodies.where(part).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
        run_audit(spark, stream, f"{base}/audit", f"{base}/ckpt", PER_MINUTE, BURST)
    audit = spark.read.parquet(f"{base}/audit")
    batch = audit_rows(decide(reqs, msgs, rate_per_minute=PER_MINUTE, burst=BURST))
    assert shown(audit) == shown(batch)
    ids = [r.request_id for r in audit.collect()]
    assert len(ids) == len(set(ids)) and not {41, 42, 43, 44, 45, 47, 50} & set(ids)
    assert 0 < len(ids) < 40  # some calls are limited
    assert not any("request" in str(r[c]) for r in audit.collect() for c in audit.columns if c != "request_id")


def test_audit_stream_of_odd_requests(spark):
    """Without a limit every valid request is audited, a null caller's too."""
    base = os.path.join(checkpoint_dir(spark), f"audit-{uuid.uuid4().hex[:6]}")
    bodies = request_bodies(requests(spark), messages(spark))
    bodies.coalesce(1).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(bodies.schema).parquet(f"{base}/src")
    run_audit(spark, stream, f"{base}/audit", f"{base}/ckpt", 60_000.0, 1000.0)
    rows = {r.request_id: r for r in spark.read.parquet(f"{base}/audit").collect()}
    assert set(rows) == set(range(51)) - {41, 42, 43, 44, 45, 47, 50}
    assert rows[3].caller_id is None and rows[48].prompt_tokens == 100
    assert rows[40].blocked_pii and rows[40].prompt_tokens == 0 and rows[49].blocked_pii


def test_bodies_are_bounded(spark):
    bodies = {r.conv_id: r.messages for r in request_bodies(requests(spark), messages(spark)).collect()}
    assert len(bodies[47]) == 51 and len(bodies[45][0].content) == 32_001 and bodies[50] is None
    assert [m.role for m in bodies[49]] == ["system", "user"]
    more = spark.range(200).select(F.lit(47).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                   F.lit("user").alias("role"), F.repeat(F.lit("z"), 40_000).alias("text"))
    body = request_bodies(requests(spark), more).where("conv_id = 47").first().messages
    assert len(body) == 51 and all(len(m.content) == 32_001 for m in body)


def test_audit_tail_has_a_total_order(spark):
    rows = [(i, "c", f"2024-01-01 00:00:0{i % 2}") for i in range(10)]
    calls = spark.createDataFrame(rows, "request_id bigint, caller_id string, t string").withColumn("_t", F.to_timestamp("t"))
    for parts in (1, 3, 7):
        tail = audit_tail(calls.repartition(parts), 4, id_col="request_id")
        assert [r.request_id for r in tail.collect()] == [3, 5, 7, 9]
