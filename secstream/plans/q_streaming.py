"""Query keys that run the streaming jobs (T1-T3, T5) on message files
derived from the driver tables and read back their sink tables. Their oracle
SQL is the batch result: the checks assert stream = batch."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.dedup import read_upserted
from ..operators.ingest import flat_documents
from ..operators.ingest import enrich_messages
from ..operators.ranking import exact_rank
from ..session import checkpoint_dir
from ..sources import envelope
from ..sources.driver_events import raw_events
from ..sources.tables import read_table
from ..streaming.audit import request_bodies, run_audit
from ..streaming.incidents import UNTIMED, read_groups, read_kept, run_incident_stream
from ..streaming.ingest import MESSAGE_SCHEMA, message_stream, read_dead_letters, run_ingest
from ..streaming.ratelimit import ROWS_PER_TRIGGER, rate_limit_stream
from . import q_incidents, q_ingest, q_policy
from .registry import ORACLES, register
from .sql_events import ENRICHED_COLUMNS, with_docs

#: Micro-batches of a replay, and the least files of one.
BATCHES, FILES_PER_BATCH = 4, 4
REQUESTS_PER_TRIGGER = 50_000


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def _batch_files(spark) -> int:
    """Files of a micro-batch: one a core, so that no core waits while a batch is read."""
    return max(FILES_PER_BATCH, spark.sparkContext.defaultParallelism)


def _write_in_order(df, path: str, order_col: str, batches: int = BATCHES) -> None:
    """Write one group of files per range of ``order_col``, so a file source replays the
    ranges in order. Rows without a value come first. ``df`` is worked out once, into a folder beside ``path``."""
    spark = df.sparkSession
    once = f"{path}-rows-{uuid.uuid4().hex[:8]}"
    df.write.parquet(once)
    rows = spark.read.schema(df.schema).parquet(once)
    bounds = rows.agg(F.min(order_col), F.max(order_col)).first()
    lo, hi = bounds[0] or 0, bounds[1] or 0
    step = (hi - lo) // batches + 1
    number = F.coalesce(F.floor((F.col(order_col) - lo) / step).cast("int"), F.lit(0))
    for i in range(batches):
        rows.filter(number == i).repartition(_batch_files(spark)).write.mode("append").parquet(path)


def _write_pieces(df, base: str, order_col: str, rows: int) -> None:
    """As ``_write_in_order``, but in ranges of equal row counts, at most ``rows`` and at
    most a share of 1/``BATCHES``: ranked and written once by piece, then copied piece by piece."""
    total = df.count()
    if not total:
        return df.write.parquet(f"{base}/src")
    size = min(rows, -(-total // BATCHES))
    ranked = exact_rank(df, [], [order_col], "_r")
    ranked.withColumn("piece", F.floor((F.col("_r") - 1) / size)).drop("_r") \
        .write.partitionBy("piece").parquet(f"{base}/pieces")
    for i in range(-(-total // size)):
        part = df.sparkSession.read.schema(df.schema).parquet(f"{base}/pieces/piece={i}")
        part.repartition(_batch_files(df.sparkSession)).write.mode("append").parquet(f"{base}/src")


def _messages(spark, sf_dir, replay: bool):
    raw = raw_events(read_table(spark, sf_dir, "events"))
    msgs = envelope.encode(raw).withColumn("seq", F.col("event_id") * 2)
    if replay:
        again = envelope.encode(raw.filter(F.col("raw.sus") == 1)).withColumn("seq", F.col("event_id") * 2 + 1)
        msgs = msgs.unionByName(again)
    return msgs.select(*[f.name for f in MESSAGE_SCHEMA.fields])


@register("stream_ingest", ORACLES["ingest_enriched"])
def stream_ingest(spark, sf_dir):
    """T1 + T5 + S11: messages (suspicious rows delivered twice) streamed in 4
    micro-batches into the upserted document table; equals the batch result."""
    base = _scratch(spark, "ingest")
    _write_in_order(_messages(spark, sf_dir, replay=True), f"{base}/src", "seq")
    run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt", _batch_files(spark))
    return flat_documents(read_upserted(spark, f"{base}/docs")).select(*ENRICHED_COLUMNS)


def _damaged_stream(spark, sf_dir) -> str:
    """Damaged messages streamed in 4 micro-batches; the folder of the document table."""
    base = _scratch(spark, "damaged")
    m = q_ingest._damaged_messages(spark, sf_dir).withColumn("seq", F.col("event_id"))
    _write_in_order(m.select(*[f.name for f in MESSAGE_SCHEMA.fields]), f"{base}/src", "seq")
    run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt", _batch_files(spark))
    return f"{base}/docs"


@register("stream_dead_letter", ORACLES["ingest_dead_letter"])
def stream_dead_letter(spark, sf_dir):
    """S12 + T1: the messages of the stream that give no document, with the reason; equals the batch job."""
    return read_dead_letters(spark, f"{_damaged_stream(spark, sf_dir)}-dead").select("event_id", "reason")


@register("stream_accepted", ORACLES["ingest_nulls"])
def stream_accepted(spark, sf_dir):
    """T1 + G1: the documents of all other messages of the stream; equals the batch job."""
    d = read_upserted(spark, _damaged_stream(spark, sf_dir))
    return d.select("event_id", "log_type", F.col("attributes.user_id").alias("user_id"),
                    F.col("labels.evil").alias("evil"), F.col("labels.sus").alias("sus"))


UNTIMED_EVERY, LATE_EVERY = 50, 20
_DISTURBED = f"""docs2 AS (SELECT * REPLACE (
  CASE WHEN event_id % {UNTIMED_EVERY} = 7 THEN NULL ELSE event_ts END AS event_ts,
  CASE WHEN event_id % {UNTIMED_EVERY} = 7 THEN 0.0 ELSE epoch END AS epoch) FROM docs),
"""
_STREAM_INC_SQL = with_docs(q_incidents._GROUPS_SELECT,
                            _DISTURBED + q_incidents._INC_CTE.replace("FROM docs)", "FROM docs2)"))


def _incident_stream(spark, sf_dir) -> str:
    """Event messages in which some have no readable time and some arrive in the last batch."""
    base = _scratch(spark, "incidents")
    m = _messages(spark, sf_dir, replay=False)
    untimed = F.col("event_id") % UNTIMED_EVERY == 7
    m = m.withColumn("value", F.when(untimed, F.regexp_replace(
        "value", '("[Tt]imestamp":)"[^"]*"', '$1"some time"')).otherwise(F.col("value")))
    last = (read_table(spark, sf_dir, "events", "event_id").agg(F.max("event_id")).first()[0] or 0) * 2
    m = m.withColumn("arrival", F.when(F.col("event_id") % LATE_EVERY == 3, F.lit(last)).otherwise(F.col("seq")))
    _write_in_order(m, f"{base}/src", "arrival")
    docs = enrich_messages(message_stream(spark, f"{base}/src", _batch_files(spark)))
    run_incident_stream(spark, docs, f"{base}/incidents", f"{base}/ckpt", q_incidents.WINDOW, "1 day")
    return f"{base}/incidents"


@register("stream_incidents", _STREAM_INC_SQL)
def stream_incidents(spark, sf_dir):
    """One-day tumbling windows per host, merged micro-batch by micro-batch; equals the
    batch groups with untimed (bucket 0) and late events counted."""
    return read_groups(spark, _incident_stream(spark, sf_dir))


@register("stream_untimed", with_docs(f"SELECT event_id, log_type FROM docs WHERE event_id % {UNTIMED_EVERY} = 7"))
def stream_untimed(spark, sf_dir):
    """The events without a readable time, kept in their own table as well."""
    return read_kept(spark, _incident_stream(spark, sf_dir), UNTIMED).select("event_id", "log_type")


@register("stream_rate_limit", ORACLES["rate_limit"])
def stream_rate_limit(spark, sf_dir):
    """T3 + T4: the token bucket as state of groups of callers across micro-batches of at most
    ``ROWS_PER_TRIGGER`` calls; equals the batch walk."""
    base = _scratch(spark, "ratelimit")
    calls = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    _write_pieces(calls, base, "event_id", ROWS_PER_TRIGGER)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", _batch_files(spark)).parquet(f"{base}/src")
    out = rate_limit_stream(stream, "user_id", "ts", "event_id", q_policy.RL_RATE_PER_MINUTE, q_policy.RL_BURST)
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(f"{base}/out")
    return res.select("id", "caller", "allowed", F.round("available", 6).alias("available"),
                      F.round("tokens", 6).alias("tokens"))


def _request_stream(spark, source: str, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", _batch_files(spark)).parquet(source)


@register("stream_audit", ORACLES["gateway_audit"])
def stream_audit(spark, sf_dir):
    """T6 + G-3..G-5: chat requests streamed in the order they came, at most ``REQUESTS_PER_TRIGGER`` a
    micro-batch, into the append-only audit; equals the batch audit."""
    base = _scratch(spark, "audit")
    messages, requests = q_policy._requests(spark, sf_dir)
    bodies = request_bodies(requests, messages)
    _write_pieces(bodies, base, "request_ts", REQUESTS_PER_TRIGGER)
    run_audit(spark, _request_stream(spark, f"{base}/src", bodies.schema), f"{base}/audit", f"{base}/ckpt",
              q_policy.GW_RATE_PER_MINUTE, q_policy.GW_BURST)
    a = spark.read.parquet(f"{base}/audit")
    return a.select("ts_utc", "caller_id", "model", "prompt_tokens", "response_tokens", "latency_ms",
                    "blocked_pii", F.array_join("pii_types", ",").alias("pii_types"), "success")
