"""Query keys: ingest."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.dedup import latest_per_key
from ..operators.ingest import accepted_documents, dead_letters, enrich_messages, flat_documents
from ..session import checkpoint_dir
from ..sources import envelope
from ..sources.csv_logs import discover, read_csv_logs, write_keyed
from ..sources.driver_events import raw_events
from ..sources.tables import read_table
from .registry import register
from .sql_events import ENRICHED_COLUMNS, with_docs

_COLS = ", ".join(ENRICHED_COLUMNS)


def _message_docs(spark, sf_dir):
    """events -> JSON envelopes -> decoded, enriched documents."""
    return enrich_messages(envelope.encode(raw_events(read_table(spark, sf_dir, "events"))))


@register("ingest_enriched", with_docs(f"SELECT {_COLS} FROM docs"))
def ingest_enriched(spark, sf_dir):
    """events -> JSON envelopes -> decode -> route/parse -> features -> ids."""
    return flat_documents(_message_docs(spark, sf_dir)).select(*ENRICHED_COLUMNS)


_DEDUP_SQL = with_docs("""
SELECT doc_id, max_by(event_id, delivery) AS event_id, max_by(log_type, delivery) AS log_type,
       max_by(timestamp, delivery) AS timestamp, count(*) AS deliveries
FROM (SELECT doc_id, event_id, log_type, timestamp, 0 AS delivery FROM docs
      UNION ALL
      SELECT doc_id, event_id, log_type, timestamp, 1 AS delivery FROM docs WHERE sus = 1)
GROUP BY doc_id""")


@register("ingest_dedup", _DEDUP_SQL)
def ingest_dedup(spark, sf_dir):
    """The suspicious rows are delivered twice (an at-least-once replay);
    the upsert key collapses them to one document per id."""
    docs = _message_docs(spark, sf_dir).select("doc_id", "event_id", "log_type", "timestamp", F.col("labels.sus").alias("sus"))
    # a row a delivery by a flat-map: a union of two readings would decode every message twice
    times = F.when(F.col("sus") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delivered = docs.withColumn("delivery", F.explode(times))
    out = latest_per_key(delivered.select("doc_id", "event_id", "log_type", "timestamp", "delivery"),
                         "doc_id", "delivery", count_as="deliveries")
    return out.select("doc_id", "event_id", "log_type", "timestamp", "deliveries")


def _damaged_messages(spark, sf_dir):
    """Messages of the events, some cut short, some of an unknown type, some with a number too large,
    and some without label, with a null or NaN label, or with a user id sent as text."""
    m = envelope.encode(raw_events(read_table(spark, sf_dir, "events")))
    case = F.col("event_id") % 20
    v = F.col("value")
    label = r'"sus":[0-9.]+'
    return m.withColumn("value", F.when(case == 0, F.substring(v, 1, 25))
                        .when(case == 1, F.regexp_replace(v, '"log_type":"[a-z_]+"', '"log_type":"mystery"'))
                        .when(case == 2, F.regexp_replace(v, r'"(DnsResponseCode|argsNum)":[0-9.]+', '"$1":1.0E12'))
                        .when(case == 3, F.regexp_replace(v, label, '"sus":null'))
                        .when(case == 4, F.regexp_replace(v, label, '"sus":NaN'))
                        .when(case == 5, F.regexp_replace(v, label + ",?", ""))
                        .when(case == 6, F.regexp_replace(v, r'"userId":([0-9.]+)', '"userId":"$1"'))
                        .otherwise(v))


_FATE_SQL = """fate AS (SELECT *, event_id % 20 AS c,
  CASE WHEN event_id % 20 = 0 THEN 'undecodable' WHEN event_id % 20 = 1 THEN 'unknown_type'
       WHEN event_id % 20 = 2 AND (log_type <> 'dns' OR dns_response_code IS NOT NULL) THEN 'out_of_range' END AS reason
  FROM docs)"""


@register("ingest_dead_letter", with_docs(f"""
SELECT event_id, reason FROM ({_FATE_SQL.removeprefix("fate AS (").removesuffix(")")}) WHERE reason IS NOT NULL"""))
def ingest_dead_letter(spark, sf_dir):
    """The messages that give no document, with the reason."""
    return dead_letters(_damaged_messages(spark, sf_dir)).select("event_id", "reason")


@register("ingest_nulls", with_docs(f"""
SELECT event_id, log_type, user_id, evil, CASE WHEN c IN (3, 4) THEN NULL WHEN c = 5 THEN 0 ELSE sus END AS sus
FROM ({_FATE_SQL.removeprefix("fate AS (").removesuffix(")")}) WHERE reason IS NULL"""))
def ingest_nulls(spark, sf_dir):
    """G1: null and NaN labels stay null, absent ones are 0, numbers sent as text are read."""
    d = accepted_documents(_damaged_messages(spark, sf_dir))
    return d.select("event_id", "log_type", F.col("attributes.user_id").alias("user_id"),
                    F.col("labels.evil").alias("evil"), F.col("labels.sus").alias("sus"))


_FAMILY_COLUMNS = {
    "dns": ("DnsTimestamp", "SourceIP", "DestinationIP", "DnsQuery", "DnsResponseCode", "sus", "evil"),
    "standard_host": ("timestamp", "processId", "parentProcessId", "userId", "processName", "hostName", "eventId",
                      "eventName", "argsNum", "returnValue", "args", "sus", "evil"),
    "deep_kernel": ("timestamp", "processId", "threadId", "parentProcessId", "userId", "mountNamespace", "processName",
                    "hostName", "eventId", "eventName", "stackAddresses", "argsNum", "returnValue", "args", "sus", "evil"),
}


def _csv_folder(spark, sf_dir) -> str:
    """The events as CSV files of the three families, each with its own header."""
    folder = os.path.join(checkpoint_dir(spark), "csv", uuid.uuid4().hex)
    raw = raw_events(read_table(spark, sf_dir, "events"))
    for (source, family) in (("events-dns.csv", "dns"), ("events-training.csv", "deep_kernel"),
                             ("events-host.csv", "standard_host")):
        rows = raw.filter(F.col("source_file") == source)
        rows.select(*[F.col(f"raw.{c}").alias("Timestamp" if c == "DnsTimestamp" else c) for c in _FAMILY_COLUMNS[family]]) \
            .write.option("header", True).option("escape", '"').csv(f"{folder}/{source}")
    return folder


def _csv_sink(spark, sf_dir):
    """CSV files -> records -> keyed messages in a sink; (sink path, delivery report)."""
    folder = _csv_folder(spark, sf_dir)
    rows = read_csv_logs(spark, discover(spark, folder=folder))
    return f"{folder}/messages", write_keyed(envelope.encode(rows), f"{folder}/messages")


_CSV_COLUMNS = [c for c in ENRICHED_COLUMNS if c != "event_id"]


@register("csv_ingest", with_docs(f"SELECT {', '.join(_CSV_COLUMNS)} FROM docs"))
def csv_ingest(spark, sf_dir):
    """S1 + S2 + S5: CSV files of three headers -> keyed messages -> the documents of ``ingest_enriched``."""
    path, _ = _csv_sink(spark, sf_dir)
    # the files carry no row id; ``event_id`` here keeps the name of the raw field apart
    messages = spark.read.parquet(path).withColumn("event_id", F.lit(None).cast("bigint"))
    return flat_documents(enrich_messages(messages)).select(*_CSV_COLUMNS)


@register("csv_delivery", with_docs("""
SELECT source_file, count(*) AS delivered, (SELECT count(*) FROM docs) AS rows_read FROM docs GROUP BY source_file"""))
def csv_delivery(spark, sf_dir):
    """Per file the rows that the sink holds, beside the rows read in all."""
    return _csv_sink(spark, sf_dir)[1]
