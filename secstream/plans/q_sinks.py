"""Query keys: stored documents, their derived tables and request validation
(S14, S15, S17, P16, D2, F9)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.encoder import norm
from ..operators import sinks as S
from ..operators import validation as V
from ..operators.dedup import read_upserted
from ..operators.ingest import flat_documents
from ..session import checkpoint_dir
from ..sources.runbooks import parse_runbook
from ..sources.tables import read_table
from .inputs import event_docs, stored_event_docs
from .q_context import _RUNBOOK_SQL, runbook_files
from .registry import register
from .sql_events import ENRICHED_COLUMNS, with_docs


def _place(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex[:8]}")


@register("flagged_scan", with_docs("SELECT doc_id, log_type, sus, evil FROM docs WHERE sus = 1 OR evil = 1"))
def flagged_scan(spark, sf_dir):
    """The flagged documents of the stored table."""
    return S.flagged(stored_event_docs(spark, sf_dir)).select("doc_id", "log_type", "labels.sus", "labels.evil")


@register("vector_sink", with_docs("""
SELECT DISTINCT doc_id, log_type, timestamp, 384 AS dim, CAST(1.0 AS DOUBLE) AS norm
FROM docs WHERE sus = 1 OR evil = 1"""))
def vector_sink(spark, sf_dir):
    """Flagged documents encoded and upserted, malicious ones delivered again; one row per id."""
    path = _place(spark, "vectors")
    docs = S.flagged(event_docs(spark, sf_dir))
    encoder = S.fit_document_encoder(docs)
    S.write_vectors(spark, docs, path, encoder)
    S.write_vectors(spark, docs.filter(F.col("labels.evil") == 1), path, encoder)
    return read_upserted(spark, path).select("doc_id", "log_type", "timestamp", F.size("embedding").alias("dim"),
                                             F.round(norm("embedding"), 4).alias("norm"))


@register("runbook_sink", f"""SELECT regexp_replace(filename, '[.][^.]*$', '') AS runbook_id, title, severity, tags
FROM ({_RUNBOOK_SQL.strip()})""")
def runbook_sink(spark, sf_dir):
    """Parsed runbooks upserted by file stem, all of them twice."""
    path = _place(spark, "runbooks")
    rows = parse_runbook(runbook_files(spark, sf_dir))
    S.write_runbooks(spark, rows, path)
    S.write_runbooks(spark, rows, path)
    return read_upserted(spark, path).select("runbook_id", "title", "severity", F.array_join("tags", "|").alias("tags"))


@register("stored_events", with_docs("""
SELECT doc_id, log_type, CASE WHEN event_id % 10 = 0 THEN '' ELSE timestamp END AS timestamp, source_file,
  CASE WHEN event_id % 10 <> 1 THEN process_name END AS process_name, CASE WHEN event_id % 10 <> 2 THEN sus END AS sus
FROM docs"""))
def stored_events(spark, sf_dir):
    """Events rebuilt from stored documents of which some lack a field."""
    d = event_docs(spark, sf_dir)
    digit = F.col("event_id") % 10
    d = d.withColumn("timestamp", F.when(digit != 0, F.col("timestamp"))) \
        .withColumn("attributes", F.when(digit != 1, F.col("attributes"))) \
        .withColumn("labels", F.when(digit != 2, F.col("labels")))
    return S.stored_events(d).select("doc_id", "log_type", "timestamp", "source_file", "attributes.process_name",
                                     "labels.sus")


@register("feature_recompute", with_docs(f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM docs"))
def feature_recompute(spark, sf_dir):
    """Features computed again from the stored documents, in a new place."""
    path = _place(spark, "features")
    S.recompute_features(event_docs(spark, sf_dir), path)
    return flat_documents(spark.read.parquet(path)).select(*ENRICHED_COLUMNS)


@register("request_validation", """
SELECT id, array_to_string(list_filter([
  CASE WHEN NOT coalesce(window_minutes BETWEEN 1 AND 1440, FALSE) THEN 'window_minutes' END,
  CASE WHEN NOT coalesce(lookback_minutes BETWEEN 1 AND 1440, FALSE) THEN 'lookback_minutes' END,
  CASE WHEN NOT coalesce(max_events BETWEEN 1 AND 5000, FALSE) THEN 'max_events' END], lambda x: x IS NOT NULL), ',')
  AS violations
FROM (SELECT event_id AS id, user_id * 3 AS window_minutes, CASE WHEN event_type <> 'view' THEN event_id % 2000 END
  AS lookback_minutes, CAST(floor(value * 20) AS BIGINT) AS max_events FROM events)""")
def request_validation(spark, sf_dir):
    """requests for recent incidents (stand-in numbers from events) with the rules that they break."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    r = ev.select(F.col("event_id").alias("id"), (F.col("user_id") * 3).alias("window_minutes"),
                  F.when(F.col("event_type") != "view", F.col("event_id") % 2000).alias("lookback_minutes"),
                  F.floor(F.col("value") * 20).alias("max_events"))
    return V.validate(r, "recent").select("id", F.array_join("violations", ",").alias("violations"))
