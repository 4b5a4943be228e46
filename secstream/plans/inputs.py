"""Inputs shared by the query keys: the enriched event documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.doc_store import read_documents, write_documents
from ..operators.ingest import enrich, flat_documents
from ..session import checkpoint_dir
from ..sources.driver_events import raw_events
from ..sources.tables import read_table, table_path
from .sql_events import ENRICHED_COLUMNS


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested enriched documents derived from the ``events`` table (no JSON
    round trip: in production this is the table the ingest job writes)."""
    return enrich(raw_events(read_table(spark, sf_dir, "events")))


def flat_event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_documents(event_docs(spark, sf_dir)).select(*ENRICHED_COLUMNS)


_written: dict[tuple, str] = {}


def once_a_session(spark: SparkSession, sf_dir: str, table: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a table derived from ``table``, under ``spark.checkpoint.dir``.

    The first key of a session that needs it writes it by ``write(path)``; the others read it,
    as long as the files of ``table`` are the same (paths, times and lengths).
    """
    files = (spark.read.format("binaryFile").load(table_path(sf_dir, table))
             .select("path", F.unix_micros("modificationTime").alias("at"), "length"))
    state = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "at", "length").cast("decimal(38,0)"))
                      .alias("digest")).first()
    folder = os.path.join(checkpoint_dir(spark), name)
    key = (spark.sparkContext.applicationId, folder, sf_dir, state["n"], state["digest"])
    if key not in _written:
        path = os.path.join(folder, uuid.uuid4().hex)
        write(path)
        _written[key] = path
    return _written[key]


def stored_event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event documents as the ingest job stores them (``doc_store``)."""
    docs = event_docs(spark, sf_dir)
    path = once_a_session(spark, sf_dir, "events", "documents", lambda p: write_documents(docs, p))
    return read_documents(spark, path, docs.schema)
