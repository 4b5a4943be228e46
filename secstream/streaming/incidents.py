"""Tumbling-window incident groups kept up to date by a stream of documents.

Every micro-batch aggregates its own events per (host, window) and writes the
partial counts, bounds and flags to its own folder; a replayed batch replaces it.
The partials are the state: there is no state store that grows, no watermark that
drops rows, and after any order of arrival their sum equals the batch result,
late events and those without a parseable time (bucket 0) included. A batch reads
nothing but the newest times of the batches before it.

Rows worth a look are also kept as they came: ``untimed`` holds the documents
without a time, ``late_events`` those more than ``watermark`` behind the newest event of
the batches before theirs; a batch writes its own folder of either, and again when
it is replayed. ``clock`` holds the newest event time of each batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import read_batches, write_batch
from ..operators.incidents import add_partials, finish_groups, group_partials

GROUPS, UNTIMED, LATE, CLOCK = "groups", "untimed", "late_events", "clock"


def run_incident_stream(spark: SparkSession, docs_stream: DataFrame, target_path: str, checkpoint: str,
                        window_minutes: int = 10, watermark: str = "1 day") -> None:
    """Drain ``docs_stream`` into the four tables under ``target_path``."""
    def table(name: str) -> str:
        return f"{target_path}/{name}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        def write(rows: DataFrame, name: str) -> None:
            write_batch(rows, table(name), batch_id, checkpoint)

        docs = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write(docs.filter(F.col("event_time").isNull()), UNTIMED)
            # a replayed batch sees the times that it saw before: those of smaller numbers
            seen = None
            if batch_id > 0:
                seen = (read_batches(spark, table(CLOCK)).filter(F.col("number") < batch_id)
                        .agg(F.max("newest").alias("newest")).first())
            late = F.lit(False) if seen is None or seen["newest"] is None else (
                F.col("event_time") < F.lit(seen["newest"]) - F.expr(f"INTERVAL {watermark}"))
            write(docs.filter(late), LATE)
            write(group_partials(docs, window_minutes), GROUPS)
            write(docs.agg(F.max("event_time").alias("newest")).withColumn("number", F.lit(batch_id)), CLOCK)
        finally:
            docs.unpersist()

    q = (docs_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_groups(spark: SparkSession, target_path: str) -> DataFrame:
    """The groups with bounds and severity, as the batch operator gives them."""
    return finish_groups(add_partials(read_batches(spark, f"{target_path}/{GROUPS}").drop("run", "batch")))


def read_kept(spark: SparkSession, target_path: str, name: str) -> DataFrame:
    """The documents kept under ``UNTIMED`` or ``LATE``."""
    return read_batches(spark, f"{target_path}/{name}").drop("run", "batch")
