"""The enrichment stream with a replay-safe upsert sink.

``readStream`` over message files (Kafka in production: the same code with
``format("kafka")`` and ``startingOffsets``) -> the batch enrichment
functions unchanged -> ``foreachBatch`` upsert keyed by ``doc_id``. The
checkpoint commits offsets only after the batch was written
(at-least-once), and the upsert makes a replayed batch a no-op (T5).
``maxFilesPerTrigger`` bounds every micro-batch like the reference's
100,000-message poll; ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.dedup import read_batches, upsert_parquet, write_batch
from ..operators.ingest import accepted, rejected, route_messages
from ..operators.registry import PARSERS, Parsers

MESSAGE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("event_id", T.LongType()),  # source row id, carried like a message header
])


def message_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source_dir))


def run_ingest(spark: SparkSession, source_dir: str, target_path: str, checkpoint: str,
               max_files_per_trigger: int = 1, transform=None, dead_path: str | None = None,
               parsers: Parsers = PARSERS) -> None:
    """Drain ``source_dir`` into the upserted document table at ``target_path``.

    Every message of a batch is decoded and routed once: those that give no document go, with
    the reason, to the batch's folder under ``dead_path`` (default: beside the table), so
    documents and dead letters account for every message as in the batch job.
    """
    dead_path = dead_path or f"{target_path.rstrip('/')}-dead"

    def sink(batch: DataFrame, batch_id: int) -> None:
        routed = route_messages(batch, parsers=parsers).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_batch(rejected(routed), dead_path, batch_id, checkpoint)
            docs = accepted(routed, parsers)
            upsert_parquet(spark, docs if transform is None else transform(docs), target_path, key="doc_id", order="seq",
                           batch_id=batch_id, writer=checkpoint)
        finally:
            routed.unpersist()

    q = (message_stream(spark, source_dir, max_files_per_trigger).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_dead_letters(spark: SparkSession, dead_path: str) -> DataFrame:
    """The messages that gave no document, with the reason."""
    return read_batches(spark, dead_path).drop("run", "batch")
