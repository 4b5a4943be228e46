"""The scoring stream: events in, probabilities and flags out.

Scoring is stateless, so the batch function runs unchanged on the stream and the
file sink keeps each result once. The bundle is read when the stream starts; a
newer bundle takes effect at the next start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.models import load_bundle, score_events


def run_scoring(spark: SparkSession, events: DataFrame, bundle_path: str, out_path: str, checkpoint: str) -> None:
    """Drain the streaming ``events`` (…, log_type, attributes) into scored rows at ``out_path``."""
    models, meta = load_bundle(spark, bundle_path)
    q = (score_events(events, models, meta).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
