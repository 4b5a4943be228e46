"""T1 as a batch job: messages -> decoded -> parsed -> features -> ids.

The same functions run unchanged on a streaming DataFrame (see
``secstream.streaming.ingest``); only the sink differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_features
from ..functions.ids import doc_id
from ..functions.timeparse import parse_iso
from ..sources import envelope
from .parse import parse_documents
from .registry import PARSERS, Parsers


def enrich(raw_rows: DataFrame, numeric_epoch: bool = False, keep_null_labels: bool = False,
           parsers: Parsers = PARSERS) -> DataFrame:
    """(…, source_file, log_type, raw) -> enriched documents with ``doc_id``
    and a typed ``event_time`` (null when the text does not parse)."""
    docs = with_features(parse_documents(raw_rows, keep_null_labels, parsers))
    return docs.withColumn("doc_id", doc_id(parsers.id_fields)).withColumn(
        "event_time", parse_iso(F.col("timestamp"), numeric_epoch=numeric_epoch))


def enrich_messages(messages: DataFrame, value_col: str = "value", parsers: Parsers = PARSERS) -> DataFrame:
    """S10 + T1: JSON envelopes -> enriched documents."""
    return enrich(envelope.decode(messages, value_col, parsers.raw_fields), keep_null_labels=True, parsers=parsers)


def route_messages(messages: DataFrame, value_col: str = "value", parsers: Parsers = PARSERS) -> DataFrame:
    """The decoded messages with ``reason``, null for those that give a document.

    ``undecodable``: no JSON envelope with a raw record; ``unknown_type``: a log
    type without a parser; ``out_of_range``: a number that its column cannot hold.
    """
    rows = envelope.decode(messages.withColumn("_message", F.col(value_col)), value_col, parsers.raw_fields)
    outside = F.lit(False)
    for name, kind in parsers.ranges.items():
        number = F.col(f"raw.{name}")
        outside = outside | (number.isNotNull() & number.try_cast(kind).isNull())
    reason = (F.when(F.col("raw").isNull(), "undecodable")
              .when(~parsers.is_known(), "unknown_type")
              .when(outside, "out_of_range"))
    return rows.withColumn("reason", reason)


def _where_flat(df: DataFrame, condition, columns: list[str]) -> DataFrame:
    """Rows that meet the condition, by a flat-map: a pushed filter would repeat the JSON decode."""
    row = F.array(F.struct(*columns))
    return df.select(F.inline(F.when(condition, row).otherwise(F.array().cast(df.select(row).schema[0].dataType))))


def rejected(routed: DataFrame, value_col: str = "value") -> DataFrame:
    """Of routed messages those that give no document, as they came, with the reason."""
    kept = [c for c in routed.columns if c not in ("source_file", "log_type", "raw")]
    return _where_flat(routed, F.col("reason").isNotNull(), kept).withColumnRenamed("_message", value_col)


def accepted(routed: DataFrame, parsers: Parsers = PARSERS) -> DataFrame:
    """Enriched documents of all other routed messages: with the rejected ones they account for every message."""
    kept = [c for c in routed.columns if c not in ("reason", "_message")]
    return enrich(_where_flat(routed, F.col("reason").isNull(), kept), keep_null_labels=True, parsers=parsers)


def dead_letters(messages: DataFrame, value_col: str = "value", parsers: Parsers = PARSERS) -> DataFrame:
    return rejected(route_messages(messages, value_col, parsers), value_col)


def accepted_documents(messages: DataFrame, value_col: str = "value", parsers: Parsers = PARSERS) -> DataFrame:
    return accepted(route_messages(messages, value_col, parsers), parsers)


def flat_documents(docs: DataFrame) -> DataFrame:
    """Flatten the nested document (for exports and SQL comparison)."""
    feats = [f"features.{f.name}" for f in docs.schema["features"].dataType.fields]
    top = [c for c in docs.columns if c not in ("attributes", "labels", "features")]
    attrs = [F.col(f"attributes.{f.name}").alias(("attr_" if f.name in top else "") + f.name)
             for f in docs.schema["attributes"].dataType.fields]
    return docs.select(*top, *attrs, "labels.sus", "labels.evil", *feats)
