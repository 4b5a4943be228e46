"""Route raw rows by log type into one document schema.

One ``select`` with a ``when`` per branch of the parser registry replaces the
per-type parser classes: all log types share a single pass over the input and the
output schema is the union of all branch fields (absent ones are null).
Rows of an unknown log type give no document here; ``ingest.dead_letters``
reports them, with undecodable and out-of-range ones, for a dead-letter table.

Defaults (applied where the raw field is missing): DNS text fields ``""``,
response code null; kernel/host text fields ``""``; event name
``unknown_kernel_event`` (deep kernel) or ``unknown_event`` (host); labels 0, but
with ``keep_null_labels`` (messages: the decoder tells absent keys, read as 0, from
null ones) a null label stays null;
source file ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import PARSERS, Parsers, _int

KNOWN_LOG_TYPES = PARSERS.log_types


def parse_documents(df: DataFrame, keep_null_labels: bool = False, parsers: Parsers = PARSERS) -> DataFrame:
    """(…, source_file, log_type, raw) -> parsed documents (only known types).

    The router emits zero or one document per row through ``inline`` (a
    flat-map), not a ``Filter``: a filter on the routed type would be pushed
    below the decoding projection and repeat the whole JSON decode inside
    the predicate."""
    top, attributes = parsers.document_columns()
    nothing = F.lit(None).cast("string")
    labels = F.struct(
        *(F.coalesce(_int(F.col(f"raw.{n}")), F.lit(None if keep_null_labels else 0).cast("int")).alias(n)
          for n in ("sus", "evil")),
    )
    extra = [c for c in df.columns if c not in ("source_file", "log_type", "raw")]
    doc = F.struct(
        *[F.col(c) for c in extra],
        F.coalesce(F.col("source_file"), F.lit("unknown")).alias("source_file"),
        F.col("log_type"),
        F.coalesce(top["timestamp"], F.lit("")).alias("timestamp"),
        top.get("log_attribute", nothing).alias("log_attribute"),
        top.get("event_name", nothing).alias("event_name"),
        F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("attributes"),
        labels.alias("labels"),
    )
    return df.select(F.inline(F.when(parsers.is_known(), F.array(doc)).otherwise(F.array().cast(
        df.select(F.array(doc)).schema[0].dataType))))
