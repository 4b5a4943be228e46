"""Stored documents and the tables derived from them.

Every sink is the replay-safe upsert of ``operators.dedup``: running a job
twice leaves one row per id.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoder import encode, fit_encoder
from ..functions.features import with_features
from ..functions.text import document_text
from .dedup import upsert_parquet


def flagged(docs: DataFrame) -> DataFrame:
    """Documents labelled suspicious or malicious; null labels are not flagged."""
    return docs.filter((F.col("labels.sus") == 1) | (F.col("labels.evil") == 1))


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "log_type", "log_attribute", "timestamp", document_text().alias("text"))


def fit_document_encoder(docs: DataFrame, dim: int = 384) -> PipelineModel:
    """The encoder of one vector table: all its vectors must come from the same one."""
    return fit_encoder(text_rows(docs), "text", dim)


def write_vectors(spark, docs: DataFrame, target_path: str, encoder: PipelineModel, batch_id: int | None = None) -> None:
    """M15 + S15: upsert (doc_id, log_type, log_attribute, timestamp, text, embedding) under
    the ids of the source documents."""
    upsert_parquet(spark, encode(encoder, text_rows(docs)), target_path, "doc_id", "timestamp", batch_id,
                   writer="vectors")


def _stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def write_runbooks(spark, runbooks: DataFrame, target_path: str) -> None:
    """Parsed runbooks upserted by file stem; a file read again replaces its row.
    Of files with one stem the one with the greatest name stays."""
    rows = runbooks.withColumn("runbook_id", _stem(F.col("filename")))
    upsert_parquet(spark, rows, target_path, "runbook_id", "filename")


def stored_events(docs: DataFrame) -> DataFrame:
    """Stored documents as analysis events; a missing field gets its default: empty
    text, or a struct of nulls for attributes, labels and features."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("log_type", "timestamp", "source_file")]

    def struct(name: str) -> Column:
        nulls = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema[name].dataType.fields])
        return F.coalesce(F.col(name), nulls).alias(name)

    return docs.select("doc_id", *text, *[struct(n) for n in ("attributes", "labels", "features")])


def recompute_features(docs: DataFrame, target_path: str) -> None:
    """The features of stored documents computed again, into a new place (never over the
    source); adaptive rebalance evens the file sizes."""
    out = with_features(docs.drop("features"))
    out.hint("rebalance").write.mode("errorifexists").parquet(target_path)
