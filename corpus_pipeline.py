"""A corpus pipeline: documents in, token ids of the mixed and cleaned corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row that the one
before it kept; ``run`` writes each result as Parquet into the folder named by
``spark.checkpoint.dir`` and reads it again, so a lost executor costs one stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm import bpe, chunk_dedup, fair_mix, knn_quality, shingle_join
from secstream.llm.common import table
from secstream.session import checkpoint_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest neighbours vote for; an empty text follows the sample's share."""
    model = knn_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return (knn_quality.score_quality(docs, model, out="__score")
            .where(F.col("__score") >= knn_quality.THRESHOLD).select(*docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return chunk_dedup.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return shingle_join.keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return fair_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    return (bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                       keep=("doc_id", "lang", "source")).drop("decoded"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier is trained, and near copies need connected components: no SQL over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
