"""Shared helpers of the training-data operators.

Word rule used by several operators: a word is a maximal run of bytes outside
``\\x20`` and ``\\x09-\\x0D`` (ASCII white space). A null text counts as empty.
A null ``doc_id`` hashes like the empty string when rows are split by ``crc32``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the folder comes from ``spark.checkpoint.dir``."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)


class PlainNames:
    """The rows of a table under names that no operator uses inside.

    ``kept`` maps the columns an operator reads to the names it reads them by; every other column
    becomes ``column<i>``. ``back`` gives rows their own names again, in the table's order. So an
    extra column may have any name or type, also ``__size`` or one with a dot.
    """

    def __init__(self, df: DataFrame, kept: dict[str, str]):
        self.names = [(c, kept.get(c, f"column{i}")) for i, c in enumerate(df.columns)]
        self.rows = df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in self.names))

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(n).alias(c) for c, n in self.names))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_row(df: DataFrame, columns: list[str], first: str, pick: str) -> Column:
    """An aggregate: the ``min`` or ``max`` row by ``first``, then by all other columns in order;
    columns without an order (maps) are compared last, by their JSON text."""
    order = [first, *(c for c in columns if c != first and _orderable(df.schema[c].dataType))]
    other = [c for c in columns if c not in order]
    if not other:
        return (F.min if pick == "min" else F.max)(F.struct(*order))
    key = F.struct(*order, *(F.to_json(F.struct(c)).alias(f"json_{i}") for i, c in enumerate(other)))
    return (F.min_by if pick == "min" else F.max_by)(F.struct(*columns), key)


def text_slices(batches: Iterable[pa.RecordBatch], column: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row slices of bounded text volume (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of every text: distinct words, word numbers in order, and text bounds.

    Text ``i`` holds the words ``codes[bounds[i]:bounds[i + 1]]``.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False).astype(bool)
    before = np.concatenate(([0], np.cumsum(kept)))
    ends = np.concatenate(([0], np.cumsum(lengths)))
    words = flat.filter(full).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[ends]


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every distinct word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i+1]]`` for every i; empty segments give 0."""
    totals = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return totals[bounds[1:]] - totals[bounds[:-1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int = 5,
                    held_out: int = 0) -> DataFrame:
    """At most ``rows`` labelled training texts: (doc_id, text, label), label 0 or 1.

    Rows of the held-out remainder never enter. Ids are chosen by the order of
    a hash, so the sample repeats; conflicting labels of an id are averaged and
    rounded, and of repeated ids the smallest text is used. Only the chosen ids
    (bounded by ``rows``) are broadcast.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .where(id_remainder(F.col("doc_id"), modulus) != held_out)
           .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
