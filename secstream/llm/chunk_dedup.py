"""Exact duplicates by content-defined chunk recipes.

A normalised text (A-Z lower-cased) is cut where a rolling hash of its last
``WINDOW`` bytes meets a mask, with smallest and largest chunk sizes, so equal
passages give equal chunks wherever they stand. Each chunk gets a 128-bit
address. Chunk contents move once (copies inside a block of rows are sent
once) and each address is verified: all contents met under it must be equal.
A text is then the ordered list of its chunk identifiers, its recipe, and only
these short lists are grouped and compared. A text that holds an address with
two contents (never seen in practice) is grouped by its whole text instead, so
the result is exact in every case.

Defined cases: a null text equals the empty text; null ids are smaller than all
others; of rows that agree in id and text one stays. Groups of any size are
pre-aggregated before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, PlainNames, one_row, shared_folder, text_slices

WINDOW = 32
MASK = np.uint32((1 << 10) - 1)
SMALLEST = 256
LARGEST = 8_192
BASE = 0x9E3779B1
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every ``WINDOW`` bytes, by doubling the window (modulo 2**32)."""
    h = data.astype(np.uint32) + np.uint32(1)
    span, power = 1, BASE
    while span < WINDOW:
        h = h[:-span] * np.uint32(power) + h[span:]
        power = power * power & 0xFFFFFFFF
        span *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """End offsets of the chunks; none for an empty text."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = window_hashes(np.frombuffer(data, np.uint8))
    h ^= h >> np.uint32(15)
    marks = np.flatnonzero((h & MASK) == 0) + WINDOW
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > LARGEST:
            start += LARGEST
            ends.append(start)
        if mark - start >= SMALLEST:
            ends.append(mark)
            start = mark
    while n - start > LARGEST:
        start += LARGEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in chunk_ends(data):
        out.append(data[start:end])
        start = end
    return out


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER_BYTES)


def with_recipes(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``__recipe`` (ordered 128-bit chunk addresses) and ``__sha256`` (hex) to the columns ``keep``."""
    keep = tuple(df.columns) if keep is None else keep
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "__recipe binary, __sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            recipes, hashes = [], []
            for text_ in part.column("__text").to_pylist():
                data = normalised(text_)
                recipes.append(b"".join(map(xxhash.xxh3_128_digest, _chunks(data))))
                hashes.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(recipes, pa.binary()), pa.array(hashes, pa.string())],
                names=[*part.schema.names[:-1], "__recipe", "__sha256"])

    return source.mapInArrow(run, schema)


def chunk_contents(df: DataFrame, text: str = "text") -> DataFrame:
    """(address, content) of the chunks of all texts, each address once per block of rows and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            seen: set[tuple[bytes, bytes]] = set()
            for text_ in part.column("__text").to_pylist():
                seen.update((xxhash.xxh3_128_digest(c), c) for c in _chunks(normalised(text_)))
            if seen:
                addresses, contents = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(addresses, pa.binary()), pa.array(contents, pa.binary())],
                                                 names=["address", "content"])

    return df.select(F.col(text).alias("__text")).mapInArrow(run, "address binary, content binary")


def unverified_addresses(df: DataFrame, text: str = "text") -> DataFrame:
    """Addresses under which different contents were met."""
    return (chunk_contents(df, text).groupBy("address")
            .agg(F.min("content").alias("low"), F.max("content").alias("high"))
            .where(F.col("low") != F.col("high")).select("address"))


def _addresses(recipe: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(recipe) / 16 - 1, F.lit(0)).cast("int")),
                       lambda i: F.substring(recipe, i * 16 + 1, F.lit(16)))


def with_identity(df: DataFrame, recipes: DataFrame, text: str = "text") -> DataFrame:
    """Rename the recipe to ``__identity`` after verification.

    ``recipes`` is ``with_recipes(df)``. Only if an address failed its
    verification do the texts that hold it fall back to their whole text; the
    failing addresses are found by a join, not sent to the driver.
    """
    failed = unverified_addresses(df, text)
    shared_folder(df.sparkSession)
    failed = failed.checkpoint()
    if failed.isEmpty():
        return recipes.withColumnRenamed("__recipe", "__identity")
    hit = (recipes.select("__recipe").distinct()
           .select("__recipe", F.explode(_addresses(F.col("__recipe"))).alias("address"))
           .join(failed, "address", "left_semi").select("__recipe").distinct().withColumn("__hit", F.lit(True)))
    return (recipes.join(hit, "__recipe", "left")
            .withColumn("__identity", F.when(F.col("__hit"), F.concat(F.col("__recipe"), F.unhex("__sha256")))
                        .otherwise(F.col("__recipe"))).drop("__recipe", "__hit"))


def duplicate_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    shared_folder(df.sparkSession)
    rows = (with_recipes(df, text, ("doc_id",))
            .withColumn("__row", F.monotonically_increasing_id()).checkpoint())
    rows = with_identity(df, rows, text)
    groups = rows.groupBy("__identity").agg(F.max(F.struct("doc_id", "__row")).alias("__top"),
                                            F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "__identity").select(
        "doc_id", F.col("__top.doc_id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__top.__row")).alias("kept"), F.col("__sha256").alias("text_sha256"))


def drop_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of equal texts the one with the largest ``doc_id``.

    Of rows that also agree in ``doc_id`` the largest by all columns stays.
    Copies are reduced inside each task before anything is shuffled. Other columns may have any
    name and a type with plain field names (``common.one_row`` orders those without an order).
    """
    names = PlainNames(df, {"doc_id": "doc_id", text: "text"})
    df = names.rows
    rows = with_identity(df, with_recipes(df, "text"), "text")
    kept = rows.groupBy("__identity").agg(one_row(df, df.columns, "doc_id", "max").alias("__kept"))
    return names.back(kept.select(*(F.col("__kept").getField(c).alias(c) for c in df.columns)))
