"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken: "Winnowing", 2003).

Every ``GRAM`` code points of a text get a rolling polynomial hash; of every
``SPAN`` successive hashes the smallest is chosen, the rightmost of equal ones,
and chosen hashes are kept with their positions. Two texts that share a passage
of ``GRAM + SPAN - 1`` code points share a fingerprint hash; passages under
``GRAM`` code points are never reported. A text with fewer hashes than ``SPAN``
keeps the smallest of all; one shorter than ``GRAM`` keeps one hash of its
whole; the empty text has none.

The fingerprint string is the base64 text of the 32-bit hashes (little-endian),
a dot, and the base64 text of the position gaps, one byte each (a gap is at
most ``SPAN``, which must stay under 128). The likeness of two
fingerprints is the Jaccard similarity of their sets of hashes; two empty texts
have likeness 1.

The next document is found without one big sort: rows are cut into id ranges
whose bounds come from the ids alone, each range is sorted and streamed, and
the first row of a range is also sent to the end of the range before it.

Defined cases: a null text is empty; rows with null ids come last; rows with
equal ids are ordered by text; with one row the next document is itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_slices

GRAM = 12
SPAN = 24
BASE = 0x100000001B3
ROWS_PER_RANGE = 4_000
MOST_RANGES = 20_000
_MASK = (1 << 64) - 1
Print = tuple[np.ndarray, np.ndarray]


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of every ``gram`` code points: polynomial sums, built by joining shorter spans."""
    total, length, shorter, power = None, 0, points.astype(np.uint64) + np.uint64(1), BASE
    span = 1
    n = len(points) - gram + 1
    while span <= gram:
        if gram & span:
            if total is None:
                total, length = shorter, span
            else:  # the shorter span, then what is joined so far
                total = shorter[:len(total) - span] * np.uint64(pow(BASE, length, 1 << 64)) + total[span:]
                length += span
        if 2 * span <= gram:
            shorter = shorter[:-span] * np.uint64(power) + shorter[span:]
            power = power * power & _MASK
        span *= 2
    return mix64(total[:n]) >> np.uint64(32)


def fingerprint(text: str, gram: int = GRAM, span: int = SPAN) -> Print:
    """Chosen hashes (uint32) and their positions in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(points) < gram:
        return gram_hashes(points, len(points)).astype(np.uint32), np.zeros(1, np.int64)
    hashes = gram_hashes(points, gram)
    n = len(hashes)
    # smaller key: smaller hash, then larger position
    keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width, low = min(span, n), keys
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:n - width + 1], low[width - have:])
    chosen = low[np.flatnonzero(np.append(True, low[1:] != low[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def as_string(prints: Print) -> str:
    hashes, places = prints
    gaps = np.diff(places, prepend=0).astype(np.uint8)  # successive choices lie at most SPAN apart
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode() + "." + base64.b64encode(gaps.tobytes()).decode()


def from_string(value: str) -> Print:
    """Hashes and positions of a fingerprint string."""
    hashes, gaps = map(base64.b64decode, value.split("."))
    return np.frombuffer(hashes, "<u4"), np.cumsum(np.frombuffer(gaps, np.uint8), dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, given as sorted distinct arrays."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the fingerprint string of every whole text (null: as empty); other columns stay."""
    if out in df.columns:
        raise ValueError(f"column {out} is taken")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            prints = [as_string(fingerprint(t or "")) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.string())],
                                             names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def _range_of(bounds: list[int]):
    """Number of the id range, counted from the largest ids down; null ids lie in a range of their own."""
    low_to_high = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        found = np.full(len(ids), len(low_to_high) + 1)
        found[known] = len(low_to_high) - np.searchsorted(low_to_high, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(found)

    return number


def _with_ranges(df: DataFrame, rows_per_range: int) -> DataFrame:
    """Append ``__range`` and ``__tail``: rows with __tail 1 repeat the first rows of the following range."""
    ids = df.select("doc_id")
    parts = min(MOST_RANGES, max(1, -(-ids.count() // rows_per_range)))
    bounds = []
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * parts)).alias("c")).first()["c"] or []))
    number = _range_of(bounds)
    heads = {r["__range"]: r["head"] for r in
             ids.withColumn("__range", number("doc_id")).groupBy("__range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # the id at the head of each range, and the range that it also closes
    before = spark_map({heads[r]: order[i - 1] for i, r in enumerate(order) if heads[r] is not None})
    closes = before[F.col("doc_id")] if before is not None else F.lit(None).cast("int")
    if order and heads[order[-1]] is None:
        closes = F.when(F.col("doc_id").isNull(), F.lit(order[len(order) - 2])).otherwise(closes)
    return (df.withColumn("__range", number("doc_id"))
            .withColumn("__place", F.explode(F.filter(F.array(
                F.struct(F.col("__range").alias("r"), F.lit(0).alias("t")),
                F.struct(closes.alias("r"), F.lit(1).alias("t"))), lambda x: x["r"].isNotNull())))
            .withColumn("__range", F.col("__place.r")).withColumn("__tail", F.col("__place.t")).drop("__place"))


def spark_map(values: dict[int, int]):
    """A literal map; None if it is empty. One entry per id range."""
    if not values:
        return None
    return F.map_from_arrays(F.lit(list(values)).cast("array<bigint>"), F.lit(list(values.values())).cast("array<int>"))


_REPORT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edit_report(df: DataFrame, text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next for every row.
    """
    ranged = _with_ranges(df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")), rows_per_range)
    order = ["__range", "__tail", F.col("doc_id").desc_nulls_last(), "text"]
    rows = ranged.repartition("__range").sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, fingerprint and its hashes, waiting for the next text
        for part in text_slices(batches, "text"):
            out: list[tuple] = []
            for doc_id, text_, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__tail")), strict=True):
                if tail and held is None:
                    continue
                prints = fingerprint(text_)
                hashes = np.unique(prints[0])
                if held is not None:
                    changed = edited(held[1], text_)
                    other = fingerprint(changed)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), as_string(held[2]),
                                as_string(other), likeness(held[3], np.unique(other[0])), likeness(held[3], hashes)))
                held = None if tail else (doc_id, text_, prints, hashes)
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], _SCHEMA)

    return rows.mapInArrow(walk, _REPORT)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                     ("near_edited", pa.float64()), ("near_next", pa.float64())])
