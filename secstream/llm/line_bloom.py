"""Line dedup with two Bloom filters: once-seen and twice-seen line hashes.

A text is split at line feeds. A line's key is the line without ASCII white
space at its ends, A-Z lower-cased. Keys of at least ``MIN_POINTS`` code points
that two or more documents hold lose their lines everywhere but in the
document with the smallest id.

1. Every task sends the distinct 64-bit hashes of its keys, packed, to the
   segment of the filter that they belong to, with those that two of its
   documents hold apart. A segment's hashes stream through one task: a hash
   whose bits are all set in the once-seen filter enters the twice-seen
   filter, the others enter the first. The twice-seen segments make the filter
   that the scan below uses; its size is bounded by ``MAX_FILTER_BITS``.
2. The scan tests every line. Only suspected repeats are shuffled, with their
   whole keys, one row per block of documents and key; grouping by key
   confirms them exactly and finds the first document. Contents are named by
   128-bit digests, which are verified: if two suspects share one (never
   seen), keys are compared by content from there on.
3. What a document loses is joined to it by id, and the kept lines are joined.

A filter has no false negatives, so the result is exact at every size. Beyond
some hundreds of millions of lines the bounded filter fills up: more lines are
then shuffled than needed, at most all of them (the cost of a plain grouping).
A frequent line is one hash a task and one row a block, never a row per document.

Defined cases: a null or empty text is one empty line; documents are told apart
by id, so rows that repeat an id count once and keep the same lines; a null id
is one document, larger than all others. An empty table gives an empty result.
Other columns pass through; names that this module adds raise on a clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, text_slices

SPACE = " \t\n\x0b\x0c\r"
MIN_POINTS = 10
BITS_PER_LINE = 16
MIN_FILTER_BITS = 1 << 16
#: 64 MiB, the size of what is broadcast at most.
MAX_FILTER_BITS = 1 << 29
#: A segment is built by one task, 16 KiB of filter.
SEGMENT_BITS = 1 << 17
BLOCK_LINES = 1_000_000


def digest(key: bytes) -> bytes:
    """128-bit name of a key."""
    return xxhash.xxh3_128_digest(key)


def key_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, the key number of every line (-1: too short), and the bounds of each text's lines."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=SPACE))
    long_ = pc.greater_equal(pc.utf8_length(keys), MIN_POINTS)
    found = keys.filter(long_).dictionary_encode()
    numbers = np.full(len(keys), -1, np.int64)
    numbers[long_.to_numpy(zero_copy_only=False).astype(bool)] = found.indices.to_numpy(zero_copy_only=False)
    return found.dictionary, numbers, np.concatenate(([0], np.cumsum(counts)))


def line_hashes(keys: pa.Array) -> np.ndarray:
    hash_ = xxhash.xxh3_64_intdigest
    return np.fromiter((hash_(k) for k in keys.cast(pa.binary()).to_pylist()), np.uint64, len(keys))


def held_by_documents(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, as two arrays ordered by key and text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = numbers >= 0
    pair = np.unique(numbers[own] * len(bounds) + owner[own])
    return pair % len(bounds), pair // len(bounds)


def filter_bits(lines: int, most: int = MAX_FILTER_BITS) -> int:
    """A power of two of at least ``BITS_PER_LINE`` a line, within the bounds."""
    return min(most, max(MIN_FILTER_BITS, 1 << (max(1, lines * BITS_PER_LINE) - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of every hash and its two bits in the segment."""
    width = min(bits, SEGMENT_BITS)
    low = np.uint64(width - 1)
    first, second = hashes & low, (hashes >> np.uint64(20)) & low
    return ((hashes >> np.uint64(40)) & np.uint64(bits // width - 1)).astype(np.int64), first.astype(np.int64), second.astype(np.int64)


def _packed_hashes(docs: DataFrame, bits: int) -> DataFrame:
    """(segment, once, twice): a block's distinct hashes; ``twice`` has those that two of its documents hold."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            # an id once per key, whatever the slice; a second id makes the key a repeat
            hashes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            first = np.append(True, hashes[1:] != hashes[:-1])
            start = np.flatnonzero(first)
            last = np.append(start[1:], len(hashes)) - 1
            distinct, repeated = hashes[start], ids[start] != ids[last]
            segment = places(distinct, bits)[0]
            order = np.argsort(segment, kind="stable")
            distinct, repeated, segment = distinct[order], repeated[order], segment[order]
            names, cuts = np.unique(segment, return_index=True)
            cuts = np.append(cuts, len(segment))
            rows = [(int(s), distinct[a:b][~repeated[a:b]].tobytes(), distinct[a:b][repeated[a:b]].tobytes())
                    for s, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                                               pa.array(columns[2], pa.binary())], names=["segment", "once", "twice"])

        for part in text_slices(batches, "__text"):
            keys, numbers, bounds = key_lists(part.column("__text"))
            if not len(keys):
                continue
            text, key = held_by_documents(numbers, bounds)
            ids = part.column("__id").to_numpy(zero_copy_only=False)
            held.append((line_hashes(keys)[key], ids[text]))
            total += len(key)
            if total >= BLOCK_LINES:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    # a number per id, equal for equal ids: which documents agree is all that counts here
    return docs.select(F.xxhash64("__id").alias("__id"), "__text").mapInArrow(pack, "segment bigint, once binary, twice binary")


def twice_seen(docs: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter as packed bits: of every key that two documents hold, all bits are set."""
    width = min(bits, SEGMENT_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                                              names=["segment", "bits"])

        for batch in batches:
            for segment, seen, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != at:
                    if at is not None:
                        yield full()
                    at, once, twice = segment, np.zeros(width, bool), np.zeros(width, bool)
                _, a, b = places(np.frombuffer(seen, np.uint64), bits)
                again = once[a] & once[b]
                twice[a[again]] = twice[b[again]] = True
                once[a] = once[b] = True
                _, a, b = places(np.frombuffer(repeated, np.uint64), bits)
                twice[a] = twice[b] = once[a] = once[b] = True
        if at is not None:
            yield full()

    segments = (_packed_hashes(docs, bits).repartition("segment").sortWithinPartitions("segment")
                .mapInArrow(build, "segment bigint, bits binary").toArrow())
    out = np.zeros(bits // 8, np.uint8)
    for segment, packed in zip(segments.column("segment").to_pylist(), segments.column("bits").to_pylist(), strict=True):
        out[segment * width // 8:(segment + 1) * width // 8] = np.frombuffer(packed, np.uint8)
    return out


def in_filter(hashes: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    segment, a, b = places(hashes, bits)
    start = segment * min(bits, SEGMENT_BITS)
    hit = np.ones(len(hashes), bool)
    for at in (start + a, start + b):
        hit &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def suspected_repeats(docs: DataFrame, packed: np.ndarray, bits: int) -> DataFrame:
    """(digest, key, ids, with_null): suspected keys and the distinct ids that hold them, a row per block and key."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    id_type = docs.schema["__id"].dataType.simpleString()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            keys, numbers, bounds = key_lists(part.column("__text"))
            hit = in_filter(line_hashes(keys), sent.value, bits)
            if not hit.any():
                continue
            text, key = held_by_documents(numbers, bounds)
            text, key = text[hit[key]], key[hit[key]]
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            ids = part.column("__id").take(pa.array(text)).to_pylist()
            groups = [set(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            names = keys.take(pa.array(key[cuts[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(k) for k in names.cast(pa.binary()).to_pylist()], pa.binary()), names,
                 pa.array([[i for i in g if i is not None] for g in groups], pa.list_(part.schema.field("__id").type)),
                 pa.array([None in g for g in groups])], names=["digest", "key", "ids", "with_null"])

    return docs.mapInArrow(test, f"digest binary, key string, ids array<{id_type}>, with_null boolean")


def lines_to_drop(docs: DataFrame, most_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, bool]:
    """(__id, __lost): names of the keys that each document loses, and whether names are digests (else keys).

    ``docs``: (__id, __text).
    """
    shared_folder(docs.sparkSession)
    lines = docs.agg(F.sum(F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = filter_bits(lines, most_bits)
    suspects = suspected_repeats(docs, twice_seen(docs, bits), bits).checkpoint()
    keys = (suspects.groupBy("digest", "key")
            .agg(F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last"),
                 F.max("with_null").alias("null_too")).checkpoint())
    clear = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    name = "digest" if clear else "key"
    repeats = keys.where("first < last or (null_too and first is not null)").select(name, "first")
    losing = F.concat(F.transform(F.filter("ids", lambda i: i != F.col("first")), lambda i: F.struct(i.alias("__id"))),
                      F.when(F.col("with_null"), F.array(F.struct(F.lit(None).cast(docs.schema["__id"].dataType).alias("__id"))))
                      .otherwise(F.array().cast(f"array<struct<__id:{docs.schema['__id'].dataType.simpleString()}>>")))
    lost = (suspects.select(name, "ids", "with_null").join(repeats, name)
            .select(F.explode(losing).alias("doc"), F.col(name).cast("binary").alias("__name"))
            .groupBy("doc.__id").agg(F.collect_set("__name").alias("__lost")))
    return lost, clear


def drop_repeated_lines(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None,
                        with_text: bool = True, most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The columns ``keep`` (all by default) with ``n_lines``, ``n_dropped``, ``kept_sha256`` and, if ``with_text``, ``kept_text``."""
    keep = tuple(df.columns) if keep is None else keep
    added = ["n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if with_text else [])]
    if clash := set(keep) & {*added, "__id", "__text", "__lost"}:
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    lost, by_digest = lines_to_drop(df.select(F.col(key).alias("__id"), F.col(text).alias("__text")), most_bits)
    rows = (df.select(*keep, F.col(key).alias("__own"), F.col(text).alias("__text"))
            .join(lost, F.col("__own").eqNullSafe(F.col("__id")), "left").select(*keep, "__lost", "__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]),
                        "n_lines bigint, n_dropped bigint, kept_sha256 string", *(["kept_text string"] if with_text else [])])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            counts, dropped, hashes, kept = [], [], [], []
            for whole, lost in zip(part.column("__text").to_pylist(), part.column("__lost").to_pylist(), strict=True):
                whole = whole or ""
                counts.append(whole.count("\n") + 1)
                if lost:
                    names, lines = set(lost), whole.split("\n")
                    own = key_lists(pa.array([whole]))
                    keys = own[0].cast(pa.binary()).to_pylist()
                    gone = np.array([(digest(k) if by_digest else k) in names for k in keys] + [False])
                    stay = ~gone[own[1]]
                    whole = "\n".join(line for line, here in zip(lines, stay.tolist(), strict=True) if here)
                    dropped.append(int((~stay).sum()))
                else:
                    dropped.append(0)
                hashes.append(hashlib.sha256(whole.encode()).hexdigest())
                kept.append(whole)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-2], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(hashes, pa.string()),
                 *([pa.array(kept, pa.string())] if with_text else [])], names=[*part.schema.names[:-2], *added])

    return rows.mapInArrow(rebuild, schema)
