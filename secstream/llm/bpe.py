"""Byte-level BPE by a segment tree over byte positions.

A text is cut by the vocabulary's pattern; every match is encoded on its own.
The leaves of a segment tree hold the rank of the pair that starts at a live
byte position (infinite if the pair is no token); the root gives the smallest
rank at the leftmost place. A merge changes three leaves: the merged position,
its live left neighbour and the swallowed position; each is a point update
along one path to the root. Short matches of one block are merged in lockstep,
one tree per row of a matrix; long matches walk a tree of their own, so a match
of n bytes costs O(n log n).

Defined cases: null or empty text has no ids; bytes round-trip for every text.
Repeated rows are encoded alike. The vocabulary file is read once by the driver
and broadcast (its size is checked against ``MAX_VOCABULARY_BYTES``).
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MAX_VOCABULARY_BYTES = 64 << 20
CACHE_PIECES = 150_000
#: Text volume encoded together: its matches are held as Python strings, some 15 times its bytes.
ENCODE_BYTES = 1 << 20
LOCKSTEP_BYTES = 64
BLOCK_ROWS = 8_192
NONE = np.int64(1) << 62


class Vocabulary:
    """Token bytes by rank, and the rank of every pair of tokens that is itself a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.shift = max(1, len(self.bytes).bit_length() + 1)
        self.absent = (1 << self.shift) - 1
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.keys = np.append(self.keys, NONE)
        self.values = np.append(self.values, NONE)
        self.single = np.array([ranks.get(bytes([b]), self.absent) for b in range(256)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << self.shift | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 token, space, rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def encode_long(piece: bytes, voc: Vocabulary) -> list[int]:
    """Merge one match on its own tree."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    token = [int(voc.single[b]) for b in piece]
    after = list(range(1, n)) + [-1]
    before = list(range(-1, n - 1))
    none, shift, pairs = int(NONE), voc.shift, voc.pairs
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << shift | token[j]) if j >= 0 else None
        return none if rank is None else rank * width + i

    for i in range(n):
        tree[width + i] = leaf(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        token[i], after[i] = rank, k
        if k >= 0:
            before[k] = i
        update(j, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    out, i = [], 0
    while i >= 0:
        out.append(token[i])
        i = after[i]
    return out


def encode_rows(pieces: list[bytes], width: int, voc: Vocabulary) -> list[bytes]:
    """Merge many short matches in lockstep, one tree of ``width`` leaves per row."""
    n, depth = len(pieces), width.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    live = place[None, :] < lengths[:, None]
    token = np.full((n, width + 1), voc.absent, np.int64)
    token[:, :width] = np.where(live, voc.single[raw], voc.absent)
    after = np.broadcast_to(np.append(place + 1, width), (n, width + 1)).copy()
    after[np.arange(n), lengths - 1] = width
    before = np.broadcast_to(np.append(place - 1, width), (n, width + 1)).copy()
    before[:, 0] = width
    tree = np.full((n, 2 * width), NONE, np.int64)
    ranks = voc.pair_ranks(token[:, :width], token[:, 1:])
    ranks[~live] = NONE
    ranks[np.arange(n), lengths - 1] = NONE
    tree[:, width:] = np.where(ranks < NONE, ranks * width + place, NONE)
    for level in range(depth - 1, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo:2 * hi:2], tree[:, 2 * lo + 1:2 * hi:2])
    flat_tree, flat_token = tree.reshape(-1), token.reshape(-1)
    flat_after, flat_before = after.reshape(-1), before.reshape(-1)
    rows = np.flatnonzero(tree[:, 1] < NONE)

    def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        # the place after the last one maps to node 0, which no path reads
        node = np.where(at < width, at + width, 0)
        base = row * (2 * width)
        flat_tree[base + node] = value
        for _ in range(depth):
            node >>= 1
            two = base + 2 * node
            flat_tree[base + node] = np.minimum(flat_tree[two], flat_tree[two + 1])

    def rank_at(cell: np.ndarray, at: np.ndarray, next_cell: np.ndarray) -> np.ndarray:
        found = voc.pair_ranks(flat_token[cell], flat_token[next_cell])
        return np.where(found < NONE, found * width + at, NONE)

    while len(rows):
        rank, i = np.divmod(flat_tree[rows * (2 * width) + 1], width)
        base = rows * (width + 1)
        j = flat_after[base + i]
        k = flat_after[base + j]
        h = flat_before[base + i]
        flat_token[base + i] = rank
        flat_after[base + i] = k
        flat_before[base + k] = i
        flat_token[base + width] = voc.absent
        update(rows, j, np.full(len(rows), NONE))
        update(rows, i, rank_at(base + i, i, base + k))
        update(rows, h, np.where(h < width, rank_at(base + h, h, base + i), NONE))
        rows = rows[flat_tree[rows * (2 * width) + 1] < NONE]

    # live positions in order: follow the links of all rows together
    out = np.zeros((n, width), np.uint32)
    count = np.zeros(n, np.int64)
    rows, at = np.arange(n), np.zeros(n, np.int64)
    while len(rows):
        out[rows, count[rows]] = token[rows, at]
        count[rows] += 1
        at = after[rows, at]
        going = at < width
        rows, at = rows[going], at[going]
    packed = out.astype("<u4")
    return [packed[r, :c].tobytes() for r, c in enumerate(count.tolist())]


class Encoder:
    """Encodes texts to packed ids (little-endian unsigned 32-bit); one per Python worker."""

    def __init__(self, voc: Vocabulary, pattern: str, cache_pieces: int = CACHE_PIECES):
        self.voc, self.limit = voc, cache_pieces
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode matches not met before, shortest trees first."""
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            data = piece.encode()
            rank = self.voc.ranks.get(data)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(data) > LOCKSTEP_BYTES:
                self.cache[piece] = np.array(encode_long(data, self.voc), "<u4").tobytes()
            else:
                by_width.setdefault(1 << max(1, (len(data) - 1).bit_length()), []).append(piece)
        for width, group in by_width.items():
            for start in range(0, len(group), BLOCK_ROWS):
                part = group[start:start + BLOCK_ROWS]
                self.cache.update(zip(part, encode_rows([p.encode() for p in part], width, self.voc), strict=True))

    def encode_block(self, texts: list[str]) -> Iterator[bytes]:
        found = [self.find(t) for t in texts]
        if len(self.cache) > self.limit:
            self.cache.clear()
        new: set[str] = set()
        for pieces in found:
            new.update(pieces)
        new.difference_update(self.cache)
        self.learn(new)
        get = self.cache.__getitem__
        for pieces in found:
            yield b"".join(map(get, pieces))


def decode_ids(packed: bytes, voc: Vocabulary) -> bytes:
    return b"".join(map(voc.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[str, tuple[Vocabulary, Encoder]] = {}


def _loaded(content: bytes, pattern: str) -> tuple[Vocabulary, Encoder]:
    """The worker's vocabulary and encoder, kept while the Python worker lives."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        voc = Vocabulary(parse_ranks(content))
        _LOADED[key] = (voc, Encoder(voc, pattern))
    return _LOADED[key]


def _content(df: DataFrame, path: str):
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file above {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True,
           keep: tuple[str, ...] | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Keeps the columns ``keep`` (all by default) and appends ``n_tokens`` long,
    ``ids_sha256``, ``decoded_sha256`` and, if ``ids``, ``ids`` array<int> and
    ``decoded`` binary. Raises on a clash with those names.
    """
    keep = tuple(df.columns) if keep is None else keep
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    if clash := set(keep) & set(added):
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    content = _content(df, path)
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                        *(["ids array<int>, decoded binary"] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this Python worker left
        voc, encoder = _loaded(content.value, pattern)
        for part in text_slices(batches, "__text", ENCODE_BYTES):
            counts, id_hashes, byte_hashes, packed_ids, decoded = [], [], [], [], []
            texts = [t or "" for t in part.column("__text").to_pylist()]
            for packed in encoder.encode_block(texts):
                back = decode_ids(packed, voc)
                counts.append(len(packed) // 4)
                id_hashes.append(hashlib.sha256(packed).hexdigest())
                byte_hashes.append(hashlib.sha256(back).hexdigest())
                if ids:
                    packed_ids.append(packed)
                    decoded.append(back)
            arrays = [part.column(i) for i in range(part.num_columns - 1)]
            arrays += [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                       pa.array(byte_hashes, pa.string())]
            if ids:
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                flat = np.frombuffer(b"".join(packed_ids), "<u4").astype(np.int32)
                arrays += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], *added])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Bytes of an id column; a null id list gives null, an id outside the vocabulary raises."""
    content = _content(df, path)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(parse_ranks(content.value)).bytes
        for part in batches:
            back = [None if v is None else b"".join(table[i] for i in v) for v in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())],
                                             names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


