"""Language-model scores by a weighted backoff automaton of trigrams.

Tokens of a text are its words (A-Z lower-cased) and one end. States are the
histories of the training tokens: the root, every training word ``v`` and every
training pair ``u v``. A state has an arc for each of its continuations in
training and one failure arc to the state of its history without the first
word: pair to word, word to root. The root has an arc for every token, weighted
by ``(c + 0.5) / (N + 0.5 * (V + 1))``. With the prior mass ``m`` of the state's
order (``PRIOR``) an arc from ``h`` by ``w`` weighs ``(c(h w) + m * p) / (c(h) +
m)``, ``p`` being the probability of ``w`` at the failure state, and the failure
arc ``m / (c(h) + m)``. So the probabilities of every state sum to 1, and a
history seen often hardly backs off. An arc leads to the longest state that
ends the words read. A text is scored in one traversal from the root that
carries the state and sums log10 weights.

The model is never gathered in one place. Each block of texts is reduced to its
distinct words, pairs and triples, in the order of their hashes, with the counts
from its training texts; a bucket is a range of hashes, and its task sums the
counts of all blocks and returns the totals to each block in its own order; the
task of a block then holds exactly the part of the automaton that its texts can
reach. An n-gram is sent once per block, so frequent ones are pre-aggregated.
Words are told apart by 64 bits of hash, pairs and triples by 56; the number of
buckets grows with the texts without a limit.

Defined cases: a null or empty text has one token, the end; a null id is
treated by the caller's split. Without training texts ``N`` and ``V`` are 0 and
every token has weight 1. Repeated rows are scored alike, each has its row. A
very long text is a block of its own. Nothing is ranked, so there are no ties.
An empty table gives no rows. Only ``doc_id`` and the text are read: other
columns may have any name and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix64, segment_sums, split_words, text_slices

#: Prior mass of the states of one word and of two (fixed parameters, chosen once by held-out score).
PRIOR = (400.0, 6.0)
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 10 << 20
END_HASH = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
WORD_BITS, NGRAM_BITS = 64, 56


class Block:
    """The texts of a block as word numbers, ends included, with the block's distinct n-grams.

    ``names`` are the sorted hashes of its pairs and triples; ``pair[i]`` and ``triple[i]`` say which
    of them end at token ``i``, if ``before[i]``, the number of tokens before it in its text (2 at most), allows one.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, hashes: np.ndarray):
        self.codes, self.bounds, self.hashes = codes, bounds, hashes

    def find_ngrams(self) -> None:
        codes = self.codes
        self.before = np.minimum(np.arange(len(codes)) - np.repeat(self.bounds[:-1], np.diff(self.bounds)), 2)
        has_pair, has_triple = self.before >= 1, self.before == 2
        tokens = self.hashes[codes]
        pairs = mix64(np.append(tokens[:1], tokens[:-1]) * MULTIPLIERS[0] + tokens)
        triples = mix64(np.append(pairs[:1], pairs[:-1]) * MULTIPLIERS[1] + tokens)
        found = np.concatenate((pairs[has_pair], triples[has_triple])) >> np.uint64(64 - NGRAM_BITS)
        del tokens, pairs, triples
        self.names, place = np.unique(found, return_inverse=True)
        cut = int(has_pair.sum())
        self.pair, self.triple = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
        self.pair[has_pair], self.triple[has_triple] = place[:cut], place[cut:]
        self.word_order = np.argsort(self.hashes)

    def training_counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words (in the order of their hashes) and of the n-grams in the training texts."""
        inside = np.repeat(train, np.diff(self.bounds))
        words = np.bincount(self.codes[inside], minlength=len(self.hashes))[self.word_order]
        names = np.concatenate((self.pair[inside & (self.before >= 1)], self.triple[inside & (self.before == 2)]))
        return words, np.bincount(names, minlength=len(self.names))

    def cuts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the buckets among the words in hash order and among the n-grams."""
        return (_range_cuts(self.hashes[self.word_order], WORD_BITS, buckets),
                _range_cuts(self.names, NGRAM_BITS, buckets))


def _range_cuts(ordered: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of hashes starts, and the end."""
    starts = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(ordered, starts), len(ordered))


def read_block(texts: pa.Array) -> Block:
    """Words are numbered by falling frequency in the block, so most numbers are short."""
    words, codes, bounds = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = bounds[1:] + np.arange(len(texts))
    with_ends = np.full(len(codes) + len(texts), len(words), np.int64)
    inside = np.ones(len(with_ends), bool)
    inside[ends] = False
    with_ends[inside] = codes
    order = np.argsort(-np.bincount(with_ends, minlength=len(words) + 1), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Block(rank[with_ends], np.concatenate(([0], ends + 1)), np.append(hash_words(words), END_HASH)[order])


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as half bytes; 15 stands for a larger one, which follows as a byte, 255 for one that follows as 8."""
    low = np.minimum(counts, 15).astype(np.uint8)
    if len(low) % 2:
        low = np.append(low, np.uint8(0))
    more = counts[counts >= 15]
    return ((low[::2] | low[1::2] << 4).tobytes() + np.minimum(more, 255).astype(np.uint8).tobytes()
            + more[more >= 255].astype("<i8").tobytes())


def _unpack_counts(packed: bytes, n: int) -> np.ndarray:
    half = np.frombuffer(packed, np.uint8, (n + 1) // 2)
    counts = np.empty(2 * len(half), np.int64)
    counts[::2], counts[1::2] = half & 15, half >> 4
    counts = counts[:n]
    larger = counts == 15
    at = (n + 1) // 2
    more = np.frombuffer(packed, np.uint8, int(larger.sum()), at).astype(np.int64)
    more[more == 255] = np.frombuffer(packed, "<i8", offset=at + len(more))
    counts[larger] = more
    return counts


def _pack_steps(ordered: np.ndarray) -> bytes:
    """Sorted numbers: the first in 8 bytes, then the low bytes of the steps and their high parts as counts."""
    if not len(ordered):
        return b""
    steps = np.diff(ordered)
    mean = int(ordered[-1] - ordered[0]) // max(len(steps), 1)
    low = min((mean.bit_length() + 4) // 8, 7)  # most high parts fit half a byte
    return (int(ordered[0]).to_bytes(8, "little") + bytes([low])
            + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()
            + _pack_counts((steps >> np.uint64(8 * low)).astype(np.int64)))


def _unpack_steps(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    low, end = packed[8], 9 + packed[8] * (n - 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(packed, np.uint8, 8)
    steps[1:, :low] = np.frombuffer(packed, np.uint8, low * (n - 1), 9).reshape(n - 1, low)
    steps = steps.view("<u8").ravel()
    steps[1:] += _unpack_counts(packed[end:], n - 1).astype(np.uint64) << np.uint64(8 * low)
    return np.cumsum(steps, dtype=np.uint64)


def _pack_codes(codes: np.ndarray) -> bytes:
    """Word numbers as 2 bytes; 65535 stands for a larger one, which follows as 4."""
    return np.minimum(codes, 65535).astype("<u2").tobytes() + codes[codes >= 65535].astype("<u4").tobytes()


def _unpack_codes(packed: bytes, n: int) -> np.ndarray:
    codes = np.frombuffer(packed, "<u2", n).astype(np.int64)
    codes[codes == 65535] = np.frombuffer(packed, "<u4", offset=2 * n)
    return codes


_REQUEST = ("bucket bigint, block bigint, n_words int, words binary, word_counts binary, n_names int, names binary, "
            "counts binary")
_RETURN = ("block bigint, bucket bigint, word_counts binary, counts binary, doc_id array<bigint>, train array<boolean>, "
           "bounds binary, codes binary, hashes binary")
_RETURN_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("word_counts", pa.binary()),
                            ("counts", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                            ("bounds", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary())])


def _named_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, pa.RecordBatch, np.ndarray]]:
    """Blocks with a name made from their content, so both passes over the texts agree on it."""
    for part in text_slices(batches, "text", BLOCK_BYTES):
        block = read_block(part.column("text"))
        train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
        name = xxhash.xxh3_64()
        for piece in (block.codes, block.bounds, block.hashes, train):
            name.update(piece.tobytes())
        name.update(repr(part.column("doc_id").to_pylist()).encode())
        yield int(np.uint64(name.intdigest()).astype(np.int64)), block, part, train


def _requests(docs: DataFrame, buckets: int) -> DataFrame:
    """The distinct n-grams of each block by bucket, with their counts in its training texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, _, train in _named_blocks(batches):
            block.find_ngrams()
            words, (word_counts, counts) = block.hashes[block.word_order], block.training_counts(train)
            word_cuts, cuts = block.cuts(buckets)
            full = np.flatnonzero(np.diff(word_cuts) + np.diff(cuts)).tolist()
            in_words = [slice(word_cuts[b], word_cuts[b + 1]) for b in full]
            in_names = [slice(cuts[b], cuts[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([name] * len(full), pa.int64()),
                 pa.array([s.stop - s.start for s in in_words], pa.int32()),
                 pa.array([_pack_steps(words[s]) for s in in_words], pa.binary()),
                 pa.array([_pack_counts(word_counts[s]) for s in in_words], pa.binary()),
                 pa.array([s.stop - s.start for s in in_names], pa.int32()),
                 pa.array([_pack_steps(block.names[s]) for s in in_names], pa.binary()),
                 pa.array([_pack_counts(counts[s]) for s in in_names], pa.binary())],
                names=["bucket", "block", "n_words", "words", "word_counts", "n_names", "names", "counts"])

    return docs.mapInArrow(pack, _REQUEST)


def _sequences(docs: DataFrame) -> DataFrame:
    """The texts of each block as word numbers, with the hashes of its words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, part, train in _named_blocks(batches):
            yield pa.RecordBatch.from_pylist([{
                "block": name, "bucket": -1, "doc_id": part.column("doc_id").to_pylist(), "train": train.tolist(),
                "bounds": block.bounds.tobytes(), "codes": _pack_codes(block.codes),
                "hashes": block.hashes.tobytes()}], _RETURN_SCHEMA)

    return docs.mapInArrow(pack, _RETURN)


def _totals(sizes: pd.Series, packed: pd.Series, packed_counts: pd.Series) -> list[bytes]:
    """Counts summed over all blocks, per block in its own order."""
    sizes = sizes.tolist()
    keys = np.concatenate([_unpack_steps(k, n) for k, n in zip(packed, sizes, strict=True)])
    counts = np.concatenate([_unpack_counts(c, n) for c, n in zip(packed_counts, sizes, strict=True)])
    _, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, weights=counts).astype(np.int64)[at]
    cuts = np.cumsum([0, *sizes])
    return [_pack_counts(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sum_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's n-grams, returned to each block."""
    out = pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"],
                        "word_counts": _totals(rows["n_words"], rows["words"], rows["word_counts"]),
                        "counts": _totals(rows["n_names"], rows["names"], rows["counts"])})
    for column in ("doc_id", "train", "bounds", "codes", "hashes"):
        out[column] = None
    return out


def training_totals(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the training texts, ends included."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", BLOCK_BYTES):
            words, codes, _ = split_words(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
            hashes = np.sort(np.append(hash_words(words), END_HASH))
            cuts = _range_cuts(hashes, WORD_BITS, buckets)
            full = np.flatnonzero(np.diff(cuts)).tolist()
            tokens = [len(codes) + part.num_rows] + [0] * (len(full) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([int(cuts[b + 1] - cuts[b]) for b in full], pa.int32()),
                 pa.array([_pack_steps(hashes[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())],
                names=["bucket", "tokens", "n_words", "words"])

    def distinct(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([_unpack_steps(h, n) for h, n in zip(rows["words"], rows["n_words"], strict=True)])
        return pd.DataFrame({"n": [int(rows["tokens"].sum())], "v": [len(np.unique(values))]})

    totals = (docs.where("train").select("text")
              .mapInArrow(pack, "bucket bigint, tokens bigint, n_words int, words binary")
              .groupBy("bucket").applyInPandas(distinct, "n bigint, v bigint")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first())
    return totals["n"] or 0, totals["v"] or 0


class Automaton:
    """The part of the automaton that one block reaches; counts are totals over all training texts."""

    def __init__(self, block: Block, word_totals: np.ndarray, totals: np.ndarray, n: int, v: int):
        self.block, self.totals = block, totals
        self.words = np.empty(len(word_totals), np.int64)
        self.words[block.word_order] = word_totals
        self.known = self.words > 0
        self.root = (self.words + 0.5) / (n + 0.5 * (v + 1))

    def states(self) -> np.ndarray:
        """The state carried to every token, by its order: 2 a pair, 1 a word, 0 the root.

        The arc that reads a token leads to its pair with the token before if that is a state, else to
        the token if that is one, else to the root; the next token starts from there, a text from the root.
        """
        block = self.block
        pair = (block.before >= 1) & (self.totals[block.pair] > 0) if len(self.totals) else np.zeros(len(block.codes), bool)
        reached = np.where(pair, 2, np.where(self.known[block.codes], 1, 0))
        carried = np.zeros(len(reached), np.int64)
        carried[1:] = reached[:-1]
        carried[block.bounds[:-1]] = 0
        return carried

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every text, and of its tokens at the root alone.

        Weights are taken up the failure chain: the root's arc, then for tokens whose carried state has
        one word or two the word state's arc (or failure arc and the root's), then the pair state's.
        """
        block, state = self.block, self.states()
        weight = self.root[block.codes]
        base = segment_sums(np.log10(weight), block.bounds)
        for order, ending in ((1, block.pair), (2, block.triple)):
            at = np.flatnonzero(state >= order)
            history = self.words[block.codes[at - 1]] if order == 1 else self.totals[block.pair[at - 1]]
            seen, mass = self.totals[ending[at]], PRIOR[order - 1]
            failure = mass / (history + mass)
            weight[at] = seen / (history + mass) + failure * weight[at]  # without an arc only the failure's part
        return segment_sums(np.log10(weight), block.bounds), base


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(df: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """Score every whole text; rows where ``held_out`` is false train the model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                     (~held_out).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    n, v = training_totals(docs, buckets)

    def score(blobs: pd.DataFrame) -> pd.DataFrame:
        heads, returned = blobs[blobs["bucket"] < 0], blobs[blobs["bucket"] >= 0]
        if heads.empty:
            raise ValueError("the two passes over the texts cut different blocks; read them from a stable table")
        head = heads.iloc[0]
        bounds = np.frombuffer(head["bounds"], np.int64)
        block = Block(_unpack_codes(head["codes"], int(bounds[-1])), bounds, np.frombuffer(head["hashes"], np.uint64))
        block.find_ngrams()
        word_cuts, cuts = block.cuts(buckets)
        word_totals, totals = np.full(len(block.hashes), -1), np.full(len(block.names), -1)
        for row in returned.itertuples(index=False):
            for into, at, packed in ((word_totals, word_cuts, row.word_counts), (totals, cuts, row.counts)):
                lo, hi = at[row.bucket], at[row.bucket + 1]
                into[lo:hi] = _unpack_counts(packed, hi - lo)
        if (word_totals < 0).any() or (totals < 0).any():
            raise ValueError("the two passes over the texts cut different blocks; read them from a stable table")
        automaton = Automaton(block, word_totals, totals, n, v)
        scores, base = automaton.traverse()
        known = segment_sums(automaton.known[block.codes], block.bounds).astype(np.int64)
        # blocks of equal rows share a name; each is one head
        return pd.concat([pd.DataFrame({
            "doc_id": pd.array(list(h.doc_id), "Int64"), "held_out": ~np.asarray(list(h.train), bool),
            "n_tokens": np.diff(block.bounds), "n_known": known, "train_tokens": n, "base_score": base, "score": scores})
            for h in heads.itertuples(index=False)])

    summed = _requests(docs, buckets).groupBy("bucket").applyInPandas(_sum_bucket, _RETURN)
    return summed.unionByName(_sequences(docs)).groupBy("block").applyInPandas(score, _SCORES)
