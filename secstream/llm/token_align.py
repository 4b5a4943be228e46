"""Alignment of two tokenizations of the same text, by white-space anchors.

A text is fully encoded by a byte-level BPE (A) and by a piece model with byte
fallback (B). Where both sides have a token that begins with a space at the same
byte offset, both have an end there: such anchors cut the two id lists into
windows, mostly one word each. A window is aligned once, by walking the token
ends of both sides, and remembered by its two id tuples; windows of a block are
then looked up. Wherever an A token and a B token end together a group ends, and
the two tokens are a link.

Links are counted corpus-wide by id pair: every task adds up its pairs before
they are shuffled, so a frequent pair is one row a task. The encoded rows are
checkpointed (texts are tokenized once), with each text's pairs as sorted, packed
numbers. The pair table is broadcast only if it has ``MAX_PAIRS`` rows at most;
beyond that the texts' distinct pairs are joined to it by a shuffle.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ
from a space and the text, have no tokens: zeros, and an empty digest. Repeated
rows each count. An empty table gives an empty result. Other columns pass
through; names that this module adds raise on a clash. Vocabulary files are
read once by the driver and broadcast (``MAX_VOCABULARY_BYTES`` each at most).
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, text_slices

MAX_VOCABULARY_BYTES = 64 << 20
#: Text volume encoded together; tokens of a block are held as Python objects.
ENCODE_BYTES = 1 << 20
REMEMBERED_WINDOWS = 200_000
REMEMBERED_LINKS = 4_000_000
PENDING_PAIRS = 4_000_000
#: Rows of the pair table up to which it is broadcast, 16 bytes each.
MAX_PAIRS = 4_000_000


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(a_json: dict, a_bytes: list[bytes]) -> dict[bytes, int] | None:
    """Token bytes and ids, if ids rank the merges and the split is the plain byte-level one; else None.

    Then the rank library, several times faster, gives the ids that the file's own library gives.
    """
    model = a_json["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(x + y) for x, y in merges]
    split = a_json.get("pre_tokenizer") or {}
    plain = (a_json.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not model.get("ignore_merges") and None not in ids)
    if not plain or ids != sorted(set(ids)) or len(merges) + 256 != len(model["vocab"]):
        return None
    return {a_bytes[i]: i for i in model["vocab"].values()}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; one per Python worker."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        symbols = byte_of_symbol()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        ranks = merge_ranks(json.loads(a_json), self.a_bytes)
        self.ranked = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken
            self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [(self.b.id_to_piece(i), self.b.IsByte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return self.encode_a(texts), self.b.encode(texts, num_threads=1)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - start
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def _joiner(tokens: list[bytes]):
    """A function from token numbers to their joined bytes and each token's end."""
    table = np.frombuffer(b"".join(tokens), np.uint8)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.cumsum(size) - size

    def joined(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = size[ids]
        ends = np.cumsum(own)
        return table[np.repeat(start[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)], ends

    return joined


class Aligner:
    """Aligns blocks of texts; remembers windows by their id tuples."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self.base = len(tokenizers.b_bytes)
        self.a_len = np.fromiter(map(len, tokenizers.a_bytes), np.int64, len(tokenizers.a_bytes))
        self.b_len = np.fromiter(map(len, tokenizers.b_bytes), np.int64, len(tokenizers.b_bytes))
        # an id as text with what follows it: A inside a group and at its end, B inside, at its end, and at the window's end
        self.symbols = np.array([f"{i}{after}" for size, marks in ((len(self.a_len), ",|"), (self.base, (",", ";", "")))
                                 for after in marks for i in range(size)], object)
        # with a token for every byte, rank merges cover any text
        self.lossless_a = tokenizers.ranked is not None and {bytes([i]) for i in range(256)} <= set(tokenizers.a_bytes)
        self.a_joined, self.b_joined = _joiner(tokenizers.a_bytes), _joiner(tokenizers.b_bytes)
        self.a_space = np.array([t[:1] == b" " for t in tokenizers.a_bytes])
        self.b_space = np.array([t[:1] == b" " for t in tokenizers.b_bytes])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[tuple[int, ...], int] = {}
        self.texts: list[str] = []
        self.starts, self.counts, self.codes = array("q"), array("q"), array("q")

    def learn(self, windows: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> None:
        """Align windows not met before, given as token ranges (from a, to a, from b, to b) in the order of the block.

        The ends of both sides are walked together for all of them: an A end that is also a B end closes a group.
        """
        own_a, own_b = (_ranges(windows[:, k], windows[:, k + 1]) for k in (0, 2))
        a, b, end_a, end_b = a[own_a], b[own_b], end_a[own_a], end_b[own_b]
        partner = np.searchsorted(end_b, end_a)
        closes_a = end_b[partner] == end_a
        closes_b = np.zeros(len(b), bool)
        closes_b[partner[closes_a]] = True
        size_a, size_b = windows[:, 1] - windows[:, 0], windows[:, 3] - windows[:, 2]
        counts = np.diff(np.append(0, np.cumsum(closes_a)[np.cumsum(size_a) - 1]))
        ends = np.zeros(len(b), bool)
        ends[np.cumsum(size_b) - 1] = True
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        kind = np.concatenate((closes_a * len(self.a_len), 2 * len(self.a_len) + (closes_b.astype(np.int64) + ends) * self.base))
        parts = self.symbols[(np.concatenate((a, b)) + kind)[order]].tolist()
        bounds = np.append(0, np.cumsum(size_a + size_b)).tolist()
        self.texts += ["".join(parts[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        self.starts.frombytes((len(self.codes) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.counts.frombytes(counts.astype(np.int64).tobytes())
        self.codes.frombytes((a[closes_a].astype(np.int64) * self.base + b[partner[closes_a]]).tobytes())

    def covered(self, texts: list[str], ids: list[list[int]], tokens: np.ndarray, joined_of, of: list[bytes]) -> list[bool]:
        """Whether one side's joined bytes are a space and the text."""
        wanted = [b" " + t.encode() for t in texts]
        joined, ends = joined_of(tokens)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
        if np.array_equal(np.append(0, ends)[np.cumsum(counts)], np.cumsum(sizes)) and np.array_equal(
                joined, np.frombuffer(b"".join(wanted), np.uint8)):
            return [True] * len(texts)
        return [b"".join(map(of.__getitem__, own)) == want for want, own in zip(wanted, ids, strict=True)]

    def align(self, texts: list[str]) -> list[tuple[int, int, np.ndarray, str] | None]:
        """Per text (tokens of A, tokens of B, link codes, groups as text); None without tokens."""
        if len(self.texts) > REMEMBERED_WINDOWS or len(self.codes) > REMEMBERED_LINKS:
            self.forget()
        full = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = self.tok.encode([texts[i] for i in full])
        a, b = _flat(ids_a), _flat(ids_b)
        good = self.covered([texts[i] for i in full], ids_b, b, self.b_joined, self.tok.b_bytes)
        if not self.lossless_a:
            good_a = self.covered([texts[i] for i in full], ids_a, a, self.a_joined, self.tok.a_bytes)
            good = [x and y for x, y in zip(good, good_a, strict=True)]
        if not all(good):
            full = [i for i, g in zip(full, good, strict=True) if g]
            ids_a, ids_b = ([x for x, g in zip(ids, good, strict=True) if g] for ids in (ids_a, ids_b))
            a, b = _flat(ids_a), _flat(ids_b)
        out: list = [None] * len(texts)
        if not full:
            return out
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        total = np.cumsum(np.fromiter((len(texts[i].encode()) + 1 for i in full), np.int64, len(full)))
        heads = np.concatenate(([0], total[:-1]))
        anchors = np.union1d(np.intersect1d(start_a[self.a_space[a]], start_b[self.b_space[b]], assume_unique=True), heads)
        cut_a = np.append(np.searchsorted(start_a, anchors), len(a))
        cut_b = np.append(np.searchsorted(start_b, anchors), len(b))
        # the ids of a window, A before B (B's above all of A's), lie together: a slice is the key of both tuples
        both = np.empty(len(a) + len(b), np.int64)
        both[np.arange(len(a)) + np.repeat(cut_b[:-1], np.diff(cut_a))] = a
        both[np.arange(len(b)) + np.repeat(cut_a[1:], np.diff(cut_b))] = b + len(self.a_len)
        ids, cuts = tuple(both.tolist()), (cut_a + cut_b).tolist()
        memo, get = self.memo, self.memo.get
        windows = [get(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        new: list[int] = []
        for w in [w for w, at in enumerate(windows) if at is None]:
            key = ids[cuts[w]:cuts[w + 1]]
            at = get(key)
            if at is None:
                at = memo[key] = len(memo)
                new.append(w)
            windows[w] = at
        if new:
            w = np.array(new)
            self.learn(np.stack((cut_a[w], cut_a[w + 1], cut_b[w], cut_b[w + 1]), axis=1), a, b, end_a, end_b)
        number = np.array(windows, np.int64)
        counts = np.frombuffer(self.counts, np.int64)[number]
        starts = np.frombuffer(self.starts, np.int64)[number]
        ends = np.cumsum(counts)
        codes = np.frombuffer(self.codes, np.int64)[_ranges(starts, starts + counts)]
        bounds = np.append(np.searchsorted(anchors, heads), len(anchors))
        link_bounds = np.append(0, ends)[bounds]
        for k, i in enumerate(full):
            lo, hi = bounds[k], bounds[k + 1]
            out[i] = (len(ids_a[k]), len(ids_b[k]), codes[link_bounds[k]:link_bounds[k + 1]],
                      ";".join(map(self.texts.__getitem__, windows[lo:hi])))
        return out


def pack_pairs(codes: np.ndarray) -> bytes:
    """Distinct codes and how often each occurs, as compressed steps."""
    distinct, n = np.unique(codes, return_counts=True)
    steps = np.concatenate((np.diff(distinct, prepend=0), n)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(distinct).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    raw = pa.Codec("zstd").decompress(blob[4:], 16 * size, asbytes=True) if size else b""
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel() if size else np.zeros(0, "<u8")
    return np.cumsum(values[:size]).astype(np.int64), values[size:].astype(np.int64)


_LOADED: dict[str, Aligner] = {}


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """The worker's aligner, kept while the Python worker lives."""
    key = hashlib.sha256(files[0]).hexdigest() + hashlib.sha256(files[1]).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(Tokenizers(*files))
    return _LOADED[key]


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is above {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


ADDED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def align_texts(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] | None = None,
                with_groups: bool = True) -> DataFrame:
    """The columns ``keep`` with counts, digest, ``__pairs`` (packed) and, if ``with_groups``, ``groups`` as text."""
    keep = tuple(df.columns) if keep is None else keep
    names = [*_NAMES, "__pairs", *(["groups"] if with_groups else [])]
    if clash := set(keep) & {*names, "n_best", "count_sum", "__text", "__row"}:
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    files = df.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), ADDED,
                        "__pairs binary", *(["groups string"] if with_groups else [])])
    nothing = (0, 0, np.zeros(0, np.int64), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files.value)
        gc.disable()  # millions of tuples live here and none in a cycle
        for part in text_slices(batches, "__text", ENCODE_BYTES):
            rows = [r or nothing for r in aligner.align([t or "" for t in part.column("__text").to_pylist()])]
            links = pa.array([len(r[2]) for r in rows], pa.int64())
            groups = [r[3] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 links, links, pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                 pa.array([pack_pairs(r[2]) for r in rows], pa.binary()),
                 *([pa.array(groups, pa.string())] if with_groups else [])], names=[*part.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def vocabulary_size(b_path: str) -> int:
    """Number of B ids: a pair's code is ``a * size + b``."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=_read(b_path)).get_piece_size()


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(code, n, best): links of every id pair in all texts, and whether no other A id has more with its B id."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, at = np.unique(codes, return_inverse=True)
            return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)

        def out(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(unpack_pairs(blob))
                pending += len(held[-1][0])
                if pending >= PENDING_PAIRS:
                    held = [merged()]
                    pending = len(held[0][0])
                    if pending > PENDING_PAIRS // 2:
                        yield out(*held[0])
                        held, pending = [], 0
        if held:
            yield out(*merged())

    counts = (aligned.select("__pairs").mapInArrow(add_up, "code bigint, n bigint")
              .groupBy("code").agg(F.sum("n").alias("n")).checkpoint())
    b = F.pmod("code", F.lit(size))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return (counts.withColumn("b", b).join(most, "b")
            .select("code", "n", (F.col("n") == F.col("most")).alias("best")).checkpoint())


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` from a broadcast pair table."""
    table = counts.orderBy("code").toArrow()
    sent = aligned.sparkSession.sparkContext.broadcast(
        (table.column("code").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy()))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields), "n_best bigint, count_sum bigint"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            n_best, count_sum = [], []
            for blob in batch.column("__pairs").to_pylist():
                own, times = unpack_pairs(blob)
                at = np.searchsorted(code, own)
                n_best.append(int(times[best[at]].sum()))
                count_sum.append(int((times * n[at]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                                             names=[*batch.schema.names, "n_best", "count_sum"])

    return aligned.mapInArrow(look_up, schema)


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` by a join of the texts' distinct pairs with the pair table. ``aligned`` has ``__row``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, blob in zip(batch.column("__row").to_pylist(), batch.column("__pairs").to_pylist(), strict=True):
                own, times = unpack_pairs(blob)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row, np.int64)), pa.array(own), pa.array(times)],
                                                     names=["__row", "code", "times"])

    sums = (aligned.select("__row", "__pairs").mapInArrow(spread, "__row bigint, code bigint, times bigint").join(counts, "code")
            .groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    return (aligned.join(sums, "__row", "left").withColumn("n_best", F.coalesce("n_best", F.lit(0).cast("bigint")))
            .withColumn("count_sum", F.coalesce("count_sum", F.lit(0).cast("bigint"))))


def alignment_report(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] | None = None,
                     with_groups: bool = False, most_pairs: int = MAX_PAIRS) -> DataFrame:
    """The columns ``keep`` with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum (and ``groups``)."""
    shared_folder(df.sparkSession)
    aligned = (align_texts(df, a_path, b_path, text, keep, with_groups)
               .withColumn("__row", F.monotonically_increasing_id()).checkpoint())
    counts = pair_counts(aligned, vocabulary_size(b_path))
    rows = _looked_up(aligned, counts) if counts.count() <= most_pairs else _joined(aligned, counts)
    return rows.select(*(c for c in aligned.columns if c not in ("__pairs", "__row")), "n_best", "count_sum")
