"""N-gram Jaccard join by grouped prefixes, and the groups of linked documents.

A document's set holds the 64-bit hashes of its distinct word 5-grams (with
fewer words: its whole sequence). Two documents link when
``100 * |x & y| >= 75 * |x | y|``, that is ``7 * |x & y| >= 3 * (|x| + |y|)``.
Documents with equal sets are one vertex, named by a 64-bit hash of the set; two
different sets or 5-grams share a hash with probability 2**-64 per pair.

1. All sets travel once, packed per block of documents and bucket of shingles,
   to learn which shingles several documents hold and how many. The common
   order of shingles puts rare ones first, so a document of its own words has
   no shared shingle in its prefix and leaves the join here. Shingles that are
   hot (a bounded table, found beforehand) keep to their block and never meet
   in one task; copies inside a block travel once.
2. Two linked sets share a shingle in their prefixes, the first
   ``n - ceil(0.75 n) + 1`` shingles in that order. Documents with identical
   prefix and size form one group.
3. Each group is paired with the smallest group of a shingle's list, the pairs
   are filtered by size and position, and the leader that most shingles
   support is kept; members are paired with the first of their group. Pairs
   are expanded to texts and verified exactly.
4. Lists whose documents already lie in one component of verified links are
   settled: further links inside a component cannot change it. The documents
   of the open lists are compared all with all, in bounded blocks, by products
   of membership matrices; a task returns ties between components only, so
   neither pairs nor links of a dense group are ever listed.

Defined cases: null or empty texts, and texts of white space, have the empty
set, size 0, no link, and stay alone; a null id never names a component unless
nothing else is in it; repeated rows fall into one component. Lists of pairs
with one hot document are split by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PlainNames, hash_words, mix64, one_row, shared_folder, split_words, text_slices
from .components import components

SHINGLE_WORDS = 5
HOT_ROWS = 1_000_000
HOT_COUNT = 64
BLOCK_SHINGLES = 2_000_000
BUCKET_SHINGLES = 1_500_000
MEMBERS_PER_TASK = 2_000
UNIT_VERTICES = 1_000
UNIT_SHINGLES = 1_000_000
MATRIX_SHINGLES = 4_096
BROADCAST_ROWS = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    from pyarrow import compute as pc
    words, codes, bounds = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(hashes)
    rolled = np.full(max(n - k + 1, 0), np.uint64(k))
    for i in range(k):
        rolled = rolled * MULTIPLIER + hashes[i:n - k + 1 + i] if n >= k else rolled
    rolled = mix64(rolled)
    out = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= k:
            out.append(np.unique(rolled[start:end - k + 1]))
        elif end > start:
            h = np.full(1, np.uint64(end - start))
            for i in range(start, end):
                h = h * MULTIPLIER + hashes[i:i + 1]
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def vertex_of(shingles: np.ndarray) -> int | None:
    """Signed 64-bit name of a set; None for the empty set."""
    if not len(shingles):
        return None
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n):
    """Of a set of ``n`` shingles, or of each of an array of sizes."""
    return n - (3 * n + 3) // 4 + 1


class HotShingles:
    """Frequent shingles and their levels (rounded log2 of the count), for fast lookups."""

    BITS = 22

    def __init__(self, shingles: np.ndarray, levels: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.levels = shingles[order], levels[order]
        self.marks = np.zeros(1 << self.BITS, bool)
        self.marks[(shingles >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def level(self, shingles: np.ndarray) -> np.ndarray:
        """Level of every shingle; 0 if it is not hot."""
        level = np.zeros(len(shingles), np.uint8)
        maybe = np.flatnonzero(self.marks[(shingles >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.shingles, shingles[maybe])
            at[at == len(self.shingles)] = 0
            known = self.shingles[at] == shingles[maybe]
            level[maybe[known]] = self.levels[at[known]]
        return level


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def with_vertices(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``__n`` (set size) and ``__vertex`` (null for the empty set) to the columns ``keep``."""
    keep = tuple(df.columns) if keep is None else keep
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "__n bigint, __vertex bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            sets = shingle_sets(part.column("__text"))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([vertex_of(s) for s in sets], pa.int64())],
                names=[*part.schema.names[:-1], "__n", "__vertex"])

    return source.mapInArrow(run, schema)


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hottest shingles: at most ``HOT_ROWS`` of those counted ``HOT_COUNT`` times, with their levels.

    Counts cover the shingles that more than two texts of a block share. Only
    the way a shingle travels and its place in the common order depend on this
    table, never the links; what reaches the driver is bounded by its rows.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 2
            return pa.RecordBatch.from_arrays([pa.array(shingles[often].view(np.int64)), pa.array(counts[often])],
                                              names=["shingle", "n"])

        for part in text_slices(batches, "text"):
            held += shingle_sets(part.column("text"))
            total += sum(map(len, held[-part.num_rows:]))
            if total >= BLOCK_SHINGLES:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    top = (texts.select("text").mapInArrow(repeated, "shingle bigint, n bigint")
           .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
           .select("shingle", F.floor(F.log2("n")).cast("tinyint").alias("level"))
           .orderBy(F.desc("level"), "shingle").limit(HOT_ROWS).toArrow())
    return (top.column("shingle").to_numpy().astype(np.int64).view(np.uint64),
            top.column("level").to_numpy().astype(np.uint8))


_PACKED = "bucket bigint, block bigint, tokens binary, levels binary, local binary, vertices binary, sizes binary"


def _packed_sets(texts: DataFrame, hot, buckets: int) -> DataFrame:
    """All sets of a block of texts, packed by bucket of shingles.

    A row holds the sorted shingles of one bucket and, for each, the number of
    its text in the block; copies inside the block count once. Hot shingles
    are packed apart (negative bucket): their level is known, so they need not
    meet in one task. They carry the table of the block's vertices and sizes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        vertices: dict[int, int] = {}
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            size = np.fromiter(map(len, held), np.uint32, len(held))
            shingles = np.concatenate(held)
            local = np.repeat(np.arange(len(held), dtype=np.uint32 if len(held) > 65535 else np.uint16), size)
            level = hot.value.level(shingles)
            known = level > 0
            rows = [[-1 - block], [block], [shingles[known].tobytes()], [level[known].tobytes()], [local[known].tobytes()],
                    [np.fromiter(vertices, np.int64, len(vertices)).tobytes()], [size.tobytes()]]
            shingles, local = shingles[~known], local[~known]
            bucket = (shingles >> np.uint64(32)) % np.uint64(buckets)
            token = shingles & np.uint64(0xFFFFFFFF)
            order = np.argsort(bucket << np.uint64(32) | token)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            for b in range(buckets):
                chosen = order[cuts[b]:cuts[b + 1]]
                if len(chosen):
                    steps = np.diff(token[chosen], prepend=np.uint64(0)).astype("<u4")
                    if steps.max() < 1 << 24:
                        packed = steps.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                    else:
                        packed = steps.tobytes()
                    for column, value in zip(rows, (b, block, packed, b"", local[chosen].tobytes(), b"", b""), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[2:])],
                names=["bucket", "block", "tokens", "levels", "local", "vertices", "sizes"])

        for part in text_slices(batches, "text"):
            for shingles in shingle_sets(part.column("text")):
                if len(shingles) and (vertex := vertex_of(shingles)) not in vertices:
                    vertices[vertex] = len(held)
                    held.append(shingles)
                    total += len(shingles)
            if total >= BLOCK_SHINGLES:
                yield flush()
                block, vertices, held, total = block + 1, {}, [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(pack, _PACKED)


def _shared_of_bucket(blobs: pd.DataFrame) -> pd.DataFrame:
    """Shingles of a bucket that several texts hold, with their levels, sent back by block."""
    if blobs["bucket"].iloc[0] < 0:
        return blobs
    tokens, local, block = [], [], []
    for row in blobs.itertuples(index=False):
        raw = np.frombuffer(row.tokens, np.uint8)
        for width, kind in ((2, np.uint16), (4, np.uint32)):
            for bytes_ in (3, 4):
                if len(raw) % bytes_ == 0 and len(raw) // bytes_ * width == len(row.local):
                    n, dtype = len(raw) // bytes_, kind
        steps = np.zeros((n, 4), np.uint8)
        steps[:, :len(raw) // n] = raw.reshape(n, -1)
        tokens.append(np.cumsum(steps.view("<u4").ravel(), dtype=np.uint64))
        local.append(np.frombuffer(row.local, dtype).astype(np.uint32))
        block.append(np.full(n, len(block), np.uint32))
    token, local, at = map(np.concatenate, (tokens, local, block))
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    lengths = np.diff(np.append(np.flatnonzero(first), len(token)))
    count = np.repeat(lengths, lengths)
    shared = count > 1
    order, token, count = order[shared], token[shared], count[shared]
    at, local = at[order], local[order]
    bucket = np.uint64(blobs["bucket"].iloc[0])
    back = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[back], np.arange(len(blobs) + 1))
    out = []
    for i, name in enumerate(blobs["block"].tolist()):
        chosen = back[cuts[i]:cuts[i + 1]]
        if len(chosen):
            out.append((int(bucket), name, (token[chosen] | bucket << np.uint64(32)).tobytes(),
                        np.log2(count[chosen]).astype(np.uint8).tobytes(),
                        local[chosen].astype(np.uint32).tobytes(), b"", b""))
    return pd.DataFrame(out, columns=blobs.columns)


def _prefixes_of_block(buckets: int):
    """Prefix postings and members of one block, in the order (level, shingle); unshared shingles come first."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        head = blobs[blobs["bucket"] < 0].iloc[0]
        vertex, size = np.frombuffer(head.vertices, np.int64), np.frombuffer(head.sizes, np.uint32).astype(np.int64)
        token, level, local = [], [], []
        for row in blobs.itertuples(index=False):
            t = np.frombuffer(row.tokens, np.uint64)
            if row.bucket < 0:
                t = (t >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | t & np.uint64(0xFFFFFFFF)
            token.append(t)
            level.append(np.frombuffer(row.levels, np.uint8))
            local.append(np.frombuffer(row.local, np.uint16 if len(row.local) == 2 * len(t) else np.uint32).astype(np.int64))
        token, level, local = map(np.concatenate, (token, level, local))
        order = np.lexsort((token, level, local))
        token, local = token[order], local[order]
        count = np.bincount(local, minlength=len(size))
        place = np.arange(len(local)) - np.repeat(np.cumsum(count) - count, count) + (size - count)[local]
        limit = prefix_length(size)
        kept = place < limit[local]
        token, local, place = token[kept], local[kept], place[kept]
        cuts = np.searchsorted(local, np.arange(len(size) + 1))
        names = vertex.copy()
        for i in np.flatnonzero((count == size) & (cuts[1:] > cuts[:-1])):
            prefix = token[cuts[i]:cuts[i + 1]]
            names[i] = np.uint64(xxhash.xxh3_64_intdigest(prefix.tobytes(), int(size[i]))).astype(np.int64)
        return pd.DataFrame({"token": token.view(np.int64), "group": names[local], "vertex": vertex[local],
                             "size": size[local].astype(np.int32), "place": place.astype(np.int32)})

    return run


def prefix_postings(texts: DataFrame, total: int) -> DataFrame:
    """(token, group, vertex, size, place): the shared shingles in the prefixes of all sets.

    A group holds documents with identical prefix and size. ``total`` is the
    number of shingles, which sets the number of buckets.
    """
    buckets = max(1, int(total // BUCKET_SHINGLES) + 1)
    hot = texts.sparkSession.sparkContext.broadcast(HotShingles(*frequent_shingles(texts)))
    shared = _packed_sets(texts, hot, buckets).groupBy("bucket").applyInPandas(_shared_of_bucket, _PACKED)
    return shared.groupBy("block").applyInPandas(
        _prefixes_of_block(buckets), "token bigint, group bigint, vertex bigint, size int, place int")


_PASSES = ("4 * least(size, {0}.size) >= 3 * greatest(size, {0}.size)"
           " and 7 * least(size - place, {0}.size - {0}.place) >= 3 * (size + {0}.size)")


def _star_pairs(postings: DataFrame, members: DataFrame) -> DataFrame:
    """Each group with the first group of the list that most of its shingles support, and members with their group's first.

    The first group of a list is its smallest by (size, group); minima are
    pre-aggregated, and the join with the lists can be split at hot shingles.
    """
    firsts = members.groupBy("group").agg(F.min("vertex").alias("first")).checkpoint()
    lists = postings.groupBy("token", "group", "size", "place").agg(F.lit(1).alias("one"))
    heads = (lists.groupBy("token").agg(F.min(F.struct("size", "group", "place")).alias("head"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("token", "head").checkpoint())
    best = (postings.join(heads, "token").where(F.col("group") != F.col("head.group")).where(_PASSES.format("head"))
            .groupBy("group", F.col("head.group").alias("leader")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("group").agg(F.max(F.struct("n", "leader")).alias("best"))
            .select("group", F.col("best.leader").alias("leader")))
    star = (best.join(firsts, "group").withColumnRenamed("first", "src")
            .join(firsts.select(F.col("group").alias("leader"), F.col("first").alias("dst")), "leader").select("src", "dst"))
    inner = (members.join(firsts, "group").where("vertex != first")
             .select(F.col("vertex").alias("src"), F.col("first").alias("dst")))
    return star.unionByName(inner).where("src != dst").distinct()


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table only if it is proven small; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(docs: DataFrame, vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets link. ``docs``: (__key, text); ``vertices``: (vertex, __key).

    Texts of the pairs' vertices meet in the order of ``dst``; a vertex with
    many partners is split over several tasks.
    """
    split = pairs.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("__parts"))
    wanted = (pairs.join(split, "dst")
              .select(F.col("dst").alias("__leader"), F.pmod(F.xxhash64("src"), F.col("__parts")).cast("int").alias("__part"),
                      F.lit(1).alias("__role"), F.col("src").alias("vertex"))
              .unionByName(split.select(F.col("dst").alias("__leader"),
                                        F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"),
                                        F.lit(0).alias("__role"), F.col("dst").alias("vertex"))))
    wanted = wanted.join(vertices, "vertex").checkpoint()
    rows = (docs.join(_small(wanted), "__key")
            .select("__leader", "__part", "__role", "vertex", "text")
            .repartition("__leader", "__part").sortWithinPartitions("__leader", "__part", "__role", "vertex"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for part in text_slices(batches, "text"):
            src, dst = [], []
            places = zip(part.column("__leader").to_pylist(), part.column("__part").to_pylist(), strict=True)
            for place, role, vertex, shingles in zip(places, part.column("__role").to_pylist(),
                                                     part.column("vertex").to_pylist(),
                                                     shingle_sets(part.column("text")), strict=True):
                if vertex_of(shingles) != vertex:
                    continue  # another row with the same id
                if role == 0:
                    at, leader = place, shingles
                elif at == place:
                    both = len(np.intersect1d(leader, shingles, assume_unique=True))
                    if 7 * both >= 3 * (len(leader) + len(shingles)):
                        src.append(vertex)
                        dst.append(place[0])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return rows.mapInArrow(check, "src bigint, dst bigint")


def _open_lists(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings, with components, of the shingles and groups that lie in several components."""
    rows = (postings.join(comps, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")))
    spread = (rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"))
              .where("a != b").select("token").checkpoint())
    return rows.join(_small(spread), "token", "left_semi")


def _linked_roots(sets: list[np.ndarray], component: np.ndarray) -> np.ndarray:
    """For each set the first set it is tied to by links, directly or through others; its own number if none.

    Overlaps are products of the membership matrix, built for shingles that
    several sets hold, a bounded number of them at a time.
    """
    k = len(sets)
    size = np.fromiter(map(len, sets), np.int64, k)
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), size)
    shared = np.bincount(at, minlength=len(shingles)) > 1
    number = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], number[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    overlap = np.zeros((k, k), np.float32)
    for start in range(0, int(shared.sum()), MATRIX_SHINGLES):
        lo, hi = np.searchsorted(at, (start, start + MATRIX_SHINGLES))
        held = np.zeros((k, MATRIX_SHINGLES), np.float32)
        held[owner[lo:hi], at[lo:hi] - start] = 1
        overlap += held @ held.T
    tied = 7 * overlap >= 3 * (size[:, None] + size)
    tied |= component[:, None] == component
    roots = np.arange(k)
    while True:
        low = np.where(tied, roots, k).min(axis=1)
        if (low == roots).all():
            return roots
        roots = low


def _links_across(docs: DataFrame, vertices: DataFrame, open_lists: DataFrame) -> DataFrame:
    """Ties (src, dst) between components of open lists: every pair of their vertices is compared.

    Vertices whose open lists touch form one cluster; a cluster is cut into
    blocks by hash and each pair of blocks is one unit of work, which holds a
    bounded number of vertices and shingles and returns a row per vertex at most.
    """
    heads = open_lists.groupBy("token").agg(F.min("vertex").alias("dst"))
    touching = components(open_lists.join(heads, "token").select(F.col("vertex").alias("src"), "dst"))
    placed = (open_lists.groupBy("vertex").agg(F.first("component").alias("component"), F.first("size").alias("size"))
              .join(touching.withColumnRenamed("component", "__cluster"), "vertex"))
    blocks = (placed.groupBy("__cluster")
              .agg(F.greatest(F.ceil(F.sum("size") / UNIT_SHINGLES), F.ceil(F.count(F.lit(1)) / UNIT_VERTICES))
                   .cast("int").alias("__blocks")))
    numbered = (placed.join(blocks, "__cluster")
                .withColumn("__own", F.pmod(F.xxhash64("vertex"), F.col("__blocks")).cast("int"))
                .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))))
    wanted = (numbered.join(vertices, "vertex")
              .select("__key", "vertex", "component", "__cluster", F.least("__own", "__other").alias("__low"),
                      F.greatest("__own", "__other").alias("__high")).checkpoint())
    unit = ("__cluster", "__low", "__high")
    rows = (docs.join(_small(wanted), "__key").select(*unit, "vertex", "component", "text")
            .repartition(*unit).sortWithinPartitions(*unit, "vertex"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def ties() -> pa.RecordBatch:
            names = list(held)
            roots = _linked_roots([held[v][0] for v in names], np.array([held[v][1] for v in names])) if names else []
            found = [(names[i], names[r]) for i, r in enumerate(roots) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()),
                                               pa.array([d for _, d in found], pa.int64())], names=["src", "dst"])

        for part in text_slices(batches, "text"):
            keys = zip(*(part.column(c).to_pylist() for c in unit), strict=True)
            for key, vertex, component, shingles in zip(keys, part.column("vertex").to_pylist(),
                                                        part.column("component").to_pylist(),
                                                        shingle_sets(part.column("text")), strict=True):
                if key != at:
                    yield ties()
                    at, held = key, {}
                if vertex_of(shingles) == vertex:
                    held[vertex] = (shingles, component)
        yield ties()

    return rows.mapInArrow(compare, "src bigint, dst bigint")


def linked_components(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex that links with another one.

    ``docs``: (__key, text); ``sized``: its (__key, __n, __vertex), checkpointed.
    """
    vertices = (sized.where(F.col("__vertex").isNotNull())
                .groupBy(F.col("__vertex").alias("vertex")).agg(F.min("__key").alias("__key")))
    total = sized.agg(F.sum("__n").alias("n")).first()["n"] or 0
    postings = prefix_postings(docs, total).distinct().checkpoint()
    members = postings.select("group", "vertex").distinct()
    links = verified(docs, vertices, _star_pairs(postings, members).checkpoint()).checkpoint()
    comps = components(links).checkpoint()
    still_open = _open_lists(postings, comps).checkpoint()
    if still_open.isEmpty():
        return comps
    more = _links_across(docs, vertices, still_open)
    return components(comps.select(F.col("vertex").alias("src"), F.col("component").alias("dst")).unionByName(more))


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col("doc_id"), F.xxhash64(F.col(text))).alias("__key"), F.col(text).alias("text"))


def near_duplicate_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``df``."""
    shared_folder(df.sparkSession)
    docs = _keyed(df, text)
    sized = with_vertices(df.select("doc_id", F.coalesce(F.col("doc_id"), F.xxhash64(F.col(text))).alias("__key"),
                                    F.col(text).alias("text")), "text", ("doc_id", "__key")).checkpoint()
    comps = linked_components(docs, sized)
    classes = (sized.where(F.col("__vertex").isNotNull()).groupBy("__vertex").agg(F.min("doc_id").alias("low"))
               .join(comps, F.col("__vertex") == F.col("vertex"), "left")
               .withColumn("component", F.coalesce("component", "__vertex")).select("__vertex", "low", "component"))
    names = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(names, "component").select("__vertex", "component_id")
    return (sized.join(named, "__vertex", "left")
            .select("doc_id", F.col("__n").alias("n_shingles"),
                    F.when(F.col("__vertex").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one_of_each(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the smallest row by id, then by all columns.

    Other columns may have any name and a type with plain field names (``common.one_row`` orders those without an order).
    """
    shared_folder(df.sparkSession)
    names = PlainNames(df, {"doc_id": "doc_id", text: "text"})
    df = names.rows
    docs = _keyed(df, "text")
    rows = with_vertices(df, "text")
    sized = with_vertices(docs, "text", ("__key",)).checkpoint()
    comps = linked_components(docs, sized)
    classes = (sized.where(F.col("__vertex").isNotNull()).groupBy("__vertex").agg(F.count(F.lit(1)).alias("__rows"))
               .join(comps, F.col("__vertex") == F.col("vertex"), "left"))
    crowded = (classes.where(F.col("component").isNotNull() | (F.col("__rows") > 1))
               .select("__vertex", F.coalesce("component", "__vertex").alias("__component"))).checkpoint()
    placed = rows.join(_small(crowded), "__vertex", "left")
    chosen = (placed.where(F.col("__component").isNotNull()).groupBy("__component")
              .agg(one_row(df, df.columns, "doc_id", "min").alias("__kept"))
              .select(*(F.col("__kept").getField(c).alias(c) for c in df.columns)))
    return names.back(placed.where(F.col("__component").isNull()).select(*df.columns).unionByName(chosen))
