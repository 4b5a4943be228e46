"""Line dedup, cross-tokenizer alignment and centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward, documents, named_like_internals, words
from pyspark.sql import functions as F

from secstream.llm import line_bloom, pca_kmeans, queries, token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOW = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


# ---- line dedup -------------------------------------------------------------------------------------------------


def dropped_by_hand(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(SPACE).translate(LOW), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(SPACE).translate(LOW)
            own = holders[key]
            first = min((d for d in own if d is not None), default=None)
            if len(key) < least or len(own) < 2 or doc == first:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def line_corpus(spark, seed, n=120):
    rng = random.Random(seed)
    common = [f"A shared licence line number {i}" for i in range(30)] + ["short", "  ", "", "exactly 10", "ünïcödé lïnés çöunt"]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 9))]
        lines = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in lines]
        rows.append((rng.choice([i, i, None, 7]), "\n".join(lines)))
    return rows, documents(spark, [(i, t, None, None) for i, t in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rows, docs = line_corpus(spark, seed)
    got = line_bloom.drop_repeated_lines(docs.repartition(5), keep=("doc_id",))
    assert as_rows(got) == sorted(dropped_by_hand(rows), key=repr)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.collect())


def test_lines_of_awkward_tables(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_rows(line_bloom.drop_repeated_lines(docs, keep=("doc_id",))) == sorted(dropped_by_hand(rows), key=repr)
    assert line_bloom.drop_repeated_lines(documents(spark, [])).count() == 0
    wide = named_like_internals(docs).withColumn("digest", F.lit("d")).withColumn("ids", F.lit(1)).withColumn(
        "m", F.create_map(F.lit("a"), F.lit(1)))
    out = line_bloom.drop_repeated_lines(wide)
    assert out.columns == [*wide.columns, "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    assert {r.digest for r in out.collect()} == {"d"}
    with pytest.raises(ValueError):
        line_bloom.drop_repeated_lines(docs.withColumn("n_lines", F.lit(1)))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter far too small suspects every line; the result is the same."""
    rows, docs = line_corpus(spark, 3)
    monkeypatch.setattr(line_bloom, "MIN_FILTER_BITS", 64)
    assert as_rows(line_bloom.drop_repeated_lines(docs, keep=("doc_id",), most_bits=64)) == sorted(dropped_by_hand(rows), key=repr)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    docs = documents(spark, [(i, "\n".join([f"only in document {i} line {j}" for j in range(40)] + [f"shared by two {i // 2}"]), None, None)
                             for i in range(200)])
    pairs = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).repartition(7)
    bits = line_bloom.filter_bits(200 * 41)
    packed = line_bloom.twice_seen(pairs, bits)

    def hits(lines):
        return line_bloom.in_filter(line_bloom.line_hashes(pa.array(lines)), packed, bits)
    assert hits([f"shared by two {i}" for i in range(100)]).all()
    assert hits([f"only in document {i} line {j}" for i in range(200) for j in range(40)]).mean() < 0.02


def test_shared_digests_are_told_apart_by_content(spark, monkeypatch):
    docs = documents(spark, [(1, "a repeated line here\nkept line of one", None, None), (2, "A repeated line here\nother line of two", None, None)])
    pairs = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    suspects = spark.createDataFrame([(b"same", "a repeated line here", [1, 2], False), (b"same", "kept line of one", [1], False)],
                                     "digest binary, key string, ids array<bigint>, with_null boolean")
    monkeypatch.setattr(line_bloom, "suspected_repeats", lambda *_: suspects)
    lost, by_digest = line_bloom.lines_to_drop(pairs)
    assert not by_digest
    assert [(r["__id"], [bytes(x) for x in r["__lost"]]) for r in lost.collect()] == [(2, [b"a repeated line here"])]


# ---- alignment --------------------------------------------------------------------------------------------------


def aligned_by_hand(rows):
    """Whole report of (doc_id, text) rows, straight from the contract."""
    tok = token_align.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    docs = []
    for doc, text in rows:
        a, b = ([], []) if not text else tok.a.encode(" " + text, add_special_tokens=False).ids, [] if not text else tok.b.encode(text)
        if not text:
            a = []
        whole = b" " + (text or "").encode()
        ta, tb = [tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            docs.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        links = [(a[int(np.searchsorted(ends_a, c))], b[int(np.searchsorted(ends_b, c))]) for c in cuts]
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ends_a) if start < e <= c) + "|"
                          + ",".join(str(x) for x, e in zip(b, ends_b) if start < e <= c))
            start = c
        docs.append((doc, a, b, links, ";".join(groups)))
    count, most = {}, {}
    for d in docs:
        for link in d[3]:
            count[link] = count.get(link, 0) + 1
    for (x, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((doc, len(a), len(b), len(links), len(links), sum(count[x] == most[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, a, b, links, g in docs), key=repr)


def alignment_rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


ODD = ["a  b   c\n\n\td", "naïve café — 東京 \U0001F600", "<0x0A> ▁ odd", "<|endoftext|> and <s> </s>", "x" * 300, "a\x00b", "  lead", "tail  ",
       "I'm you're 12,345.67 http://a.b/c?d=e", " nbsp", "ﬁ ligature Å"]


def test_alignment_against_brute_force(spark):
    docs = awkward(spark).where("doc_id is null or doc_id not in (6, 7)").unionByName(documents(
        spark, [(20 + i, t, None, None) for i, t in enumerate([*ODD, "the cat sat on the mat", "the cat ate", words("w", 200)])]))
    want = aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[1] for r in want) and any(not r[1] for r in want)
    assert alignment_rows(token_align.alignment_report(docs, A, B, keep=("doc_id",))) == want
    # the way taken beyond the broadcast bound
    assert alignment_rows(token_align.alignment_report(docs, A, B, keep=("doc_id",), most_pairs=0)) == want


def test_alignment_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    assert alignment_rows(token_align.alignment_report(docs, A, B, keep=("doc_id",))) == aligned_by_hand(
        [(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_columns_and_empty_table(spark):
    wide = named_like_internals(documents(spark, [(1, words("w", 3_000), "en", "a")])).withColumn("code", F.lit(1)).withColumn("n", F.lit(2))
    out = token_align.alignment_report(wide, A, B, with_groups=True)
    row = out.first()
    assert (row.code, row.n, row.size) == (1, 2, "x") and row.n_groups == row.groups.count(";") + 1
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest()
    assert token_align.alignment_report(documents(spark, []), A, B).count() == 0
    with pytest.raises(ValueError):
        token_align.alignment_report(wide.withColumn("n_a", F.lit(1)), A, B)


def test_both_libraries_split_every_character_alike():
    """The rank library stands in for the file's own one: same classes for every plane's characters."""
    tok = token_align.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    assert tok.ranked is not None
    points = [*range(0xD800), *range(0xE000, 0xE100), *range(0xF900, 0x20100)]
    for start in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)} {chr(c)}!" for c in points[start:start + 20_000]]
        own = [e.ids for e in tok.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        assert own == tok.encode_a(texts)


def test_windows_are_remembered_by_id_tuples():
    aligner = token_align.Aligner(token_align.Tokenizers(open(A, "rb").read(), open(B, "rb").read()))
    first = aligner.align(["the cat sat on the mat"])[0]
    known = len(aligner.texts)
    assert known < first[0] and aligner.align(["the mat sat on the cat"])[0][0] == first[0]
    assert len(aligner.texts) == known  # every window of the second text was met before
    codes = np.array([5, 9, 5, 1 << 40], np.int64)
    own, n = token_align.unpack_pairs(token_align.pack_pairs(codes))
    assert own.tolist() == [5, 9, 1 << 40] and n.tolist() == [2, 1, 1]


# ---- clustering -------------------------------------------------------------------------------------------------


def clusters_by_hand(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for j, vs in own.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in placed:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for i, j, d in placed), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def cluster_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.4, (40, 64)) for m in (-1, 0, 1)]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [0.0] * 63),
             (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, []), (907, rows[0][1]), (908, rows[0][1])]
    got = cluster_rows(pca_kmeans.cluster_report(vectors(spark, rows).repartition(6)))
    assert got == clusters_by_hand(rows, 64, 8, 10) and len(got) == 124


def test_ties_few_vectors_and_empty_tables(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert cluster_rows(pca_kmeans.cluster_report(vectors(spark, same))) == clusters_by_hand(same, 64, 8, 10)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert cluster_rows(pca_kmeans.cluster_report(vectors(spark, few))) == clusters_by_hand(few, 64, 8, 10)
    assert pca_kmeans.cluster_report(vectors(spark, [])).count() == 0
    assert pca_kmeans.cluster_report(vectors(spark, [(1, None)])).count() == 0
    wide = vectors(spark, few).withColumn("cluster", F.lit("c")).withColumn("id", F.lit(1)).withColumn("rest", F.lit(2))
    assert cluster_rows(pca_kmeans.cluster_report(wide)) == clusters_by_hand(few, 64, 8, 10)
    with pytest.raises(Exception, match="64 bits"):
        pca_kmeans.cluster_report(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_hold_and_spare_exact_distances():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * np.concatenate([rng.normal(m, 0.2, (200, 64)) for m in (-2, 0, 2, 4)])).astype(np.int64)
    f = x.astype(np.float64)
    rotation = pca_kmeans.Rotation(len(x), f.sum(axis=0), f.T @ f, 8)
    centroids = x[::100]
    lead, rest = rotation.split(f)
    parts = rotation.split(centroids.astype(np.float64))
    measured = []
    cluster, distance = pca_kmeans.nearest(x, lead, rest, centroids, parts, measured)
    every = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert sum(measured) < 0.6 * every.size


def test_queries_are_registered():
    assert {"op11_anchor_align", "op12_line_bloom", "op13_pca_kmeans"} <= set(queries.QUERIES)
    assert {"op12_line_bloom", "op13_pca_kmeans"} <= set(queries.ORACLES)
