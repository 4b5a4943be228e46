import hashlib
import random

import pytest
from helpers import awkward, documents, named_like_internals, words
from pyspark.sql import functions as F

from secstream.llm import chunk_dedup, components, shingle_join

LOW = {c: c + 32 for c in range(65, 91)}


def key(row):
    return -(2 ** 63) if row.doc_id is None else row.doc_id


def test_exact_groups_against_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOW), []).append(r)
    want = []
    for text, own in groups.items():
        top = max(own, key=key).doc_id
        kept = [False] * len(own)
        kept[max(range(len(own)), key=lambda i: key(own[i]))] = True
        want += [(r.doc_id, top, len(own), k, hashlib.sha256(text.encode()).hexdigest()) for r, k in zip(own, kept, strict=True)]
    got = [tuple(r) for r in chunk_dedup.duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact_stage_keeps_columns_and_one_row(spark):
    docs = named_like_internals(awkward(spark))
    out = chunk_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.text.lower() if r.text else "" for r in out.collect()) == sorted(
        {(r.text or "").lower() for r in docs.collect()})
    assert {r.doc_id for r in out.collect() if r.text and r.text.lower() == "alpha beta gamma delta epsilon zeta. eta!"} == {2}
    assert chunk_dedup.drop_duplicates(documents(spark, [])).count() == 0


def test_chunks_join_to_the_text_and_survive_edits():
    rng = random.Random(1)
    data = bytes(rng.randrange(32, 127) for _ in range(60_000))
    chunks = chunk_dedup._chunks(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= chunk_dedup.LARGEST
    edited = chunk_dedup._chunks(data[:100] + b"!" + data[100:])
    assert len(set(chunks) & set(edited)) >= len(chunks) - 3


def test_failed_addresses_fall_back_to_whole_texts(spark, monkeypatch):
    """With an address function that collides, texts are still told apart."""
    docs = documents(spark, [(1, "one text", "en", "a"), (2, "another", "en", "a"), (3, "ONE text", "en", "a")])
    recipes = chunk_dedup.with_recipes(docs, "text", ("doc_id",)).withColumn("__recipe", F.unhex(F.lit("00" * 16)))
    failed = spark.createDataFrame([(bytes(16),)], "address binary")
    monkeypatch.setattr(chunk_dedup, "unverified_addresses", lambda df, text: failed)
    rows = chunk_dedup.with_identity(docs, recipes).collect()
    by = {r.doc_id: bytes(r["__identity"]) for r in rows}
    assert by[1] == by[3] != by[2]


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r.text or "").translate(LOW).split(" ") if r.text and r.text.strip(" \t\n") else []
        w = [x for part in w for x in part.replace("\t", "\n").split("\n") if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        ids = low.setdefault(find(i), [])
        if r.doc_id is not None:
            ids.append(r.doc_id)
    return [(r.doc_id, len(sets[i]), min(low[find(i)], default=None)) for i, r in enumerate(rows)]


def near_rows():
    rng = random.Random(4)
    rows, n = [], 100
    for family in range(12):
        base = [f"f{family}x{i}" for i in range(rng.choice([6, 9, 30, 80, 200]))]
        for _ in range(rng.choice([2, 5, 12])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((n, " ".join(text), "en", "a"))
            n += 1
    common = words("passage", 60)
    rows += [(n + i, words(f"own{i}q", 70) + " " + common, "en", "b") for i in range(15)]
    return rows


def test_near_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 1_500)
    monkeypatch.setattr(shingle_join, "BUCKET_SHINGLES", 3_000)
    monkeypatch.setattr(shingle_join, "MEMBERS_PER_TASK", 3)
    docs = awkward(spark).unionByName(documents(spark, near_rows()))
    got = [tuple(r) for r in shingle_join.near_duplicate_groups(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(docs.collect())))


def test_dense_group_below_the_leader(spark, monkeypatch):
    """Copies that mostly link through each other, not through the first one, in several blocks."""
    monkeypatch.setattr(shingle_join, "UNIT_VERTICES", 6)
    rng = random.Random(8)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text), "en", "a"))
    docs = documents(spark, rows)
    got = {tuple(r) for r in shingle_join.near_duplicate_groups(docs).collect()}
    assert got == set(brute_components(docs.collect()))


def test_near_stage_keeps_one_of_each(spark):
    docs = named_like_internals(awkward(spark).unionByName(documents(spark, near_rows())))
    rows = docs.collect()
    want = brute_components(rows)
    out = shingle_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    alone = sum(n == 0 for _, n, _ in want)
    groups = {(c, None if c is not None else i) for i, (_, n, c) in enumerate(want) if n}
    assert out.count() == alone + len(groups)
    assert shingle_join.keep_one_of_each(documents(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (3, 1)], [(i, i + 1) for i in range(0, 40)]])
def test_components(spark, edges):
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    seen = {v for e in edges if e[0] != e[1] for v in e}
    assert set(got) == seen
    for a, b in edges:
        if a != b:
            assert got[a] == got[b] <= min(a, b)
