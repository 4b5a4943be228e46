"""Every stage of the pipeline against a plain computation on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward
from pyspark.sql import functions as F
from test_dedup import LOW, brute_components, key

from secstream.llm import knn_quality, queries
from secstream.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = table(spark, SF, "documents")
    extra = docs.orderBy("doc_id").limit(40)
    near = extra.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.lit(" x")).alias("text"), "lang", "source", "n_chars")
    copies = extra.withColumn("doc_id", F.col("doc_id") + 2_000_000).withColumn("text", F.upper("text"))
    odd = awkward(spark).withColumn("doc_id", F.col("doc_id") + 9_000_000)  # ids of their own; null and repeated ones stay
    docs.unionByName(near).unionByName(copies).unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    out = [table(spark, folder, "documents")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return folder, out


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_quality_keeps_what_its_neighbours_vote_for(spark, stages):
    folder, out = stages
    model = knn_quality.fit_quality(out[0], table(spark, folder, "labels"))
    kept = []
    rows = out[0].collect()
    import pyarrow as pa
    vectors = model.project(knn_quality.term_counts(pa.array([r.text for r in rows], pa.string())))
    for r, v in zip(rows, vectors, strict=True):
        cosine = model.vectors @ v
        top = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[:knn_quality.NEIGHBOURS]
        weights = [max(float(cosine[i]), 0.0) for i in top]
        total = sum(weights)
        score = sum(w * model.labels[i] for w, i in zip(weights, top)) / total if total > 0 else model.labels.mean()
        kept += [repr(tuple(r))] if score >= knn_quality.THRESHOLD else []
    assert sorted(kept) == rows_of(out[1]) and 0 < len(kept) < len(rows)


def test_exact_copies_leave_the_largest_id(stages):
    _, out = stages
    best = {}
    for r in out[1].collect():
        text = (r.text or "").translate(LOW)
        if text not in best or key(r) > key(best[text]):
            best[text] = r
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in best.values()) == sorted(
        r.doc_id if r.doc_id is not None else -1 for r in out[2].collect())
    assert out[2].count() < out[1].count()


def test_one_of_each_near_group_stays(stages):
    _, out = stages
    rows = [r for r in out[2].collect() if r.doc_id is not None]
    component = {r[0]: r[2] for r in brute_components(rows)}
    got = sorted(r.doc_id for r in out[3].collect() if r.doc_id is not None)
    assert got == sorted(set(component.values())) and len(got) < len(rows)


def test_the_mix_takes_the_copies_of_the_plan(stages):
    folder, out = stages
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/2/*.parquet')")
    plan = con.execute(f"SELECT doc_id, size, taken FROM ({queries.MIX_SQL})").fetchall()
    want = Counter({i: taken // size for i, size, taken in plan if size})
    assert {i: n for i, n in want.items() if n} == dict(Counter(r.doc_id for r in out[4].collect()))


def test_tokens_are_those_of_the_rank_library(stages):
    _, out = stages
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    from tiktoken.load import load_tiktoken_bpe
    enc = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in out[4].collect()}
    for r in out[5].collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
