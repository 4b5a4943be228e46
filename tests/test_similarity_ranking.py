"""Exact top-k against brute force; distributed rank and running sums."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from secstream.operators.ranking import exact_rank, running_sums
from secstream.operators.similarity import top_k_similar


def test_topk_matches_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(120, 8)).astype(np.float32)
    vecs[5] = vecs[6]  # an exact tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<float>")
    got = top_k_similar(df, df, 4, "id", "id", "embedding", exclude_self=True, rows_per_block=25)
    got = sorted((r["id"], r["rank"], r["neighbor_id"]) for r in got.collect())
    v = vecs.astype(np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    want = []
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        want += [(i, r + 1, j) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_scores_in_unit_interval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    s = [r["score"] for r in top_k_similar(df, df, 2, "id", "id", "embedding", exclude_self=True).collect()]
    assert all(0.0 <= x <= 1.0 for x in s) and min(s) == 0.0


def test_exact_rank_and_running_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.permutation(500), "v": rng.integers(0, 10, 500)})
    df = spark.createDataFrame(pdf)
    r = exact_rank(df, ["g"], ["k"], "rank", num_partitions=7).toPandas()
    want = pdf.assign(rank=pdf.groupby("g")["k"].rank(method="first").astype(int))
    m = r.merge(want, on=["g", "k", "v"], suffixes=("", "_w"))
    assert len(m) == 500 and (m["rank"] == m["rank_w"]).all()
    c = running_sums(df, [F.col("k").desc()], ["v"], num_partitions=5).toPandas().sort_values("k", ascending=False)
    assert (c["v_cum"].to_numpy() == pdf.sort_values("k", ascending=False)["v"].cumsum().to_numpy()).all()


def test_topk_plan_has_no_pairwise_join(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, embedding array<double>")
    out = top_k_similar(df, df, 3, "id", "id", "embedding", exclude_self=True, rows_per_block=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInPandas" in plan


def test_exact_rank_plan_has_no_single_partition_window(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    plan = exact_rank(df, ["g"], ["id"], "r")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan.lower()


def test_topk_of_many_copies_holds_k_answers_a_query():
    from secstream.operators.similarity import best_columns
    scores = np.zeros((3, 10_000))
    scores[1, 7] = 1.0
    scores[2, :9_999] = -np.inf
    rows, cols = best_columns(scores, 3)
    assert sorted(zip(rows.tolist(), cols.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 7), (2, 9_999)]


def test_best_columns_match_a_sort():
    from secstream.operators.similarity import best_columns
    rng = np.random.default_rng(3)
    for n, k, steps in ((5, 9, 3), (100, 2, 50), (700, 3, 4), (700, 3, 10_000), (3_000, 20, 900)):
        scores = rng.integers(0, steps, (40, n)).astype(float)
        scores[rng.random(scores.shape) < 0.05] = -np.inf
        want = [(r, c) for r in range(40) for c in sorted(range(n), key=lambda c: (-scores[r, c], c))[:k]
                if np.isfinite(scores[r, c])]
        rows, cols = best_columns(scores, k)
        assert sorted(zip(rows.tolist(), cols.tolist())) == sorted(want)


def test_packed_vectors_are_short_and_whole():
    import pytest

    from secstream.operators.similarity import pack_vector, unpack_vectors
    sparse, dense = np.zeros(384, np.float32), np.arange(384, dtype=np.float32)
    sparse[[3, 380]] = 0.1, np.nan
    packed = [pack_vector(v) for v in (sparse, dense)]
    assert len(packed[0]) < 20 and len(packed[1]) == 1 + 4 * 384
    np.testing.assert_array_equal(unpack_vectors(packed, "float32"), np.vstack([sparse, dense]).astype(np.float64))
    with pytest.raises(ValueError, match="lengths"):
        unpack_vectors([packed[0], pack_vector(dense[:5])], "float32")


def test_query_blocks_follow_packed_bytes(spark, monkeypatch):
    from secstream.operators import similarity as S
    rng = np.random.default_rng(4)
    vecs = rng.integers(0, 2, (60, 6)).astype(np.float32)  # many exact ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<float>")

    def answers():
        return sorted(map(tuple, S.top_k_similar(df, df, 5, "id", "id", "embedding", metric="euclidean").collect()))

    one = answers()
    for name, value in (("QUERY_BLOCK_BYTES", 100), ("LEAST_QUERY_ROWS", 7), ("DEFAULT_ROWS_PER_BLOCK", 13)):
        monkeypatch.setattr(S, name, value)
    assert answers() == one and len(one) == 300
