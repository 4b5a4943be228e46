"""The nearest rows of oversampling are searched once; columns in blocks give the answers of a sort."""

import numpy as np

from secstream.operators import oversample as O
from secstream.operators import similarity as S


def test_each_search_of_oversampling_is_run_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, int(i % 5 == 0), float(rng.normal(i % 5 == 0)), float(rng.normal())) for i in range(150)],
                               "id long, y int, a double, b double")
    met, real = [], O.top_k_similar

    def counted(*args, **kwargs):
        seen = spark.sparkContext.accumulator(0)
        met.append(seen)

        def look(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        found = real(*args, **kwargs)
        return found.mapInArrow(look, found.schema)

    monkeypatch.setattr(O, "top_k_similar", counted)
    out = O.borderline_smote(df, "id", "y", ["a", "b"])
    n = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert n[(1, True)] == 90
    assert met[0].value == 30 * O.M_NEIGHBORS and met[1].value == met[2].value > 0


def test_blocks_of_columns_give_the_answers_of_a_sort():
    rng = np.random.default_rng(7)
    for n, k, steps, block in ((5, 9, 3, 2), (100, 2, 50, 7), (700, 3, 4, 64), (900, 20, 10_000, 300)):
        scores = rng.integers(0, steps, (30, n)).astype(float)
        scores[rng.random(scores.shape) < 0.05] = -np.inf
        best, place = np.full((30, k), -np.inf), np.full((30, k), -1)
        for first in range(0, n, block):
            best, place = S.better_columns(best, place, scores[:, first:first + block], first)
        for row, at in zip(scores, place):
            want = [c for c in sorted(range(n), key=lambda c: (-row[c], c)) if np.isfinite(row[c])][:k]
            assert at[at >= 0].tolist() == want
