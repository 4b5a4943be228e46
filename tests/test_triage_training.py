"""Boosted trees against brute force, early stopping, and what the training queries hand to the models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from secstream.operators import boosting as B
from secstream.operators import models as MD
from secstream.plans import q_triage as Q

SF = "/root/testdata/sf0.001"
PLAIN = dict(max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0, min_child_weight=1, gamma=0.0,
             reg_alpha=0.0, reg_lambda=1.0)


def frame(spark, n=160, seed=4):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({c: rng.integers(0, 6, n).astype(float) for c in MD.FEATURE_COLS})
    pdf["y"] = (pdf.iloc[:, 0] + rng.normal(scale=3, size=n) > 3.5).astype(int)
    pdf["doc_id"] = range(n)
    return spark.createDataFrame(pdf)


def tree_by_hand(x, y, w, margin, params, columns):
    """Nested dict tree by trying every feature and value of every node."""
    def sums(rows):
        p = [1 / (1 + np.exp(-margin[i])) for i in rows]
        return (sum(round(w[i] * (q - y[i]) * B.QUANTUM) for i, q in zip(rows, p)) / B.QUANTUM,
                sum(round(w[i] * q * (1 - q) * B.QUANTUM) for i, q in zip(rows, p)) / B.QUANTUM)

    def shrunk(g):
        return np.sign(g) * max(abs(g) - params["reg_alpha"], 0)

    def worth(g, h):
        return shrunk(g) ** 2 / (h + params["reg_lambda"]) if h + params["reg_lambda"] > 0 else 0

    def node(rows, depth):
        g, h = sums(rows)
        leaf = -params["learning_rate"] * shrunk(g) / (h + params["reg_lambda"])
        best = None
        for f in columns if depth < params["max_depth"] else []:
            for cut in sorted({x[i][f] for i in rows})[:-1]:
                left, right = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
                a, b = sums(left), sums(right)
                gain = worth(*a) + worth(*b) - worth(g, h)
                if min(a[1], b[1]) >= params["min_child_weight"] and gain > 1e-6 and gain >= params["gamma"] and (
                        best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut, left, right)
        return leaf if best is None else (best[1], best[2], node(best[3], depth + 1), node(best[4], depth + 1))

    return node(list(range(len(y))), 0)


def as_nested(tree, cuts, n=0):
    f = int(tree.feature[n])
    if f < 0:
        return float(tree.value[n])
    return (f, float(cuts[f][int(tree.bin[n])]), as_nested(tree, cuts, int(tree.left[n])), as_nested(tree, cuts, int(tree.right[n])))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(b, tuple) and abs(a - b) < 1e-9


@pytest.mark.parametrize("params", [PLAIN, {**PLAIN, "gamma": 1.0, "reg_alpha": 0.7, "reg_lambda": 3.0, "min_child_weight": 4},
                                    {**PLAIN, "reg_lambda": 0.0, "max_depth": 5}])
def test_splits_against_a_brute_force_tree(params):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (60, 4)).astype(float)
    y = (x[:, 0] + x[:, 2] + rng.normal(size=60) > 4.5).astype(float)
    w = np.where(y == 1, 1.7, 1.0)
    cuts = [np.unique(c) for c in x.T]
    bins = B.Model(cuts, [], []).bins(x)
    trees, _ = B.fit_rows(bins, y, w, np.arange(60), np.zeros(60, bool), params, 2, 30, 1)
    margin = np.zeros(60)
    for tree in trees:
        assert same(tree_by_hand(x.tolist(), y, w, margin, params, range(4)), as_nested(tree, cuts))
        margin += tree.margins(bins)


def test_the_table_way_and_the_task_way_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "ROUNDS_A_CHECKPOINT", 2)
    params = {**PLAIN, "subsample": 0.7, "colsample_bytree": 0.6}
    args = (frame(spark), frame(spark, 80, 5), "y", list(MD.FEATURE_COLS), [params], 4)
    one, two = B.fit_models(*args)[0], B.fit_models(args[0].repartition(3), *args[1:], in_task_rows=0)[0]
    assert [B._packed(t) for t in one.trees] == [B._packed(t) for t in two.trees] and len(one.trees) == 4
    assert one.scores == pytest.approx(two.scores, abs=1e-12)


def test_scores_are_areas_under_pr_and_rows_score_alike(spark):
    val = frame(spark, 80, 5)
    model = B.fit_models(frame(spark), val, "y", list(MD.FEATURE_COLS), [PLAIN], 5)[0]
    scored = MD.positive_probability(model, val, "p").withColumn("rawPrediction", F.col("p"))
    ev = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderPR", numBins=0)
    assert model.scores[-1] == pytest.approx(ev.evaluate(scored), abs=1e-9)
    again = B.model_of_nodes([dict(zip([c.split()[0] for c in B.NODE_SCHEMA.split(", ")], r)) for r in B.node_table(model)],
                             len(MD.FEATURE_COLS))
    x = np.array([[float(v) for v in r] for r in val.select(*MD.FEATURE_COLS).collect()])
    x[0, 0], x[1] = np.nan, 1e9
    assert np.allclose(model.margins(x), again.margins(x))


def test_training_stops_after_patience(spark):
    assert B.stopping_round([.1, .3, .2, .3, .25], 3) == (2, 5)
    assert B.stopping_round([.1, .3, .2, .3, .4], 3) == (5, None)
    model, best = MD.boost(frame(spark), frame(spark, 80, 5), "y", {**PLAIN, "max_depth": 2}, max_rounds=40, patience=2)
    assert 2 < len(model.trees) < 40 and best == max(model.scores) and len(model.trees) == model.best_round + 2
    with pytest.raises(ValueError, match="no positive"):
        MD.boost(frame(spark).withColumn("y", F.lit(0)), frame(spark), "y", PLAIN, 2)


def test_search_has_eight_parameters_and_thirty_trials(spark, tmp_path):
    sets = MD.parameter_sets(30, 42)
    assert len(sets) == 30 and all(len(p) == 8 for p in sets)
    assert all(lo <= p[k] <= hi for p in sets for k, (lo, hi) in MD.SEARCH_RANGES.items())
    out = MD.random_search(frame(spark), frame(spark, 80, 5), "y", trials=3, max_rounds=4)
    assert out.count() == 3 and set(MD.SEARCH_RANGES) < set(out.columns)
    for _ in range(2):
        MD.log_trials(out, f"{tmp_path}/trials", "a")
    MD.log_trials(out, f"{tmp_path}/trials", "b")
    kept = spark.read.parquet(f"{tmp_path}/trials").orderBy("run", "trial").collect()
    assert len(kept) == 6 and kept[2]["best_so_far"] == max(r["area_under_pr"] for r in kept)


@pytest.mark.parametrize("query", ["ml_score", "ml_search"])
def test_queries_train_the_whole_job(spark, monkeypatch, query):
    class Stop(Exception):
        pass

    seen, sampled = [], []

    def fit_models(train, val, label, features, sets, max_rounds, patience=MD.PATIENCE, seed=42, **_):
        seen.append((len(sets), max_rounds, patience, "resampled" in train.columns, val.filter("split <> 'val'").isEmpty()))
        raise Stop

    monkeypatch.setattr(MD, "fit_models", fit_models)
    monkeypatch.setattr(Q, "_splits", lambda *_: spark.sql("SELECT 1 AS doc_id, 'val' AS split"))
    monkeypatch.setattr(Q, "_resampled", lambda df, label: sampled.append(label) or df.withColumn("resampled", F.lit(1)))
    with pytest.raises(Stop):
        getattr(Q, query)(spark, SF)
    assert seen == [(1, 500, 30, True, True) if query == "ml_score" else (30, 400, 30, True, True)]
    assert sampled == ["sus" if query == "ml_score" else "evil"]


def test_training_rows_are_resampled(spark):
    rows = frame(spark, 120).withColumn("doc_id", F.monotonically_increasing_id())
    out = Q._resampled(rows, "y").groupBy("y", "synthetic").count().collect()
    n = {(r["y"], r["synthetic"]): r["count"] for r in out}
    assert n[(1, True)] == n[(0, False)] - n[(1, False)] > 0
