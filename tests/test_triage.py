"""Split, undersampling, curve, thresholds, report and AUC against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from secstream.operators import triage as TR


def scored(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(y * 0.3 + rng.random(n) * 0.7, 0, 1), 2)
    return pd.DataFrame({"id": range(n), "y": y, "score": s}), spark.createDataFrame(
        pd.DataFrame({"id": range(n), "y": y, "score": s}))


def brute_curve(pdf):
    rows = []
    for t in sorted(pdf["score"].unique()):
        pred = pdf["score"] >= t
        tp = int((pred & (pdf["y"] == 1)).sum())
        fp = int((pred & (pdf["y"] == 0)).sum())
        rows.append((t, tp, fp, tp / (tp + fp), tp / int((pdf["y"] == 1).sum())))
    return rows


def test_curve_thresholds_and_auc(spark):
    pdf, df = scored(spark)
    curve = TR.pr_curve(df, "score", "y")
    got = sorted((r["threshold"], r["tp"], r["fp"], r["precision"], r["recall"]) for r in curve.collect())
    want = brute_curve(pdf)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    f1s = [(2 * p * r / (p + r + 1e-9), -t) for t, _, _, p, r in want]
    best_t = -max(f1s)[1]
    assert TR.threshold_max_f1(curve).first()["threshold"] == best_t
    ok = [t for t, _, _, p, r in want if p >= 0.9 and r >= 0.5]
    assert TR.threshold_for_precision(curve).first()["threshold"] == (min(ok) if ok else 0.5)
    # AUC: probability that a positive outranks a negative (ties count half)
    pos, neg = pdf[pdf.y == 1].score.to_numpy(), pdf[pdf.y == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(TR.roc_auc(df, "score", "y").first()["roc_auc"] - auc) < 1e-12


def test_report_accuracy(spark):
    pdf, df = scored(spark)
    rep = {r["class"]: r for r in TR.classification_report(df, "score", "y", 0.5).collect()}
    acc = ((pdf.score >= 0.5).astype(int) == pdf.y).mean()
    assert abs(rep["accuracy"]["f1"] - round(acc, 4)) < 1e-9
    assert rep["0"]["support"] + rep["1"]["support"] == len(pdf)


def test_split_and_undersample(spark):
    pdf = pd.DataFrame({"id": range(1000), "sus": [i % 3 == 0 for i in range(1000)], "evil": [i % 10 == 0 for i in range(1000)]})
    pdf[["sus", "evil"]] = pdf[["sus", "evil"]].astype(int)
    df = spark.createDataFrame(pdf)
    split = TR.stratified_split(df, "id", ["sus", "evil"]).toPandas()
    for _, g in split.groupby(["sus", "evil"]):
        t = round(len(g) * 0.15)
        assert (g.split == "test").sum() == t and (g.split == "val").sum() == t
    again = TR.stratified_split(df, "id", ["sus", "evil"]).toPandas()
    assert split.sort_values("id").split.tolist() == again.sort_values("id").split.tolist()
    under = TR.undersample(df, "id", "evil").toPandas()
    assert (under.evil == 1).sum() == 100 and (under.evil == 0).sum() == 500
    bal = TR.class_balance(df, "evil").first()
    assert bal["scale_pos_weight"] == 9.0


def test_borderline_smote_invariants(spark):
    from secstream.operators.oversample import BINARY_FEATURES, borderline_smote
    rng = np.random.default_rng(5)
    n = 240
    x1 = rng.normal(size=n)
    y = ((x1 + rng.normal(scale=0.8, size=n)) > 1.2).astype(int)
    pdf = pd.DataFrame({"id": range(n), "y": y, "x1": x1, "feat_is_root_user": rng.integers(0, 2, n).astype(float)})
    df = spark.createDataFrame(pdf)
    out = borderline_smote(df, "id", "y", ["x1", "feat_is_root_user"]).toPandas()
    real, synth = out[~out.synthetic], out[out.synthetic]
    assert len(real) == n
    if len(synth):
        assert (out.y == 1).sum() == (out.y == 0).sum()
        assert set(synth["feat_is_root_user"].unique()) <= {0.0, 1.0}
        assert synth.x1.between(pdf.x1.min(), pdf.x1.max()).all()
    again = borderline_smote(df, "id", "y", ["x1", "feat_is_root_user"]).toPandas()
    assert sorted(again[again.synthetic].x1.round(12)) == sorted(synth.x1.round(12))
    assert "feat_is_root_user" in BINARY_FEATURES
