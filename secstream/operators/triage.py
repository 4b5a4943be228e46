"""Triage data preparation and evaluation.

Every step is a distributed job: the stratified split and the undersampling
rank rows with ``exact_rank`` (no single-partition window even though there
are only four strata); the precision-recall curve aggregates by score first
and then takes global running sums with ``running_sums``; thresholds,
reports and AUC are single-pass aggregates over the curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import MODEL_FEATURES
from .parse import KNOWN_LOG_TYPES
from .ranking import exact_rank, running_sums

# ---- fixed values (reference settings) -------------------------------------
SEED = 42
TEST_FRACTION = 0.15
VAL_FRACTION = 0.15
UNDERSAMPLE_RATIO = 5
F1_EPS = 1e-9
PRECISION_TARGET = 0.90
MIN_RECALL = 0.50
FALLBACK_THRESHOLD = 0.5
TRADEOFF_TARGETS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
BOTH_PRECISION = 0.90
BOTH_RECALL = 0.80
# ---------------------------------------------------------------------------


def build_frame(df: DataFrame, features: str = "features", labels: str = "labels") -> DataFrame:
    """M1: drop rows without both labels (F7), absent features -> 0,
    ``log_type`` default ``unknown``, labels as int."""
    kept = df.filter(F.col(f"{labels}.sus").isNotNull() & F.col(f"{labels}.evil").isNotNull())
    feats = [F.coalesce(F.col(f"{features}.{f}").cast("double"), F.lit(0.0)).alias(f) for f in MODEL_FEATURES]
    return kept.select("*", *feats, F.coalesce(F.col("log_type"), F.lit("unknown")).alias("_lt"),
                       F.col(f"{labels}.sus").cast("int").alias("sus"),
                       F.col(f"{labels}.evil").cast("int").alias("evil")).drop(features, labels, "log_type") \
        .withColumnRenamed("_lt", "log_type")


def encode_log_type(df: DataFrame, classes: list[str], col: str = "log_type", out: str = "log_type_code") -> DataFrame:
    """Alphabetical label code fitted on ``classes``; unknown -> 0."""
    expr = F.lit(0)
    for i, c in enumerate(sorted(set(classes))):
        expr = F.when(F.col(col) == c, F.lit(i)).otherwise(expr)
    return df.withColumn(out, expr)


def fit_log_types(df: DataFrame, col: str = "log_type", known: tuple[str, ...] = (*KNOWN_LOG_TYPES, "unknown")) -> list[str]:
    """The ``known`` classes that occur, for ``encode_log_type``: at most ``len(known)`` names,
    whatever texts the column holds (any other type is encoded like an unknown one)."""
    present = df.agg(*[F.max(F.coalesce(F.col(col).cast("string"), F.lit("unknown")) == k).alias(k) for k in known]).first()
    return sorted(k for k in known if present[k])


def _hash_order(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, id_col: str, strata: list[str], seed: int = SEED) -> DataFrame:
    """M2: exact, reproducible 70/15/15 split per stratum: rows ranked by
    ``md5(seed|id)``; the first ``round(0.15 n)`` are test, the next
    ``round(0.15 n)`` validation, the rest train."""
    keyed = df.withColumn("_stratum", F.concat_ws("_", *[F.col(s).cast("string") for s in strata])) \
              .withColumn("_h", _hash_order(id_col, seed))
    ranked = exact_rank(keyed, ["_stratum"], ["_h", id_col], "_r")
    sizes = keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(sizes, "_stratum")
    t = F.round(F.col("_n") * TEST_FRACTION).cast("bigint")
    v = F.round(F.col("_n") * VAL_FRACTION).cast("bigint")
    split = F.when(F.col("_r") <= t, F.lit("test")).when(F.col("_r") <= t + v, F.lit("val")).otherwise(F.lit("train"))
    return j.withColumn("split", split).drop("_stratum", "_h", "_r", "_n")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and ``neg / pos`` (null when no positive:
    the caller must treat that as an error, as the reference does)."""
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")) \
        .withColumn("scale_pos_weight",
                    F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")))


def undersample(df: DataFrame, id_col: str, label: str, ratio: int = UNDERSAMPLE_RATIO,
                seed: int = SEED) -> DataFrame:
    """M4: all positives and ``min(neg, ratio * pos)`` negatives chosen by
    ``md5(seed|id)`` order (exact counts, reproducible)."""
    bal = class_balance(df, label).first()
    pos, neg = bal["positives"], bal["negatives"]
    target = min(neg, ratio * pos)
    negs = exact_rank(df.filter(F.col(label) == 0).withColumn("_h", _hash_order(id_col, seed)), [], ["_h", id_col],
                      "_r").filter(F.col("_r") <= target).drop("_h", "_r")
    return df.filter(F.col(label) == 1).unionByName(negs)


def pr_curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """M8: one point per distinct score t (predict positive when score >= t):
    tp, fp, precision, recall. Aggregated by score first, then global running
    sums in descending score order."""
    by_score = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    cum = running_sums(by_score, [F.col("threshold").desc()], ["pos", "neg"])
    total_pos = scored.agg(F.count_if(F.col(label) == 1)).first()[0]
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    return cum.select(
        "threshold", tp.alias("tp"), fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        (tp / F.lit(total_pos) if total_pos else F.lit(0.0)).cast("double").alias("recall"))


def f1(p: Column, r: Column) -> Column:
    return F.lit(2.0) * p * r / (p + r + F.lit(F1_EPS))


def threshold_max_f1(curve: DataFrame) -> DataFrame:
    """M9: the threshold of maximal F1; the lowest threshold on ties."""
    c = curve.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return c.agg(best.alias("b")).select("b.*")


def threshold_for_precision(curve: DataFrame, target: float = PRECISION_TARGET,
                            min_recall: float = MIN_RECALL) -> DataFrame:
    """Lowest threshold with precision >= target and recall >= min_recall, else 0.5."""
    ok = (F.col("precision") >= target) & (F.col("recall") >= min_recall)
    return curve.agg(F.coalesce(F.min(F.when(ok, F.col("threshold"))), F.lit(FALLBACK_THRESHOLD)).alias("threshold"))


def tradeoff_table(curve: DataFrame, targets=TRADEOFF_TARGETS) -> DataFrame:
    """Per precision target the lowest threshold reaching it, with its
    precision, recall, F1 and the 90/80 mark; null row when unreachable.
    One pass: a conditional ``min_by`` per target."""
    aggs = []
    for i, t in enumerate(targets):
        hit = F.col("precision") >= t
        aggs.append(F.min_by(F.when(hit, F.struct("threshold", "precision", "recall")),
                             F.when(hit, F.col("threshold"))).alias(f"t{i}"))
    row = curve.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias("p"))
                                  for i, t in enumerate(targets)]))
    r = row.select(stacked.alias("x")).select("x.target", "x.p.*")
    return r.select(
        F.round("target", 2).alias("target"), "threshold", "precision", "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
        ((F.col("precision") >= BOTH_PRECISION) & (F.col("recall") >= BOTH_RECALL)).alias("both_90_80"))


def classification_report(scored: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and
    weighted averages, rounded to 4 digits (one aggregate pass)."""
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    y = F.col(label)
    c = scored.agg(
        F.count_if((pred == 1) & (y == 1)).alias("tp"), F.count_if((pred == 1) & (y != 1)).alias("fp"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"), F.count_if((pred == 0) & (y != 1)).alias("tn"))

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    f11 = safe(2 * p1 * r1, p1 + r1)
    f10 = safe(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    rows = [
        ("0", p0, r0, f10, s0), ("1", p1, r1, f11, s1),
        ("accuracy", F.lit(None), F.lit(None), safe(tp + tn, n), n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f10 + f11) / 2, n),
        ("weighted avg", safe(p0 * s0 + p1 * s1, n), safe(r0 * s0 + r1 * s1, n), safe(f10 * s0 + f11 * s1, n), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("class"), F.round(p.cast("double"), 4).alias("precision"),
                             F.round(r.cast("double"), 4).alias("recall"), F.round(f.cast("double"), 4).alias("f1"),
                             s.cast("bigint").alias("support")) for k, p, r, f, s in rows])
    return c.select(F.explode(arr).alias("x")).select("x.*")


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """ROC-AUC by the rank-sum formula with average ranks for ties;
    null when a class is missing."""
    by_score = scored.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(by_score, [F.col("s").asc()], ["cnt"])
    avg_rank = F.col("cnt_cum") - (F.col("cnt") - 1) / 2.0
    agg = cum.agg(F.sum(F.col("pos") * avg_rank).alias("rsum"), F.sum("pos").alias("p"), F.sum("cnt").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    auc = F.when((p > 0) & (n > 0), (F.col("rsum") - p * (p + 1) / 2.0) / (p * n))
    return agg.select(auc.alias("roc_auc"), p.alias("positives"), n.alias("negatives"))
