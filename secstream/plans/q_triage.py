"""Query keys: triage data work (M1-M4, M6, M8-M12, A14) on documents + labels.

Stand-in: every labelled document is an event; ``evil`` = toxic,
``sus`` = 1 - quality; the document text plays the kernel ``args``; the
deterministic score for the evaluation keys is ``n_chars / (n_chars + 2000)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import MODEL_FEATURES, serving_features
from ..operators import triage as TR
from ..session import checkpoint_dir
from ..sources.tables import read_table
from .q_features import _unicode_word
from .registry import register
from .sql_events import NETWORK, SENSITIVE, SHELL, entropy_sql


def labelled_events(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    log_type = (F.when(F.col("lang") == "en", F.lit("standard_host")).when(F.col("lang") == "de", F.lit("deep_kernel"))
                .otherwise(F.lit("dns")))
    attrs = F.struct(
        F.col("text").alias("args"),
        F.concat(F.col("source"), F.lit("."), F.col("lang"), F.lit(".example.com")).alias("dns_query"),
        F.when(F.col("n_chars") > 2000, F.lit(0)).otherwise(F.lit(3)).alias("dns_response_code"),
        F.when(F.col("n_chars") < 100, F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("return_value"),
        F.when(F.col("source") == "src0", F.lit(0)).otherwise(F.lit(1000)).cast("bigint").alias("user_id"),
    )
    ev = j.select("doc_id", "n_chars", log_type.alias("log_type"), attrs.alias("attributes"),
                  F.struct((1 - F.col("quality")).alias("sus"), F.col("toxic").alias("evil")).alias("labels"))
    return ev.withColumn("features", serving_features(F.col("log_type")))


def ml_frame_df(spark, sf_dir):
    """The encoded training frame (the fitted label classes are a tiny distinct result)."""
    frame = TR.build_frame(labelled_events(spark, sf_dir))
    return TR.encode_log_type(frame, TR.fit_log_types(frame))


_FRAME_CTE = f"""
ev AS (
  SELECT d.doc_id, d.n_chars, d.text AS args,
    CASE d.lang WHEN 'en' THEN 'standard_host' WHEN 'de' THEN 'deep_kernel' ELSE 'dns' END AS log_type,
    d.source || '.' || d.lang || '.example.com' AS dns_query,
    CASE WHEN d.n_chars > 2000 THEN 0 ELSE 3 END AS code,
    CASE WHEN d.n_chars < 100 THEN -1 ELSE 0 END AS rv,
    CASE WHEN d.source = 'src0' THEN 0 ELSE 1000 END AS uid,
    1 - l.quality AS sus, l.toxic AS evil
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
frame AS (
  SELECT doc_id, n_chars, log_type, dense_rank() OVER (ORDER BY log_type) - 1 AS log_type_code,
    CAST(CASE WHEN log_type = 'dns' THEN length(dns_query) ELSE 0 END AS DOUBLE) AS feat_dns_query_length,
    CAST(CASE WHEN log_type = 'dns' THEN round({entropy_sql('dns_query')}, 4) ELSE 0 END AS DOUBLE)
      AS feat_dns_query_entropy,
    CAST(CASE WHEN log_type = 'dns' THEN length(dns_query) - length(replace(dns_query, '.', '')) ELSE 0 END AS DOUBLE)
      AS feat_dns_num_subdomains,
    CAST(CASE WHEN log_type = 'dns' THEN (CASE WHEN code = 0 THEN 0 ELSE 1 END) ELSE 0 END AS DOUBLE) AS feat_dns_failed,
    CAST(CASE WHEN log_type <> 'dns' THEN (CASE WHEN uid = 0 THEN 1 ELSE 0 END) ELSE 0 END AS DOUBLE) AS feat_is_root_user,
    CAST(CASE WHEN log_type <> 'dns' THEN (CASE WHEN rv < 0 THEN 1 ELSE 0 END) ELSE 0 END AS DOUBLE) AS feat_return_failed,
    CAST(CASE WHEN log_type <> 'dns' THEN length(coalesce(args, '')) ELSE 0 END AS DOUBLE) AS feat_args_length,
    CAST(CASE WHEN log_type <> 'dns' THEN regexp_matches(coalesce(args, ''), '(?i){SHELL}')::INT ELSE 0 END AS DOUBLE)
      AS feat_args_has_shell,
    CAST(CASE WHEN log_type <> 'dns' THEN regexp_matches(coalesce(args, ''), '(?i){_unicode_word(NETWORK)}')::INT
      ELSE 0 END AS DOUBLE) AS feat_args_has_network,
    CAST(CASE WHEN log_type <> 'dns' THEN regexp_matches(coalesce(args, ''), '(?i){SENSITIVE}')::INT ELSE 0 END AS DOUBLE)
      AS feat_args_has_sensitive_path,
    sus, evil
  FROM ev)"""

_FRAME_COLS = ("doc_id", "log_type", "log_type_code", *MODEL_FEATURES, "sus", "evil")


@register("ml_frame", f"WITH {_FRAME_CTE}\nSELECT {', '.join(_FRAME_COLS)} FROM frame")
def ml_frame(spark, sf_dir):
    """M1 + M3 + X12 + X13: flat training frame with encoded log type."""
    return ml_frame_df(spark, sf_dir).select(*_FRAME_COLS)


@register("ml_split", f"""WITH {_FRAME_CTE}
SELECT doc_id, sus, evil, CASE WHEN r <= t THEN 'test' WHEN r <= 2 * t THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, sus, evil,
    row_number() OVER (PARTITION BY sus, evil ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
    CAST(round(count(*) OVER (PARTITION BY sus, evil) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS t
  FROM frame)""")
def ml_split(spark, sf_dir):
    """M2: exact stratified 70/15/15 split by (sus, evil), seed 42."""
    frame = ml_frame_df(spark, sf_dir).select("doc_id", "sus", "evil")
    return TR.stratified_split(frame, "doc_id", ["sus", "evil"]).select("doc_id", "sus", "evil", "split")


@register("ml_undersample", f"""WITH {_FRAME_CTE},
bal AS (SELECT count(*) FILTER (WHERE evil = 1) AS pos, count(*) FILTER (WHERE evil = 0) AS neg FROM frame)
SELECT doc_id, evil FROM frame WHERE evil = 1
UNION ALL
SELECT doc_id, evil FROM (
  SELECT doc_id, evil, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS r
  FROM frame WHERE evil = 0) WHERE r <= (SELECT least(neg, 5 * pos) FROM bal)""")
def ml_undersample(spark, sf_dir):
    """M4: all evil rows and at most 5 times as many benign rows (md5 order)."""
    frame = ml_frame_df(spark, sf_dir).select("doc_id", "evil")
    return TR.undersample(frame, "doc_id", "evil")


@register("ml_class_weight", f"""WITH {_FRAME_CTE}
SELECT 'sus' AS label, count(*) FILTER (WHERE sus = 1) AS positives, count(*) FILTER (WHERE sus = 0) AS negatives,
  round(count(*) FILTER (WHERE sus = 0) / count(*) FILTER (WHERE sus = 1), 6) AS scale_pos_weight FROM frame
UNION ALL
SELECT 'evil', count(*) FILTER (WHERE evil = 1), count(*) FILTER (WHERE evil = 0),
  round(count(*) FILTER (WHERE evil = 0) / count(*) FILTER (WHERE evil = 1), 6) FROM frame""")
def ml_class_weight(spark, sf_dir):
    """A14 + M6: class balance and scale_pos_weight for both labels."""
    frame = ml_frame_df(spark, sf_dir)
    parts = [TR.class_balance(frame, lab).select(F.lit(lab).alias("label"), "positives", "negatives",
                                                  F.round("scale_pos_weight", 6).alias("scale_pos_weight"))
             for lab in ("sus", "evil")]
    return parts[0].unionByName(parts[1])


def _scored(spark, sf_dir):
    frame = ml_frame_df(spark, sf_dir)
    return frame.select("doc_id", "evil", F.round(F.col("n_chars").cast("double")
                                                  / (F.col("n_chars").cast("double") + F.lit(2000.0)), 6).alias("score"))


_CURVE_CTE = f"""{_FRAME_CTE},
s AS (SELECT doc_id, evil AS y, round(CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000 AS DOUBLE)), 6) AS score
      FROM frame),
g AS (SELECT score AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM s GROUP BY score),
c0 AS (SELECT threshold,
         CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM g),
curve AS (SELECT threshold, tp, fp, tp / (tp + fp) AS precision,
            tp / (SELECT count(*) FROM s WHERE y = 1) AS recall FROM c0),
f AS (SELECT *, 2.0 * precision * recall / (precision + recall + CAST(1e-9 AS DOUBLE)) AS f1 FROM curve),
best AS (SELECT threshold, precision, recall, f1 FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1)"""


def _curve(spark, sf_dir):
    return TR.pr_curve(_scored(spark, sf_dir), "score", "evil")


@register("ml_pr_curve", f"""WITH {_CURVE_CTE}
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve""")
def ml_pr_curve(spark, sf_dir):
    """M8: precision-recall curve, one point per distinct score."""
    c = _curve(spark, sf_dir)
    return c.select("threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                    F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("ml_threshold_f1", f"""WITH {_CURVE_CTE}
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM best""")
def ml_threshold_f1(spark, sf_dir):
    """M9: threshold of maximal F1 (lowest on ties)."""
    b = TR.threshold_max_f1(_curve(spark, sf_dir))
    return b.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("ml_threshold_precision", f"""WITH {_CURVE_CTE}
SELECT coalesce(min(threshold) FILTER (WHERE precision >= CAST(0.9 AS DOUBLE) AND recall >= CAST(0.5 AS DOUBLE)),
                CAST(0.5 AS DOUBLE)) AS threshold FROM curve""")
def ml_threshold_precision(spark, sf_dir):
    """Lowest threshold with precision >= 0.90 and recall >= 0.50, else 0.5."""
    return TR.threshold_for_precision(_curve(spark, sf_dir))


_TARGETS = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in TR.TRADEOFF_TARGETS)


@register("ml_tradeoff", f"""WITH {_CURVE_CTE},
targets(target) AS (VALUES {_TARGETS}),
hits AS (SELECT t.target, c.threshold, c.precision, c.recall,
           row_number() OVER (PARTITION BY t.target ORDER BY c.threshold) AS r
         FROM targets t JOIN curve c ON c.precision >= t.target)
SELECT round(t.target, 2) AS target, h.threshold, round(h.precision, 6) AS precision, round(h.recall, 6) AS recall,
  round(2.0 * h.precision * h.recall / (h.precision + h.recall + CAST(1e-9 AS DOUBLE)), 6) AS f1,
  h.precision >= CAST(0.9 AS DOUBLE) AND h.recall >= CAST(0.8 AS DOUBLE) AS both_90_80
FROM targets t LEFT JOIN (SELECT * FROM hits WHERE r = 1) h ON t.target = h.target""")
def ml_tradeoff(spark, sf_dir):
    """Precision-target trade-off table (N/A rows as nulls)."""
    t = TR.tradeoff_table(_curve(spark, sf_dir))
    return t.select("target", "threshold", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "both_90_80")


@register("ml_report", f"""WITH {_CURVE_CTE},
cm AS (SELECT count(*) FILTER (WHERE score >= (SELECT threshold FROM best) AND y = 1) AS tp,
              count(*) FILTER (WHERE score >= (SELECT threshold FROM best) AND y <> 1) AS fp,
              count(*) FILTER (WHERE score < (SELECT threshold FROM best) AND y = 1) AS fn,
              count(*) FILTER (WHERE score < (SELECT threshold FROM best) AND y <> 1) AS tn FROM s),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
             CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
             tp + fn AS s1, tn + fp AS s0 FROM cm),
m2 AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f11,
              CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f10, s0 + s1 AS n FROM m)
SELECT '0' AS class, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f10, 4) AS f1, CAST(s0 AS BIGINT) AS support FROM m2
UNION ALL SELECT '1', round(p1, 4), round(r1, 4), round(f11, 4), CAST(s1 AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0 END, 4), CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f10 + f11) / 2, 4), CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 4), round((r0 * s0 + r1 * s1) / n, 4),
  round((f10 * s0 + f11 * s1) / n, 4), CAST(n AS BIGINT) FROM m2""")
def ml_report(spark, sf_dir):
    """Classification report at the max-F1 threshold."""
    scored = _scored(spark, sf_dir)
    thr = TR.threshold_max_f1(TR.pr_curve(scored, "score", "evil")).first()["threshold"]
    return TR.classification_report(scored, "score", "evil", thr)


@register("ml_auc", f"""WITH {_CURVE_CTE},
rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
a AS (SELECT sum(r) FILTER (WHERE y = 1) AS rsum, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM rk)
SELECT round((rsum - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc, p AS positives, n AS negatives FROM a""")
def ml_auc(spark, sf_dir):
    """ROC-AUC with average ranks for tied scores."""
    a = TR.roc_auc(_scored(spark, sf_dir), "score", "evil")
    return a.select(F.round("roc_auc", 6).alias("roc_auc"), F.col("positives").cast("bigint").alias("positives"),
                    F.col("negatives").cast("bigint").alias("negatives"))


def _splits(spark, sf_dir):
    frame = ml_frame_df(spark, sf_dir)
    return TR.stratified_split(frame, "doc_id", ["sus", "evil"]).persist()


def _resampled(train, label: str):
    """The training split as both models and the search see it: undersampled to 5:1, then
    Borderline-SMOTE to 1:1; unchanged where the label is balanced. Checkpoints keep the plan
    of a boosting round, and its text, small."""
    from ..operators.models import FEATURE_COLS
    from ..operators.oversample import borderline_smote
    checkpoint_dir(train.sparkSession)
    under = TR.undersample(train, "doc_id", label).checkpoint()
    return borderline_smote(under, "doc_id", label, list(FEATURE_COLS)).checkpoint()


@register("ml_score")
def ml_score(spark, sf_dir):
    """M4-M7 + M9 + M10 + M14: train both models on the resampled training split (class
    weight, at most 500 rounds, early stopping on the validation split), pick the max-F1 threshold for sus and the precision one for evil
    on validation, score the test split (rows-only: model output is not SQL)."""
    from ..operators import models as MD
    checkpoint_dir(spark)
    s = _splits(spark, sf_dir).checkpoint()
    tr, va, out = (s.filter(F.col("split") == x) for x in ("train", "val", "test"))
    for label, params in (("sus", MD.SUS_PARAMS), ("evil", MD.EVIL_PARAMS)):
        model = MD.train(_resampled(tr, label), va, label, params)
        curve = TR.pr_curve(MD.positive_probability(model, va, "p"), "p", label)
        best = TR.threshold_max_f1(curve) if label == "sus" else TR.threshold_for_precision(curve)
        out = MD.score(model, out, float(best.first()["threshold"]), label)
    return out.select("doc_id", "sus", "evil", *[f"{n}_{f}" for n in ("sus", "evil")
                                                 for f in ("probability", "flag", "threshold")])


@register("ml_search")
def ml_search(spark, sf_dir):
    """M13 + S19: random search of 30 parameter sets of at most 400 rounds with early stopping,
    trained on the resampled training split, scored on the validation split (rows-only)."""
    from ..operators import models as MD
    checkpoint_dir(spark)
    s = _splits(spark, sf_dir).checkpoint()
    train, val = (s.filter(F.col("split") == x) for x in ("train", "val"))
    return MD.random_search(_resampled(train, "evil"), val, "evil")


@register("ml_smote")
def ml_smote(spark, sf_dir):
    """M4 + M5: undersampled training split oversampled by Borderline-SMOTE
    (borderline-2) to 1:1 (rows-only; invariants tested)."""
    from ..operators.models import FEATURE_COLS
    from ..operators.oversample import borderline_smote
    s = _splits(spark, sf_dir).filter(F.col("split") == "train")
    under = TR.undersample(s, "doc_id", "evil")
    out = borderline_smote(under, "doc_id", "evil", list(FEATURE_COLS))
    return out.select("doc_id", "evil", "synthetic", *FEATURE_COLS)
