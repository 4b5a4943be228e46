"""Train, tune, persist and apply triage classifiers.

Boosted trees are grown from histograms (``boosting``) with the reference's eight
training parameters, the class weight of the training balance and its early
stopping: the area under PR of the validation split after every round, stopped
after ``PATIENCE`` rounds without a better one. The bundle is a table of nodes a
model and a one-row metadata table (feature order, label classes, thresholds).
Tuning is a random search over the reference's parameter ranges; the trials are
returned as a table, which ``log_trials`` appends to a stored one.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import MODEL_FEATURES, serving_features
from .boosting import NODE_SCHEMA, PATIENCE, Model, fit_models, model_of_nodes, node_table, probability
from .triage import encode_log_type

FEATURE_COLS = (*MODEL_FEATURES, "log_type_code")

# ---- fixed values (reference training settings) ----
SUS_PARAMS = dict(max_depth=5, learning_rate=0.225087, subsample=0.586104, colsample_bytree=0.903578,
                  min_child_weight=6, gamma=0.399563, reg_alpha=1.358576, reg_lambda=4.009962)
EVIL_PARAMS = dict(max_depth=6, learning_rate=0.05, subsample=0.8, colsample_bytree=0.8,
                   min_child_weight=1, gamma=0.0, reg_alpha=0.0, reg_lambda=1.0)
MAX_ROUNDS = 500
SEARCH_TRIALS = 30
SEARCH_ROUNDS = 400
SEARCH_RANGES = dict(max_depth=(3, 8), learning_rate=(0.01, 0.3), subsample=(0.5, 1.0), colsample_bytree=(0.3, 1.0),
                     min_child_weight=(1, 20), gamma=(0.0, 5.0), reg_alpha=(0.0, 10.0), reg_lambda=(0.0, 10.0))
# ----------------------------------------------------
WHOLE = ("max_depth", "min_child_weight")
LOG_SCALE = ("learning_rate",)


def boost(train_df: DataFrame, val_df: DataFrame, label: str, params: dict, max_rounds: int, patience: int = PATIENCE,
          seed: int = 42) -> tuple[Model, float]:
    """The model of the round at which training stops, and the best area under PR."""
    model = fit_models(train_df, val_df, label, list(FEATURE_COLS), [params], max_rounds, patience, seed)[0]
    return model, max(model.scores)


def train(train_df: DataFrame, val_df: DataFrame, label: str, params: dict, max_rounds: int = MAX_ROUNDS) -> Model:
    """M7: fit on train; val rows only steer early stopping."""
    return boost(train_df, val_df, label, params, max_rounds)[0]


def positive_probability(model: Model, df: DataFrame, out: str = "probability_1") -> DataFrame:
    return df.withColumn(out, probability(model, list(FEATURE_COLS)))


def score(model: Model, df: DataFrame, threshold: float, name: str) -> DataFrame:
    """Probability rounded to 4 digits, flag on the unrounded value."""
    p = positive_probability(model, df, "_p")
    return p.withColumn(f"{name}_probability", F.round("_p", 4)) \
        .withColumn(f"{name}_flag", F.col("_p") >= F.lit(threshold)) \
        .withColumn(f"{name}_threshold", F.lit(threshold)).drop("_p")


def save_bundle(spark: SparkSession, models: dict[str, Model], thresholds: dict[str, float],
                classes: list[str], path: str) -> None:
    """A node table per model and a one-row metadata table."""
    for name, m in models.items():
        spark.createDataFrame(node_table(m), NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"feature_cols": list(FEATURE_COLS), "classes": classes, "thresholds": thresholds}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, Model], dict]:
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no model bundle at {path}: run training first") from e
    return {n: model_of_nodes(spark.read.parquet(f"{path}/{n}").collect(), len(meta["feature_cols"]))
            for n in meta["thresholds"]}, meta


def serving_frame(events: DataFrame, classes: list[str]) -> DataFrame:
    """X12 + M3 on events (…, log_type, attributes): the model's columns beside the event's own."""
    typed = encode_log_type(events, classes).withColumn("_f", serving_features(F.col("log_type")))
    return typed.select("*", *[F.col(f"_f.{f}").cast("double").alias(f) for f in MODEL_FEATURES]).drop("_f")


def score_events(events: DataFrame, models: dict[str, Model], meta: dict) -> DataFrame:
    """M14 + J5 + T7: the six result fields of each event, by the models and thresholds of one
    bundle. The metadata enters as literals, so a batch and a stream share this plan."""
    out = serving_frame(events, meta["classes"])
    for name in models:
        out = score(models[name], out, float(meta["thresholds"][name]), name)
    return out.drop(*MODEL_FEATURES, "log_type_code")


def parameter_sets(trials: int, seed: int) -> list[dict]:
    """``trials`` draws from the reference's ranges, the learning rate on a log scale."""
    rnd = random.Random(seed)

    def draw(name: str, low: float, high: float) -> float:
        if name in WHOLE:
            return rnd.randint(low, high)
        if name in LOG_SCALE:
            return round(math.exp(rnd.uniform(math.log(low), math.log(high))), 6)
        return round(rnd.uniform(low, high), 6)

    return [{name: draw(name, *span) for name, span in SEARCH_RANGES.items()} for _ in range(trials)]


def random_search(train_df: DataFrame, val_df: DataFrame, label: str, trials: int = SEARCH_TRIALS,
                  max_rounds: int = SEARCH_ROUNDS, seed: int = 42) -> DataFrame:
    """Random parameter sets, each fit with early stopping and scored by its best area
    under PR on the validation split. One row per trial (parameters, rounds, metric), best first."""
    sets = parameter_sets(trials, seed)
    models = fit_models(train_df, val_df, label, list(FEATURE_COLS), sets, max_rounds, seed=seed)
    rows = [(i, *[float(p[k]) for k in SEARCH_RANGES], m.best_round, len(m.trees), max(m.scores))
            for i, (p, m) in enumerate(zip(sets, models, strict=True))]
    schema = "trial int, " + ", ".join(f"{k} double" for k in SEARCH_RANGES) + ", best_round int, rounds int, area_under_pr double"
    return train_df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("area_under_pr").desc(), "trial")


def log_trials(trials: DataFrame, path: str, run: str) -> None:
    """The trials of a run, kept under its name; a repeated run replaces its rows."""
    trials.withColumn("best_so_far", F.max("area_under_pr").over(_by_trial())).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/run={run}")


def _by_trial():
    from pyspark.sql import Window
    return Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)  # a row per trial
