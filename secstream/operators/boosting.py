"""Gradient-boosted trees by histograms, as Spark jobs.

Features are binned once to bytes at quantiles of all training rows. A tree
grows level by level: every task adds up gradients and Hessians by (node,
feature, bin), the sums meet in one small aggregation, and the driver, which
gets at most ``2**depth * features * 256`` sums, picks the splits. Margins stay
beside the rows; the trees since the last checkpoint are applied on the fly, so
a round reads one table and a lost executor costs no more than
``ROUNDS_A_CHECKPOINT`` trees. Validation margins are kept the same way: early
stopping needs no second fit.

Gradients are summed as integers (``QUANTUM`` steps a unit), so a tree does not
depend on how the rows lie in tasks. That makes the other way exact too: a
training set of at most ``IN_TASK_ROWS`` rows (some 40 bytes each when binned) is
broadcast, and a model is grown by one task with the same functions. The
parameter sets of a search are then the rows of one job, one task each.

Split gain, with G and H the sums of a node and T(G) = sign(G) * max(|G| - alpha, 0):

    T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda)

A split needs this to be above ``MIN_GAIN`` and at least gamma, and Hessians of
at least ``min_child_weight`` on both sides; the first feature and bin win ties.
Rows are drawn per tree by a hash of the row, columns by a seeded choice. A null
or NaN feature lies above every threshold.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ranking import running_sums

BINS = 256
QUANTUM = 1 << 20
MIN_GAIN = 1e-6
#: Rows (training and validation) up to which a model is grown inside one task: some 40 bytes a row are
#: broadcast, some 200 held while a tree grows.
IN_TASK_ROWS = 2_000_000
ROUNDS_A_CHECKPOINT = 16
PATIENCE = 30


@dataclass
class Tree:
    """Node arrays; ``feature`` is -1 in a leaf. Rows with bin <= ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Every row one level down."""
        feature = self.feature[at]
        left = bins[np.arange(len(at)), np.maximum(feature, 0)] <= self.bin[at]
        return np.where(feature < 0, at, np.where(left, self.left[at], self.right[at]))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while (self.feature[at] >= 0).any():
            at = self.step(at, bins)
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Model:
    """Cut points of every feature and the trees; ``scores`` has the validation area after every round."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    scores: list[float]

    @property
    def best_round(self) -> int:
        return int(np.argmax(self.scores)) + 1 if self.scores else 0

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of raw feature rows."""
        out = np.zeros(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.where(np.isnan(x[:, f]), BINS - 1, np.searchsorted(cuts, x[:, f], "left"))
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return np.sum([t.margins(bins) for t in self.trees], axis=0) if self.trees else np.zeros(len(x))


# ---- one tree ---------------------------------------------------------------------------------------------------


def row_draw(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row keys (public splitmix64 constants)."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic gradients and Hessians as whole steps of ``1 / QUANTUM``."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(weight * (p - y) * QUANTUM), np.rint(weight * p * (1 - p) * QUANTUM)


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray,
              columns: list[int] | None = None) -> np.ndarray:
    """Sums by (node, feature, bin) of the rows whose ``node`` is not negative; last axis G, H, as integers.
    Features other than ``columns`` are left at 0."""
    rows = np.flatnonzero(node >= 0)
    features = bins.shape[1]
    out = np.zeros((nodes, features, BINS, 2), np.int64)
    at, bins, sums = node[rows] * BINS, bins[rows], (g[rows], h[rows])
    for f in range(features) if columns is None else columns:
        place = at + bins[:, f]
        for k, v in enumerate(sums):
            out[:, f, :, k] = np.bincount(place, v, nodes * BINS).reshape(nodes, BINS).astype(np.int64)
    return out


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _worth(g: np.ndarray, h: np.ndarray, params: dict) -> np.ndarray:
    below = h + params["reg_lambda"]
    return np.where(below > 0, _shrunk(g, params["reg_alpha"]) ** 2 / np.where(below > 0, below, 1), 0)


def best_splits(sums: np.ndarray, params: dict, columns: list[int]) -> list[tuple[int, int] | None]:
    """(feature, bin) of every node's best split, None where none is allowed."""
    total = sums[:, columns[0]].sum(axis=1)
    left = np.cumsum(sums[:, columns], axis=2)[:, :, :-1] / QUANTUM
    whole = total[:, None, None, :] / QUANTUM
    right = whole - left
    gain = _worth(left[..., 0], left[..., 1], params) + _worth(right[..., 0], right[..., 1], params) - _worth(
        whole[..., 0], whole[..., 1], params)
    least = max(params["min_child_weight"], MIN_GAIN)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf).reshape(len(sums), -1)
    out: list[tuple[int, int] | None] = []
    for node, at in enumerate(gain.argmax(axis=1).tolist()):
        f, b = divmod(at, BINS - 1)
        best = gain[node, at]
        out.append((columns[f], b) if best > MIN_GAIN and best >= params["gamma"] else None)
    return out


def grow(level_sums: Callable[[Tree, list[int]], np.ndarray], params: dict, columns: list[int]) -> Tree:
    """A tree from the sums of each level; ``level_sums(tree, nodes)`` gives those of the open nodes."""
    feature, bin_, left, right, sums = [-1], [0], [0], [0], [None]
    frontier = [0]

    def tree(values: list[float] | None = None) -> Tree:
        return Tree(np.array(feature), np.array(bin_), np.array(left), np.array(right),
                    np.array(values if values else [0.0] * len(feature)))

    for _ in range(params["max_depth"]):
        if not frontier:
            break
        found = level_sums(tree(), frontier)
        nexts = []
        for i, (node, split) in enumerate(zip(frontier, best_splits(found, params, columns), strict=True)):
            sums[node] = found[i, columns[0]].sum(axis=0)
            if split is None:
                continue
            f, b = split
            low = found[i, f, :b + 1].sum(axis=0)
            feature[node], bin_[node], left[node], right[node] = f, b, len(feature), len(feature) + 1
            for own in (low, sums[node] - low):
                nexts.append(len(feature))
                feature.append(-1)
                bin_.append(0)
                left.append(0)
                right.append(0)
                sums.append(own)
        frontier = nexts
    values = []
    for own in sums:
        g, h = (own / QUANTUM) if own is not None else (0.0, 0.0)
        below = h + params["reg_lambda"]
        values.append(float(-params["learning_rate"] * _shrunk(np.float64(g), params["reg_alpha"]) / below) if below > 0 else 0.0)
    return tree(values)


def tree_columns(params: dict, features: int, seed: int, number: int) -> list[int]:
    """The columns that tree ``number`` may split on."""
    wanted = max(1, int(params["colsample_bytree"] * features))
    return sorted(random.Random(seed * 1_000_003 + number).sample(range(features), wanted))


def pr_area(margin: np.ndarray, y: np.ndarray) -> float:
    """Area under the precision-recall curve by trapezoids, one point per distinct margin."""
    p = int(y.sum())
    if not p:
        return 0.0
    values, at = np.unique(-margin, return_inverse=True)
    pos = np.bincount(at, y, len(values))
    tp, all_ = np.cumsum(pos), np.cumsum(np.bincount(at, minlength=len(values)))
    precision = tp / all_
    return float((pos / p * (precision + np.append(precision[:1], precision[:-1])) / 2).sum())


def stopping_round(scores: list[float], patience: int = PATIENCE) -> tuple[int, int | None]:
    """The best round (from 1, the first of equals) and the round after which training stops: the
    first with ``patience`` rounds since the best one, ``None`` while there is none."""
    best = 0
    for i, s in enumerate(scores):
        if i == 0 or s > scores[best]:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, None


# ---- inside one task --------------------------------------------------------------------------------------------


def alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal rows, and the number of every row's set."""
    flat = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1) for c in columns], axis=1)
    return np.unique(flat.view(np.dtype((np.void, flat.shape[1]))).ravel(), return_index=True, return_inverse=True)[1:]


def fit_rows(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, key: np.ndarray, val: np.ndarray, params: dict,
             max_rounds: int, patience: int, seed: int) -> tuple[list[Tree], list[float]]:
    """Boosting over rows held in memory; ``val`` marks the validation rows. Rows with the same bins, label and
    weight have the same gradients: they are drawn each by its own key, and added up as a count."""
    v_bins, v_y = bins[val], y[val]
    bins, y, weight, key = (x[~val] for x in (bins, y, weight, key))
    if len(y):
        first, number_of = alike(bins, y, weight)
        bins, y, weight = bins[first], y[first], weight[first]
    margin, v_margin = np.zeros(len(y)), np.zeros(len(v_y))
    trees: list[Tree] = []
    scores: list[float] = []
    for number in range(max_rounds):
        drawn = row_draw(key, seed * 1_000_003 + number) < params["subsample"]
        times = np.bincount(number_of[drawn], minlength=len(y)) if len(y) else np.zeros(0)
        g, h = (x * times for x in gradients(margin, y, weight))
        columns = tree_columns(params, bins.shape[1], seed, number)
        at = np.zeros(len(y), np.int64)

        def level_sums(tree: Tree, nodes: list[int]) -> np.ndarray:
            nonlocal at
            at = tree.step(at, bins)  # the tree is one level deeper than at the last call
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            return histogram(bins, np.where(times > 0, place[at], -1), len(nodes), g, h, columns)

        tree = grow(level_sums, params, columns)
        trees.append(tree)
        margin += tree.value[tree.step(at, bins)]
        v_margin += tree.margins(v_bins)
        scores.append(pr_area(v_margin, v_y))
        if stopping_round(scores, patience)[1] is not None:
            break
    return trees, scores


# ---- Spark ------------------------------------------------------------------------------------------------------


def feature_cuts(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """At most ``BINS - 2`` cut points a feature: quantiles of its values, so few distinct values are bins of their own."""
    at = [(i + 1) / (BINS - 1) for i in range(BINS - 2)]
    x = [F.when(~F.isnan(c), c) for c in (F.col(f).cast("double") for f in features)]
    row = df.agg(*(F.percentile_approx(c, at, 100_000).alias(f"q{i}") for i, c in enumerate(x))).first()
    return [np.unique(np.array(q if q is not None else [], np.float64)) for q in row]


def binned(train: DataFrame, val: DataFrame, label: str, features: list[str], model: Model, weight: float) -> DataFrame:
    """The checkpointed rows (bins, y, weight, key, val, margin) of both splits."""
    checkpoint_dir(train.sparkSession)

    def rows(df: DataFrame, is_val: bool) -> DataFrame:
        x = [F.col(f).cast("double") for f in features]
        return df.select(F.array(*x).alias("x"), F.coalesce(F.col(label), F.lit(0)).cast("double").alias("y"),
                         F.xxhash64(*df.columns).alias("key"), F.lit(is_val).alias("val"))

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in model.bins(x)], pa.binary()), batch.column("y"),
                 pa.array(np.where(y == 1, weight, 1.0)), batch.column("key"), batch.column("val"), pa.array(np.zeros(len(y)))],
                names=["bins", "y", "weight", "key", "val", "margin"])

    return (rows(train, False).unionByName(rows(val, True))
            .mapInArrow(to_bins, "bins binary, y double, weight double, key bigint, val boolean, margin double").checkpoint())


def _arrays(batch: pa.RecordBatch | pa.Table, features: int):
    """bins, y, weight, key, val, margin as arrays."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, features)
    return (bins, *(np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                               else batch.column(c).to_numpy()) for c in ("y", "weight", "key", "val", "margin")))


def _level_sums(state: DataFrame, pending: list[Tree], params: dict, features: int, draw: int):
    """The sums of a level by one job over the rows."""

    def level_sums(tree: Tree, nodes: list[int]) -> np.ndarray:
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), features, BINS, 2), np.int64)
            for batch in batches:
                bins, y, weight, key, val, margin = _arrays(batch, features)
                g, h = gradients(margin + sum((t.margins(bins) for t in pending), np.zeros(len(y))), y, weight)
                mine = ~val.astype(bool) & (row_draw(key, draw) < params["subsample"])
                total += histogram(bins, np.where(mine, place[tree.leaves(bins)], -1), len(nodes), g, h)
            flat = total.reshape(-1, 2)
            found = np.flatnonzero(flat.any(axis=1))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found, 0]), pa.array(flat[found, 1])],
                                                 names=["cell", "g", "h"])

        out = np.zeros((len(nodes) * features * BINS, 2), np.int64)
        cells = state.mapInArrow(add_up, "cell bigint, g bigint, h bigint").groupBy("cell").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out[cells.column("cell").to_numpy()] = np.stack([cells.column("g").to_numpy(), cells.column("h").to_numpy()], axis=1)
        return out.reshape(len(nodes), features, BINS, 2)

    return level_sums


def _with_margins(state: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, *_, margin = _arrays(batch, features)
            margin = margin + sum((t.margins(bins) for t in trees), np.zeros(len(margin)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], names=batch.schema.names)

    return state.mapInArrow(add, state.schema)


def validation_area(rows: DataFrame) -> float:
    """``pr_area`` of a table (margin, y), by running sums over distinct margins."""
    points = rows.groupBy("margin").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    p = points.agg(F.sum("pos")).first()[0] or 0
    if not p:
        return 0.0
    c = running_sums(points, [F.col("margin").desc()], ["pos", "n"])
    precision = F.col("pos_cum") / F.col("n_cum")
    before = F.col("n_cum") - F.col("n")
    last = F.when(before > 0, (F.col("pos_cum") - F.col("pos")) / F.when(before > 0, before)).otherwise(precision)
    return float(c.agg(F.sum(F.col("pos") / F.lit(float(p)) * (precision + last) / 2)).first()[0])


def fit_table(state: DataFrame, params: dict, features: int, max_rounds: int, patience: int, seed: int,
              area: Callable[[DataFrame], float] = validation_area) -> tuple[list[Tree], list[float]]:
    """Boosting over a table of any size: a job per level and the validation area per round."""
    trees: list[Tree] = []
    pending: list[Tree] = []
    scores: list[float] = []
    for number in range(max_rounds):
        sums = _level_sums(state, pending, params, features, seed * 1_000_003 + number)
        trees.append(grow(sums, params, tree_columns(params, features, seed, number)))
        pending.append(trees[-1])
        scores.append(area(_with_margins(state.where("val"), pending, features).select("margin", "y")))
        if stopping_round(scores, patience)[1] is not None:
            break
        if len(pending) == ROUNDS_A_CHECKPOINT:
            state, pending = _with_margins(state, pending, features).checkpoint(), []
    return trees, scores


def _packed(tree: Tree) -> list:
    return [tree.feature.tolist(), tree.bin.tolist(), tree.left.tolist(), tree.right.tolist(), tree.value.tolist()]


def _unpacked(parts: list) -> Tree:
    return Tree(*(np.array(p, np.int64) for p in parts[:4]), np.array(parts[4], np.float64))


def class_weight(df: DataFrame, label: str) -> float:
    """M6: negatives a positive; positives weigh that much."""
    bal = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not bal["p"]:
        raise ValueError(f"no positive examples for {label}: cannot train")
    return bal["n"] / bal["p"]


def fit_models(train: DataFrame, val: DataFrame, label: str, features: list[str], sets: list[dict], max_rounds: int,
               patience: int = PATIENCE, seed: int = 42, in_task_rows: int = IN_TASK_ROWS) -> list[Model]:
    """A model for each parameter set, with early stopping by the validation area. The trees end with the
    round at which training stopped."""
    empty = Model(feature_cuts(train, features), [], [])
    state = binned(train, val, label, features, empty, class_weight(train, label))
    if state.count() > in_task_rows:
        found = [fit_table(state, params, len(features), max_rounds, patience, seed) for params in sets]
        return [Model(empty.cuts, trees, scores) for trees, scores in found]
    spark, width = train.sparkSession, len(features)
    data = spark.sparkContext.broadcast(_arrays(state.orderBy("key").toArrow(), width)[:-1])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, text in zip(batch["number"], batch["params"], strict=True):
                bins, y, weight, key, is_val = data.value
                trees, scores = fit_rows(bins, y, weight, key, is_val.astype(bool), json.loads(text), max_rounds, patience, seed)
                yield pd.DataFrame({"number": [number], "trees": [json.dumps([_packed(t) for t in trees])], "scores": [scores]})

    jobs = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(sets)], "number int, params string")
    fitted = (jobs.repartitionByRange(len(sets), "number").mapInPandas(fit, "number int, trees string, scores array<double>")
              .collect())
    return [Model(empty.cuts, [_unpacked(t) for t in json.loads(r["trees"])], list(r["scores"]))
            for r in sorted(fitted, key=lambda r: r["number"])]


def probability(model: Model, features: list[str]) -> Column:
    """Probability of label 1; the model travels with the function (rounds * nodes numbers)."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        rows = np.array([[np.nan if v is None else v for v in r] for r in x], np.float64)
        return pd.Series(1 / (1 + np.exp(-model.margins(rows))))

    return score(F.array(*(F.col(f).cast("double") for f in features)))


def node_table(model: Model) -> list[tuple]:
    """The model as rows (tree, node, feature, threshold, left, right, value); a leaf has feature -1."""
    out = []
    for t, tree in enumerate(model.trees):
        for n in range(len(tree.feature)):
            f, b = int(tree.feature[n]), int(tree.bin[n])
            cuts = model.cuts[f]
            at = None if f < 0 else float(cuts[b]) if b < len(cuts) else float("inf")
            out.append((t, n, f, at, int(tree.left[n]), int(tree.right[n]), float(tree.value[n])))
    return out


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double"


def model_of_nodes(rows: list, features: int) -> Model:
    """A scoring model from a node table: its cuts are the thresholds that the trees use."""
    cuts = [np.unique(np.array([r["threshold"] for r in rows if r["feature"] == f], np.float64)) for f in range(features)]
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        by.setdefault(r["tree"], []).append(r)
    trees = [Tree(np.array([r["feature"] for r in own]),
                  np.array([int(np.searchsorted(cuts[r["feature"]], r["threshold"])) if r["feature"] >= 0 else 0 for r in own]),
                  np.array([r["left"] for r in own]), np.array([r["right"] for r in own]), np.array([r["value"] for r in own]))
             for own in by.values()]
    return Model(cuts, trees, [])
