"""J1, approximate: an inverted-file index over vectors, searched by probing its nearest cells.

``build_index`` fits the cell centres on at most ``SAMPLE_ROWS`` rows (the first by
a hash of their ids) by spherical k-means and places every row in the cell of its
nearest centre. There are about ``sqrt(n)`` cells. A search looks at the ``probes``
cells nearest to a query, scores their rows exactly and keeps the best ``k``, so
its work is queries * n * probes / cells instead of queries * n.

Nothing is capped: a cell with more than ``CELL_ROWS`` rows is split into parts by
id, and a cell that many queries probe into parts of queries; every (cell, part,
query part) is one task's group with two bounded sides, and a query meets all
parts of a cell. What reaches the driver or is broadcast is the sample, the
centres and the parts of each cell, all bounded by parameters.

Not-a-number components count as zero and a zero vector has cosine 0 with all;
rows with a null id, a null vector, a null component or another length than most of
the sample are not indexed, and queries like that find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .similarity import QUERY_TILE, unit_rows

SAMPLE_ROWS = 20_000
MOST_CELLS = 4_096
CELL_ROWS = 20_000
ROUNDS = 8
SEED = 7


@dataclass
class VectorIndex:
    """``rows``: (id, v, cell, part), checkpointed; ``parts``: (cell, parts), one row a cell."""

    centres: np.ndarray
    rows: DataFrame
    parts: DataFrame

    def save(self, path: str) -> None:
        """The index as plain tables, the rows in a folder per cell."""
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        self.parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
        self.rows.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


def load_index(spark, path: str) -> VectorIndex:
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    rows = spark.read.parquet(f"{path}/rows")
    return VectorIndex(np.array(centres, np.float64), rows.select("id", "v", F.col("cell").cast("int").alias("cell"), "part"),
                       spark.read.parquet(f"{path}/parts"))


def spherical_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres of unit length; an empty cell starts anew at the row that fits its cell worst."""
    rows = unit_rows(sample)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        scores = rows @ centres.T
        cell, fit = scores.argmax(axis=1), scores.max(axis=1)
        worst = iter(np.argsort(fit, kind="stable"))
        for j in range(len(centres)):
            own = rows[cell == j]
            centres[j] = own.sum(axis=0) if len(own) else rows[next(worst)]
        centres = unit_rows(centres)
    return centres


def _whole(df: DataFrame, vec: str, dim: int | None = None) -> DataFrame:
    v = F.col(vec)
    kept = df.where(v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)))
    return kept.where(F.size(v) == dim) if dim is not None else kept


def _near_cells(df: DataFrame, vec: str, centres: np.ndarray, probes: int) -> DataFrame:
    """The columns with ``cells``: the numbers of the ``probes`` nearest centres, nearest first."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = unit_rows(np.vstack(batch[vec].to_numpy()).astype(np.float64)) @ centres.T
                order = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield batch.assign(cells=list(order))

    return df.mapInPandas(near, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def build_index(corpus: DataFrame, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None,
                sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Index every row of ``corpus`` with a whole vector."""
    checkpoint_dir(corpus.sparkSession)
    rows = _whole(corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v").where("id is not null")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()]
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    rows = rows.where(F.size("v") == dim)
    wanted = cells or min(MOST_CELLS, max(1, math.isqrt(rows.count())))
    held = np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim)
    centres = spherical_centres(held, min(wanted, len(held))) if len(held) else held
    if not len(centres):
        centres = np.zeros((1, dim))
    placed = (_near_cells(rows, "v", centres, 1).select("id", "v", F.col("cells")[0].alias("cell")).checkpoint())
    parts = (placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
             .select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")).checkpoint())
    split = (placed.join(F.broadcast(parts), "cell")
             .select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).checkpoint())
    return VectorIndex(centres, split, parts)


def search_index(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", vec_col: str = "embedding",
                 probes: int = 8, exclude_self: bool = False, query_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, neighbor_id, rank, score) of the best ``k`` rows in the ``probes`` nearest cells of every query.

    Scores are exact, (1 + cos) / 2; ties go to the smaller id.
    """
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be >= 1")
    checkpoint_dir(queries.sparkSession)
    q = _whole(queries.select(F.col(query_id).alias("qid"), F.col(vec_col).cast("array<double>").alias("qv")), "qv",
               index.centres.shape[1]).where("qid is not null")
    probed = (_near_cells(q, "qv", index.centres, probes).select("qid", "qv", F.explode("cells").alias("cell")).checkpoint())
    shares = (probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
              .select("cell", F.ceil(F.col("n") / query_rows).cast("int").alias("shares")).join(index.parts, "cell"))
    shares = F.broadcast(shares.checkpoint())  # a row per cell
    left = (probed.join(shares, "cell")
            .select("qid", "qv", "cell", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int").alias("share"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    right = (index.rows.join(shares.select("cell", "shares"), "cell")
             .select("id", "v", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))

    def best(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": qdf["qid"].iloc[:0], "cid": cdf["id"].iloc[:0], "cos": np.zeros(0)})]
        if len(qdf) and len(cdf):
            qids, ids = qdf["qid"].to_numpy(), cdf["id"].to_numpy()
            qm, cm = (unit_rows(np.vstack(x.to_numpy()).astype(np.float64)) for x in (qdf["qv"], cdf["v"]))
            own = min(k, len(ids))
            for start in range(0, len(qids), QUERY_TILE):
                scores = qm[start:start + QUERY_TILE] @ cm.T
                if exclude_self:
                    scores[qids[start:start + QUERY_TILE, None] == ids] = -np.inf
                least = np.partition(scores, len(ids) - own, axis=1)[:, len(ids) - own]
                at, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                found.append(pd.DataFrame({"qid": qids[start + at], "cid": ids[col], "cos": scores[at, col]}))
        return (pd.concat(found).sort_values(["qid", "cos", "cid"], ascending=[True, False, True])
                .groupby("qid", sort=False).head(k))

    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("cid", index.rows.schema["id"].dataType),
                           T.StructField("cos", T.DoubleType())])
    keys = ("cell", "part", "share")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)
    order = Window.partitionBy("qid").orderBy(F.col("cos").desc(), F.col("cid").asc())
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(query_id), F.col("cid").alias("neighbor_id"), F.col("rank").cast("int").alias("rank"),
                    F.round((1 + F.col("cos")) / 2, 4).alias("score")))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row: queries with an exact answer, and the share of exact (query, neighbor) pairs that were found."""
    hits = exact.join(found.select(query_id, "neighbor_id", F.lit(1).alias("hit")), [query_id, "neighbor_id"], "left")
    return hits.agg(F.count_distinct(query_id).alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
