"""Centroid clustering of integer vectors with PCA-rotated filtering.

Every vector becomes integers, ``floor(scale * x)``, and the table is stored once
with the vector's leading coordinates after a rotation onto the principal axes
(fitted on the covariance of all vectors) and the norm of what the other axes
hold. For a centroid with the same parts,

    |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2  <=  |x - c|^2

so a centroid whose left side exceeds the best exact distance cannot be
nearest. The centroid with the least bound is measured first, then those that
survive, in exact integers; equal distances go to the smaller number. The
rotation is floating point, so bounds carry a slack far above its rounding:
the filter decides what is measured, never the result.

A round is one job: each task adds up counts and component sums of its
clusters, the sums meet as one row per cluster, and only the centroids (``k``
rows) reach the driver. The stored table is checkpointed, so a lost executor
costs one round.

Defined cases: vectors that are null, of another length, or that hold a null or
non-finite component take no part and get no row. Repeated rows count each time.
Start vectors with equal hashes (repeated ids) go by their components; a null id
hashes like the empty string. With fewer vectors than ``k`` there are as many
centroids as vectors; an empty table gives an empty result. Other columns are
not read, whatever their names. A component beyond ``2**27`` after scaling raises,
because squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

LEADING = 8
LARGEST = 1 << 27
SLACK = 1e-6


def integer_vectors(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a list column whose lists all have ``dim`` finite items."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.floor(x * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale}: its squared distances do not fit 64 bits")
    return whole.astype(np.int64)


def _whole_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)))


class Rotation:
    """Principal axes of all vectors: the leading ones and the centre."""

    def __init__(self, count: int, sums: np.ndarray, products: np.ndarray, leading: int):
        self.centre = sums / max(count, 1)
        covariance = products / max(count, 1) - np.outer(self.centre, self.centre)
        _, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :leading])

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates and the norm of the rest."""
        moved = x - self.centre
        lead = moved @ self.axes
        rest = np.einsum("ij,ij->i", moved, moved) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0))


def fit_rotation(vectors: DataFrame, vec: str, dim: int, scale: int, leading: int) -> Rotation:
    """Covariance of all vectors: each task sends ``dim`` rows of sums, the driver gets ``dim`` rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = integer_vectors(batch.column(0), dim, scale).astype(np.float64)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums),
                 pa.array(list(products), pa.list_(pa.float64()))], names=["axis", "n", "total", "products"])

    rows = (vectors.select(vec).mapInArrow(moments, "axis int, n bigint, total double, products array<double>")
            .groupBy("axis").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                 F.array(*(F.sum(F.col("products")[j]) for j in range(dim))).alias("products"))
            .orderBy("axis").collect())
    if not rows:
        return Rotation(0, np.zeros(dim), np.zeros((dim, dim)), leading)
    return Rotation(rows[0]["n"], np.array([r["total"] for r in rows]), np.array([r["products"] for r in rows]), leading)


def store(df: DataFrame, vec: str, key: str, dim: int, scale: int, leading: int) -> tuple[DataFrame, Rotation]:
    """The checkpointed table (id, whole, lead, rest) and the rotation behind it."""
    vectors = _whole_vectors(df.select(F.col(key).alias("id"), F.col(vec).alias("vec")), "vec", dim)
    rotation = fit_rotation(vectors, "vec", dim, scale, leading)
    id_type = vectors.schema["id"].dataType.simpleString()

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integer_vectors(batch.column("vec"), dim, scale)
            lead, rest = rotation.split(x.astype(np.float64))
            bounds = np.arange(len(x) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds * dim), pa.array(x.astype(np.int32).ravel())),
                 pa.ListArray.from_arrays(pa.array(bounds * lead.shape[1]), pa.array(lead.ravel())), pa.array(rest)],
                names=["id", "whole", "lead", "rest"])

    shared_folder(df.sparkSession)
    return vectors.mapInArrow(rotate, f"id {id_type}, whole array<int>, lead array<double>, rest double").checkpoint(), rotation


def first_centroids(stored: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors with the ``k`` smallest sha256 of ``salt:id``, in ascending hash order."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = stored.select(F.sha2(name, 256).alias("h"), "whole").orderBy("h", "whole").limit(k).collect()
    return [list(r["whole"]) for r in rows]


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, parts: tuple[np.ndarray, np.ndarray],
            measured: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of every vector's nearest centroid; ``measured`` gets the count of exact distances."""
    c_lead, c_rest = parts
    n = len(x)
    steps = lead[:, None, :] - c_lead
    bound = np.einsum("ijk,ijk->ij", steps, steps) + (rest[:, None] - c_rest) ** 2
    size = (np.einsum("ij,ij->i", lead, lead) + rest ** 2)[:, None] + (np.einsum("ij,ij->i", c_lead, c_lead) + c_rest ** 2)
    bound -= SLACK * (size + 1)

    def exact(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        if measured is not None:
            measured.append(len(rows))
        gap = x[rows] - centroids[numbers]
        return np.einsum("ij,ij->i", gap, gap)

    first = bound.argmin(axis=1) if n else np.zeros(0, np.int64)
    cluster, distance = first.copy(), exact(np.arange(n), first)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= distance) & (first != j))
        if len(rows):
            found = exact(rows, np.full(len(rows), j))
            better = (found < distance[rows]) | ((found == distance[rows]) & (j < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = j, found[better]
    return cluster, distance


def _assigned(batches: Iterator[pa.RecordBatch], dim: int, centroids: np.ndarray, parts):
    """(batch, integers, cluster, distance) of every batch of the stored table."""
    for batch in batches:
        x = batch.column("whole").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        lead = batch.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        rest = batch.column("rest").to_numpy(zero_copy_only=False)
        yield batch, x, *nearest(x, lead, rest, centroids, parts)


def next_centroids(stored: DataFrame, rotation: Rotation, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """One round: componentwise exact floor of the mean of every non-empty cluster."""
    held = np.array(centroids, np.int64)
    parts = rotation.split(held.astype(np.float64))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(held), np.int64), np.zeros((len(held), dim), np.int64)
        for _, x, cluster, _ in _assigned(batches, dim, held, parts):
            n += np.bincount(cluster, minlength=len(held))
            for j in np.unique(cluster):
                total[j] += x[cluster == j].sum(axis=0)
        own = np.flatnonzero(n)
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(own)), pa.int32()),
                 pa.array(np.repeat(n[own], dim)), pa.array(total[own].ravel())], names=["cluster", "axis", "n", "total"])

    rows = (stored.mapInArrow(sums, "cluster int, axis int, n bigint, total bigint").groupBy("cluster", "axis")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    out = [list(c) for c in centroids]
    for r in rows:
        out[r["cluster"]][r["axis"]] = int(r["total"]) // r["n"]
    return out


def cluster_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", dim: int = 64, k: int = 8, rounds: int = 10,
                    scale: int = 1024, salt: str = "3", leading: int = LEADING) -> tuple[DataFrame, list[list[int]]]:
    """(``key``, cluster int, distance long) of every kept vector, checkpointed, and the final centroids."""
    stored, rotation = store(df, vec, key, dim, scale, leading)
    centroids = first_centroids(stored, k, salt)
    id_type = stored.schema["id"].dataType.simpleString()
    schema = f"`{key}` {id_type}, cluster int, distance bigint"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = next_centroids(stored, rotation, centroids, dim)
    held = np.array(centroids, np.int64)
    parts = rotation.split(held.astype(np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(batches, dim, held, parts):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                             names=[key, "cluster", "distance"])

    return stored.mapInArrow(assign, schema).checkpoint(), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(df: DataFrame, vec: str = "embedding", key: str = "vec_id", **options) -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256. A row per cluster is broadcast."""
    placed, centroids = cluster_vectors(df, vec, key, **options)
    own = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster")
           .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = df.sparkSession.createDataFrame(
        [(j, own[j], sum(own.values()), centroid_digest(c)) for j, c in enumerate(centroids) if j in own],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid_sha256")
