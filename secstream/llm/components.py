"""Connected components of an edge table by alternating large-star and small-star steps.

Every step replaces a vertex's edges by edges to the smallest vertex around it
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Minima
are pre-aggregated in each task, edges stay a table, and every round is cut off
by ``checkpoint()``, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder


#: Edges a task of a round handles: a small table is not spread over as many tasks, and their files, as the texts.
EDGES_PER_TASK = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).coalesce(tasks)
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low")).coalesce(tasks)
    return (both.join(low, "src").where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst")).coalesce(tasks).distinct().coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low")).coalesce(tasks)
    near = down.join(low, "src").where(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return near.unionByName(low.select("src", F.col("low").alias("dst"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the edges (src, dst); the component is its smallest vertex.

    Loops and repeated edges are allowed; a vertex without any edge to another
    one does not appear.
    """
    shared_folder(edges.sparkSession)
    edges = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct().checkpoint()
    tasks = edges.count() // EDGES_PER_TASK + 1  # edges are never more than at the start
    edges = edges.coalesce(tasks)
    state = None
    while True:
        edges = _small_star(_large_star(edges, tasks), tasks).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("component")).unionByName(
                edges.select(F.col("dst").alias("vertex"), F.col("dst").alias("component")).distinct())
        state = now
