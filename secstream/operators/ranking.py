"""Exact ranks and running sums without a single-partition window.

A ``Window`` with no ``partitionBy`` (or partitioned by a handful of strata)
puts a whole table, or a third of it, into one task. These helpers instead
range-partition the rows by (group, order), number them inside each task,
and add per-task offsets taken from a table of one row per (task, group):
that table is bounded by ``partitions + groups`` rows. The result is the
exact rank / running sum, computed by all tasks in parallel.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    return int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_rank(df: DataFrame, group_cols: list[str], order_cols: list, rank_col: str = "rank",
               num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` within each group by ``order_cols`` (ascending;
    the order must be total, e.g. end with a unique id)."""
    keys = [*group_cols, *order_cols]
    s = (df.repartitionByRange(_parts(df, num_partitions), *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
         .persist(StorageLevel.MEMORY_AND_DISK))
    blocks = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # null groups are groups: the join must not lose them
    b = blocks.select(F.col("_pid").alias("_bp"), *(F.col(c).alias(f"_b_{c}") for c in group_cols), "_off", "_m0")
    same = F.col("_pid") == F.col("_bp")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    out = s.join(b, same).drop("_bp", *(f"_b_{c}" for c in group_cols))
    return out.withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint")).drop(
        "_pid", "_mid", "_off", "_m0")


def running_sums(df: DataFrame, order_cols: list, value_cols: list[str], suffix: str = "_cum",
                 num_partitions: int | None = None) -> DataFrame:
    """Inclusive global running sums of ``value_cols`` in ``order_cols`` order
    (the order must be total). Each output column is ``<value><suffix>``."""
    s = (df.repartitionByRange(_parts(df, num_partitions), *order_cols)
         .withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK))
    totals = s.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per task: tiny
    totals = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}")
                                     for v in value_cols])
    inner = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    s = s.join(F.broadcast(totals), "_pid")
    for v in value_cols:
        s = s.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.sum(v).over(inner))
    return s.drop("_pid", *[f"_o_{v}" for v in value_cols])
