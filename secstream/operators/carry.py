"""The previous row, or the last value before a row, without gathering a key in one task.

``lag`` and ``last(..., ignorenulls)`` over ``partitionBy(key).orderBy(time)`` give one task all
rows of a key. Here the rows are placed by range over (key, order): a key that holds a third of all
rows is spread over the tasks its rows need. A task works out the value inside its range; a
table of one row per task says what the first key of each range had before it:

* each task reports the last value of its last key, and whether its whole range is one key;
* the value carried into a range is that of the nearest earlier range whose last key is the
  range's first key.

That table has as many rows as there are ranges, whatever the data, and is broadcast. The placed
rows are written by ``checkpoint()``, so their ranges stay the same when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import _parts

_USED = ("_pid", "_mid", "_key", "_val", "_in", "_from", "_first", "_carried")


def place(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """The rows in ranges of (keys, order), numbered, and written once; ``carry`` works on the result."""
    if not keys:
        raise ValueError("name at least one key")
    clash = [c for c in _USED if c in df.columns]
    if clash:
        raise ValueError(f"columns of these names are used inside: {clash}")
    n = _parts(df, tasks)
    placed = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return (placed.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
            .withColumn("_key", F.struct(*keys)).checkpoint())


def carry(placed: DataFrame, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Placed rows with ``name``: the last non-null ``value`` of the earlier rows of their keys
    (``inclusive``: or of the row itself), null where there is none. Can be called again on its result."""
    if name in placed.columns:
        raise ValueError(f"there is a column {name!r} already")
    s = placed.withColumn("_val", value)
    s = s.withColumn("_val", F.when(F.col("_val").isNotNull(), F.struct(F.col("_val").alias("v"))))
    # inside a range: one window per (range, key), never the key alone
    frame = Window.partitionBy("_pid", "_key").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    inner = s.withColumn("_in", F.last("_val", ignorenulls=True).over(frame))
    # one row per range: its first key, its last key and the last value of that one
    by_key = s.groupBy("_pid", "_key").agg(
        F.min("_mid").alias("low"), F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_mid"))).alias("tail"))
    ends = by_key.groupBy("_pid").agg(
        F.min_by("_key", "low").alias("_first"),
        F.max_by(F.struct(F.col("_key").alias("key"), "tail"), "low").alias("final"))
    # over the table of ranges: the nearest earlier one that ends with a value
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("final.tail").isNotNull(), F.col("final")), ignorenulls=True).over(earlier)
    ends = ends.withColumn("known", known).where(F.col("known.key").eqNullSafe(F.col("_first"))).select(
        F.col("_pid").alias("_from"), "_first", F.col("known.tail").alias("_carried"))
    same = (F.col("_pid") == F.col("_from")) & F.col("_key").eqNullSafe(F.col("_first"))
    out = inner.join(F.broadcast(ends), same, "left")
    return out.withColumn(name, F.coalesce("_in", "_carried")["v"]).drop("_val", "_in", "_from", "_first", "_carried")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool = False,
                tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of the earlier rows of the same keys
    (``inclusive``: or of the row itself), null where there is none.

    ``order`` names columns that order a key's rows, ending with one that breaks ties: rows
    equal in all of them have no defined order. Nulls sort first; a null key is a key of its
    own. Other columns are kept as they are; an empty table stays empty.
    """
    return carry(place(df, keys, order, tasks), value, name, inclusive).drop("_pid", "_mid", "_key")


def previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str,
             tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: a struct of ``values`` of the row before (null for a key's first row);
    a null among the values is kept as it is."""
    return last_before(df, keys, order, F.struct(*values), name, tasks=tasks)
