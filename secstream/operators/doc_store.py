"""Documents stored so that a search reads only what it needs.

The table is partitioned by the day of ``event_time`` (documents without a time have a
partition of their own) and sorted by host and time inside a day, so a filter skips

* whole days: time bounds also name the partition column (``time_bounds``);
* row groups and pages: host, process, flags and time are pushed to the Parquet
  reader, whose statistics are narrow where rows are clustered.

Rows are placed by range over (day, host, time), not by a hash of the day: a day that
holds a third of all rows is written by as many tasks as its rows need, and a task
writes the few days that its range touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import parse_iso

DAY = "day"
#: Bytes of a row group: small enough for a host of a large day to have its own.
ROW_GROUP_BYTES = 32 << 20


def write_documents(docs: DataFrame, path: str, tasks: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write enriched documents as the stored table at ``path``, which must be new.

    ``tasks`` is the number of ranges (the session's shuffle partitions by default).
    Null hosts and times sort first; an empty input gives an empty table with the schema.
    """
    if DAY in docs.columns:
        raise ValueError(f"the documents already have a column {DAY!r}")
    order = [F.col(DAY), F.col("attributes.host_name"), F.col("event_time"), F.col("doc_id")]
    out = docs.withColumn(DAY, F.to_date("event_time"))
    out = out.repartitionByRange(tasks, *order) if tasks else out.repartitionByRange(*order)
    (out.sortWithinPartitions(*order).write.mode("errorifexists").option("parquet.block.size", row_group_bytes)
     .partitionBy(DAY).parquet(path))


def read_documents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The stored documents, with the partition column ``day``.

    ``schema`` is that of the documents written: without it Spark infers one from a file.
    """
    if schema is None:
        return spark.read.parquet(path)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != DAY]
    return spark.read.schema(", ".join([*fields, f"`{DAY}` date"])).parquet(path)


def time_bounds(start: Column | None = None, end: Column | None = None, time_col: str = "event_time") -> Column:
    """``start <= time <= end`` with the same bounds on the days: the partitions outside are not listed."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(DAY) >= F.to_date(start)) & (F.col(time_col) >= start)
    if end is not None:
        cond = cond & (F.col(DAY) <= F.to_date(end)) & (F.col(time_col) <= end)
    return cond


def request_bounds(timestamp_from: str | None = None, timestamp_to: str | None = None) -> Column:
    """The day bounds of a search request; empty or absent texts bound nothing."""
    start = parse_iso(F.lit(timestamp_from)) if timestamp_from else None
    end = parse_iso(F.lit(timestamp_to)) if timestamp_to else None
    return time_bounds(start, end)
