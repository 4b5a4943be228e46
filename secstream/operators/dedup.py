"""Last row per id, and a replay-safe upsert into a folder of Parquet batches.

A batch of a stream overwrites its own folder (``run=<checkpoint>/batch=<id>``), so
a replayed batch replaces itself and a stopped one leaves no row behind: Spark's
committer shows a folder's files only when the write has ended. The current
table is an aggregate over the batches, the last written row per key; ``compact``
is an ordinary job that writes it to a place of its own. Nothing old is read or
rewritten when a batch arrives.

``latest_per_key`` is a hash aggregate (``max_by`` over the ordering
column), so duplicates collapse with a map-side partial aggregate before the
shuffle; a key that is re-delivered many times costs one partial row per map
task. No window sort over the whole input is needed.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, WRITTEN = "upsert_key", "upsert_written"


def latest_per_key(df: DataFrame, key: str, order: str, count_as: str | None = None) -> DataFrame:
    """Keep, per ``key``, the row with the greatest ``order`` (ties: the one
    with the greatest hash of its other columns, so a rerun keeps the same row). Optionally count the copies."""
    others = [c for c in df.columns if c != key]
    aggs = [F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("_last")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(key).agg(*aggs).select(key, "_last.*", *([count_as] if count_as else []))
    return out


def batch_path(target_path: str, batch_id: int | None, writer: str = "") -> str:
    """The folder of one batch; batch ids count per writer (a stream: its checkpoint). Without
    an id every call has a folder of its own."""
    run = f"r{hashlib.md5(writer.encode()).hexdigest()[:12]}"
    return f"{target_path}/run={run}/batch={f'n{uuid.uuid4().hex}' if batch_id is None else f'b{batch_id}'}"


def write_batch(rows: DataFrame, target_path: str, batch_id: int | None, writer: str = "") -> None:
    """Write the rows of one batch; the same batch written again replaces them."""
    rows.write.mode("overwrite").parquet(batch_path(target_path, batch_id, writer))


def read_batches(spark, target_path: str) -> DataFrame:
    """The rows of all batches, with the columns ``run`` and ``batch``; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(target_path)


def upsert_parquet(spark, updates: DataFrame, target_path: str, key: str, order: str,
                   batch_id: int | None = None, writer: str = "") -> None:
    """The last row per ``key`` of ``updates`` replaces the table's row of that key. Of
    several batches with a key the one written last has it; one writer at a time."""
    last = latest_per_key(updates, key, order)
    write_batch(last.withColumn(KEY, F.col(key).cast("string")).withColumn(WRITTEN, F.lit(time.time_ns())),
                target_path, batch_id, writer)


def read_upserted(spark, target_path: str) -> DataFrame:
    """The current table: of every key the row written last."""
    rows = read_batches(spark, target_path)
    columns = [c for c in rows.columns if c not in (KEY, WRITTEN, "run", "batch")]
    last = rows.groupBy(KEY).agg(F.max_by(F.struct(*columns), F.col(WRITTEN)).alias("_last"))
    return last.select("_last.*")


def compact(spark, target_path: str, into: str, key: str) -> None:
    """The current table as the only batch of a new folder, evened out by adaptive rebalancing."""
    rows = read_upserted(spark, target_path)
    write_batch(rows.withColumn(KEY, F.col(key).cast("string")).withColumn(WRITTEN, F.lit(time.time_ns())).hint("rebalance"),
                into, 0, "compaction")
