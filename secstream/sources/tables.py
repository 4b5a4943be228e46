"""Readers for the driver tables (one parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

READ_TASKS = "spark.secstream.read.tasks"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; a column list is applied right at the scan (ReadSchema).

    A file with one row group is one split, however many cores there are. Where the
    tables are stored that way, a session may set ``spark.secstream.read.tasks`` to a
    number of tasks over which every table read is spread; unset (the default, and
    right for tables of many row groups) the scan is left as it is.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    tasks = int(spark.conf.get(READ_TASKS, "0"))
    return df.repartition(tasks) if tasks > 0 else df
