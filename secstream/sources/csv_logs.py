"""CSV log files to keyed messages, with delivery accounting.

Files come from a list (a missing one is an error) or a folder's ``*.csv``.
They are read by header: files with the same header make one scan that Spark
splits freely, so the plan grows with the number of headers, not of files.
Columns are found by name; a column that a family lacks is null.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logtype import log_type_from_file
from . import envelope

# ---- fixed values: texts that the usual CSV readers take for a missing value ----
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ---------------------------------------------------------------------------------


def discover(spark: SparkSession, paths: list[str] | None = None, folder: str | None = None) -> list[str]:
    """The listed files, each of which must exist, or the folder's sorted ``*.csv``; none is an error."""
    if (paths is None) == (folder is None):
        raise ValueError("give paths or folder")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if paths is not None:
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            if not path.getFileSystem(conf).exists(path):
                raise FileNotFoundError(f"File not found: {p}")
        found = list(paths)
    else:
        pattern = jvm.org.apache.hadoop.fs.Path(folder, "*.csv")
        found = sorted(st.getPath().toString() for st in pattern.getFileSystem(conf).globStatus(pattern) or [])
    if not found:
        raise FileNotFoundError("No files to ingest.")
    return found


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)


def _value(wire: str, dtype: T.DataType, header: tuple[str, ...]) -> Column:
    if wire not in header:
        # an absent label counts as 0
        return F.lit(0.0 if wire in ("sus", "evil") else None).cast(dtype)
    text = F.col(f"`{wire}`")
    known = F.when(~text.isin(*NA_TEXTS), text)
    return known.try_cast(dtype) if isinstance(dtype, T.DoubleType) else known


def read_csv_logs(spark: SparkSession, files: list[str], multi_line: bool = False) -> DataFrame:
    """S1 + S3: (source_file, log_type, raw, split_start, row_in_split), one row per record.

    ``source_file`` is the last ``*.csv`` name given, so a folder of part files
    named like a file counts as that file. Records that span lines need
    ``multi_line``, which reads each file in one task. ``split_start`` and ``row_in_split``
    order the records of a file. An absent label column gives label 0, an empty cell null.
    """
    by_header = defaultdict(list)
    for f in files:
        by_header[tuple(_reader(spark, multi_line).csv(f).columns)].append(f)
    out = None
    for columns, group in by_header.items():
        # enforceSchema off: a part file whose own header differs is an error, not shifted columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = [_value(wire.name, inner.dataType, columns).alias(inner.name)
               for inner, wire in zip(envelope.RAW_SCHEMA.fields, envelope.WIRE_RAW_SCHEMA.fields)]
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.csv)(/[^/]*)?$", 1)
        df = _reader(spark, multi_line).schema(schema).option("enforceSchema", False).csv(group).select(
            name.alias("source_file"), log_type_from_file(name).alias("log_type"), F.struct(*raw).alias("raw"),
            F.concat_ws("#", F.col("_metadata.file_path"),
                        F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")).alias("split_start"),
            F.monotonically_increasing_id().alias("row_in_split"))
        out = df if out is None else out.unionByName(df)
    return out


def write_keyed(messages: DataFrame, path: str) -> DataFrame:
    """S5 + S6: append messages to the sink; returns the delivery report.

    Nothing is shuffled: a task writes the records of its splits as it reads
    them, so a file that holds most of the rows is spread over its splits, and
    (key, split_start, row_in_split) orders the rows of one file. A topic sink
    takes the same ``key`` and ``value``. Of the report's columns ``rows_read`` counts what
    entered the sink in all, ``delivered`` what lies in it per key.
    """
    seen = Observation()
    messages.observe(seen, F.count(F.lit(1)).alias("rows_read")).write.mode("append").parquet(path)
    sink = messages.sparkSession.read.parquet(path)
    return sink.groupBy(F.col("key").alias("source_file")).agg(F.count(F.lit(1)).alias("delivered")) \
        .withColumn("rows_read", F.lit(int(seen.get["rows_read"])).cast("bigint"))
