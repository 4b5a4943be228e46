"""The transport envelope ``{source_file, log_type, raw}`` as JSON.

Encoding is ``to_json(struct(...))`` keyed by the source file, so a keyed
sink (Kafka, or files partitioned by key) keeps the rows of one file together.
Decoding is ``from_json`` with the declared superset schema; numeric fields
are declared as double so that a bare ``NaN`` in the payload survives the
parse and is cleaned afterwards (X10) instead of nulling the whole record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

# Wire names are the CSV headers. DNS files say ``Timestamp`` and kernel files
# ``timestamp``; Spark resolves names case-insensitively, so inside Spark the
# DNS field is called ``DnsTimestamp`` and the two schemas are converted by
# position (a struct cast), never by name.
RAW_SCHEMA = T.StructType([
    T.StructField("DnsTimestamp", _S), T.StructField("SourceIP", _S), T.StructField("DestinationIP", _S),
    T.StructField("DnsQuery", _S), T.StructField("DnsResponseCode", _D),
    T.StructField("timestamp", _S), T.StructField("eventName", _S), T.StructField("hostName", _S),
    T.StructField("eventId", _D), T.StructField("returnValue", _D), T.StructField("processId", _D),
    T.StructField("parentProcessId", _D), T.StructField("processName", _S), T.StructField("userId", _D),
    T.StructField("threadId", _D), T.StructField("mountNamespace", _D), T.StructField("stackAddresses", _S),
    T.StructField("argsNum", _D), T.StructField("args", _S),
    T.StructField("sus", _D), T.StructField("evil", _D),
])

WIRE_RAW_SCHEMA = T.StructType(
    [T.StructField("Timestamp" if f.name == "DnsTimestamp" else f.name, f.dataType) for f in RAW_SCHEMA.fields])

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("source_file", _S),
    T.StructField("log_type", _S),
    T.StructField("raw", WIRE_RAW_SCHEMA),
])


def encode(df: DataFrame) -> DataFrame:
    """(source_file, log_type, raw) -> (key, value) JSON messages."""
    return df.select(
        F.col("source_file").alias("key"),
        F.to_json(F.struct("source_file", "log_type", F.col("raw").cast(WIRE_RAW_SCHEMA).alias("raw")))
        .alias("value"),
        *[c for c in df.columns if c not in ("source_file", "log_type", "raw")],
    )


def clean_number(c: Column) -> Column:
    """NaN and +-Infinity become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def python_number_text(text: Column) -> Column:
    """A JSON number read into a string field comes back in Java notation
    (``1.621184E9``); the reference stringifies the parsed float the Python
    way (``1621184000.0``). Integral values below 1e16 are rewritten so;
    other text is left as is."""
    javaish = text.rlike(r"^-?[0-9]+(\.[0-9]+)?E-?[0-9]+$")
    d = text.try_cast("double")
    integral = d.isNotNull() & (d == F.floor(d)) & (F.abs(d) < F.lit(1e16))
    return F.when(javaish & integral, F.concat(F.floor(d).cast("bigint").cast("string"), F.lit(".0"))).otherwise(text)


def _quoted_number(value: Column, name: str) -> Column:
    """A number sent as text, such as ``"userId":"0"``; the JSON reader gives null for it."""
    text = value.cast("string")
    quoted = F.regexp_extract(text, f'"{name}"\\s*:\\s*"([^"\\\\]*)"', 1)
    # only a message that quotes this field pays for the pattern
    return F.when(F.instr(text, f'"{name}":"') + F.instr(text, f'"{name}": "') > 0, quoted.try_cast("double"))


def decode(messages: DataFrame, value_col: str = "value", more_fields: dict[str, T.DataType] | None = None) -> DataFrame:
    """JSON messages -> (source_file, log_type, raw) with numbers cleaned. ``more_fields``: raw
    fields of further log types, read in the same pass."""
    more = [T.StructField(n, t) for n, t in (more_fields or {}).items()]
    schema = T.StructType([*ENVELOPE_SCHEMA.fields[:2], T.StructField("raw", T.StructType([*WIRE_RAW_SCHEMA.fields, *more]))])
    raw_schema = T.StructType([*RAW_SCHEMA.fields, *more])
    parsed = messages.withColumn("_env", F.from_json(F.col(value_col).cast("string"), schema,
                                                     {"allowNonNumericNumbers": "true"}))
    parsed = parsed.withColumn("_raw", F.col("_env.raw").cast(raw_schema))
    raw_fields = []
    for f in raw_schema.fields:
        c = F.col(f"_raw.{f.name}")
        if isinstance(f.dataType, T.DoubleType):
            c = clean_number(c)
            if f.name in ("sus", "evil"):
                # an absent label key means 0; a null or NaN label stays null
                c = F.when(c.isNull() & (F.instr(F.col(value_col).cast("string"), f'"{f.name}"') == 0), F.lit(0.0)).otherwise(c)
            else:
                c = F.coalesce(c, clean_number(_quoted_number(F.col(value_col), f.name)))
        elif f.name == "timestamp":
            c = python_number_text(c)
        raw_fields.append(c.alias(f.name))
    keep = [c for c in messages.columns if c not in (value_col, "key")]
    return parsed.select(
        *keep,
        F.col("_env.source_file").alias("source_file"),
        F.col("_env.log_type").alias("log_type"),
        F.when(F.col("_raw").isNull(), F.lit(None)).otherwise(F.struct(*raw_fields)).alias("raw"),
    )
