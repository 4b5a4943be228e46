"""T6 with G-3: from chat requests to the metadata-only audit as one stream.

A request arrives whole, as one row with its messages. Validation (F9), the joined text (G-2), its token
estimate (X17) and its personal-data types (A15) are expressions on that row, so no text goes further than
the row it came in; the caller's token bucket (T3) is the stream's only state. Requests that are valid and
allowed are appended to the audit (G-4, G-5), in files that hold each request once: the sink commits a
micro-batch with the checkpoint, so a restart neither loses nor repeats a row.

Defined cases: a request without messages, with a null role, or with a null or empty content is invalid; a
null caller is a caller of its own; calls of one caller in a micro-batch are taken in order of time, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pii import detected_types
from ..operators.policy import MAX_CONTENT_CHARS, MAX_MESSAGES, ROLES, audit_rows, words
from .ratelimit import rate_limit_stream


def request_bodies(requests: DataFrame, messages: DataFrame, request_col: str = "conv_id", order_col: str = "turn",
                   role_col: str = "role", content_col: str = "text") -> DataFrame:
    """Requests with their messages in one row, as a gateway receives them.

    A body is read only just beyond its limits: one message and one character more than allowed. It is refused
    either way, and no body grows with the data. The rank's bound prunes before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(request_col).orderBy(order_col))
    bounded = (messages.select(request_col, F.col(order_col).alias("place"), F.col(role_col).alias("role"),
                               F.substring(content_col, 1, MAX_CONTENT_CHARS + 1).alias("content"), place.alias("_n"))
               .where(F.col("_n") <= MAX_MESSAGES + 1))
    bodies = bounded.groupBy(request_col).agg(F.sort_array(F.collect_list(F.struct("_n", "role", "content"))).alias("messages"))
    return requests.join(bodies.withColumn("messages", F.transform(
        "messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))), request_col, "left")


def _valid(messages: Column) -> Column:
    """F9 on the messages of one row."""
    good = F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))
                    & F.coalesce(F.length(m["content"]), F.lit(0)).between(1, MAX_CONTENT_CHARS))
    return F.coalesce(F.size(messages).between(1, MAX_MESSAGES) & good, F.lit(False))


def audit_stream(requests: DataFrame, rate_per_minute: float, burst: float, request_col: str = "conv_id",
                 caller_col: str = "caller_id", time_col: str = "request_ts", model: str = "chat-model") -> DataFrame:
    """Audit rows of a stream of requests (``messages``: array of role and content), with the request's id."""
    m = F.col("messages")
    tokens = F.aggregate(m, F.lit(0).cast("bigint"), lambda n, x: n + words(x["content"]))
    valid = requests.where(_valid(m)).select(
        F.col(request_col).alias("id"), F.col(caller_col).alias("caller"), F.col(time_col).alias("at"),
        F.unix_micros(time_col).alias("at_us"), tokens.alias("prompt_tokens"),
        F.array_join(detected_types(F.array_join(F.transform(m, lambda x: x["content"]), " ")), ",").alias("pii"))
    calls = rate_limit_stream(valid, "caller", "at", "id", rate_per_minute, burst, keep=("at_us", "prompt_tokens", "pii"))
    found = F.filter(F.split("pii", ","), lambda t: t != "")
    decided = calls.select(
        F.col("id").alias("request_id"), F.col("caller").alias("caller_id"), F.timestamp_micros("at_us").alias("request_ts"),
        "prompt_tokens", found.alias("pii_types"), F.lit(model).alias("model"),
        F.when(~F.col("allowed"), "rate_limited").when(F.size(found) > 0, "blocked_pii").otherwise("forwardable").alias("decision"))
    return audit_rows(decided, keep=("request_id",)).drop("_t")


def run_audit(spark: SparkSession, requests: DataFrame, audit_path: str, checkpoint: str, rate_per_minute: float,
              burst: float, **columns: str) -> None:
    """Drain a stream of requests into the append-only audit table."""
    rows = audit_stream(requests, rate_per_minute, burst, **columns)
    q = (rows.writeStream.format("parquet").option("path", audit_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
