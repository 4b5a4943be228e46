"""Per-caller token bucket over timestamped calls.

A bucket starts full (``burst`` tokens) at the caller's first call; before each
call it refills by ``elapsed_seconds * rate_per_minute / 60`` capped at
``burst``; the call is allowed when at least one token is there and then
consumes one; a rejected call consumes nothing.

The bucket is a sequential state machine, but not over all of a caller's calls:
after ``burst / rate`` seconds without a call the bucket is full whatever was
before. Each caller's calls are cut there into segments, found by carrying the
last call's time and the last segment's start over ranges of (caller, time, id)
(``carry``), so a caller with a third of all calls is spread over tasks. Segments
are hash-partitioned and sorted inside each partition — a sort that spills — and an
Arrow-batched ``mapInPandas`` walks the sorted rows carrying only the current
segment's ``(tokens, last)`` across batches. A caller that never pauses that long is
one segment, streamed by one task in bounded memory. The streaming form
(``secstream.streaming.ratelimit``) keeps the same state in the state store between
micro-batches. Calls need a time: one without is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .carry import carry, place

# ---- fixed values (reference defaults) -------------------------------------
DEFAULT_RATE_PER_MINUTE = 60.0
DEFAULT_BURST = 10.0
# ---------------------------------------------------------------------------


def bucket_walk(callers: np.ndarray, micros: np.ndarray, rate_per_sec: float, burst: float,
                state: dict | None = None, levels: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Walk calls already sorted by (caller, time). Returns allowed, level
    before the call (T4), level after, and the carried state of the last caller.
    ``levels`` holds the (tokens, last) with which known callers start; others start full."""
    n = len(callers)
    allowed = np.zeros(n, dtype=bool)
    before = np.zeros(n, dtype=np.float64)
    after = np.zeros(n, dtype=np.float64)
    cur = state.get("caller") if state else None
    tokens = state.get("tokens", burst) if state else burst
    last = state.get("last", 0) if state else 0
    levels = levels or {}
    for i in range(n):
        c = callers[i]
        t = int(micros[i])
        if c != cur:
            cur = c
            tokens, last = levels.get(c, (float(burst), t))
        elapsed = max(t - last, 0) / 1e6
        tokens = min(burst, tokens + elapsed * rate_per_sec)
        last = max(last, t)
        before[i] = tokens
        if tokens >= 1.0:
            tokens -= 1.0
            allowed[i] = True
        after[i] = tokens
    return allowed, before, after, {"caller": cur, "tokens": tokens, "last": last}


def segments(slim: DataFrame, rate_per_sec: float, burst: float, tasks: int | None = None) -> DataFrame:
    """(id, caller, t_us) -> with ``segment``, a number for each run of calls of a caller without a pause in
    which an empty bucket fills. The pause is judged by the walk's own arithmetic, so both agree to the bit."""
    placed = place(slim, ["caller"], ["t_us", "id"], tasks)
    timed = carry(placed, F.col("t_us"), "last_us")
    refill = (F.col("t_us") - F.col("last_us")) / F.lit(1e6) * F.lit(rate_per_sec)
    starts = F.when(F.col("last_us").isNull() | (refill >= F.lit(float(burst))), F.col("_mid"))
    return carry(timed, starts, "segment", inclusive=True).drop("_pid", "_mid", "_key", "last_us")


def rate_limit(calls: DataFrame, caller_col: str, time_col: str, id_col: str,
               rate_per_minute: float = DEFAULT_RATE_PER_MINUTE, burst: float = DEFAULT_BURST,
               num_partitions: int | None = None) -> DataFrame:
    """T3 + T4 over a table of calls -> (id, caller, allowed, available, tokens)."""
    if rate_per_minute <= 0 or burst < 1:
        raise ValueError("rate_per_minute must be > 0 and burst >= 1")
    rate_per_sec = rate_per_minute / 60.0
    slim = calls.select(F.col(id_col).alias("id"), F.col(caller_col).cast("string").alias("caller"),
                        F.unix_micros(F.col(time_col).cast("timestamp")).alias("t_us"))
    parts = int(num_partitions or calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (segments(slim, rate_per_sec, burst, parts).repartition(parts, "segment")
               .sortWithinPartitions("segment", "t_us", "id"))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = T.StructType([
        T.StructField("id", T._parse_datatype_string(id_type)), T.StructField("caller", T.StringType()),
        T.StructField("allowed", T.BooleanType()), T.StructField("available", T.DoubleType()),
        T.StructField("tokens", T.DoubleType()),
    ])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for b in batches:
            allowed, before, after, state = bucket_walk(b["segment"].to_numpy(), b["t_us"].to_numpy(),
                                                        rate_per_sec, burst, state)
            yield pd.DataFrame({"id": b["id"], "caller": b["caller"], "allowed": allowed,
                                "available": before, "tokens": after})

    return ordered.mapInPandas(walk, schema)
