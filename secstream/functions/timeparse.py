"""X16 and friends: ISO-8601 text <-> timestamps, epoch seconds.

Only explicit ISO patterns are accepted, so bare times such as ``17:13:14``
or numeric text such as ``1621184000.0`` stay unparsed (G6) instead of being
silently read as some date. Text without an offset is read in the session
time zone, which the library pins to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd' 'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd' 'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd",
)


def parse_iso(text: Column, numeric_epoch: bool = False) -> Column:
    """ISO text -> timestamp (null when unparseable).

    ``numeric_epoch=True`` additionally reads numeric text as epoch seconds
    (an option; the default reproduces the reference, where such kernel
    timestamps are unparseable and land in bucket 0).
    """
    # digits past the microsecond are cut and an offset without a colon gets one, as ISO readers do
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in ISO_PATTERNS])
    if numeric_epoch:
        secs = t.try_cast("double")
        parsed = F.coalesce(parsed, F.timestamp_micros((secs * 1e6).cast("bigint")))
    return parsed


def epoch_seconds(ts: Column) -> Column:
    """Timestamp -> float epoch seconds; null -> 0.0."""
    return F.coalesce(F.unix_micros(ts) / F.lit(1e6), F.lit(0.0))


def iso_utc(ts: Column) -> Column:
    """Timestamp -> ``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00``; fraction only when non-zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.when(F.unix_micros(ts) % 1000000 == 0, whole).otherwise(frac)
