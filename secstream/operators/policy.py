"""Text policy over tables: F9, P15, X17, G-1..G-5, T6, O5.

A chat request is the group of rows ``(request_id, turn, role, content)``.
Only work that really needs the whole request text (PII matches that span
messages, G-2) collects a request into one row, and only after validation has
proven the request bounded (at most 50 messages of at most 32,000 characters).
Everything else is a per-row expression or an algebraic aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pii import PII_PATTERNS, SNIPPET_CHARS, detected_types
from .ratelimit import rate_limit

# ---- fixed values (reference request limits) -------------------------------
ROLES = ("user", "assistant", "system")
MAX_MESSAGES = 50
MAX_CONTENT_CHARS = 32_000
MAX_CALLER_CHARS = 64
SYSTEM_PREFIX = "[System Instructions]: "
AUDIT_RING = 1000
# Python str.split() whitespace, spelled for Java regex.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# ---------------------------------------------------------------------------


def words(text: Column) -> Column:
    """X17 per message: Python ``len(text.split())``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), PY_WHITESPACE), lambda w: w != ""))


def request_stats(messages: DataFrame, request_col: str = "conv_id", role_col: str = "role",
                  content_col: str = "text") -> DataFrame:
    """F9 per request (one partial+final aggregate): message count, bad roles,
    empty/oversized contents and the token estimate (sum of word counts equals
    the word count of the space-joined text)."""
    c = F.col(content_col)
    return messages.groupBy(request_col).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(~F.coalesce(F.col(role_col).isin(*ROLES), F.lit(False))).alias("bad_roles"),
        F.count_if(F.coalesce(F.length(c), F.lit(0)) < 1).alias("empty_contents"),
        F.count_if(F.coalesce(F.length(c), F.lit(0)) > MAX_CONTENT_CHARS).alias("long_contents"),
        F.sum(words(c)).cast("bigint").alias("prompt_tokens"),
    )


def violations(stats: DataFrame) -> DataFrame:
    """Rule columns -> ``violations array<string>`` and ``valid``."""
    rules = [
        F.when(F.col("n_messages") < 1, F.lit("messages: at least 1")),
        F.when(F.col("n_messages") > MAX_MESSAGES, F.lit(f"messages: at most {MAX_MESSAGES}")),
        F.when(F.col("bad_roles") > 0, F.lit("role: user|assistant|system")),
        F.when(F.col("empty_contents") > 0, F.lit("content: at least 1 character")),
        F.when(F.col("long_contents") > 0, F.lit(f"content: at most {MAX_CONTENT_CHARS} characters")),
    ]
    v = F.array_compact(F.array(*rules))
    return stats.withColumn("violations", v).withColumn("valid", F.size(v) == 0)


def request_texts(messages: DataFrame, valid_ids: DataFrame, request_col: str = "conv_id",
                  order_col: str = "turn", content_col: str = "text") -> DataFrame:
    """G-2: the contents of each *valid* request joined by one space, in turn
    order. The semi join first restricts the collect to requests bounded by F9."""
    m = messages.join(valid_ids.select(request_col), request_col, "left_semi")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, content_col))),
                                      lambda s: s[content_col]), " ")
    return m.groupBy(request_col).agg(joined.alias("full_text"))


def fold_system(messages: DataFrame, request_col: str = "conv_id", order_col: str = "turn",
                role_col: str = "role", content_col: str = "text") -> DataFrame:
    """Drop system messages; the latest pending system message is
    prefixed to the next non-system message; ``assistant`` -> ``model``."""
    is_sys = F.col(role_col) == "system"
    before = Window.partitionBy(request_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("_seg", F.coalesce(F.sum(F.when(is_sys, 0).otherwise(1)).over(before), F.lit(0)))
    upto = Window.partitionBy(request_col, "_seg").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_sys", F.last(F.when(is_sys, F.col(content_col)), ignorenulls=True).over(upto))
    out = m.filter(~is_sys)
    content = F.when(F.col("_sys").isNotNull(),
                     F.concat(F.lit(SYSTEM_PREFIX), F.col("_sys"), F.lit("\n\n"), F.col(content_col))
                     ).otherwise(F.col(content_col))
    role = F.when(F.col(role_col) == "assistant", F.lit("model")).otherwise(F.lit("user"))
    return out.select(request_col, order_col, role.alias("role"), content.alias("content"))


def decide(requests: DataFrame, messages: DataFrame, request_col: str = "conv_id",
           caller_col: str = "caller_id", time_col: str = "request_ts", rate_per_minute: float = 60.0,
           burst: float = 10.0, model: str = "chat-model") -> DataFrame:
    """G-3: per request, in the reference's order: validation (422), rate
    limit (429, not audited), PII scan of the joined text (422, audited),
    else forwardable. ``requests`` holds (request, caller, time)."""
    stats = violations(request_stats(messages, request_col))
    req = requests.join(stats, request_col, "left")
    valid = req.filter(F.col("valid"))
    limited = rate_limit(valid, caller_col, time_col, request_col, rate_per_minute, burst)
    texts = request_texts(messages, valid, request_col)
    scanned = texts.select(request_col, detected_types(F.col("full_text")).alias("pii_types"))
    out = (req.join(limited.select(F.col("id").alias(request_col), "allowed"), request_col, "left")
           .join(scanned, request_col, "left"))
    decision = (F.when(~F.coalesce(F.col("valid"), F.lit(False)), F.lit("invalid"))
                .when(~F.col("allowed"), F.lit("rate_limited"))
                .when(F.size(F.col("pii_types")) > 0, F.lit("blocked_pii"))
                .otherwise(F.lit("forwardable")))
    return out.select(request_col, caller_col, time_col, "n_messages", "prompt_tokens",
                      F.coalesce(F.col("pii_types"), F.array().cast("array<string>")).alias("pii_types"),
                      decision.alias("decision"), F.lit(model).alias("model"))


def audit_rows(decisions: DataFrame, caller_col: str = "caller_id", time_col: str = "request_ts",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """G-4/G-5: metadata-only audit rows (no text column can reach them).
    Rate-limited and invalid requests are not audited. The model call itself
    is not made here, so forwarded rows carry the token estimate, 0 response
    tokens and an unknown (null) success."""
    audited = decisions.filter(F.col("decision").isin("blocked_pii", "forwardable"))
    blocked = F.col("decision") == "blocked_pii"
    return audited.select(
        F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"),
        F.col(caller_col).alias("caller_id"), "model",
        F.when(blocked, F.lit(0)).otherwise(F.col("prompt_tokens")).cast("int").alias("prompt_tokens"),
        F.lit(0).alias("response_tokens"), F.lit(0).alias("latency_ms"),
        blocked.alias("blocked_pii"),
        F.when(blocked, F.col("pii_types")).otherwise(F.array().cast("array<string>")).alias("pii_types"),
        F.when(blocked, F.lit(False)).otherwise(F.lit(None).cast("boolean")).alias("success"),
        F.col(time_col).alias("_t"), *keep,
    )


def audit_tail(audit: DataFrame, limit: int = 100, time_col: str = "_t", id_col: str | None = None) -> DataFrame:
    """Newest ``limit`` entries (1..1000), returned oldest first; of one caller and instant by request id."""
    if not 1 <= limit <= AUDIT_RING:
        raise ValueError(f"limit must be 1..{AUDIT_RING}")
    order = [time_col, "caller_id", *([id_col] if id_col else [])]
    newest = audit.orderBy(*(F.col(c).desc() for c in order)).limit(limit)
    return newest.orderBy(*order)


_MATCH_FIELDS = [
    T.StructField("pii_type", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("snippet", T.StringType()),
]


def pii_matches(texts: DataFrame, keys: tuple[str, ...] = ("source", "item_id"), text_col: str = "text") -> DataFrame:
    """G-1 with offsets: every non-overlapping match per pattern with type,
    start, end and the first 20 characters. Python ``re`` (the reference's
    engine) runs inside Arrow batches; rows are scanned where they are, no
    shuffle. Offsets are in code points; ``keys`` locate the text."""
    compiled = {k: re.compile(v) for k, v in PII_PATTERNS.items()}
    schema = T.StructType([texts.schema[k] for k in keys] + _MATCH_FIELDS)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, text in zip(*[b[k] for k in keys], b[text_col]):
                if not isinstance(text, str):
                    continue
                for name, pat in compiled.items():
                    for m in pat.finditer(text):
                        rows.append((*key, name, m.start(), m.end(), m.group()[:SNIPPET_CHARS]))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return texts.select(*keys, text_col).mapInPandas(scan, schema)
