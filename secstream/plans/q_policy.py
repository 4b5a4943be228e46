"""Query keys: text policy (G-1..G-5, A15, F9, F11, P15, X17, T3, T4, T6, O5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import policy as P
from ..operators.ratelimit import rate_limit
from ..sources.tables import read_table
from .registry import register


def _texts(spark, sf_dir):
    """All scanned texts: documents, raw pages, conversation turns."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("item_id"), F.lit(0).cast("bigint").alias("sub_id"),
        "text")
    pages = read_table(spark, sf_dir, "pages", "page_id", "html").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("item_id"), F.lit(0).cast("bigint").alias("sub_id"),
        F.col("html").alias("text"))
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("item_id"),
        F.col("turn").cast("bigint").alias("sub_id"), "text")
    return docs.unionByName(pages).unionByName(conv)


_TEXTS_SQL = """texts AS (
  SELECT 'documents' AS source, doc_id AS item_id, CAST(0 AS BIGINT) AS sub_id, text FROM documents
  UNION ALL SELECT 'pages', page_id, CAST(0 AS BIGINT), html FROM pages
  UNION ALL SELECT 'conversations', conv_id, CAST(turn AS BIGINT), text FROM conversations)"""


def _q(p: str) -> str:
    return p.replace("'", "''")


_COUNTS = ",\n".join(
    f"  CAST(len(regexp_extract_all(coalesce(text, ''), '{_q(p)}')) AS INTEGER) AS \"{t}\""
    for t, p in pii.PII_PATTERNS.items())
_PII_FINDINGS_SQL = f"""WITH {_TEXTS_SQL},
counts AS (SELECT source, item_id, sub_id,
{_COUNTS}
  FROM texts)
SELECT source, item_id, sub_id, pii_type, matches FROM (
  UNPIVOT counts ON {", ".join(f'"{t}"' for t in pii.PII_PATTERNS)} INTO NAME pii_type VALUE matches)
WHERE matches > 0"""


@register("pii_findings", _PII_FINDINGS_SQL)
def pii_findings(spark, sf_dir):
    """G-1 counts: per text and pattern, the number of non-overlapping matches."""
    t = _texts(spark, sf_dir)
    f = t.select("source", "item_id", "sub_id", F.explode(pii.type_counts(F.col("text"))).alias("f"))
    return f.select("source", "item_id", "sub_id", "f.pii_type", F.col("f.matches").cast("int").alias("matches"))


_TYPES = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{_q(pii.PII_PATTERNS[t])}') THEN '{t}' END"
                   for t in sorted(pii.PII_PATTERNS))
_PII_TYPES_SQL = f"""WITH {_TEXTS_SQL}
SELECT source, item_id, sub_id, pii_types FROM (
  SELECT source, item_id, sub_id, concat_ws(',', {_TYPES}) AS pii_types FROM texts)
WHERE pii_types <> ''"""


@register("pii_types", _PII_TYPES_SQL)
def pii_types(spark, sf_dir):
    """Sorted distinct types per text (texts with at least one)."""
    t = _texts(spark, sf_dir).select("source", "item_id", "sub_id",
                                     F.array_join(pii.detected_types(F.col("text")), ",").alias("pii_types"))
    return t.filter(F.col("pii_types") != "")


_CLEAN = " OR ".join(f"regexp_matches(coalesce(text, ''), '{_q(p)}')" for p in pii.PII_PATTERNS.values())


@register("pii_clean", f"""WITH {_TEXTS_SQL}
SELECT source, count(*) FILTER (WHERE NOT ({_CLEAN})) AS clean, count(*) FILTER (WHERE {_CLEAN}) AS flagged
FROM texts GROUP BY source""")
def pii_clean(spark, sf_dir):
    """clean vs flagged texts per source."""
    t = _texts(spark, sf_dir).withColumn("_clean", pii.is_clean(F.col("text")))
    return t.groupBy("source").agg(F.count_if(F.col("_clean")).alias("clean"),
                                   F.count_if(~F.col("_clean")).alias("flagged"))


@register("pii_matches")
def pii_matches(spark, sf_dir):
    """G-1 with offsets and 20-character snippets (Python regex engine in
    Arrow batches; no SQL oracle: checked against brute force in tests)."""
    return P.pii_matches(_texts(spark, sf_dir), ("source", "item_id", "sub_id"))


_CONV_STATS_SQL = """stats AS (
  SELECT conv_id, count(*) AS n_messages,
    count(*) FILTER (WHERE role NOT IN ('user', 'assistant', 'system') OR role IS NULL) AS bad_roles,
    count(*) FILTER (WHERE coalesce(length(text), 0) < 1) AS empty_contents,
    count(*) FILTER (WHERE coalesce(length(text), 0) > 32000) AS long_contents,
    CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''),
      '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'),
      lambda w: w <> ''))) AS BIGINT) AS prompt_tokens
  FROM conversations GROUP BY conv_id),
checked AS (
  SELECT *, concat_ws(',',
      CASE WHEN n_messages < 1 THEN 'messages: at least 1' END,
      CASE WHEN n_messages > 50 THEN 'messages: at most 50' END,
      CASE WHEN bad_roles > 0 THEN 'role: user|assistant|system' END,
      CASE WHEN empty_contents > 0 THEN 'content: at least 1 character' END,
      CASE WHEN long_contents > 0 THEN 'content: at most 32000 characters' END) AS violations
  FROM stats)"""


def _conv_stats(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conv, P.violations(P.request_stats(conv))


@register("chat_validate", f"""WITH {_CONV_STATS_SQL}
SELECT conv_id, n_messages, violations, violations = '' AS valid FROM checked""")
def chat_validate(spark, sf_dir):
    """F9 as a table-validation job: one row per request with its violations."""
    _, stats = _conv_stats(spark, sf_dir)
    return stats.select("conv_id", F.col("n_messages").cast("bigint").alias("n_messages"),
                        F.array_join("violations", ",").alias("violations"), "valid")


@register("chat_tokens", f"""WITH {_CONV_STATS_SQL}
SELECT conv_id, prompt_tokens FROM stats""")
def chat_tokens(spark, sf_dir):
    """Whitespace-word estimate of the prompt tokens of each request."""
    _, stats = _conv_stats(spark, sf_dir)
    return stats.select("conv_id", "prompt_tokens")


@register("chat_fold", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role,
  CASE WHEN sys IS NOT NULL THEN '[System Instructions]: ' || sys || chr(10) || chr(10) || text ELSE text END AS content
FROM (
  SELECT *, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sys
  FROM (SELECT *, coalesce(sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
        FROM conversations))
WHERE role <> 'system'""")
def chat_fold(spark, sf_dir):
    """System prompts folded into the next message, roles mapped."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return P.fold_system(conv)


# Rate limit on the events table: every event is a call of caller user_id.
RL_RATE_PER_MINUTE = 1.0 / 1440.0
RL_BURST = 3.0


def _walk_sql(calls_cte: str, rate_per_minute: float, burst: float) -> str:
    rate = f"CAST({rate_per_minute / 60.0!r} AS DOUBLE)"
    b = f"CAST({burst!r} AS DOUBLE)"
    refill = f"least({b}, w.tokens + ((c.t_us - w.t_us) / 1e6) * {rate})"
    return f"""WITH RECURSIVE {calls_cte},
calls AS (SELECT id, caller, t_us, row_number() OVER (PARTITION BY caller ORDER BY t_us, id) AS rn FROM calls0),
walk(id, caller, rn, t_us, allowed, available, tokens) AS (
  SELECT id, caller, rn, t_us, TRUE, {b}, {b} - 1.0 FROM calls WHERE rn = 1
  UNION ALL
  SELECT c.id, c.caller, c.rn, c.t_us, {refill} >= 1.0, {refill},
    CASE WHEN {refill} >= 1.0 THEN {refill} - 1.0 ELSE {refill} END
  FROM walk w JOIN calls c ON c.caller = w.caller AND c.rn = w.rn + 1)"""


@register("rate_limit", _walk_sql(
    "calls0 AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS caller, epoch_us(ts) AS t_us FROM events)",
    RL_RATE_PER_MINUTE, RL_BURST) + """
SELECT id, caller, allowed, round(available, 6) AS available, round(tokens, 6) AS tokens FROM walk""")
def rate_limit_q(spark, sf_dir):
    """T3 + T4: token bucket per caller over every event (1 token per day, burst 3)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    out = rate_limit(ev, "user_id", "ts", "event_id", RL_RATE_PER_MINUTE, RL_BURST)
    return out.select("id", "caller", "allowed", F.round("available", 6).alias("available"),
                      F.round("tokens", 6).alias("tokens"))


# Gateway requests derived from conversations: caller and arrival time.
GW_RATE_PER_MINUTE = 6.0
GW_BURST = 2.0


def _requests(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    req = conv.select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("caller-"), F.floor(F.col("conv_id") / 4).cast("string")).alias("caller_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 5).alias("request_ts"))
    return conv, req


def _decisions(spark, sf_dir):
    conv, req = _requests(spark, sf_dir)
    return P.decide(req, conv, "conv_id", "caller_id", "request_ts", GW_RATE_PER_MINUTE, GW_BURST)


_GW_SQL = _walk_sql(_CONV_STATS_SQL + """,
req AS (SELECT c.conv_id, 'caller-' || CAST(c.conv_id // 4 AS VARCHAR) AS caller_id,
          TIMESTAMP '2024-01-01 00:00:00' + c.conv_id * INTERVAL 5 SECOND AS request_ts, c.n_messages, c.prompt_tokens,
          c.violations = '' AS valid
        FROM checked c),
calls0 AS (SELECT conv_id AS id, caller_id AS caller, epoch_us(request_ts) AS t_us FROM req WHERE valid)""",
                   GW_RATE_PER_MINUTE, GW_BURST) + f""",
full_text AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
              WHERE conv_id IN (SELECT conv_id FROM req WHERE valid) GROUP BY conv_id),
typed AS (SELECT conv_id, concat_ws(',', {_TYPES}) AS pii_types FROM full_text),
dec AS (
  SELECT r.conv_id, r.caller_id, r.request_ts, r.n_messages, r.prompt_tokens, coalesce(t.pii_types, '') AS pii_types,
    CASE WHEN NOT r.valid THEN 'invalid' WHEN NOT w.allowed THEN 'rate_limited'
         WHEN coalesce(t.pii_types, '') <> '' THEN 'blocked_pii' ELSE 'forwardable' END AS decision
  FROM req r LEFT JOIN walk w ON w.id = r.conv_id LEFT JOIN typed t ON t.conv_id = r.conv_id)"""


@register("gateway_decisions", _GW_SQL + """
SELECT conv_id, caller_id, n_messages, prompt_tokens, pii_types, decision FROM dec""")
def gateway_decisions(spark, sf_dir):
    """G-3: validation -> rate limit -> PII scan of the joined text -> forward."""
    d = _decisions(spark, sf_dir)
    return d.select("conv_id", "caller_id", F.col("n_messages").cast("bigint").alias("n_messages"),
                    "prompt_tokens", F.array_join("pii_types", ",").alias("pii_types"), "decision")


_AUDIT_SELECT = """
SELECT strftime(request_ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, caller_id, 'chat-model' AS model,
  CAST(CASE WHEN decision = 'blocked_pii' THEN 0 ELSE prompt_tokens END AS INTEGER) AS prompt_tokens,
  0 AS response_tokens, 0 AS latency_ms, decision = 'blocked_pii' AS blocked_pii,
  CASE WHEN decision = 'blocked_pii' THEN pii_types ELSE '' END AS pii_types,
  CASE WHEN decision = 'blocked_pii' THEN FALSE END AS success
FROM dec WHERE decision IN ('blocked_pii', 'forwardable')"""


@register("gateway_audit", _GW_SQL + _AUDIT_SELECT)
def gateway_audit(spark, sf_dir):
    """G-4/G-5 + T6: metadata-only audit rows of the audited decisions."""
    a = P.audit_rows(_decisions(spark, sf_dir))
    return a.select("ts_utc", "caller_id", "model", "prompt_tokens", "response_tokens", "latency_ms",
                    "blocked_pii", F.array_join("pii_types", ",").alias("pii_types"), "success")


@register("audit_tail", _GW_SQL + f""",
audit AS ({_AUDIT_SELECT.replace("SELECT ", "SELECT request_ts AS _t, conv_id, ", 1)})
SELECT ts_utc, caller_id, blocked_pii, prompt_tokens FROM audit ORDER BY _t DESC, caller_id DESC, conv_id DESC LIMIT 25""")
def audit_tail(spark, sf_dir):
    """The newest 25 audit entries (returned oldest first)."""
    tail = P.audit_tail(P.audit_rows(_decisions(spark, sf_dir), keep=("conv_id",)), 25, id_col="conv_id")
    return tail.select("ts_utc", "caller_id", "blocked_pii", "prompt_tokens")
