"""Query keys: prose-only detection jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detections as D
from ..operators.rolling import HOUR, rolling_trend
from ..operators.similarity import top_k_similar
from ..session import checkpoint_dir
from ..sources.tables import read_table
from . import q_incidents
from .inputs import event_docs
from .q_features import _unicode_word
from .registry import register
from .sql_events import NETWORK, with_docs

_DNS = "log_attribute = 'network_dns'"
_HOST = "log_attribute IS NULL"


@register("forensics", with_docs("""
SELECT doc_id, host_name, timestamp FROM docs
WHERE event_name = 'execve' AND user_id = 0
  AND event_ts BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"""))
def forensics(spark, sf_dir):
    """S20 + D1: write the date-partitioned cold store, then find execve by
    root in the 7 days before 2024-01-20 (partition-pruned read)."""
    path = os.path.join(checkpoint_dir(spark), "cold", f"events-{uuid.uuid4().hex[:8]}")
    D.cold_store_write(event_docs(spark, sf_dir), path)
    out = D.forensics(spark, path, "2024-01-20T00:00:00Z", 7)
    return out.select("doc_id", "attributes.host_name", "timestamp")


_X_SQL = "(epoch_us(ts) / 1e6 - 1704067200) / 3600.0"


@register("rolling_slope", f"""
SELECT event_id, n, round(slope, 4) AS slope, round(r2, 4) AS r2 FROM (
  SELECT event_id,
    count(*) OVER w AS n, regr_slope(value, x) OVER w AS slope, regr_r2(value, x) OVER w AS r2
  FROM (SELECT event_id, user_id, value, {_X_SQL} AS x FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY x RANGE BETWEEN 24 PRECEDING AND CURRENT ROW))""")
def rolling_slope(spark, sf_dir):
    """D3: trailing 24-hour slope and R² of each user's value (memory-guard style)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    out = rolling_trend(ev, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), F.col("value"), 24 * HOUR, "event_id",
                        unit=HOUR)
    return out.select("event_id", "n", F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r2"))


_BASE = "regexp_extract(coalesce(dns_query, ''), '([^.]+\\.[^.]+)$', 1)"


@register("nxdomain_rate", with_docs(f"""
SELECT source_ip AS host, count(*) AS dns_events, count(*) FILTER (WHERE dns_response_code = 3) AS nxdomain,
  count(*) FILTER (WHERE feat_dns_query_entropy > 3.5 AND {_BASE} NOT IN ('example.com', 'amazonaws.com'))
    AS high_entropy_unlisted,
  round(count(*) FILTER (WHERE dns_response_code = 3) / count(*), 6) AS nx_rate
FROM docs WHERE {_DNS} GROUP BY source_ip"""))
def nxdomain_rate(spark, sf_dir):
    """NXDOMAIN rate per host and unlisted high-entropy queries."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute") == "network_dns")
    return D.nxdomain_rates(docs)


_IP = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"


def _oct(i):
    return f"TRY_CAST(regexp_extract(coalesce(args, ''), '{_IP}', {i}) AS INTEGER)"


_PRIVATE = (f"({_oct(1)} = 10 OR ({_oct(1)} = 172 AND {_oct(2)} BETWEEN 16 AND 31) OR "
            f"({_oct(1)} = 192 AND {_oct(2)} = 168) OR {_oct(1)} = 127)")


@register("rule_findings", with_docs(f"""
SELECT rule, host, count(*) AS hits FROM (
  SELECT 'persistence_path' AS rule, host_name AS host FROM docs
    WHERE {_HOST} AND regexp_matches(coalesce(args, ''), '(?i){D.PERSISTENCE_PATTERN}')
  UNION ALL
  SELECT 'network_external', host_name FROM docs
    WHERE {_HOST} AND regexp_matches(coalesce(args, ''), '(?i){_unicode_word(NETWORK)}')
      AND regexp_extract(coalesce(args, ''), '{_IP}', 0) <> '' AND NOT coalesce({_PRIVATE}, FALSE)
  UNION ALL
  SELECT 'interactive_shell', host_name FROM docs
    WHERE {_HOST} AND regexp_matches(coalesce(args, ''), '(?i){D.INTERACTIVE_SHELL_PATTERN}')
  UNION ALL
  SELECT 'account_file', host_name FROM docs
    WHERE {_HOST} AND regexp_matches(coalesce(args, ''), '(?i)/etc/(passwd|shadow|sudoers)')
  UNION ALL
  SELECT 'escalation_tool', host_name FROM docs
    WHERE {_HOST} AND regexp_matches(coalesce(args, ''), '(?i)\\b(su|sudo|pkexec)\\b')
  UNION ALL
  SELECT 'process_memory', host_name FROM docs
    WHERE {_HOST} AND (regexp_matches(coalesce(args, ''), '(?i)/proc/\\d+/mem')
      OR (event_name = 'ptrace' AND process_name NOT IN ('gdb', 'strace', 'lldb'))))
GROUP BY rule, host"""))
def rule_findings(spark, sf_dir):
    """Persistence paths, network tools to external addresses, interactive shells."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull())
    return D.rule_findings(docs)


@register("beaconing", with_docs(f"""
SELECT host, domain, count(*) AS calls, round(avg(gap), 3) AS avg_gap,
  round(CASE WHEN avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) END, 4) AS cv,
  count(*) >= 5 AND coalesce(CASE WHEN avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) END < 0.1, FALSE) AS regular
FROM (SELECT source_ip AS host, {_BASE} AS domain,
        epoch - lag(epoch) OVER (PARTITION BY source_ip, {_BASE} ORDER BY epoch, doc_id) AS gap
      FROM docs WHERE {_DNS})
GROUP BY host, domain"""))
def beaconing(spark, sf_dir):
    """Interval regularity per (host, base domain)."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute") == "network_dns")
    return D.beaconing(docs)


@register("shared_credential", with_docs(f"""
SELECT bucket, user_id, count(*) AS hosts, sum(n) AS events FROM (
  SELECT CAST(floor(epoch / 86400.0) AS BIGINT) AS bucket, user_id, host_name, count(*) AS n
  FROM docs WHERE {_HOST} AND user_id IS NOT NULL GROUP BY ALL)
GROUP BY bucket, user_id HAVING count(*) >= 2"""))
def shared_credential(spark, sf_dir):
    """One credential used on at least two hosts within a day."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull())
    out = D.shared_credentials(docs, 1440, 2)
    return out.select("bucket", "user_id", F.col("hosts").cast("bigint").alias("hosts"),
                      F.col("events").cast("bigint").alias("events"))


@register("unmatched_mmaps", with_docs(f"""
SELECT host, allocs, frees, allocs - frees AS unmatched FROM (
  SELECT host_name AS host, count(*) FILTER (WHERE event_name IN ('mmap', 'brk')) AS allocs,
    count(*) FILTER (WHERE event_name = 'munmap') AS frees FROM docs WHERE {_HOST} GROUP BY host_name)
WHERE allocs - frees > 0"""))
def unmatched_mmaps(spark, sf_dir):
    """Allocations without a matching munmap per host."""
    return D.unmatched_mmaps(event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull()))


_MERGE_CTE = q_incidents._INC_CTE.replace("floor(epoch / 86400.0)", "floor(epoch / 600.0)")


@register("incident_merge", with_docs("""
SELECT host, island, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS groups,
  sum(event_count) AS events, max(sev) AS worst FROM (
  SELECT host, bucket, event_count, sev,
    sum(brk) OVER (PARTITION BY host ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT host, bucket, event_count,
      CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sev,
      CASE WHEN bucket - lag(bucket) OVER (PARTITION BY host ORDER BY bucket) <= 3 THEN 0 ELSE 1 END AS brk
    FROM grp2))
GROUP BY host, island""", _MERGE_CTE))
def incident_merge(spark, sf_dir):
    """10-minute incident groups of a host merged when at most 30 minutes apart."""
    out = D.merge_incidents(event_docs(spark, sf_dir), 10, 3)
    return out.select("host", F.col("island").cast("bigint").alias("island"), "first_bucket", "last_bucket",
                      F.col("groups").cast("bigint").alias("groups"), F.col("events").cast("bigint").alias("events"),
                      "worst")


@register("incident_merge_category", with_docs("""
SELECT host, category, island, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS groups,
  sum(event_count) AS events, max(sev) AS worst FROM (
  SELECT *, sum(brk) OVER (PARTITION BY host, category ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY host, category ORDER BY bucket) <= 3 THEN 0 ELSE 1 END
      AS brk FROM (
      SELECT host, coalesce(feat_event_category, log_type) AS category, bucket, count(*) AS event_count,
        CASE WHEN bool_or(is_evil) THEN 4 WHEN bool_or(is_sus_risky) THEN 3 WHEN bool_or(is_sus) THEN 2 ELSE 1 END AS sev
      FROM inc0 GROUP BY ALL)))
GROUP BY host, category, island""", _MERGE_CTE))
def incident_merge_category(spark, sf_dir):
    """Windows of one host and one event category merged when at most 30 minutes apart."""
    cat = F.coalesce(F.col("features.feat_event_category"), F.col("log_type"))
    out = D.merge_by_category(event_docs(spark, sf_dir), cat, 10, 3)
    return out.select("host", "category", *[F.col(c).cast("bigint").alias(c) for c in
                                            ("island", "first_bucket", "last_bucket", "groups", "events")], "worst")


@register("shared_credential_sliding", with_docs(f"""
SELECT first_slot, user_id, count(*) AS hosts, CAST(sum(n) AS BIGINT) AS events FROM (
  SELECT slot - step AS first_slot, user_id, host_name, count(*) AS n
  FROM (SELECT CAST(floor(epoch / 3600.0) AS BIGINT) AS slot, user_id, host_name FROM docs
        WHERE {_HOST} AND user_id IS NOT NULL), (SELECT unnest(generate_series(0, 23)) AS step)
  GROUP BY ALL)
GROUP BY first_slot, user_id HAVING count(*) >= 2"""))
def shared_credential_sliding(spark, sf_dir):
    """One credential on at least two hosts in a window of 24 hourly slots, sliding by the
    hour: uses at most 23 hours apart always share one; of uses 23 to 24 hours apart only
    those whose slots differ by 23 are found."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull())
    return D.shared_credentials_sliding(docs, 1440, 60, 2)


@register("shared_credential_exact", with_docs("""
SELECT e.doc_id, e.user_id, e.host, w.doc_id AS other_id, w.host AS other_host, round((e.t_us - w.t_us) / 1e6, 3) AS seconds
FROM uses e JOIN uses w ON e.user_id = w.user_id AND e.host <> w.host
  AND (w.t_us < e.t_us OR (w.t_us = e.t_us AND w.host < e.host)) AND e.t_us - w.t_us <= 86400000000
QUALIFY row_number() OVER (PARTITION BY e.doc_id ORDER BY w.t_us DESC, w.host DESC, w.doc_id DESC) = 1""", f"""
uses AS (SELECT doc_id, user_id, host_name AS host, epoch_us(event_ts) AS t_us FROM docs
         WHERE {_HOST} AND user_id IS NOT NULL AND event_ts IS NOT NULL)"""))
def shared_credential_exact(spark, sf_dir):
    """Every use of a credential at most 24 hours after one on another host, with the latest such use."""
    return D.shared_credentials_exact(event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull()), 1440)


@register("exec_after_write", with_docs(f"""
SELECT exec_id, write_id, host, round(seconds, 3) AS seconds FROM (
  SELECT e.doc_id AS exec_id, w.doc_id AS write_id, e.host_name AS host, e.epoch - w.epoch AS seconds,
    row_number() OVER (PARTITION BY e.doc_id ORDER BY w.epoch DESC, w.doc_id DESC) AS r
  FROM docs e JOIN docs w ON e.host_name = w.host_name AND w.epoch <= e.epoch AND e.epoch - w.epoch <= 86400
  WHERE e.event_name = 'execve' AND w.event_name = 'write' AND e.{_HOST} AND w.{_HOST}) WHERE r = 1"""))
def exec_after_write(spark, sf_dir):
    """Executions with the last write on the same host in the day before (events are sparse here)."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull())
    return D.exec_after_write(docs, {"host": F.col("attributes.host_name")}, 1440)


@register("process_parents", with_docs(f"""
SELECT doc_id, parent_id, host, root_from_user, shell_from_web FROM (
  SELECT c.doc_id, p.doc_id AS parent_id, c.host_name AS host,
    coalesce(c.user_id = 0 AND p.user_id <> 0, FALSE) AS root_from_user,
    c.process_name IN ('sh', 'bash', 'dash', 'zsh')
      AND p.process_name IN ('nginx', 'apache', 'apache2', 'httpd', 'gunicorn', 'node') AS shell_from_web,
    row_number() OVER (PARTITION BY c.doc_id ORDER BY p.epoch DESC, p.doc_id DESC) AS r
  FROM docs c JOIN docs p ON c.host_name = p.host_name AND p.attr_event_id % 10 = (c.attr_event_id + 3) % 10
    AND p.epoch <= c.epoch
  WHERE c.{_HOST} AND p.{_HOST}) WHERE r = 1"""))
def process_parents(spark, sf_dir):
    """The latest event of the parent process on the same host. The stand-in process
    id is the last digit of the event id column, the parent's that plus three."""
    docs = event_docs(spark, sf_dir).filter(F.col("log_attribute").isNull())
    n = F.col("attributes.event_id")
    return D.process_parents(docs, n % 10, (n + 3) % 10)


@register("latency_quantiles_exact", """
SELECT event_type, max(value) FILTER (WHERE r = greatest(ceil(CAST(0.5 AS DOUBLE) * n), 1)) AS p50,
  max(value) FILTER (WHERE r = greatest(ceil(CAST(0.95 AS DOUBLE) * n), 1)) AS p95,
  max(value) FILTER (WHERE r = greatest(ceil(CAST(0.99 AS DOUBLE) * n), 1)) AS p99
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
GROUP BY event_type""")
def latency_quantiles_exact(spark, sf_dir):
    """Exact p50/p95/p99 of the value per event type."""
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return D.exact_quantiles(ev, "event_type", "value", "event_id", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("counter_rate", """
SELECT user_id, count(*) AS samples, round(sum(inc), 6) AS increase,
  round(CASE WHEN max(t) - min(t) > 0 THEN sum(inc) / ((max(t) - min(t)) / 3600.0) END, 6) AS rate_per_hour
FROM (SELECT user_id, t, CASE WHEN p IS NULL THEN 0.0 WHEN value < p THEN value ELSE value - p END AS inc FROM (
        SELECT user_id, value, epoch_us(ts) / 1e6 AS t,
          lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events))
GROUP BY user_id""")
def counter_rate(spark, sf_dir):
    """Counter increase with reset handling and rate per hour, per user."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return D.counter_increase(ev, "user_id", t, F.col("value"), "event_id")


@register("latency_quantiles")
def latency_quantiles(spark, sf_dir):
    """p50/p95/p99 of the value per event type (approximate quantiles,
    mergeable sketches; no SQL oracle because engines' estimators differ)."""
    ev = read_table(spark, sf_dir, "events", "event_type", "value")
    q = F.percentile_approx("value", [0.5, 0.95, 0.99], 10000)
    return ev.groupBy("event_type").agg(q.alias("q")).select(
        "event_type", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


@register("parent_child", """
SELECT c.conv_id, c.turn, c.role, CAST(length(c.text) AS INTEGER) AS chars, p.role AS parent_role,
  CAST(length(p.text) AS INTEGER) AS parent_chars
FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1""")
def parent_child(spark, sf_dir):
    """Every turn joined to its parent turn."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return D.parent_child(conv)


@register("recent_change", """
SELECT e.event_id AS incident_id, c.event_id AS change_id, e.user_id,
  round((epoch_us(e.ts) - epoch_us(c.ts)) / 6e7, 3) AS minutes_before
FROM events e JOIN events c ON e.user_id = c.user_id
  AND c.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts
WHERE e.event_type = 'error' AND c.event_type = 'signup'""")
def recent_change(spark, sf_dir):
    """Sign-ups (changes) of the same user in the 2 hours before each error."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    ev = ev.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return D.recent_changes(ev.filter(F.col("event_type") == "error"), ev.filter(F.col("event_type") == "signup"),
                            "user_id", 2)


@register("rerank", """
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, a.label = b.label AS same,
    list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
      (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) *
       sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS cos
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top20 AS (SELECT *, round((1 + cos) / 2, 4) AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, neighbor_id) AS r FROM pairs),
re AS (SELECT query_id, neighbor_id,
         round(score + CASE WHEN same THEN CAST(0.05 AS DOUBLE) ELSE 0.0 END, 4) AS rerank_score FROM top20 WHERE r <= 20)
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, neighbor_id) AS rank FROM re)
WHERE rank <= 5""")
def rerank(spark, sf_dir):
    """Retrieve 20 neighbours, re-rank with a same-label bonus, keep 5."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    labels = read_table(spark, sf_dir, "embeddings", "vec_id", "label")
    top = top_k_similar(emb, emb, 20, "vec_id", "vec_id", "embedding", exclude_self=True) \
        .withColumnRenamed("vec_id", "query_id")
    top = top.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id") \
        .join(labels.select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("nl")), "neighbor_id")
    score = F.round(F.col("score") + F.when(F.col("ql") == F.col("nl"), F.lit(0.05)).otherwise(F.lit(0.0)), 4)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("neighbor_id"))
    out = top.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
    return out.select("query_id", "neighbor_id", F.col("rank").cast("int").alias("rank"), "rerank_score")


@register("span_breakdown", """
SELECT o.o_orderkey, round(o.o_totalprice, 6) AS duration, coalesce(c.children, 0) AS children,
  round(coalesce(c.child_time, 0.0), 6) AS child_time, round(o.o_totalprice - coalesce(c.child_time, 0.0), 6) AS self_time
FROM orders o LEFT JOIN (
  SELECT l_orderkey, count(*) AS children, sum(l_extendedprice * (1 - l_discount)) AS child_time
  FROM lineitem GROUP BY l_orderkey) c ON o.o_orderkey = c.l_orderkey""")
def span_breakdown(spark, sf_dir):
    """Orders as parent spans (duration = total price), their line items
    as child spans (duration = discounted price); self time per parent."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumnRenamed(
        "o_totalprice", "d")
    items = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("d"))
    out = D.span_breakdown(orders, items, "o_orderkey", "d")
    return out.select("o_orderkey", F.round("duration", 6).alias("duration"),
                      F.col("children").cast("bigint").alias("children"),
                      F.round("child_time", 6).alias("child_time"), F.round("self_time", 6).alias("self_time"))


@register("leakage_classifier")
def leakage_classifier(spark, sf_dir):
    """Logistic regression on hashed tokens of conversation turns, labelled
    by the PII/secret scan (a learned leakage detector); scores every turn
    (rows-only). The texts are spread over all tasks before they are searched,
    however few row groups their files have."""
    from pyspark.ml.functions import vector_to_array

    from ..functions import pii
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").repartition(tasks)
    docs = read_table(spark, sf_dir, "documents", "text").repartition(tasks)
    train = conv.select("text").unionByName(docs).withColumn(
        "leak", (~pii.is_clean(F.col("text"))).cast("double"))
    model = D.leakage_classifier(train, "text", "leak")
    scored = model.transform(conv.withColumn("leak", (~pii.is_clean(F.col("text"))).cast("double")))
    return scored.select("conv_id", "turn", "leak",
                         F.round(vector_to_array("probability")[1], 4).alias("leak_probability"))
