"""Query keys: incidents (A1-A9, P9, P11, O2, T2 batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incidents as inc
from .inputs import event_docs
from .registry import register
from .sql_events import with_docs

WINDOW = 1440  # minutes; 10-minute windows are degenerate on the driver data

_INC_CTE = f"""
inc0 AS (
  SELECT *, coalesce(nullif(host_name, ''), nullif(source_ip, ''), 'unknown_host') AS host,
    CAST(CASE WHEN epoch > 0 THEN floor(epoch / {60.0 * WINDOW}) ELSE 0 END AS BIGINT) AS bucket,
    coalesce(sus, 0) <> 0 AS is_sus, coalesce(evil, 0) <> 0 AS is_evil,
    coalesce(sus, 0) <> 0 AND (coalesce(feat_is_root_user, 0) <> 0 OR coalesce(feat_args_has_shell, 0) <> 0
      OR coalesce(feat_args_has_network, 0) <> 0) AS is_sus_risky
  FROM docs),
inc AS (
  SELECT *, substr(md5(host || ':' || CAST(bucket AS VARCHAR)), 1, 12) AS group_id,
    row_number() OVER (PARTITION BY host, bucket ORDER BY epoch, doc_id) AS ord
  FROM inc0),
grp AS (
  SELECT group_id, host, bucket, count(*) AS event_count,
    count(*) FILTER (WHERE is_evil) AS evil_count, count(*) FILTER (WHERE is_sus) AS sus_count,
    bool_or(is_sus_risky) AS risky,
    min(event_ts) FILTER (WHERE epoch > 0) AS t0, max(event_ts) FILTER (WHERE epoch > 0) AS t1
  FROM inc GROUP BY group_id, host, bucket),
grp2 AS (
  SELECT *, CASE WHEN evil_count > 0 THEN 'critical' WHEN risky THEN 'high' WHEN sus_count > 0 THEN 'medium'
    ELSE 'low' END AS severity FROM grp)
"""


def _iso(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN '' WHEN epoch_us({col}) % 1000000 = 0 "
            f"THEN strftime({col}, '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime({col}, '%Y-%m-%dT%H:%M:%S.%f+00:00') END")


_GROUPS_SELECT = f"""
SELECT group_id, host, bucket, {_iso('t0')} AS window_start, {_iso('t1')} AS window_end,
  event_count, evil_count, sus_count, severity,
  CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank
FROM grp2"""


@register("incident_groups", with_docs(_GROUPS_SELECT, _INC_CTE))
def incident_groups(spark, sf_dir):
    return inc.incident_groups(event_docs(spark, sf_dir), WINDOW)


def _top_sql(value_col: str, n: int) -> str:
    return with_docs(f"""
SELECT group_id, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT group_id, value, count, row_number() OVER (PARTITION BY group_id ORDER BY count DESC, first_ord) AS rank
  FROM (SELECT group_id, {value_col} AS value, count(*) AS count, min(ord) AS first_ord FROM inc
        WHERE {value_col} IS NOT NULL AND {value_col} <> '' GROUP BY group_id, {value_col}))
WHERE rank <= {n}""", _INC_CTE)


@register("incident_top_processes", _top_sql("process_name", 5))
def incident_top_processes(spark, sf_dir):
    return inc.incident_top_values(event_docs(spark, sf_dir), F.col("attributes.process_name"), 5, WINDOW)


@register("incident_event_types", _top_sql("log_type", 5))
def incident_event_types(spark, sf_dir):
    return inc.incident_top_values(event_docs(spark, sf_dir), F.col("log_type"), 5, WINDOW)


_REP_SQL = with_docs("""
SELECT group_id, doc_id, log_type, process_name, args, dns_query FROM (
  SELECT group_id, doc_id, log_type, process_name, args, dns_query,
    row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN is_evil THEN 0 WHEN is_sus THEN 1 ELSE 2 END,
                       epoch, doc_id) AS r
  FROM inc) WHERE r = 1""", _INC_CTE)


@register("incident_representative", _REP_SQL)
def incident_representative(spark, sf_dir):
    rep = inc.incident_representative(event_docs(spark, sf_dir), WINDOW)
    return rep.select("group_id", "doc_id", "log_type", "attributes.process_name", "attributes.args",
                      "attributes.dns_query")


_SAMPLES_SQL = with_docs("""
SELECT group_id, CAST(ord AS INTEGER) AS rank, doc_id, log_type, coalesce(process_name, '') AS process_name, user_id,
  substr(coalesce(args, ''), 1, 120) AS args_snippet, coalesce(dns_query, '') AS dns_query, timestamp,
  is_evil, is_sus
FROM inc WHERE ord <= 20""", _INC_CTE)


@register("incident_samples", _SAMPLES_SQL)
def incident_samples(spark, sf_dir):
    return inc.incident_samples(event_docs(spark, sf_dir), 20, WINDOW)


_REPORT_SQL = with_docs("""
SELECT CAST(coalesce(sum(event_count), 0) AS BIGINT) AS total_events, count(*) AS total_groups,
  CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)
    WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_severity
FROM grp2""", _INC_CTE)


@register("incident_report", _REPORT_SQL)
def incident_report(spark, sf_dir):
    return inc.incident_report(inc.incident_groups(event_docs(spark, sf_dir), WINDOW))


_DESC_SQL = with_docs("""
SELECT g.group_id, substr(concat_ws(' ', g.severity || ' incident on host ' || g.host,
    CASE WHEN p.procs IS NOT NULL THEN 'processes: ' || p.procs END,
    CASE WHEN coalesce(r.args, '') <> '' THEN substr(r.args, 1, 200) END,
    CASE WHEN coalesce(r.dns_query, '') <> '' THEN 'dns: ' || r.dns_query END), 1, 800) AS description
FROM grp2 g
LEFT JOIN (SELECT group_id, string_agg(value, ' ' ORDER BY rank) AS procs FROM top3 GROUP BY group_id) p
  ON g.group_id = p.group_id
LEFT JOIN rep r ON g.group_id = r.group_id""", _INC_CTE + """,
top3 AS (
  SELECT group_id, value, rank FROM (
    SELECT group_id, value, row_number() OVER (PARTITION BY group_id ORDER BY count DESC, first_ord) AS rank
    FROM (SELECT group_id, process_name AS value, count(*) AS count, min(ord) AS first_ord FROM inc
          WHERE process_name IS NOT NULL AND process_name <> '' GROUP BY group_id, process_name))
  WHERE rank <= 3),
rep AS (
  SELECT group_id, args, dns_query FROM (
    SELECT group_id, args, dns_query, row_number() OVER (PARTITION BY group_id ORDER BY
      CASE WHEN is_evil THEN 0 WHEN is_sus THEN 1 ELSE 2 END, epoch, doc_id) AS r FROM inc) WHERE r = 1)
""")


@register("incident_description", _DESC_SQL)
def incident_description(spark, sf_dir):
    return inc.incident_descriptions(event_docs(spark, sf_dir), WINDOW)
