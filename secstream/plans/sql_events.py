"""The events stand-in mapping and the enriched documents, written in SQL.

This is the oracle side of ``secstream.sources.driver_events`` +
``secstream.operators.ingest``: an independent formulation in plain SQL that
DuckDB runs on the same parquet files. ``DOCS_CTE`` defines the CTE ``docs``
(flat enriched documents) for the oracle queries.
"""

# Fixed patterns, identical to secstream.functions.features.
SHELL = r"/bin/bash|/bin/sh|/bin/zsh|cmd\.exe|powershell"
NETWORK = r"\bcurl\b|\bwget\b|\bnc\b|\bnetcat\b|\bncat\b|\bsocat\b"
SENSITIVE = r"/etc/passwd|/etc/shadow|/etc/sudoers|/root/|/proc/\d+"


def entropy_sql(expr: str) -> str:
    return f"""(CASE WHEN coalesce(length({expr}), 0) = 0 THEN 0.0 ELSE (
        SELECT -sum((cnt / length({expr})::DOUBLE) * log2(cnt / length({expr})::DOUBLE))
        FROM (SELECT count(*) AS cnt FROM unnest(string_split({expr}, '')) AS _c(ch) GROUP BY ch)) END)"""


DOCS_CTE = f"""
ev0 AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_iso,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') OR (event_type = 'error' AND k < 20) THEN 'events-dns.csv'
                 WHEN event_type = 'error' THEN 'events-training.csv'
                 ELSE 'events-host.csv' END AS source_file
  FROM ev0),
ev2 AS (
  SELECT *, CASE WHEN source_file LIKE '%-dns%' THEN 'dns'
                 WHEN source_file LIKE '%training%' OR source_file LIKE '%testing%' OR source_file LIKE '%validation%'
                   THEN 'deep_kernel'
                 ELSE 'standard_host' END AS log_type
  FROM ev1),
parsed AS (
  SELECT event_id, source_file, log_type, ts_iso AS timestamp, ts AS event_ts,
    CASE WHEN log_type = 'dns' THEN 'network_dns' END AS log_attribute,
    CASE WHEN log_type = 'dns' THEN NULL
         WHEN event_type = 'signup' THEN 'execve' WHEN event_type = 'purchase' THEN 'write'
         WHEN k < 40 THEN 'connect' WHEN k < 60 THEN 'mmap' WHEN k < 80 THEN 'clone' ELSE 'ptrace' END AS event_name,
    CASE WHEN log_type = 'dns' THEN '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) END
      AS source_ip,
    CASE WHEN log_type = 'dns' THEN '10.0.0.2' END AS destination_ip,
    CASE WHEN log_type = 'dns' THEN (CASE WHEN k >= 90 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 16) || '.ru'
         ELSE event_type || '.svc' || CAST(k AS VARCHAR) || '.example.com' END) END AS dns_query,
    CASE WHEN log_type = 'dns' THEN (CASE WHEN k = 0 THEN NULL WHEN value >= 400 OR event_type = 'error' THEN 3 ELSE 0 END)
      END::INTEGER AS dns_response_code,
    CASE WHEN log_type <> 'dns' THEN 'host-' || CAST(user_id AS VARCHAR) END AS host_name,
    CASE WHEN log_type <> 'dns' THEN CAST(k AS BIGINT) END AS attr_event_id,
    CASE WHEN log_type <> 'dns' THEN (CASE WHEN event_type = 'error' THEN -1 ELSE 0 END) END::BIGINT AS return_value,
    CASE WHEN log_type <> 'dns' THEN event_id END AS process_id,
    CASE WHEN log_type <> 'dns' THEN user_id + 1 END AS parent_process_id,
    CASE WHEN log_type <> 'dns' THEN (CASE WHEN k < 20 THEN 'bash' WHEN k < 45 THEN 'python3' WHEN k < 70 THEN 'nginx'
         WHEN k < 85 THEN 'sshd' ELSE 'curl' END) END AS process_name,
    CASE WHEN log_type <> 'dns' THEN (CASE WHEN k % 10 = 0 THEN 0 ELSE user_id + 1000 END) END::BIGINT AS user_id,
    CASE WHEN log_type = 'deep_kernel' THEN event_id END AS thread_id,
    CASE WHEN log_type = 'deep_kernel' THEN 4026531840 END::BIGINT AS mount_namespace,
    CASE WHEN log_type = 'deep_kernel' THEN '[]' END AS stack_addresses,
    CASE WHEN log_type <> 'dns' THEN 2 END::INTEGER AS args_num,
    CASE WHEN log_type <> 'dns' THEN (CASE WHEN k >= 90 THEN '/bin/bash -c id'
         WHEN k >= 80 THEN 'wget http://203.0.113.' || CAST(k AS VARCHAR) || '/p'
         WHEN k >= 70 THEN 'cat /etc/passwd'
         ELSE '/usr/bin/app --v ' || CAST(cents AS VARCHAR) END) END AS args,
    CAST(event_type = 'error' AS INTEGER) AS sus,
    CAST(event_type = 'error' AND value >= 50 AS INTEGER) AS evil
  FROM ev2),
docs AS (
  SELECT *,
    CASE WHEN log_attribute = 'network_dns' THEN CAST(length(coalesce(dns_query, '')) AS INTEGER) END
      AS feat_dns_query_length,
    CASE WHEN log_attribute = 'network_dns' THEN round({entropy_sql("coalesce(dns_query, '')")}, 4) END
      AS feat_dns_query_entropy,
    CASE WHEN log_attribute = 'network_dns' THEN
      CAST(length(coalesce(dns_query, '')) - length(replace(coalesce(dns_query, ''), '.', '')) AS INTEGER) END
      AS feat_dns_num_subdomains,
    CASE WHEN log_attribute = 'network_dns' THEN (CASE WHEN dns_response_code = 0 THEN 0 ELSE 1 END) END
      AS feat_dns_failed,
    CASE WHEN log_attribute IS NULL THEN CAST(coalesce(user_id, -1) = 0 AS INTEGER) END AS feat_is_root_user,
    CASE WHEN log_attribute IS NULL THEN CAST(coalesce(return_value, 0) < 0 AS INTEGER) END AS feat_return_failed,
    CASE WHEN log_attribute IS NULL THEN CAST(length(coalesce(args, '')) AS INTEGER) END AS feat_args_length,
    CASE WHEN log_attribute IS NULL THEN CAST(regexp_matches(coalesce(args, ''), '(?i){SHELL}') AS INTEGER) END
      AS feat_args_has_shell,
    CASE WHEN log_attribute IS NULL THEN CAST(regexp_matches(coalesce(args, ''), '(?i){NETWORK}') AS INTEGER) END
      AS feat_args_has_network,
    CASE WHEN log_attribute IS NULL THEN CAST(regexp_matches(coalesce(args, ''), '(?i){SENSITIVE}') AS INTEGER) END
      AS feat_args_has_sensitive_path,
    CASE WHEN log_attribute IS NULL THEN (CASE
         WHEN event_name IN ('execve', 'execveat', 'fork', 'vfork', 'clone') THEN 'process_exec'
         WHEN event_name IN ('openat', 'open', 'read', 'write', 'unlink', 'rename', 'mkdir', 'rmdir', 'stat', 'lstat',
                             'fstat') THEN 'file_access'
         WHEN event_name IN ('connect', 'accept', 'bind', 'listen', 'socket', 'sendto', 'recvfrom', 'sendmsg', 'recvmsg')
           THEN 'network'
         WHEN event_name IN ('mmap', 'mprotect', 'munmap', 'brk', 'mlock') THEN 'memory'
         ELSE 'other' END) END AS feat_event_category,
    md5(CASE WHEN log_attribute = 'network_dns' THEN concat_ws('|', source_file, timestamp, coalesce(source_ip, 'None'),
          coalesce(dns_query, 'None'), coalesce(CAST(dns_response_code AS VARCHAR), 'None'))
        ELSE concat_ws('|', source_file, timestamp, coalesce(CAST(process_id AS VARCHAR), 'None'),
          coalesce(event_name, 'None'), coalesce(CAST(return_value AS VARCHAR), 'None'), coalesce(args, 'None')) END)
      AS doc_id,
    coalesce(epoch_us(event_ts) / 1e6, 0.0) AS epoch
  FROM parsed)
"""

ENRICHED_COLUMNS = (
    "event_id", "doc_id", "source_file", "log_type", "timestamp", "log_attribute", "event_name",
    "source_ip", "destination_ip", "dns_query", "dns_response_code", "host_name", "attr_event_id",
    "return_value", "process_id", "parent_process_id", "process_name", "user_id", "thread_id",
    "mount_namespace", "stack_addresses", "args_num", "args", "sus", "evil",
    "feat_dns_query_length", "feat_dns_query_entropy", "feat_dns_num_subdomains", "feat_dns_failed",
    "feat_is_root_user", "feat_return_failed", "feat_args_length", "feat_args_has_shell",
    "feat_args_has_network", "feat_args_has_sensitive_path", "feat_event_category",
)


def with_docs(select: str, ctes: str = "") -> str:
    """``WITH <docs CTEs>[, <ctes>] <select>``."""
    extra = (",\n" + ctes.strip().rstrip(",")) if ctes.strip() else ""
    return "WITH " + DOCS_CTE.strip() + extra + "\n" + select.strip()
