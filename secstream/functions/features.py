"""Detection features as native column expressions (no Python UDF).

Everything here is a Catalyst expression, so it stays inside whole-stage
codegen and does not block predicate pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for equal results) ----------
# Case-insensitive argument patterns.
SHELL_PATTERN = r"/bin/bash|/bin/sh|/bin/zsh|cmd\.exe|powershell"
NETWORK_PATTERN = r"\bcurl\b|\bwget\b|\bnc\b|\bnetcat\b|\bncat\b|\bsocat\b"
SENSITIVE_PATH_PATTERN = r"/etc/passwd|/etc/shadow|/etc/sudoers|/root/|/proc/\d+"
# Syscall sets of the event category, tested in this order.
PROCESS_EXEC_EVENTS = ("execve", "execveat", "fork", "vfork", "clone")
FILE_ACCESS_EVENTS = ("openat", "open", "read", "write", "unlink", "rename", "mkdir", "rmdir",
                      "stat", "lstat", "fstat")
NETWORK_EVENTS = ("connect", "accept", "bind", "listen", "socket", "sendto", "recvfrom", "sendmsg",
                  "recvmsg")
MEMORY_EVENTS = ("mmap", "mprotect", "munmap", "brk", "mlock")
HIGH_ENTROPY = 3.5
# ---------------------------------------------------------------------------

DNS_FEATURES = ("feat_dns_query_length", "feat_dns_query_entropy", "feat_dns_num_subdomains",
                "feat_dns_failed")
HOST_FEATURES = ("feat_is_root_user", "feat_return_failed", "feat_args_length", "feat_args_has_shell",
                 "feat_args_has_network", "feat_args_has_sensitive_path")
MODEL_FEATURES = DNS_FEATURES + HOST_FEATURES


def shannon_entropy(s: Column) -> Column:
    """-sum(p * log2 p) over the characters of ``s``; 0 for empty/null.

    Computed as ``log2(n) - sum(r * log2 r) / n`` over the run lengths ``r``
    of the sorted characters: one sort and one pass, the text is referenced
    once inside the higher-order function (no per-character re-scan)."""
    text = F.coalesce(s, F.lit(""))
    n = F.length(text).cast("double")
    chars = F.array_sort(F.split(text, ""))

    def rlog(r: Column) -> Column:
        return F.when(r > 1, r.cast("double") * F.log2(r.cast("double"))).otherwise(F.lit(0.0))

    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0.0).alias("acc"))

    def step(a: Column, ch: Column) -> Column:
        same = ch == a["prev"]
        return F.struct(ch.alias("prev"),
                        F.when(same, a["run"] + 1).otherwise(F.lit(1)).alias("run"),
                        F.when(same, a["acc"]).otherwise(a["acc"] + rlog(a["run"])).alias("acc"))

    total = F.aggregate(chars, start, step, lambda a: a["acc"] + rlog(a["run"]))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - total / n)


def dns_query_length(q: Column) -> Column:
    """Code points, null -> 0."""
    return F.length(F.coalesce(q, F.lit("")))


def count_char(q: Column, ch: str) -> Column:
    """Number of occurrences of one character."""
    text = F.coalesce(q, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def dns_failed(code: Column) -> Column:
    """0 only when the response code equals 0."""
    return F.when(F.coalesce(code == 0, F.lit(False)), F.lit(0)).otherwise(F.lit(1))


def is_root(user_id: Column) -> Column:
    """Integer user id equal to 0; null/unparseable -> -1 -> not root."""
    return (F.coalesce(user_id.try_cast("bigint"), F.lit(-1)) == 0).cast("int")


def return_failed(return_value: Column) -> Column:
    """Parsed return value < 0; null/unparseable -> 0."""
    return (F.coalesce(return_value.try_cast("bigint"), F.lit(0)) < 0).cast("int")


def has_pattern(text: Column, pattern: str) -> Column:
    """Case-insensitive regex search; null text -> 0."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + pattern).cast("int")


def event_category(event_name: Column) -> Column:
    """X9."""
    e = F.coalesce(event_name, F.lit(""))
    return (
        F.when(e.isin(*PROCESS_EXEC_EVENTS), F.lit("process_exec"))
        .when(e.isin(*FILE_ACCESS_EVENTS), F.lit("file_access"))
        .when(e.isin(*NETWORK_EVENTS), F.lit("network"))
        .when(e.isin(*MEMORY_EVENTS), F.lit("memory"))
        .otherwise(F.lit("other"))
    )


def _features(dns: Column, q: Column, code: Column, args: Column, rv: Column, uid: Column,
              event_name: Column | None) -> Column:
    def d(c: Column, dtype: str) -> Column:
        return F.when(dns, c).otherwise(F.lit(None).cast(dtype))

    def h(c: Column, dtype: str) -> Column:
        return F.when(dns, F.lit(None).cast(dtype)).otherwise(c)

    fields = [
        d(dns_query_length(q), "int").alias("feat_dns_query_length"),
        d(F.round(shannon_entropy(q), 4), "double").alias("feat_dns_query_entropy"),
        d(count_char(q, "."), "int").alias("feat_dns_num_subdomains"),
        d(dns_failed(code), "int").alias("feat_dns_failed"),
        h(is_root(uid), "int").alias("feat_is_root_user"),
        h(return_failed(rv), "int").alias("feat_return_failed"),
        h(F.length(F.coalesce(args, F.lit(""))), "int").alias("feat_args_length"),
        h(has_pattern(args, SHELL_PATTERN), "int").alias("feat_args_has_shell"),
        h(has_pattern(args, NETWORK_PATTERN), "int").alias("feat_args_has_network"),
        h(has_pattern(args, SENSITIVE_PATH_PATTERN), "int").alias("feat_args_has_sensitive_path"),
    ]
    if event_name is not None:
        fields.append(h(event_category(event_name), "string").alias("feat_event_category"))
    return F.struct(*fields)


def with_features(docs: DataFrame) -> DataFrame:
    """X11: ingest-side features, routed by ``log_attribute == 'network_dns'``."""
    a = lambda n: F.col(f"attributes.{n}")
    dns = F.coalesce(F.col("log_attribute") == "network_dns", F.lit(False))
    return docs.withColumn("features", _features(dns, a("dns_query"), a("dns_response_code"), a("args"),
                                                 a("return_value"), a("user_id"), F.col("event_name")))


def serving_features(log_type: Column, attributes: str = "attributes") -> Column:
    """Scoring-side features, routed by ``log_type == 'dns'``, absent ones 0,
    no category (G5: deliberately not identical to X11)."""
    a = lambda n: F.col(f"{attributes}.{n}")
    dns = F.coalesce(log_type == "dns", F.lit(False))
    s = _features(dns, a("dns_query"), a("dns_response_code"), a("args"), a("return_value"), a("user_id"),
                  None)
    return F.struct(*[F.coalesce(s[f], F.lit(0)).alias(f) for f in MODEL_FEATURES])
