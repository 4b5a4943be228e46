"""Detection jobs described in prose by the reference.

Each is a plain DataFrame job. Windows are partitioned by time cells of a
key, or values are carried over ranges (``carry``), where a key may hold a large share of the rows;
interval joins get an equi key by expanding time buckets on one side, so no
cross join is ever planned.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import HIGH_ENTROPY, NETWORK_PATTERN, has_pattern
from ..functions.timeparse import epoch_seconds, parse_iso
from .carry import carry, last_before, place, previous
from .incidents import incident_events, incident_groups, severity_from_flags, severity_rank
from .ranking import exact_rank

# ---- fixed values (ours, from the runbook prose) ---------------------------
PERSISTENCE_PATTERN = (r"/etc/cron|/var/spool/cron|/etc/systemd/system|/usr/lib/systemd/system|/etc/init\.d|/etc/rc\.local"
                       r"|/etc/profile\.d|/etc/environment|authorized_keys|\.bashrc")
# an interactive shell, a shell told to run a command, or a network tool told to execute one
INTERACTIVE_SHELL_PATTERN = r"(ba|z|/)sh -(i|c)|pty\.spawn|(nc|ncat|netcat|socat) .*-e"
IPV4 = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"
DNS_ALLOWLIST = ("example.com", "amazonaws.com")
WEB_SERVERS = ("nginx", "apache", "apache2", "httpd", "gunicorn", "node")
DEBUGGERS = ("gdb", "strace", "lldb")
SHELLS = ("sh", "bash", "dash", "zsh")
# ---------------------------------------------------------------------------


def cold_store_write(docs: DataFrame, path: str) -> None:
    """Date-partitioned copy of every event (year=/month=/day=). Rows are gathered by day for
    few files; a day larger than the advisory size is split over several tasks (adaptive rebalance)."""
    out = docs.withColumn("year", F.year("event_time")).withColumn("month", F.month("event_time")) \
        .withColumn("day", F.dayofmonth("event_time"))
    out.hint("rebalance", F.col("year"), F.col("month"), F.col("day")).write.mode("overwrite") \
        .partitionBy("year", "month", "day").parquet(path)


def forensics(spark, path: str, as_of: str, days: int, event_name: str = "execve") -> DataFrame:
    """``event_name`` by root in the last ``days`` days over all hosts;
    the date filter is on the partition columns, so only those days are read."""
    end = parse_iso(F.lit(as_of))
    start = end - F.make_interval(days=F.lit(days))
    day = F.make_date("year", "month", "day")
    df = spark.read.parquet(path)
    return df.filter(day.between(F.to_date(start), F.to_date(end))) \
        .filter((F.col("event_name") == event_name) & (F.col("attributes.user_id") == 0)) \
        .filter(F.col("event_time").between(start, end))


def base_domain(q: Column) -> Column:
    return F.regexp_extract(F.coalesce(q, F.lit("")), r"([^.]+\.[^.]+)$", 1)


def nxdomain_rates(dns_docs: DataFrame, allowlist=DNS_ALLOWLIST) -> DataFrame:
    """Per host the NXDOMAIN (code 3) rate, and high-entropy queries whose
    base domain is not allow-listed (a small fixed list: an ``isin``)."""
    host = F.col("attributes.source_ip")
    ent = F.col("features.feat_dns_query_entropy")
    unlisted = ~base_domain(F.col("attributes.dns_query")).isin(*allowlist)
    return dns_docs.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("dns_events"),
        F.count_if(F.col("attributes.dns_response_code") == 3).alias("nxdomain"),
        F.count_if((ent > HIGH_ENTROPY) & unlisted).alias("high_entropy_unlisted"),
    ).withColumn("nx_rate", F.round(F.col("nxdomain") / F.col("dns_events"), 6))


def is_private_ipv4(text: Column) -> Column:
    o = [F.regexp_extract(text, IPV4, i).try_cast("int") for i in (1, 2, 3, 4)]
    return ((o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168))
            | (o[0] == 127))


def rule_findings(host_docs: DataFrame) -> DataFrame:
    """Rule table over kernel/host args -> findings per (rule, host)."""
    args = F.coalesce(F.col("attributes.args"), F.lit(""))
    addresses = F.regexp_extract_all(args, F.lit(f"({IPV4})"), F.lit(1))
    external = F.exists(addresses, lambda a: ~F.coalesce(is_private_ipv4(a), F.lit(False)))
    rules = [
        ("persistence_path", has_pattern(args, PERSISTENCE_PATTERN) == 1),
        ("network_external", (has_pattern(args, NETWORK_PATTERN) == 1) & external),
        ("interactive_shell", has_pattern(args, INTERACTIVE_SHELL_PATTERN) == 1),
        ("account_file", has_pattern(args, r"/etc/(passwd|shadow|sudoers)") == 1),
        ("escalation_tool", has_pattern(args, r"\b(su|sudo|pkexec)\b") == 1),
        ("process_memory", (has_pattern(args, r"/proc/\d+/mem") == 1) | F.coalesce(
            (F.col("event_name") == "ptrace") & ~F.col("attributes.process_name").isin(*DEBUGGERS), F.lit(False))),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    f = host_docs.select(F.col("attributes.host_name").alias("host"), F.explode(hits).alias("rule"))
    return f.groupBy("rule", "host").agg(F.count(F.lit(1)).alias("hits"))


def beaconing(dns_docs: DataFrame, min_calls: int = 5, max_cv: float = 0.1) -> DataFrame:
    """Regular intervals from one host to one base domain: gaps to the call
    before (carried over ranges, so a busy pair is split), then mean, sample
    standard deviation and their ratio."""
    d = dns_docs.select(F.col("attributes.source_ip").alias("host"),
                        base_domain(F.col("attributes.dns_query")).alias("domain"),
                        epoch_seconds(F.col("event_time")).alias("t"), "doc_id")
    g = last_before(d, ["host", "domain"], ["t", "doc_id"], F.col("t"), "before") \
        .withColumn("gap", F.col("t") - F.col("before"))
    out = g.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("calls"), F.avg("gap").alias("avg_gap"),
                                          F.stddev_samp("gap").alias("sd_gap"))
    cv = F.try_divide(F.col("sd_gap"), F.col("avg_gap"))  # calls in one instant have no ratio
    return out.select("host", "domain", "calls", F.round("avg_gap", 3).alias("avg_gap"), F.round(cv, 4).alias("cv"),
                      ((F.col("calls") >= min_calls) & F.coalesce(cv < max_cv, F.lit(False))).alias("regular"))


def shared_credentials(host_docs: DataFrame, window_minutes: int = 1440, min_hosts: int = 2) -> DataFrame:
    """The same credential (user id) on several hosts in one window."""
    d = host_docs.filter(F.col("attributes.user_id").isNotNull()).select(
        F.floor(epoch_seconds(F.col("event_time")) / (60 * window_minutes)).cast("bigint").alias("bucket"),
        F.col("attributes.user_id").alias("user_id"), F.col("attributes.host_name").alias("host"))
    per_host = d.groupBy("bucket", "user_id", "host").agg(F.count(F.lit(1)).alias("n"))
    g = per_host.groupBy("bucket", "user_id").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("events"))
    return g.filter(F.col("hosts") >= min_hosts)


def shared_credentials_sliding(host_docs: DataFrame, window_minutes: int = 1440, slide_minutes: int = 60,
                               min_hosts: int = 2) -> DataFrame:
    """D6 over sliding windows, so a use on both sides of midnight is found: two
    uses at most ``window - slide`` apart always share a window. Events are added
    up per (credential, host, slide) before a row is repeated for its windows, so
    a credential in constant use ships one row per host and slide."""
    if slide_minutes < 1 or window_minutes % slide_minutes:
        raise ValueError("the window must be a multiple of the slide")
    steps = window_minutes // slide_minutes
    d = host_docs.filter(F.col("attributes.user_id").isNotNull() & F.col("event_time").isNotNull()).select(
        F.floor(epoch_seconds(F.col("event_time")) / (60 * slide_minutes)).cast("bigint").alias("slot"),
        F.col("attributes.user_id").alias("user_id"), F.col("attributes.host_name").alias("host"))
    slots = d.groupBy("slot", "user_id", "host").agg(F.count(F.lit(1)).alias("n"))
    w = slots.select("user_id", "host", "n", F.explode(F.sequence(F.col("slot") - (steps - 1), F.col("slot")))
                     .alias("first_slot"))
    per_host = w.groupBy("first_slot", "user_id", "host").agg(F.sum("n").alias("n"))
    g = per_host.groupBy("first_slot", "user_id").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("events"))
    return g.filter(F.col("hosts") >= min_hosts)


def shared_credentials_exact(host_docs: DataFrame, window_minutes: int = 1440) -> DataFrame:
    """D6, exact: each use of a credential with the latest earlier use on another host, where that is at most
    ``window_minutes`` before. A credential has uses on two hosts within the window exactly if a row is returned.

    Uses are ordered by (time, host, id). The latest earlier use on another host is the one before the
    current run of uses on one host: it is carried from the run's first row, over ranges, so a credential
    in constant use is split over tasks. A null host counts as a host; uses without a time are left out."""
    d = host_docs.filter(F.col("attributes.user_id").isNotNull() & F.col("event_time").isNotNull()).select(
        "doc_id", F.col("attributes.user_id").alias("user_id"), F.col("attributes.host_name").alias("host"),
        F.unix_micros("event_time").alias("t_us"))
    placed = place(d, ["user_id"], ["t_us", "host", "doc_id"])
    before = carry(placed, F.struct("doc_id", "host", "t_us"), "before")
    starts = F.col("before").isNotNull() & ~F.col("before.host").eqNullSafe(F.col("host"))
    other = carry(before, F.when(starts, F.col("before")), "other", inclusive=True)
    near = other.filter(F.col("t_us") - F.col("other.t_us") <= window_minutes * 60_000_000)
    return near.select("doc_id", "user_id", "host", F.col("other.doc_id").alias("other_id"),
                       F.col("other.host").alias("other_host"),
                       F.round((F.col("t_us") - F.col("other.t_us")) / 1e6, 3).alias("seconds"))


def exec_after_write(host_docs: DataFrame, keys: dict[str, Column], minutes: int = 5) -> DataFrame:
    """D7, second half: each execution with the last write of the same key in the
    ``minutes`` before it. A write is put into its time bucket and the next one, so
    the ordered pass runs per (key, bucket): a busy host is split by time."""
    width = 60 * minutes
    d = host_docs.filter(F.col("event_name").isin("write", "execve", "execveat") & F.col("event_time").isNotNull()).select(
        "doc_id", *[c.alias(n) for n, c in keys.items()], (F.col("event_name") == "write").alias("_w"),
        epoch_seconds(F.col("event_time")).alias("_t"))
    own = F.floor(F.col("_t") / width).cast("bigint")
    d = d.withColumn("_slot", F.explode(F.when(F.col("_w"), F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_slot").orderBy("_t", F.col("_w").desc(), "doc_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_w"), F.struct(F.col("doc_id").alias("id"), F.col("_t").alias("t"))), True).over(w)
    out = d.withColumn("_last", last).filter(~F.col("_w") & (F.col("_t") - F.col("_last.t") <= width))
    return out.select(F.col("doc_id").alias("exec_id"), F.col("_last.id").alias("write_id"), *keys,
                      F.round(F.col("_t") - F.col("_last.t"), 3).alias("seconds"))


def process_parents(host_docs: DataFrame, pid: Column, parent_pid: Column) -> DataFrame:
    """Each event with the latest earlier event of its parent process on the same
    host, carried over ranges of (host, process id, time): no self join that would list
    every earlier event, and the children of one busy parent are split over tasks. ``root_from_user``: root below a non-root
    parent; ``shell_from_web``: a shell below a web server."""
    base = host_docs.filter(F.col("event_time").isNotNull()).select(
        "doc_id", F.col("attributes.host_name").alias("host"), pid.alias("_pid"), parent_pid.alias("_ppid"),
        epoch_seconds(F.col("event_time")).alias("_t"), F.col("attributes.user_id").alias("user_id"),
        F.col("attributes.process_name").alias("process_name"))
    me = F.struct("doc_id", "user_id", "process_name")
    nothing = F.lit(None).cast(base.select(me).schema[0].dataType)
    sides = F.array(F.struct(F.col("_pid").alias("key"), me.alias("parent"), nothing.alias("child")),
                    F.struct(F.col("_ppid").alias("key"), nothing.alias("parent"), me.alias("child")))
    both = base.select("host", "_t", "doc_id", F.inline(sides)).filter(F.col("key").isNotNull())
    # at one instant parents come first, in the order of their ids
    both = both.withColumn("_c", F.col("child").isNotNull())
    j = last_before(both, ["host", "key"], ["_t", "_c", "doc_id"], F.col("parent"), "p", inclusive=True) \
        .filter(F.col("child").isNotNull() & F.col("p").isNotNull())
    c, p = (lambda n: F.col(f"child.{n}")), (lambda n: F.col(f"p.{n}"))
    return j.select(
        c("doc_id").alias("doc_id"), p("doc_id").alias("parent_id"), "host",
        F.coalesce((c("user_id") == 0) & (p("user_id") != 0), F.lit(False)).alias("root_from_user"),
        F.coalesce(c("process_name").isin(*SHELLS) & p("process_name").isin(*WEB_SERVERS), F.lit(False))
        .alias("shell_from_web"))


def exact_quantiles(df: DataFrame, key: str, value: str, row_id: str, probabilities: dict[str, float]) -> DataFrame:
    """D11, exact: the value of rank ceil(p * n) per key. Ranks come from a range
    sort with per-task offsets, so no key's values are gathered in one task."""
    d = df.filter(F.col(value).isNotNull()).select(key, value, row_id)
    n = d.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    r = exact_rank(d, [key], [value, row_id], "_r")
    j = r.join(n, F.col(key).eqNullSafe(F.col("_k")))
    picks = [F.max(F.when(F.col("_r") == F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1)), F.col(value))).alias(name)
             for name, p in probabilities.items()]
    return j.groupBy(key).agg(*picks)


def unmatched_mmaps(host_docs: DataFrame) -> DataFrame:
    """mmap/brk allocations without a matching munmap per host."""
    e = F.col("event_name")
    g = host_docs.groupBy(F.col("attributes.host_name").alias("host")).agg(
        F.count_if(e.isin("mmap", "brk")).alias("allocs"), F.count_if(e == "munmap").alias("frees"))
    return g.withColumn("unmatched", F.col("allocs") - F.col("frees")).filter(F.col("unmatched") > 0)


def merge_incidents(docs: DataFrame, window_minutes: int = 10, max_gap_buckets: int = 3) -> DataFrame:
    """Gaps-and-islands over each host's incident groups: groups whose
    buckets are at most ``max_gap_buckets`` apart form one merged incident. The
    untimed group (bucket 0) is far from every real bucket: an incident of its own."""
    return _islands(incident_groups(docs, window_minutes), ["host"], max_gap_buckets)


def merge_by_category(docs: DataFrame, category: Column, window_minutes: int = 10, max_gap_buckets: int = 3) -> DataFrame:
    """D8 with the category rule: only windows of one host and one category merge.
    Events are first added up per (host, category, bucket), so the sorted window
    holds one row per time bucket, not one per event."""
    ev = incident_events(docs, window_minutes).withColumn("category", category)
    sev = severity_from_flags(F.max("is_evil"), F.max("is_sus_risky"), F.max("is_sus"))
    g = ev.groupBy("host", "category", "bucket").agg(F.count(F.lit(1)).alias("event_count"),
                                                     severity_rank(sev).alias("severity_rank"))
    return _islands(g, ["host", "category"], max_gap_buckets)


def _islands(groups: DataFrame, keys: list[str], max_gap_buckets: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bucket")
    brk = F.when(F.col("bucket") - F.lag("bucket").over(w) <= max_gap_buckets, 0).otherwise(1)
    g = groups.withColumn("_b", brk).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "island").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
        F.count(F.lit(1)).alias("groups"), F.sum("event_count").alias("events"), F.max("severity_rank").alias("worst"))


def counter_increase(df: DataFrame, key: str, t: Column, v: Column, tiebreak: str) -> DataFrame:
    """Counter increase with reset handling (a drop means a reset, the
    new value is the increase) and the rate per hour over the key's span. The value
    before is carried over ranges, so a key with many samples is split over tasks."""
    d = df.select(key, tiebreak, t.alias("_t"), v.alias("_v"))
    d = previous(d, [key], ["_t", tiebreak], ["_v"], "_before").withColumn("_p", F.col("_before._v"))
    inc = F.when(F.col("_p").isNull(), F.lit(0.0)).when(F.col("_v") < F.col("_p"), F.col("_v")) \
        .otherwise(F.col("_v") - F.col("_p"))
    g = d.withColumn("_inc", inc).groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("_inc").alias("increase"),
        ((F.max("_t") - F.min("_t")) / 3600.0).alias("hours"))
    return g.select(key, "samples", F.round("increase", 6).alias("increase"),
                    F.round(F.when(F.col("hours") > 0, F.col("increase") / F.col("hours")), 6).alias("rate_per_hour"))


def parent_child(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each row joined to its parent (the previous turn): an equi join on
    (key, order - 1), co-partitioned by the key."""
    parent = messages.select(F.col(key), (F.col(order) + 1).alias(order), F.col("role").alias("parent_role"),
                             F.length("text").alias("parent_chars"))
    return messages.select(key, order, "role", F.length("text").alias("chars")).join(parent, [key, order])


def recent_changes(incidents: DataFrame, changes: DataFrame, key: str, hours: int = 2) -> DataFrame:
    """The changes of the ``hours`` before each incident on the same key.
    Changes are bucketed by hour and each incident probes its ``hours + 1``
    buckets, which turns the interval join into an equi join plus a filter."""
    inc = incidents.select(F.col("id").alias("incident_id"), F.col(key), F.col("ts").alias("inc_ts")) \
        .withColumn("_h", F.explode(F.sequence(F.floor(F.unix_seconds("inc_ts") / 3600).cast("bigint") - hours,
                                               F.floor(F.unix_seconds("inc_ts") / 3600).cast("bigint"))))
    ch = changes.select(F.col("id").alias("change_id"), F.col(key), F.col("ts").alias("ch_ts")) \
        .withColumn("_h", F.floor(F.unix_seconds("ch_ts") / 3600).cast("bigint"))
    j = inc.join(ch, [key, "_h"]).filter(
        F.col("ch_ts").between(F.col("inc_ts") - F.make_interval(hours=F.lit(hours)), F.col("inc_ts")))
    return j.select("incident_id", "change_id", key,
                    F.round((F.unix_micros("inc_ts") - F.unix_micros("ch_ts")) / 6e7, 3).alias("minutes_before"))


def span_breakdown(parents: DataFrame, children: DataFrame, key: str, duration: str) -> DataFrame:
    """Self time of each parent span = its duration minus the summed
    durations of its child spans. The children are aggregated by parent key
    first (partial aggregation), then joined: no per-parent collect."""
    c = children.groupBy(key).agg(F.count(F.lit(1)).alias("children"), F.sum(duration).alias("child_time"))
    j = parents.join(c, key, "left")
    return j.select(key, F.col(duration).alias("duration"), F.coalesce("children", F.lit(0)).alias("children"),
                    F.coalesce("child_time", F.lit(0.0)).alias("child_time"),
                    (F.col(duration) - F.coalesce("child_time", F.lit(0.0))).alias("self_time"))


def leakage_classifier(texts: DataFrame, text_col: str, label_col: str, dim: int = 1 << 12, seed: int = 42):
    """A text classifier for prompt leakage: tokens + hashed term
    frequencies + logistic regression (MLlib, distributed training).
    Returns the fitted pipeline model. The regression reads its rows twice before it
    keeps blocks of them, so labels and frequencies are worked out once, onto disk."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\s+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    regression = LogisticRegression(featuresCol="_tf", labelCol=label_col, maxIter=50, regParam=0.01)
    rows = tf.transform(tokens.transform(texts)).select("_tf", label_col).persist(StorageLevel.DISK_ONLY)
    try:
        return PipelineModel([tokens, tf, regression.fit(rows)])
    finally:
        rows.unpersist()
