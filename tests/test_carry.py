"""Values carried over ranges, against a plain walk; hot keys are spread over tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from secstream.operators import carry as C
from secstream.operators import detections as D
from secstream.operators.ratelimit import bucket_walk, rate_limit, segments
from test_doc_store import plan

SCHEMA = "k string, t long, id long, v long"


def walked(rows, inclusive):
    out, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if inclusive and v is not None:
            last[k] = v
        out[i] = last.get(k)
        if v is not None:
            last[k] = v
    return out


def got(spark, rows, inclusive, tasks=4):
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.last_before(df, ["k"], ["t", "id"], F.col("v"), "last", inclusive, tasks).collect()
    assert len(out) == len(rows)
    return {r["id"]: r["last"] for r in out}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_against_a_walk(spark, inclusive, tasks):
    rng = random.Random(tasks)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.choice([None, *range(20)]), i, rng.choice([None, None, None, i])) for i in range(400)]
    assert got(spark, rows, inclusive, tasks) == walked(rows, inclusive)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 3)),
                          st.one_of(st.none(), st.integers(0, 9))), max_size=30), st.booleans())
def test_any_small_table(spark, triples, inclusive):
    rows = [(k, t, i, v) for i, (k, t, v) in enumerate(triples)]
    assert got(spark, rows, inclusive) == walked(rows, inclusive)


def test_a_value_crosses_ranges_without_one(spark):
    rows = [("hot", 0, 0, 7)] + [("hot", 1 + i, 1 + i, None) for i in range(999)]
    assert set(got(spark, rows, True, 8).values()) == {7}


def test_a_null_of_the_row_before_stays_null(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 2, None), ("a", 3, 3, 6)], SCHEMA)
    out = {r["id"]: r["p"] and r["p"]["v"] for r in C.previous(df, ["k"], ["t", "id"], ["v"], "p").collect()}
    assert out == {1: None, 2: 5, 3: None}


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        C.last_before(df.withColumn("_pid", F.lit(1)), ["k"], ["t"], F.col("v"), "last")
    with pytest.raises(ValueError):
        C.last_before(df, ["k"], ["t"], F.col("v"), "v")
    assert C.last_before(df, ["k"], ["t"], F.col("v"), "last").columns == ["k", "t", "id", "v", "last"]


def test_a_hot_key_is_spread(spark):
    df = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), "id", F.col("id").alias("v"))
    sizes = [r["count"] for r in C.place(df, ["k"], ["t"], 8).groupBy("_pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_no_window_over_a_key_alone(spark):
    df = spark.createDataFrame([("u", 1.0, 1.0, 1)], "k string, t double, v double, id long")
    text = plan(D.counter_increase(df, "k", F.col("t"), F.col("v"), "id"))
    windows = [x for x in text.splitlines() if "windowspecdefinition(" in x]
    specs = [x.split("windowspecdefinition(")[1] for x in windows]
    assert specs and all(s.startswith("_pid") for s in specs)


def serial(rows, rate, burst):
    out = {}
    for c in {r[1] for r in rows}:
        mine = sorted((t, i) for i, cc, t in rows if cc == c)
        allowed, before, after, _ = bucket_walk(np.array([c] * len(mine), dtype=object), np.array([t for t, _ in mine]),
                                                rate / 60.0, burst)
        out.update({i: (bool(a), b, z) for (_, i), a, b, z in zip(mine, allowed, before, after)})
    return out


def test_segments_give_the_serial_walk_to_the_bit(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 10_000, 700_000, 3_999_999, 4_000_000, 4_000_001, 9_000_000])
        rows.append((i, rng.choice(["hot"] * 8 + ["x", "y"]), t))
    df = spark.createDataFrame(rows, "id long, caller string, t long").withColumn("ts", F.timestamp_micros("t"))
    out = {r["id"]: (r["allowed"], r["available"], r["tokens"]) for r in rate_limit(df, "caller", "ts", "id", 30.0, 2.0, 5).collect()}
    assert out == serial(rows, 30.0, 2.0)


def test_a_hot_caller_is_spread_over_segments(spark):
    calls = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("c"), F.col("id") % 50)).alias("caller"), (F.col("id") * 1_000_000).alias("t_us"))
    hot = segments(calls, 1.0, 3.0, 6).filter("caller = 'hot'")
    assert hot.select("segment").distinct().count() == 2000
    parts = hot.repartition(6, "segment").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 6
