"""The rate-limit stream's keys are groups of callers: their number does not grow with the callers."""

import numpy as np
from pyspark.sql import functions as F

from secstream.operators.ratelimit import bucket_walk
from secstream.streaming import ratelimit as R

BATCHES, CALLERS, BURST = 3, 200, 2.0


def _calls(n=1500):
    """(batch, id, caller, t_us): callers come back in later batches, some calls are late, some callers null."""
    rng = np.random.default_rng(7)
    caller = rng.integers(0, CALLERS, n)
    t = 1_700_000_000_000_000 + np.sort(rng.integers(0, 400_000_000, n)) - np.where(rng.random(n) < 0.05, 200_000_000, 0)
    return [(i * BATCHES // n, i, None if c == 0 else f"c{c}", int(x)) for i, (c, x) in enumerate(zip(caller, t))]


def _expected(calls):
    out = {}
    for who in {c for _, _, c, _ in calls}:
        state = None
        for b in range(BATCHES):
            mine = sorted((t, i) for x, i, c, t in calls if x == b and c == who)
            if not mine:
                continue
            ok, before, after, end = bucket_walk(np.full(len(mine), f"{who}!", dtype=object), np.array([t for t, _ in mine]),
                                                 1.0 / 60, BURST, state)
            state = end
            out.update({i: (who, bool(o), x, y) for (_, i), o, x, y in zip(mine, ok, before, after)})
    return out


def test_state_has_a_key_a_group_and_every_caller_keeps_its_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "WALK_ROWS", 16)
    calls = _calls()
    for b in range(BATCHES):
        rows = [(i, c, t) for x, i, c, t in calls if x == b]
        spark.createDataFrame(rows, "id bigint, caller string, t_us bigint").coalesce(1).select(
            "id", "caller", F.timestamp_micros("t_us").alias("ts")).write.mode("append").parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema("id bigint, caller string, ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    q = (R.rate_limit_stream(stream, "caller", "ts", "id", 1.0, BURST).writeStream.format("parquet")
         .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(calls)
    assert {r["id"]: (r["caller"], r["allowed"], r["available"], r["tokens"]) for r in got} == _expected(calls)
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(keys) <= 64 < len({c for _, _, c, _ in calls})
