"""Rolling trends against a brute-force fit over each row's window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secstream.operators.rolling import HOUR, rolling_trend
from test_doc_store import plan

DAY = 24 * HOUR


def brute(rows, width):
    out = {}
    for i, k, x, y in rows:
        win = [(b, c) for _, kk, b, c in rows if kk == k and x is not None and b is not None and x - width <= b <= x]
        pts = [(b - x, c) for b, c in win if c is not None]
        slope = r2 = None
        if len({b for b, _ in pts}) > 1:
            xs, ys = np.array([b / HOUR for b, _ in pts]), np.array([c for _, c in pts])
            dx, dy = xs - xs.mean(), ys - ys.mean()
            slope = float((dx * dy).sum() / (dx * dx).sum())
            r2 = 1.0 if len(set(ys)) == 1 else float((dx * dy).sum() ** 2 / ((dx * dx).sum() * (dy * dy).sum()))
        out[i] = (len(win), slope, r2)
    return out


def run(spark, rows, width=DAY, cells=24):
    df = spark.createDataFrame(rows, "id long, k string, x long, y double")
    out = rolling_trend(df, "k", F.col("x"), F.col("y"), width, "id", cells=cells)
    assert out.count() == len(rows)
    return {r["id"]: (r["n"], r["slope"], r["r2"]) for r in out.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][0] == b[i][0], i
        for u, v in zip(a[i][1:], b[i][1:]):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-6, abs=1e-9)), (i, a[i], b[i])


@pytest.mark.parametrize("cells", [1, 4, 24])
def test_against_brute_force(spark, cells):
    rng = random.Random(cells)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice([rng.randrange(5 * DAY), rng.randrange(120) * HOUR]),
             rng.choice([None, round(rng.uniform(-50, 500), 2), 7.0])) for i in range(300)]
    same(run(spark, rows, cells=cells), brute(rows, DAY))


def test_edges_ties_and_missing_parts(spark):
    rows = [(0, "a", 0, 1.0), (1, "a", DAY, 5.0), (2, "a", DAY + 1, 6.0), (3, "a", DAY, 9.0), (4, "a", None, 3.0),
            (5, "b", -5, 2.0), (6, "b", -5, 3.0), (7, "c", 10 ** 15, None), (8, None, 7, 1.0), (9, None, 9, 1.0)]
    got = run(spark, rows)
    same(got, brute(rows, DAY))
    assert got[4] == (0, None, None) and got[1][0] == got[3][0] == 3 and got[6] == (2, None, None)
    assert got[9] == (2, 0.0, 1.0)


def test_times_a_microsecond_apart_do_not_cancel(spark):
    base = 1_700_000_000_000_000
    rows = [(0, "a", base, 100.25), (1, "a", base + 1, 100.5)]
    assert run(spark, rows)[1][1] == pytest.approx(0.25 * HOUR, rel=1e-12)


def test_empty_and_refused(spark):
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        run(spark, [], width=25)


def test_windows_stay_inside_a_cell(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0)], "id long, k string, x long, y double")
    text = plan(rolling_trend(df, "k", F.col("x"), F.col("y"), DAY, "id"))
    specs = [x.split("windowspecdefinition(")[1] for x in text.splitlines() if "windowspecdefinition(" in x]
    assert specs and all("_cell" in s.split("ASC")[0].split("DESC")[0] for s in specs) and "regr" not in text
