"""D3: slope and R² over a trailing time window, from moments that add up.

A window function per key gives one task all rows of the key and goes through the whole frame for
each of them. Here time is cut into cells, ``CELLS`` to a window, and each row's window is

* the whole cells between, from a table of moments per (key, cell);
* its own cell up to the row;
* the window's first cell from the window's start on.

The two edges are running sums inside one (key, cell), so a key with a third of all rows is
spread over its cells (rows of one instant share one), and the work for a row does not grow
with its window. Moments are exact: times are whole microseconds from the row's cell, values whole millionths, both summed as
decimals, so nothing cancels when they are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of an hour.
HOUR = 3_600_000_000
#: Cells of a window. A cell with data gives CELLS - 1 rows of moments: more cells split a busy key finer,
#: fewer shuffle less where most cells hold a row or two.
CELLS = 6
_MILLIONTHS = 1_000_000
_SUMS = ("n", "m", "sx", "sy", "sxx", "sxy", "syy")


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _moments(over=None) -> list[Column]:
    """Sums over the data rows (``_x``, the time from the cell's start; ``_y``): n counts rows, m those with a value."""
    x, y = F.col("_x"), F.col("_y")
    seen = F.when(y.isNotNull(), x)
    sums = {"n": F.sum(F.when(x.isNotNull(), 1).otherwise(0)), "m": F.count(seen), "sx": F.sum(_decimal(seen)),
            "sy": F.sum(_decimal(y)), "sxx": F.sum(_decimal(seen) * _decimal(seen)), "sxy": F.sum(_decimal(seen) * _decimal(y)),
            "syy": F.sum(_decimal(y) * _decimal(y))}
    return [F.coalesce(c.over(over) if over is not None else c, F.lit(0)).alias(k) for k, c in sums.items()]


def _shifted(by: Column) -> list[Column]:
    """The same moments seen from a cell that starts ``by`` microseconds earlier."""
    d, m, sx, sy = _decimal(by), F.col("m").cast("decimal(20,0)"), F.col("sx"), F.col("sy")
    new = {"n": F.col("n"), "m": F.col("m"), "sx": sx + d * m, "sy": sy, "sxx": F.col("sxx") + d * sx * 2 + d * d * m,
           "sxy": F.col("sxy") + d * sy, "syy": F.col("syy")}
    return [c.cast("bigint" if k in ("n", "m") else "decimal(38,0)").alias(k) for k, c in new.items()]


def rolling_trend(df: DataFrame, key: str, x_us: Column, y: Column, width_us: int, row_id: str, unit: int = HOUR,
                  cells: int = CELLS) -> DataFrame:
    """``(row_id, n, slope, r2)`` for every row: over the rows of its key with ``x`` in ``[x - width, x]``, rows of one
    instant included, their number and the trend of ``y`` by ``unit`` of time.

    ``x_us``: whole microseconds; ``y``: rounded to millionths. Rows without a time have no window: n is 0. Rows
    without a value count but do not bear on the trend. The slope is null unless two times differ; R² is then 1 where
    all values are equal. ``row_id`` must be unique. Sums beyond 38 digits go on as doubles.
    """
    if width_us <= 0 or width_us % cells:
        raise ValueError("the width must be a positive multiple of the number of cells")
    step = width_us // cells
    t = F.col("_t")
    d = df.select(F.col(row_id).alias("_id"), F.col(key).alias("_key"), x_us.cast("bigint").alias("_t"),
                  F.round(y * _MILLIONTHS).cast("bigint").alias("_y"))
    timed = d.where(t.isNotNull()).withColumn("_cell", t - F.pmod(t, F.lit(step)))  # the cell's first microsecond
    data = timed.select("_id", "_key", "_cell", (t - F.col("_cell")).alias("_x"), "_y", F.lit(False).alias("probe"))
    # the row's probe lies at the window's start, ``cells`` cells before its own, at the same place in the cell
    probes = timed.select("_id", "_key", (F.col("_cell") - width_us).alias("_cell"), (t - F.col("_cell")).alias("at"))
    # left to right in the row's own cell; peers of one instant are in
    own = Window.partitionBy("_key", "_cell").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    here = data.select("_id", *_moments(own))
    # right to left in the first cell: data at or after the probe
    both = data.select("_id", "_key", "_cell", "_x", "_y", F.col("_x").alias("at"), "probe").unionByName(
        probes.select("_id", "_key", "_cell", F.lit(None).cast("bigint").alias("_x"), F.lit(None).cast("bigint").alias("_y"),
                      "at", F.lit(True).alias("probe")))
    back = Window.partitionBy("_key", "_cell").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    first = both.select("_id", "probe", *_moments(back)).where("probe").select("_id", *_shifted(F.lit(-width_us)))
    # whole cells: at most ``cells - 1`` rows for each (key, cell) that holds data
    per_cell = data.groupBy("_key", "_cell").agg(*_moments())
    spread = per_cell.select("_key", F.explode(F.expr(f"sequence(_cell + {step}L, _cell + {width_us - step}L, {step}L)"))
                             .alias("home"), "_cell", *_SUMS) if cells > 1 else None
    parts = here.unionByName(first)
    if spread is not None:
        between = spread.select("_key", "home", *_shifted(F.col("_cell") - F.col("home"))) \
            .groupBy("_key", "home").agg(*[F.sum(c).alias(c) for c in _SUMS])
        rows = data.select("_id", F.col("_key").alias("k"), F.col("_cell").alias("c"))
        got = rows.join(between, F.col("k").eqNullSafe(F.col("_key")) & (F.col("c") == F.col("home")))
        parts = parts.unionByName(got.select("_id", *_SUMS))
    total = parts.unionByName(d.where(t.isNull()).select("_id", *[F.lit(0).alias(c) for c in _SUMS])) \
        .groupBy("_id").agg(*[F.sum(c).alias(c) for c in _SUMS])

    def spread_of(product: str, a: str, b: str) -> Column:  # m * sum(ab) - sum(a) * sum(b)
        exact = F.try_subtract(F.try_multiply(_decimal(F.col("m")), F.col(product)), F.try_multiply(F.col(a), F.col(b)))
        m, p, u, v = (F.col(c).cast("double") for c in ("m", product, a, b))
        return F.coalesce(exact.cast("double"), m * p - u * v)

    total = total.select("_id", "n", spread_of("sxx", "sx", "sx").alias("xx"), spread_of("sxy", "sx", "sy").alias("xy"),
                         spread_of("syy", "sy", "sy").alias("yy"))
    slope = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx") * F.lit(unit / _MILLIONTHS))
    r2 = F.when(F.col("xx") > 0, F.when(F.col("yy") > 0, F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).otherwise(1.0))
    return total.select(F.col("_id").alias(row_id), F.col("n").cast("bigint").alias("n"), slope.alias("slope"), r2.alias("r2"))
