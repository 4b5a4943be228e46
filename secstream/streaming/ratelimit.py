"""T3 / T4 on a stream: the token bucket as keyed state of the callers.

``applyInPandasWithState`` keeps the ``(tokens, last)`` of the callers in the state
store between micro-batches (RocksDB on a cluster). The key is a hash group of
callers, ``CALLER_GROUPS`` in all, not the caller: a Python call per key costs
milliseconds, and callers times micro-batches grows with the square of a table whose
callers grow with it. A group's state is one Arrow table of its callers' levels.

Inside a micro-batch a group's calls are sorted by (caller, time, id) and walked,
``WALK_ROWS`` at a time, with the same function as the batch operator. The sort holds
the calls of one group in one micro-batch, so the source must bound a trigger by rows:
the query feeds at most ``ROWS_PER_TRIGGER`` calls a trigger, whatever the table's
size. Calls need a time: one without is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.ratelimit import bucket_walk

OUTPUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("caller", T.StringType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("available", T.DoubleType()),
    T.StructField("tokens", T.DoubleType()),
])
#: Most calls of a trigger, and so of one group of callers in Python memory at a time.
ROWS_PER_TRIGGER = 250_000
WALK_ROWS = 10_000
#: Keys of the state, and so Python calls of a micro-batch, however many callers there are.
CALLER_GROUPS = 64
STATE = T.StructType([T.StructField("levels", T.BinaryType())])
LEVELS = pa.schema([("caller", pa.string()), ("tokens", pa.float64()), ("last", pa.int64())])


def _read_levels(state) -> pa.Table:
    if not state.exists:
        return LEVELS.empty_table()
    return pa.ipc.open_stream(state.get[0]).read_all()


def _write_levels(state, callers: pa.Array, tokens: np.ndarray, last: np.ndarray) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, LEVELS) as w:
        w.write_table(pa.table([callers, tokens, last], schema=LEVELS))
    state.update((sink.getvalue().to_pybytes(),))


def rate_limit_stream(calls: DataFrame, caller_col: str, time_col: str, id_col: str,
                      rate_per_minute: float, burst: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """A decision for every call; columns of ``keep`` are carried to the output."""
    rate_per_sec = rate_per_minute / 60.0
    slim = calls.select(F.col(id_col).cast("bigint").alias("id"), F.col(caller_col).cast("string").alias("caller"),
                        F.unix_micros(F.col(time_col).cast("timestamp")).alias("t_us"), *keep)
    output = T.StructType([*OUTPUT.fields, *(slim.schema[c] for c in keep)])

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch = pd.concat([p[["id", "caller", "t_us", *keep]] for p in pdfs], ignore_index=True)
        if batch["t_us"].isna().any():
            raise ValueError("a call without a time")
        number, names = pd.factorize(batch["caller"].to_numpy(dtype=object), use_na_sentinel=False)  # null is a caller
        order = np.lexsort((batch["id"].to_numpy(), batch["t_us"].to_numpy(), number))
        batch, number = batch.iloc[order], number[order]
        t_us = batch["t_us"].to_numpy()

        kept = _read_levels(state).combine_chunks()
        callers = pa.array(names, pa.string(), from_pandas=True)
        at = pc.index_in(callers, value_set=pa.concat_arrays(kept["caller"].chunks or [pa.array([], pa.string())]))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False)
        tokens, last = kept["tokens"].to_numpy().copy(), kept["last"].to_numpy().copy()
        old = np.flatnonzero(at >= 0)
        levels = dict(zip(old.tolist(), zip(tokens[at[old]].tolist(), last[at[old]].tolist())))

        carried, after = None, np.empty(len(batch))
        for i in range(0, len(batch), WALK_ROWS):
            part, n = batch.iloc[i:i + WALK_ROWS], number[i:i + WALK_ROWS]
            allowed, before, after[i:i + WALK_ROWS], carried = bucket_walk(
                n, t_us[i:i + WALK_ROWS], rate_per_sec, burst, carried, levels)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "caller": part["caller"].to_numpy(), "allowed": allowed,
                                "available": before, "tokens": after[i:i + WALK_ROWS],
                                **{c: part[c].to_numpy() for c in keep}})

        # the level after a caller's last call here; a late call does not set the time back
        ends = np.flatnonzero(np.append(number[1:] != number[:-1], True))
        new = np.flatnonzero(at < 0)
        tokens[at[old]] = after[ends][old]
        last[at[old]] = np.maximum(last[at[old]], t_us[ends][old])
        _write_levels(state, pa.concat_arrays([*kept["caller"].chunks, callers.take(pa.array(new))]),
                      np.append(tokens, after[ends][new]), np.append(last, t_us[ends][new]))

    grouped = slim.withColumn("_group", F.pmod(F.xxhash64("caller"), F.lit(CALLER_GROUPS)))
    return grouped.groupBy("_group").applyInPandasWithState(step, output, STATE, "append",
                                                            GroupStateTimeout.NoTimeout)
