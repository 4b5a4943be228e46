"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Sources are numbered by code point (null last) and weigh ``weights`` in turn.
Their targets share the whole size of the corpus by weight; a target stops at
``max_repeats`` times its source's size and the excess is shared again by
weight until none is above (water filling, solved in one pass over the sources
sorted by the level at which they fill up).

Inside a source, documents are shuffled by a hash of their id and queued again
for every repeat. The virtual finish time of a queued copy is the source's
cumulative size up to and with the copy, divided by its target. All copies
are put into ranges of finish time, and the ordered queue is cut
where the running size would pass the budget: ranges below the cut are taken
whole, and the range at the cut is sorted by (finish time, source).

Cumulative sizes never need a whole source in one task: the hash is cut into
``16**hash_digits`` intervals, intervals are summed first, and running sums
inside one interval start from the sum of those before it.

Defined cases: a null text has size 0; documents of size 0 take nothing; an
empty table gives no rows; repeated ids are queued one after the other; a
source name is never confused with null. Text never moves here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, PlainNames, shared_folder

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
HASH_DIGITS = 3
FINISH_RANGES = 4_096
SALT = ":mix"


def with_size(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``__size``: the number of words of the text."""
    return df.withColumn("__size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0))
                         .cast("bigint"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: __rank, __source, __source_size, __target.

    The two windows without partition run over the sources, one row each.
    """
    rank = Window.orderBy(F.col("__source").asc_nulls_last())
    sums = sized.groupBy(F.col("source").alias("__source")).agg(F.sum("__size").alias("__source_size"))
    ranked = (sums.withColumn("__rank", F.row_number().over(rank))
              .withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)),
                                                   ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
              .withColumn("__most", F.col("__source_size") * max_repeats))
    full = Window.orderBy(F.col("__most") / F.col("__weight"), "__rank")
    everything = Window.partitionBy(F.lit(1))
    levels = (ranked
              .withColumn("__filled", F.sum("__most").over(full.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("__open", F.sum("__weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("__total", F.sum("__source_size").over(everything))
              .withColumn("__level", (F.col("__total") - F.coalesce("__filled", F.lit(0))) / F.col("__open"))
              .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__most") / F.col("__weight"),
                                                  F.col("__level"))).over(everything)))
    target = F.least(F.col("__most").cast("double"), F.coalesce(F.col("__weight") * F.col("__level"), F.lit(0.0)))
    return levels.select("__rank", "__source", "__source_size", target.alias("__target"))


def with_finish(sized: DataFrame, targets: DataFrame, hash_digits: int = HASH_DIGITS) -> DataFrame:
    """Append the source's figures and ``__cum``, the source's size up to and with the row, to every row."""
    keyed = (sized.withColumn("__hash", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                       F.lit(SALT))))
             .withColumn("__interval", F.substring("__hash", 1, hash_digits)))
    before = Window.partitionBy("__source").orderBy("__interval").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy(F.col("source").alias("__source"), "__interval").agg(F.sum("__size").alias("__sum"))
            .withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
            .withColumnRenamed("__interval", "__at").drop("__sum"))
    starts = (sums.alias("s").join(targets.alias("t"), F.col("s.__source").eqNullSafe(F.col("t.__source")))
              .select("s.__source", "__at", "__before", "__rank", "__source_size", "__target"))
    inside = (Window.partitionBy("__interval", "__rank").orderBy("__hash", "doc_id", "__size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (keyed.join(starts, F.col("source").eqNullSafe(F.col("__source"))
                       & (F.col("__interval") == F.col("__at")))
            .withColumn("__cum", F.col("__before") + F.sum("__size").over(inside))
            .drop("__source", "__at", "__before", "__interval", "__hash"))


def _copies(rows: DataFrame, max_repeats: int) -> DataFrame:
    """One narrow row per queued copy: finish time, source rank, size, range of finish time."""
    finish = F.try_divide((F.col("__repeat") * F.col("__source_size") + F.col("__cum")).cast("double"), F.col("__target"))
    return (rows.where((F.col("__size") > 0) & (F.col("__target") > 0))
            .select("__rank", "__size", "__cum", "__source_size", "__target",
                    F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("__repeat"))
            .select("__rank", "__size", finish.alias("__finish"))
            .withColumn("__range", F.floor(F.col("__finish") / (1 + F.col("__finish")) * FINISH_RANGES)))


def queue_cut(rows: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[float, int] | None:
    """(finish time, source rank) of the last copy inside the budget; None if nothing is taken."""
    copies = _copies(rows, max_repeats)
    up_to = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = rows.agg(F.sum("__size").alias("__budget"))
    ranges = (copies.groupBy("__range").agg(F.sum("__size").alias("__sum"))
              .withColumn("__upto", F.sum("__sum").over(up_to)))
    total = budget.first()["__budget"]
    if not total:
        return None
    edge = ranges.where(F.col("__upto") > total).orderBy("__range").limit(1).collect()
    order = ("__finish", "__rank")
    if not edge:
        last = copies.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
        return (last["__finish"], last["__rank"]) if last else None
    first = edge[0]
    below = first["__upto"] - first["__sum"]
    running = Window.orderBy(*order, "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = (copies.where(F.col("__range") == first["__range"])
               .withColumn("__upto", F.lit(below) + F.sum("__size").over(running)))
    inside = at_edge.where(F.col("__upto") <= total)
    lower = copies.where(F.col("__range") < first["__range"])
    last = (inside.select(*order).agg(F.max(F.struct(*order)).alias("m")).first()["m"]
            or lower.agg(F.max(F.struct(*order)).alias("m")).first()["m"])
    return (last["__finish"], last["__rank"]) if last else None


def with_repeats(rows: DataFrame, cut: tuple[float, int] | None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Append ``__copies``: how many of the row's queued copies lie at or before the cut."""
    if cut is None:
        return rows.withColumn("__copies", F.lit(0))
    taken = F.lit(0)
    for repeat in range(max_repeats):
        finish = F.try_divide((F.lit(repeat) * F.col("__source_size") + F.col("__cum")).cast("double"), F.col("__target"))
        inside = (F.col("__size") > 0) & ((finish < cut[0]) | ((finish == cut[0]) & (F.col("__rank") <= cut[1])))
        taken = taken + F.coalesce(inside, F.lit(False)).cast("int")
    return rows.withColumn("__copies", taken)


def mix_plan(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``df``."""
    shared_folder(df.sparkSession)
    sized = with_size(df.select("doc_id", "source", F.col(text).alias("text"))).drop("text").checkpoint()
    rows = with_finish(sized, source_targets(sized)).checkpoint()
    return with_repeats(rows, queue_cut(rows)).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("bigint").alias("taken"))


def mix(df: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: every row as often as its copies are taken, with the columns of ``df``.

    Whole rows are shuffled once, to meet their place in the queue. Other columns may have any name
    and type; an empty table gives an empty one.
    """
    shared_folder(df.sparkSession)
    names = PlainNames(df, {"doc_id": "doc_id", "source": "source", text: "text"})
    narrow = with_size(names.rows.select("doc_id", "source", "text")).drop("text").checkpoint()
    targets = source_targets(narrow).checkpoint()
    rows = with_finish(narrow, targets).checkpoint()
    cut = queue_cut(rows)
    whole = with_repeats(with_finish(with_size(names.rows), targets), cut)
    return names.back(whole.where(F.col("__copies") > 0)
                      .select("*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")))
