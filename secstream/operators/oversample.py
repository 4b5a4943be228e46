"""M5: Borderline-SMOTE (borderline-2) to a 1:1 class balance, as Spark jobs.

1. ``m`` nearest neighbours (Euclidean, exact blocked top-k) of every
   minority row among all rows; a minority row is in *danger* when at least
   half, but not all, of them are majority rows.
2. For danger rows: ``k`` nearest minority neighbours and ``k`` nearest
   majority neighbours.
3. ``neg - pos`` synthetic rows are spread evenly over the danger rows
   (exact counts from a distributed rank); each picks a neighbour and a gap
   from a hash of (row, sample, seed), so runs repeat: toward a minority
   neighbour with a gap in [0, 1), toward a majority neighbour (borderline-2)
   with a gap in [0, 0.5).
4. Binary features are rounded and clipped to 0/1.

Skipped (input returned unchanged) when there is no positive row, when the
classes are already balanced, or when no row is in danger. Apply it to the
training split only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import exact_rank
from .similarity import top_k_similar

# ---- fixed values (library defaults the reference relies on) ---------------
K_NEIGHBORS = 5
M_NEIGHBORS = 10
BINARY_FEATURES = ("feat_dns_failed", "feat_is_root_user", "feat_return_failed", "feat_args_has_shell",
                   "feat_args_has_network", "feat_args_has_sensitive_path")
# ---------------------------------------------------------------------------


def _u01(*cols) -> F.Column:
    """Deterministic uniform [0, 1) from a hash of the given columns."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 30)).cast("double")) / float(1 << 30)


def borderline_smote(df: DataFrame, id_col: str, label: str, feature_cols: list[str],
                     k: int = K_NEIGHBORS, m: int = M_NEIGHBORS, seed: int = 42) -> DataFrame:
    """Return ``df`` (with ``synthetic = false``) plus synthetic minority rows
    (``synthetic = true``, id null) up to a 1:1 balance."""
    base = df.withColumn("synthetic", F.lit(False))
    bal = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    pos, neg = bal["p"], bal["n"]
    if pos == 0 or pos >= neg:
        return base
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    pts = df.select(F.col(id_col).alias("id"), F.col(label).alias("y"), vec.alias("v")).persist()
    minority = pts.filter(F.col("y") == 1)
    majority = pts.filter(F.col("y") == 0)
    nn = top_k_similar(minority, pts, m, "id", "id", "v", exclude_self=True, metric="euclidean")
    nn = nn.join(pts.select(F.col("id").alias("neighbor_id"), F.col("y").alias("ny")), "neighbor_id")
    danger = (nn.groupBy("id").agg(F.count_if(F.col("ny") == 0).alias("n_maj"))
              .filter((F.col("n_maj") >= m / 2.0) & (F.col("n_maj") < m)).select("id").persist())  # every search is run once
    n_danger = danger.count()
    if n_danger == 0:
        return base
    n_new = neg - pos
    d_ranked = exact_rank(danger, [], ["id"], "r")
    per = n_new // n_danger
    extra = n_new % n_danger
    samples = d_ranked.withColumn("cnt", F.lit(per) + F.when(F.col("r") <= extra, 1).otherwise(0)) \
        .filter(F.col("cnt") > 0).select("id", F.explode(F.sequence(F.lit(0), F.col("cnt") - 1)).alias("s"))
    samples = samples.withColumn("u_side", _u01(F.col("id"), F.col("s"), F.lit(seed), F.lit(1))) \
        .withColumn("u_pick", _u01(F.col("id"), F.col("s"), F.lit(seed), F.lit(2))) \
        .withColumn("u_gap", _u01(F.col("id"), F.col("s"), F.lit(seed), F.lit(3))) \
        .withColumn("to_minority", F.col("u_side") < 0.5) \
        .withColumn("pick", (F.floor(F.col("u_pick") * k) + 1).cast("int"))
    dmin = danger.join(minority, "id").persist()
    nn_min = top_k_similar(dmin, minority, k, "id", "id", "v", exclude_self=True, metric="euclidean") \
        .select("id", F.col("rank").alias("pick"), "neighbor_id", F.lit(True).alias("to_minority"))
    nn_maj = top_k_similar(dmin, majority, k, "id", "id", "v", metric="euclidean") \
        .select("id", F.col("rank").alias("pick"), "neighbor_id", F.lit(False).alias("to_minority"))
    neigh = nn_min.unionByName(nn_maj).persist()
    # fewer than k neighbours can exist: fall back to the last available rank
    avail = neigh.groupBy("id", "to_minority").agg(F.max("pick").alias("maxpick"))
    s2 = samples.join(avail, ["id", "to_minority"]).withColumn("pick", F.least("pick", "maxpick"))
    s2 = s2.join(neigh, ["id", "to_minority", "pick"])
    s2 = s2.join(pts.select("id", F.col("v").alias("xi")), "id") \
        .join(pts.select(F.col("id").alias("neighbor_id"), F.col("v").alias("xn")), "neighbor_id")
    gap = F.when(F.col("to_minority"), F.col("u_gap")).otherwise(F.col("u_gap") * 0.5)
    s2 = s2.withColumn("g", gap).withColumn(
        "xs", F.zip_with("xi", "xn", lambda a, b: a + F.col("g") * (b - a)))
    cols = []
    for i, c in enumerate(feature_cols):
        x = F.col("xs")[i]
        if c in BINARY_FEATURES:
            x = F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(1.0))
        cols.append(x.cast(df.schema[c].dataType).alias(c))
    synth = s2.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), F.lit(1).cast(
        df.schema[label].dataType).alias(label), *cols, F.lit(True).alias("synthetic"))
    return base.select(id_col, label, *feature_cols, "synthetic").unionByName(synth)
