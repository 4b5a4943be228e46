"""The inverted-file index: exact inside its cells, complete when all are probed, bounded groups, measured recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from secstream.operators import vector_index as X
from secstream.operators.similarity import top_k_similar


def vectors(spark, n=400, dim=8, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    v = middle[rng.integers(0, groups, n)] + rng.normal(scale=0.3, size=(n, dim))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_all_cells_probed_is_the_exact_search_whatever_the_parts(spark):
    df = vectors(spark)
    index = X.build_index(df, cells=9, cell_rows=7)  # cells of up to 400 rows in parts of about 7
    assert index.rows.count() == 400 and index.parts.agg(F.max("parts")).first()[0] > 3
    got = X.search_index(index, df, 4, "id", probes=9, exclude_self=True, query_rows=30)
    assert rows(got) == rows(top_k_similar(df, df, 4, "id", "id", "embedding", exclude_self=True))


def test_recall_of_few_probes_and_work(spark):
    df = vectors(spark, 2_000)
    queries = df.filter("id % 100 = 0")
    index = X.build_index(df)
    assert len(index.centres) == 44
    found = X.search_index(index, queries, 5, "id", probes=10, exclude_self=True)
    r = X.recall(found, top_k_similar(queries, df, 5, "id", "id", "embedding", exclude_self=True), "id").first()
    assert r["queries"] == 20 and r["recall"] >= 0.9
    sizes = [n["count"] for n in index.rows.groupBy("cell").count().collect()]
    assert sum(sorted(sizes)[-10:]) < 0.6 * 2_000  # what ten probes read at most


def test_saved_index_searches_alike(spark, tmp_path):
    df = vectors(spark, 150)
    index = X.build_index(df)
    index.save(f"{tmp_path}/index")
    one, two = (X.search_index(i, df, 3, "id", probes=3) for i in (index, X.load_index(spark, f"{tmp_path}/index")))
    assert rows(one) == rows(two)


def test_odd_vectors_and_empty_tables(spark):
    schema = "id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
                                (7, [1.0, 0.0]), (None, [1.0, 1.0])], schema)
    index = X.build_index(df)
    got = X.search_index(index, df, 2, "id", probes=99, exclude_self=True)
    assert {r["id"] for r in got.collect()} == {1, 2, 6, 7}
    assert {(r["neighbor_id"], r["score"]) for r in got.filter("id = 1 and rank = 1").collect()} == {(7, 1.0)}
    empty = spark.createDataFrame([], schema)
    assert X.search_index(index, empty, 2, "id").count() == 0
    assert X.search_index(X.build_index(empty), df, 2, "id").count() == 0
    with pytest.raises(ValueError):
        X.search_index(index, df, 0, "id")
