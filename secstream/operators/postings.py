"""A stored inverted index, so a relevance search reads its terms and not the texts.

Three tables under one folder:

``documents``  (row, doc_id, dl, terms): every document with its number of tokens and its distinct
               terms with counts; ``row`` tells documents apart whose ids are null or repeated.
``postings``   (part, term, row, doc_id, tf, dl): a row for each distinct term of a document, with
               the document's length, so scoring needs no join. Partitioned by ``part``, a hash
               of the term, and placed by range over (part, term, row): the rows of a term lie
               together, a term in a third of all documents is split over tasks and files, and
               the statistics of row groups skip the other terms of a part.
``totals``     one row: number of documents and of tokens.

Terms of a text are counted inside its row (sorted tokens, run lengths), once; the only shuffle
of the build is the one that places the postings. A search filters ``part`` (partition pruning)
and ``term`` (pushed), counts its terms' documents, and scores. Null and empty texts have no
terms; an index of no documents answers every search with no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import BM25_B, BM25_K1, query_terms

#: Parts of the term space. More parts prune more and make more files.
PARTS = 64


def part_of(term: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def term_counts(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """(doc_id, dl, terms: array of (term, tf)) for every row; null and empty texts have no terms.

    Equal tokens are neighbours once sorted: a run's length is its count, in linear time.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(tokens(text)).alias("t"))
    d = d.withColumn("dl", F.size("t").cast("bigint"))
    starts = F.when(F.col("dl") > 0, F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0))),
        lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("s", starts)
    runs = F.transform("s", lambda x, j: F.struct(
        F.get("t", x).alias("term"), (F.coalesce(F.get("s", j + 1), F.size("t")) - x).alias("tf")))
    return d.select("doc_id", "dl", runs.alias("terms"))


def write_index(docs: DataFrame, text: Column, path: str, id_col: str = "doc_id", parts: int = PARTS,
                tasks: int | None = None) -> None:
    """Build the index of ``docs`` at ``path``, which must be new; ``tasks`` ranges hold the postings."""
    spark = docs.sparkSession
    counted = term_counts(docs, text, id_col).withColumn("row", F.monotonically_increasing_id())
    counted.write.mode("errorifexists").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")  # numbered once: a task that runs again reads the same rows
    flat = stored.select("row", "doc_id", "dl", F.inline("terms")).withColumn("part", part_of(F.col("term"), parts))
    order = ["part", "term", "row"]
    flat = flat.repartitionByRange(tasks, *order) if tasks else flat.repartitionByRange(*order)
    flat.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("part").parquet(f"{path}/postings")
    (stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
     .withColumn("parts", F.lit(parts)).write.mode("errorifexists").parquet(f"{path}/totals"))


def _postings(spark: SparkSession, path: str, terms: list[str], parts: int) -> DataFrame:
    id_type = spark.read.parquet(f"{path}/documents").schema["doc_id"].dataType.simpleString()
    rows = (spark.read.schema(f"term string, row bigint, doc_id {id_type}, tf int, dl bigint, part int")
            .parquet(f"{path}/postings"))
    # the parts of the terms are literals: the folders of other parts are pruned before the job starts
    chosen = spark.range(1).select(*[part_of(F.lit(t), parts) for t in terms]).first() if terms else []
    return rows.where(F.col("part").isin(sorted(set(chosen))) & F.col("term").isin(terms))


def bm25_hits(spark: SparkSession, path: str, query: str, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(row, doc_id, score) of the documents that hold a term of the query, by the formula of ``search.bm25``.

    The driver holds one document frequency for each distinct term of the query.
    """
    terms = query_terms(query)
    totals = spark.read.parquet(f"{path}/totals").first()
    n = totals["n"]
    rows = _postings(spark, path, terms, totals["parts"])
    if not terms or not totals["tokens"]:
        return rows.limit(0).select("row", "doc_id", F.lit(0.0).alias("score"))
    found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    avgdl = totals["tokens"] / n
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    tf = F.col("tf").cast("double")
    score = F.lit(0.0)
    for t in terms:  # one posting for each document and term, added in the order of the terms
        idf = math.log(1 + (n - found.get(t, 0) + 0.5) / (found.get(t, 0) + 0.5))
        gain = F.sum(F.when(F.col("term") == t, F.lit(idf) * tf / (tf + norm)))
        score = score + F.coalesce(gain, F.lit(0.0))
    return rows.groupBy("row", "doc_id").agg(score.alias("score"))


def bm25_all(spark: SparkSession, path: str, query: str, **options) -> DataFrame:
    """(doc_id, score) of every indexed document: 0 without a term of the query."""
    hits = bm25_hits(spark, path, query, **options).select("row", "score")
    return (spark.read.parquet(f"{path}/documents").select("row", "doc_id").join(hits, "row", "left")
            .select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")))
