"""Query keys of the training-data operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff_lm,
    bpe,
    chunk_dedup,
    fair_mix,
    html_blocks,
    knn_quality,
    line_bloom,
    mil_toxicity,
    pca_kmeans,
    ppm_language,
    shingle_join,
    token_align,
    winnowing,
)
from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@_register("op1_html_blocks")
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = html_blocks.fit_labeller(pages)
    return html_blocks.extract_pages(pages, model, keep=("page_id", "url"))


@_register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY),
                      public_tokenizers.PATTERN, ids=False, keep=("doc_id",))


@_register("op3_backoff_lm")
def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff_lm.score_texts(docs, id_remainder(F.col("doc_id"), 5) == 1)


@_register("op4_mil_toxicity")
def op4_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil_toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return (mil_toxicity.score_toxicity(docs, model, keep=("doc_id",))
            .select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "sentences"))


@_register("op5_winnowing")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("op6_ppm_language")
def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    trees = ppm_language.fit_languages(docs, ~held_out)
    return (ppm_language.predict_languages(docs.select("doc_id", "text"), trees, keep=("doc_id",))
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte"))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '{fair_mix.SALT}') AS h
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT source, s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sums),
weighed AS (SELECT *, (rk - 1) % 3 + 1 AS w, s * 3 AS most FROM ranked),
levels AS (
  SELECT *, CAST(sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, rk
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
       / sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed),
leveled AS (SELECT *, max(CASE WHEN lv <= CAST(most AS DOUBLE) / w THEN lv END) OVER () AS level FROM levels),
targets AS (SELECT source, rk, s, least(CAST(most AS DOUBLE), coalesce(w * level, 0.0)) AS target FROM leveled),
rows_ AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, t.rk, t.s, t.target, d.h,
         CAST(sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.h, d.doc_id, d.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT id, rk, size, CAST(r * s + cum AS DOUBLE) / target AS finish
  FROM rows_, (VALUES (0), (1), (2)) AS reps(r) WHERE size > 0 AND target > 0),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
           FROM copies),
taken AS (SELECT id, sum(size) AS taken FROM queued WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY id)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM rows_ LEFT JOIN taken USING (id)
"""


@_register("op7_fair_mix", MIX_SQL)
def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_plan(table(spark, sf_dir, "documents"))


@_register("op8_shingle_join")
def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("op9_knn_quality")
def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (knn_quality.quality_predictions(docs, table(spark, sf_dir, "labels"))
            .select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"))


DEDUP_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


@_register("op10_chunk_dedup", DEDUP_SQL)
def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("op11_anchor_align")
def op11_anchor_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_align.alignment_report(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id",))


_TRIMMED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, {_TRIMMED}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
repeats AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {line_bloom.MIN_POINTS} GROUP BY k
            HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
marked AS (SELECT r, line, i, p.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM p.first AS gone
           FROM keyed LEFT JOIN repeats p ON p.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN d USING (r) GROUP BY r, doc_id
"""


@_register("op12_line_bloom", LINES_SQL)
def op12_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bloom.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",), with_text=False)


def _cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every round as two tables: the assignment (a) and the centroids after it (c)."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}),
e AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k
           FROM kept QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM firsts)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, k, distance FROM (SELECT e.r, c.k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS distance
                              FROM e JOIN c{n} c ON e.d = c.d GROUP BY e.r, c.k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.d, CAST(coalesce(m.x, c.x) AS BIGINT) AS x FROM c{n} c LEFT JOIN (
    SELECT k, d, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT a.k, e.d, sum(e.x) AS s, count(*) AS n FROM e JOIN a{n} a USING (r) GROUP BY a.k, e.d)) m
  ON m.k = c.k AND m.d = c.d)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256
                                            FROM c{rounds} GROUP BY k) h ON h.k = a.k
"""


@_register("op13_pca_kmeans", _cluster_sql())
def op13_pca_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_kmeans.cluster_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
