"""Filtered, relevance-scored, paged search.

* Filters (F1-F3) are plain predicates placed before any scoring, so they
  reach the parquet scan as pushed filters where the column allows it.
* BM25 (A12) never explodes the corpus: each document's term frequencies
  for the (bounded) query terms and its length come from one projection;
  corpus statistics (N, average length, document frequency per query term)
  are one global aggregate whose single small row is read back as literals.
  The per-document projection is persisted so the text is tokenized once.
* Paging (O1) is ``orderBy(score desc, doc_id).offset().limit()``, planned as
  a TakeOrderedAndProject (top-k per partition, then merge) and never a full
  sort; ``keyset_page`` gives deep pages without an offset.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.timeparse import parse_iso
from .doc_store import request_bounds, time_bounds

# ---- fixed values ----------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
MAX_PAGE_SIZE = 500
# ---------------------------------------------------------------------------


def build_predicate(log_type: str | None = None, sus: int | None = None, evil: int | None = None,
                    host_name: str | None = None, process_name: str | None = None,
                    timestamp_from: str | None = None, timestamp_to: str | None = None,
                    time_col: str = "event_time", stored: bool = False) -> Column:
    """AND of the given conditions; nothing given -> all rows.
    Empty-string time bounds are ignored. ``stored``: the rows come from
    ``doc_store``, whose days the time bounds select too."""
    if log_type is not None and log_type not in ("dns", "deep_kernel", "standard_host"):
        raise ValueError("log_type must be dns, deep_kernel or standard_host")
    for name, v in (("sus", sus), ("evil", evil)):
        if v is not None and v not in (0, 1):
            raise ValueError(f"{name} must be 0 or 1")
    preds: list[Column] = []
    if log_type is not None:
        preds.append(F.col("log_type") == log_type)
    if sus is not None:
        preds.append(F.col("labels.sus") == sus)
    if evil is not None:
        preds.append(F.col("labels.evil") == evil)
    if host_name is not None:
        preds.append(F.col("attributes.host_name") == host_name)
    if process_name is not None:
        preds.append(F.col("attributes.process_name") == process_name)
    if timestamp_from:
        preds.append(F.col(time_col) >= parse_iso(F.lit(timestamp_from)))
    if timestamp_to:
        preds.append(F.col(time_col) <= parse_iso(F.lit(timestamp_to)))
    if stored:
        preds.append(request_bounds(timestamp_from, timestamp_to))
    return functools.reduce(operator.and_, preds, F.lit(True))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query string, same tokenizer as the corpus."""
    import regex
    seen: list[str] = []
    for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()):
        if t and t not in seen:
            seen.append(t)
    return seen


def bm25(docs: DataFrame, text: Column, query: str, id_col: str = "doc_id",
         k1: float = BM25_K1, b: float = BM25_B, keep: tuple[str, ...] = ()) -> DataFrame:
    """BM25 score of every document for ``query``; non-matching
    documents score 0 (they are kept: filter ``score > 0`` for match-only).

    score = sum_t idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl)),
    idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)) — the current Lucene form.
    Statistics are computed over the documents passed in (filter first).
    """
    terms = query_terms(query)
    toks = tokens(text)
    def equals(term: str):
        return lambda x: x == F.lit(term)

    tf_cols = [F.size(F.filter(F.col("_tok"), equals(t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    per_doc = (docs.select(F.col(id_col), *keep, toks.alias("_tok"))
               .select(id_col, *keep, F.size("_tok").alias("_dl"), *tf_cols)
               .persist(StorageLevel.MEMORY_AND_DISK))
    stats = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"),
                        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n = stats["n"] or 0
    avgdl = float(stats["avgdl"] or 0.0)
    score = F.lit(0.0)
    if n and avgdl > 0:
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_dl") / F.lit(avgdl))
        for i in range(len(terms)):
            df_t = stats[f"df{i}"]
            idf = math.log(1 + (n - df_t + 0.5) / (df_t + 0.5))
            tf = F.col(f"_tf{i}").cast("double")
            score = score + F.when(tf > 0, F.lit(idf) * tf / (tf + norm)).otherwise(F.lit(0.0))
    return per_doc.select(id_col, *keep, score.alias("score"))


def page(df: DataFrame, page_no: int = 1, page_size: int = 10, score_col: str = "score",
         id_col: str = "doc_id") -> DataFrame:
    """O1: one page ordered by score desc, id asc (rounded score, so ties
    are ties on every engine)."""
    if page_no < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be 1..{MAX_PAGE_SIZE}")
    ordered = df.orderBy(F.col(score_col).desc(), F.col(id_col).asc())
    return ordered.offset((page_no - 1) * page_size).limit(page_size)


def keyset_page(df: DataFrame, after_score: float | None, after_id, page_size: int = 10,
                score_col: str = "score", id_col: str = "doc_id") -> DataFrame:
    """Deep pages without an offset: rows strictly after the last (score, id)."""
    if after_score is not None:
        df = df.filter((F.col(score_col) < after_score)
                       | ((F.col(score_col) == after_score) & (F.col(id_col) > after_id)))
    return df.orderBy(F.col(score_col).desc(), F.col(id_col).asc()).limit(page_size)


def recent_flagged(docs: DataFrame, as_of: str, lookback_minutes: int = 60, min_sus: bool = True,
                   min_evil: bool = True, max_events: int = 500, stored: bool = False) -> DataFrame:
    """Flagged events in ``[as_of - lookback, as_of]``, the oldest
    ``max_events`` of them (ordered by time, then id). ``stored``: the rows come
    from ``doc_store``, of which only the days of the window are read."""
    if not (min_sus or min_evil):
        raise ValueError("at least one of min_sus / min_evil must be set")
    if not 1 <= lookback_minutes <= 1440:
        raise ValueError("lookback_minutes must be 1..1440")
    if not 1 <= max_events <= 5000:
        raise ValueError("max_events must be 1..5000")
    flags = []
    if min_sus:
        flags.append(F.col("labels.sus") == 1)
    if min_evil:
        flags.append(F.col("labels.evil") == 1)
    end = parse_iso(F.lit(as_of))
    start = end - F.make_interval(mins=F.lit(lookback_minutes))
    sel = docs.filter(functools.reduce(operator.or_, flags)).filter(F.col("event_time").between(start, end))
    if stored:
        sel = sel.filter(time_bounds(start, end))
    return sel.orderBy(F.col("event_time").asc(), F.col("doc_id").asc()).limit(max_events)
