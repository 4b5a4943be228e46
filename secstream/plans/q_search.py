"""Query keys: search (F1-F6, A10, A12, O1, O4) and event texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import document_text, query_text
from ..operators import postings as P
from ..operators import search as S
from ..sources.tables import read_table
from .inputs import event_docs, once_a_session, stored_event_docs
from .registry import register
from .sql_events import with_docs

# A fixed search request on the events documents.
REQUEST = dict(log_type="deep_kernel", sus=1, timestamp_from="2024-01-05T00:00:00Z",
               timestamp_to="2024-01-20T00:00:00Z")
_REQ_WHERE = ("log_type = 'deep_kernel' AND sus = 1 AND event_ts >= TIMESTAMP '2024-01-05 00:00:00' "
              "AND event_ts <= TIMESTAMP '2024-01-20 00:00:00'")


@register("search_filter", with_docs(f"SELECT count(*) AS total FROM docs WHERE {_REQ_WHERE}"))
def search_filter(spark, sf_dir):
    """F1-F3 + A10: exact total of a filter-only request."""
    docs = stored_event_docs(spark, sf_dir)
    return docs.filter(S.build_predicate(**REQUEST, stored=True)).agg(F.count(F.lit(1)).alias("total"))


@register("search_type_counts", with_docs(
    "SELECT log_type, count(*) AS total FROM docs WHERE sus = 1 GROUP BY log_type"))
def search_type_counts(spark, sf_dir):
    """Per-type totals of one filter (they add up to the untyped total)."""
    docs = stored_event_docs(spark, sf_dir).filter(S.build_predicate(sus=1))
    return docs.groupBy("log_type").agg(F.count(F.lit(1)).alias("total"))


@register("search_page", with_docs(f"""
SELECT doc_id, CAST(0.0 AS DOUBLE) AS score, timestamp, host_name FROM docs WHERE {_REQ_WHERE}
ORDER BY score DESC, doc_id LIMIT 25 OFFSET 25"""))
def search_page(spark, sf_dir):
    """O1: page 2 (size 25) of the filter-only request; filter-only hits score 0."""
    docs = stored_event_docs(spark, sf_dir).filter(S.build_predicate(**REQUEST, stored=True))
    hits = docs.select("doc_id", F.lit(0.0).alias("score"), "timestamp", "attributes.host_name")
    return S.page(hits, page_no=2, page_size=25)


# A request by host, process and malicious flag: documents of one host.
HOST_REQUEST = dict(log_type="standard_host", evil=0, host_name="host-7", process_name="python3",
                    timestamp_from="2024-01-02T00:00:00Z", timestamp_to="2024-01-25T00:00:00Z")


@register("search_host", with_docs("""
SELECT doc_id, timestamp, host_name, process_name FROM docs
WHERE log_type = 'standard_host' AND evil = 0 AND host_name = 'host-7' AND process_name = 'python3'
  AND event_ts >= TIMESTAMP '2024-01-02 00:00:00' AND event_ts <= TIMESTAMP '2024-01-25 00:00:00'"""))
def search_host(spark, sf_dir):
    """F1-F3 on stored documents: one host and process, flag and time range."""
    docs = stored_event_docs(spark, sf_dir).filter(S.build_predicate(**HOST_REQUEST, stored=True))
    return docs.select("doc_id", "timestamp", "attributes.host_name", "attributes.process_name")


BM25_QUERY = "password secret token of the"


def _bm25_sql(query: str, where: str, limit: int) -> str:
    terms = S.query_terms(query)
    tf = ", ".join(f"len(list_filter(tok, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"(CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / "
        f"(tf{i} + {S.BM25_K1} * ({1 - S.BM25_B} + {S.BM25_B} * dl / avgdl)) ELSE 0.0 END)"
        for i in range(len(terms)))
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS tok
  FROM documents WHERE {where}),
p AS (SELECT doc_id, len(tok) AS dl, {tf} FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM p)
SELECT doc_id, round({score}, 6) AS score FROM p, s
ORDER BY score DESC, doc_id LIMIT {limit}"""


@register("search_bm25", _bm25_sql(BM25_QUERY, "lang = 'en'", 20))
def search_bm25(spark, sf_dir):
    """A12 + F1 + O1: English documents ranked by BM25 for a fixed query; page 1 of 20. Reads the index."""
    scored = P.bm25_all(spark, english_index(spark, sf_dir), BM25_QUERY)
    return S.page(scored.select("doc_id", F.round("score", 6).alias("score")), 1, 20)


def english_index(spark, sf_dir) -> str:
    """The inverted index of the English documents, built by the first key of a session that reads it."""
    def build(path):
        docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang").filter(F.col("lang") == "en")
        P.write_index(docs, F.col("text"), path)
    return once_a_session(spark, sf_dir, "documents", "index-en", build)


_TERM_SQL = """
WITH d AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'),
    lambda x: x <> '')) AS term
  FROM documents WHERE lang = 'en'),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL)
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM p GROUP BY term"""


@register("term_statistics", _TERM_SQL)
def term_statistics(spark, sf_dir):
    """Documents and occurrences of every term of the index."""
    rows = spark.read.parquet(f"{english_index(spark, sf_dir)}/postings")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"),
                                    F.max("tf").cast("bigint").alias("most"))


@register("recent_flagged", with_docs("""
SELECT doc_id, event_id, timestamp, log_type, sus, evil FROM docs
WHERE (sus = 1 OR evil = 1)
  AND event_ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1440 MINUTE AND TIMESTAMP '2024-01-15 12:00:00'
ORDER BY event_ts, doc_id LIMIT 200"""))
def recent_flagged(spark, sf_dir):
    """F5 + F6 + O4: flagged events of the last day before ``as_of``, oldest 200."""
    docs = stored_event_docs(spark, sf_dir)
    out = S.recent_flagged(docs, "2024-01-15T12:00:00Z", lookback_minutes=1440, max_events=200, stored=True)
    return out.select("doc_id", "event_id", "timestamp", "log_type", "labels.sus", "labels.evil")


_TEXT_COMMON = """'log type: ' || log_type,
  {event}
  CASE WHEN coalesce(process_name, '') <> '' THEN 'process: ' || process_name END,
  CASE WHEN user_id IS NOT NULL THEN 'user id: ' || CAST(user_id AS VARCHAR)
    || CASE WHEN user_id = 0 THEN ' (root)' ELSE '' END END,
  CASE WHEN coalesce(args, '') <> '' THEN 'args: ' || substr(args, 1, 200) END,
  CASE WHEN coalesce(dns_query, '') <> '' THEN 'dns query: ' || dns_query END,
  CASE WHEN return_value < 0 THEN 'syscall failed'
       WHEN return_value IS NOT NULL THEN 'return value: ' || CAST(return_value AS VARCHAR) END"""

_EVENT_TEXT_SQL = with_docs(f"""
SELECT doc_id, concat_ws('. ', {_TEXT_COMMON.format(event="CASE WHEN coalesce(event_name, '') <> '' THEN 'event: ' || event_name END,")},
  CASE WHEN coalesce(feat_args_has_shell, 0) <> 0 THEN 'shell execution detected' END,
  CASE WHEN coalesce(feat_args_has_network, 0) <> 0 THEN 'network tool in args' END,
  CASE WHEN coalesce(feat_args_has_sensitive_path, 0) <> 0 THEN 'sensitive path accessed' END,
  CASE WHEN coalesce(feat_dns_query_entropy, 0) > 3.5 THEN 'high entropy dns query' END,
  CASE WHEN evil <> 0 THEN 'confirmed malicious' WHEN sus <> 0 THEN 'suspicious activity' END) AS text
FROM docs""")


@register("event_text", _EVENT_TEXT_SQL)
def event_text(spark, sf_dir):
    """The stored-side text of every event document."""
    return event_docs(spark, sf_dir).select("doc_id", document_text().alias("text"))


@register("query_text", with_docs(f"SELECT doc_id, concat_ws('. ', {_TEXT_COMMON.format(event='')}) AS text FROM docs"))
def query_text_q(spark, sf_dir):
    """The query-side text of every event."""
    return event_docs(spark, sf_dir).select("doc_id", query_text(F.col("log_type")).alias("text"))
