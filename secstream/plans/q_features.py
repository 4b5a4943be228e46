"""Query keys: feature expressions on other tables (X1-X4 on page domains,
X7-X8 on whole document texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..sources.tables import read_table
from .registry import register
from .sql_events import NETWORK, SENSITIVE, SHELL, entropy_sql

URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def _domain_sql() -> str:
    dom = f"regexp_extract(url, '{URL_HOST}', 1)"
    return f"""
SELECT page_id, domain, CAST(length(domain) AS INTEGER) AS feat_dns_query_length,
  round({entropy_sql('domain')}, 4) AS feat_dns_query_entropy,
  CAST(length(domain) - length(replace(domain, '.', '')) AS INTEGER) AS feat_dns_num_subdomains,
  round({entropy_sql('domain')}, 4) > 3.5 AS high_entropy
FROM (SELECT page_id, {dom} AS domain FROM pages)"""


@register("dns_features", _domain_sql())
def dns_features(spark, sf_dir):
    """X1-X4 on the host part of every page URL (the DNS query stand-in)."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    d = pages.select("page_id", F.regexp_extract("url", URL_HOST, 1).alias("domain"))
    ent = F.round(X.shannon_entropy(F.col("domain")), 4)
    return d.select("page_id", "domain",
                    X.dns_query_length(F.col("domain")).alias("feat_dns_query_length"),
                    ent.alias("feat_dns_query_entropy"),
                    X.count_char(F.col("domain"), ".").alias("feat_dns_num_subdomains"),
                    (ent > X.HIGH_ENTROPY).alias("high_entropy"))


def _unicode_word(pattern: str) -> str:
    """RE2 has an ASCII-only \\b; emulate the Unicode-aware boundary of the
    Java/Python engines for the ASCII words of the network pattern."""
    words = [w.replace(r"\b", "") for w in pattern.split("|")]
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


_ARGS_SQL = f"""
SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS feat_args_length,
  CAST(regexp_matches(coalesce(text, ''), '(?i){SHELL}') AS INTEGER) AS feat_args_has_shell,
  CAST(regexp_matches(coalesce(text, ''), '(?i){_unicode_word(NETWORK)}') AS INTEGER) AS feat_args_has_network,
  CAST(regexp_matches(coalesce(text, ''), '(?i){SENSITIVE}') AS INTEGER) AS feat_args_has_sensitive_path
FROM documents"""


@register("args_flags", _ARGS_SQL)
def args_flags(spark, sf_dir):
    """X7-X8 over whole document texts (shell, network tool, sensitive path)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    t = F.col("text")
    return docs.select("doc_id",
                       F.length(F.coalesce(t, F.lit(""))).alias("feat_args_length"),
                       X.has_pattern(t, X.SHELL_PATTERN).alias("feat_args_has_shell"),
                       X.has_pattern(t, X.NETWORK_PATTERN).alias("feat_args_has_network"),
                       X.has_pattern(t, X.SENSITIVE_PATH_PATTERN).alias("feat_args_has_sensitive_path"))
