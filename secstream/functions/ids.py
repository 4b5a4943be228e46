"""Deterministic ids from md5 of ``|``-joined fields.

Every part is rendered as text with ``None`` for null (G8), so ``concat_ws``
never silently skips a part and shifts the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def doc_id(id_fields: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The document's id. ``id_fields``: for further log types the attributes that name a document,
    beside its source file and timestamp."""
    a = lambda n: F.col(f"attributes.{n}")
    dns = F.coalesce(F.col("log_attribute") == "network_dns", F.lit(False))
    dns_key = F.concat_ws("|", _txt(F.col("source_file")), _txt(F.col("timestamp")), _txt(a("source_ip")),
                          _txt(a("dns_query")), _txt(a("dns_response_code")))
    host_key = F.concat_ws("|", _txt(F.col("source_file")), _txt(F.col("timestamp")), _txt(a("process_id")),
                           _txt(F.col("event_name")), _txt(a("return_value")), _txt(a("args")))
    key = F.when(dns, dns_key)
    for log_type, names in (id_fields or {}).items():
        key = key.when(F.col("log_type") == log_type, F.concat_ws(
            "|", _txt(F.col("source_file")), _txt(F.col("timestamp")), F.lit(log_type), *[_txt(a(n)) for n in names]))
    return F.md5(key.otherwise(host_key))


def short_id(*parts: Column, length: int = 12, sep: str = ":") -> Column:
    """md5 hex prefix of joined parts (group ids)."""
    return F.substring(F.md5(F.concat_ws(sep, *[_txt(p) for p in parts])), 1, length)
