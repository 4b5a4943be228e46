"""request validation as a table job.

``RULES`` name, per kind of request, a condition that a valid row meets. A row
gets the names of the rules that it breaks; valid rows go on, the others go to
a quarantine table with their reasons. A null breaks a rule unless the rule
allows it, so no condition can be skipped by leaving a field out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import KNOWN_LOG_TYPES

# ---- fixed values (request limits) -----------------------------------------
PAGE_SIZE = (1, 500)
EVENTS_K = (1, 20)
RUNBOOKS_K = (1, 10)
QUERY_CHARS = (3, 1000)
CALLER_CHARS = (1, 64)
TEMPERATURE = (0, 2)
MAX_TOKENS = (1, 8192)
WINDOW_MINUTES = (1, 1440)
EVENT_COUNT = (1, 10000)
LOOKBACK_MINUTES = (1, 1440)
LOOKBACK_EVENTS = (1, 5000)
# ---------------------------------------------------------------------------


def _range(name: str, bounds: tuple[int, int]) -> Column:
    return F.col(name).between(*bounds)


def _chars(name: str, bounds: tuple[int, int]) -> Column:
    return F.length(name).between(*bounds)


def _optional(name: str, rule: Column) -> Column:
    return F.col(name).isNull() | rule


def search_rules() -> dict[str, Column]:
    return {"log_type": _optional("log_type", F.col("log_type").isin(*KNOWN_LOG_TYPES)),
            "sus": _optional("sus", F.col("sus").isin(0, 1)), "evil": _optional("evil", F.col("evil").isin(0, 1)),
            "page": F.col("page") >= 1, "page_size": _range("page_size", PAGE_SIZE)}


def similar_rules() -> dict[str, Column]:
    return {"log_type": F.col("log_type").isin(*KNOWN_LOG_TYPES), "k": _range("k", EVENTS_K)}


def runbook_rules() -> dict[str, Column]:
    return {"query": _chars("query", QUERY_CHARS), "k": _range("k", RUNBOOKS_K)}


def caller_rules() -> dict[str, Column]:
    return {"caller": _chars("caller", CALLER_CHARS), "temperature": _range("temperature", TEMPERATURE),
            "max_tokens": _range("max_tokens", MAX_TOKENS)}


def analyze_rules() -> dict[str, Column]:
    return {"window_minutes": _range("window_minutes", WINDOW_MINUTES), "events": _range("events", EVENT_COUNT)}


def recent_rules() -> dict[str, Column]:
    return {"window_minutes": _range("window_minutes", WINDOW_MINUTES),
            "lookback_minutes": _range("lookback_minutes", LOOKBACK_MINUTES),
            "max_events": _range("max_events", LOOKBACK_EVENTS)}


RULES = {"search": search_rules, "similar": similar_rules, "runbooks": runbook_rules, "caller": caller_rules,
         "analyze": analyze_rules, "recent": recent_rules}


def validate(requests: DataFrame, kind: str) -> DataFrame:
    """Every request with ``violations``: the names of the broken rules, in the order of the rules."""
    if kind not in RULES:
        raise ValueError(f"unknown kind of request {kind!r}")
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in RULES[kind]().items()]
    return requests.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantined requests with their violations)."""
    checked = validate(requests, kind)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)
