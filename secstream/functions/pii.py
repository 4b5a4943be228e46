"""G-1, A15, F11: personal data and secret patterns as column expressions.

Counting, testing and listing types are native (``regexp_count``,
``rlike``); only exact match offsets need Python (``pii_matches`` in
``secstream.operators.policy``), run Arrow-batched with ``mapInPandas``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for equal results) ----------
PII_PATTERNS: dict[str, str] = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_us": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "private_key_pem": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "openai_api_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "password_field": r"(?i)\bpassword\s*[:=]\s*\S{4,}",
    "secret_field": r"(?i)\bsecret\s*[:=]\s*\S{4,}",
    "token_field": r"(?i)\btoken\s*[:=]\s*[A-Za-z0-9_.\-]{8,}",
    "api_key_field": r"(?i)\bapi[_\-]?key\s*[:=]\s*\S{8,}",
}
SNIPPET_CHARS = 20
#: What every match of a pattern holds, in any case of its letters: a text without it needs no search.
PII_PARTS: dict[str, tuple[str, ...]] = {
    "email": ("@",), "aws_access_key": ("akia", "asia"), "private_key_pem": ("-----begin ",), "openai_api_key": ("sk-",),
    "password_field": ("password",), "secret_field": ("secret",), "token_field": ("token",), "api_key_field": ("api",),
}
#: The same as a pattern that is cheaper to search, where there is no fixed part.
PII_OUTLINES: dict[str, str] = {
    "ssn": r"[0-9]-[0-9]{2}-[0-9]", "credit_card": r"[0-9]{13}", "phone_us": r"[0-9][-.\s][0-9]{4}",
}
# ---------------------------------------------------------------------------


def match_count(text: Column, pii_type: str) -> Column:
    """Number of non-overlapping matches of one pattern."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PII_PATTERNS[pii_type]))


def has_type(text: Column, pii_type: str) -> Column:
    """Does the pattern match? Only texts that can match are searched with it."""
    text = F.coalesce(text, F.lit(""))
    if pii_type in PII_OUTLINES:
        likely = text.rlike(PII_OUTLINES[pii_type])
    else:
        likely = F.lit(False)
        for part in PII_PARTS[pii_type]:
            likely = likely | F.lower(text).contains(part)
    return likely & text.rlike(PII_PATTERNS[pii_type])


def detected_types(text: Column) -> Column:
    """Sorted distinct type names found in ``text`` (empty if clean)."""
    found = [F.when(has_type(text, t), F.lit(t)) for t in sorted(PII_PATTERNS)]
    return F.array_compact(F.array(*found))


def is_clean(text: Column) -> Column:
    """no pattern matches."""
    hit = F.lit(False)
    for t in PII_PATTERNS:
        hit = hit | has_type(text, t)
    return ~hit


def type_counts(text: Column) -> Column:
    """Array of (pii_type, matches) for the types that occur (explode-ready)."""
    items = [F.struct(F.lit(t).alias("pii_type"), match_count(text, t).alias("matches")) for t in PII_PATTERNS]
    return F.filter(F.array(*items), lambda s: s["matches"] > 0)
