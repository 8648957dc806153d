"""Redaction of log texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in their order: pattern and replacement.
URL = (r"(?i)https?://[^\s\"'<>]+", "<redacted-url>")
BEARER = (r"(?i)bearer\s+[^\s]+", "Bearer <redacted>")
SIGNATURE = (r"(?i)sig(?:nature)?=[^&\s]+", "sig=<redacted>")
RULES = (
    URL,
    BEARER,
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "<redacted-token>"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "<redacted-token>"),
    (r"(?i)\b[0-9a-f]{64}\b", "<redacted-digest>"),
    (r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b", "<redacted-token>"),
    SIGNATURE,
    (r"(?i)\b(authorization|github[-_]?token|runtime[-_]?token|shutdown[-_]?token|password|secret)\b\s*[:=]\s*[\"']?[^,\s\"'}]+", "$1=<redacted>"),
    (r"([\"'])(?:(?:[A-Za-z]:\\)|/|\\\\)[^\"'<>\r\n]*\1", "$1<redacted-path>$1"),
    (r"\\\\[^\\\s\"'<>]+\\[^\s\"'<>]+", "<redacted-path>"),
    (r"(?:[A-Za-z]:\\|/)[^\s\"'<>]+", "<redacted-path>"),
    (r"(?<![A-Za-z0-9_.-])(?:\.{1,2}[\\/])?(?:[A-Za-z0-9_.@+-]+[\\/])+[A-Za-z0-9_.@+-]+", "<redacted-path>"),
)


#: Fixed value: names of areas, operations and errors.
FIELD = r"^[a-z][a-z0-9-]{0,47}\z"


def _apply(text: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def diagnostic_text(text: Column) -> Column:
    return _apply(text, RULES)


def error_message(text: Column) -> Column:
    return F.substring(_apply(text, (URL, BEARER, SIGNATURE)), 1, 500)


def service_message(text: Column) -> Column:
    return F.substring(_apply(text, (URL, BEARER)), 1, 300)


def field_or(text: Column, fallback: str) -> Column:
    return F.when(text.rlike(FIELD), text).otherwise(fallback)


#: Letters of a digest that an event shows, and of a message at most.
SHOWN, MOST = 12, 500


def event(area: Column, operation: Column, kind: Column, digest: Column, name: Column, message: Column, status: Column, aborted: Column) -> Column:
    """struct of an error as a journal keeps it: names that fit their pattern, the beginning of a digest, a redacted message, whether it only says that something was cancelled."""
    text = F.substring(diagnostic_text(message), 1, MOST)
    stopped = aborted | (name == "AbortError") | text.rlike(r"(?i)\babort(?:ed)?\b")
    # a name in capitals inside becomes one with hyphens
    bare = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "-"))
    return F.struct(
        field_or(area, "unknown").alias("area"), field_or(operation, "unknown").alias("operation"), F.when(kind.isin("ac", "cas"), kind).alias("kind"),
        F.when(digest.rlike(r"^[0-9a-f]{64}\z"), F.substring(digest, 1, SHOWN)).alias("digest_prefix"), field_or(bare, "error").alias("name"), text.alias("message"),
        F.when(status.between(100, 599), status).alias("status"), F.coalesce(stopped, F.lit(False)).alias("aborted"),
    )
