"""Column functions over HTTP statuses, rate limits and permissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that a client tries again, pauses and backoff in ms.
RETRYABLE = (408, 500, 502, 503, 504)
DEFAULT_PAUSE, BACKOFF, BACKOFF_MAX, PAUSE_MAX = 60_000, 250, 2_000, 60_000


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Pause asked for by a Retry-After header: seconds, or an HTTP date (which has a comma)."""
    seconds = header.try_cast("bigint")
    when = F.try_to_timestamp(F.trim(F.substring_index(header, ",", -1)), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    return (
        F.when(header.isNull() | (header == ""), None)
        .when(header.rlike(r"^[0-9]+\z"), F.when(seconds <= (1 << 53) - 1, seconds * 1000))
        .when(header.contains(","), F.greatest(F.lit(0).cast("bigint"), F.unix_millis(when) - now_ms))
    )


def rate_limit_pause_ms(status: Column, retry_ms: Column, remaining: Column, reset_ms: Column) -> Column:
    """Pause of a rate-limited response; null for all others."""
    limited = (status == 429) | ((status == 403) & (retry_ms.isNotNull() | (F.trim(remaining) == "0")))
    return F.when(F.coalesce(limited, F.lit(False)), F.coalesce(retry_ms, reset_ms, F.lit(DEFAULT_PAUSE).cast("bigint")))


def retry_delay_ms(attempt: Column, retry_ms: Column) -> Column:
    backoff = F.least(F.lit(float(BACKOFF_MAX)), BACKOFF * F.pow(F.lit(2.0), attempt)).cast("bigint")
    return F.least(F.lit(PAUSE_MAX).cast("bigint"), F.greatest(backoff, F.coalesce(retry_ms, F.lit(0).cast("bigint"))))


def error_class(status: Column, code: Column) -> Column:
    return (
        F.when(status == 429, "rate_limited")
        .when((status == 409) | code.isin("already_exists", "aborted"), "conflict")
        .when(status.isin(*RETRYABLE), "retryable")
        .when(status >= 400, "fatal")
        .otherwise("ok")
    )


def permissions(mode: Column, event: Column, ref: Column, default_branch: Column, protected: Column, runtime: Column) -> Column:
    """struct(readable, writable) of a requested mode within an event and the runner's own permissions."""
    run = F.lower(F.trim(F.coalesce(runtime, F.lit(""))))
    trusted = (event == "push") & protected & (ref == F.concat(F.lit("refs/heads/"), default_branch))
    asked = (mode == "read-write") | ((mode == "auto") & F.coalesce(trusted, F.lit(False)))
    writable = asked & ~event.isin("pull_request", "pull_request_target") & ~run.isin("none", "read")
    return F.struct((~run.isin("none", "write-only")).alias("readable"), writable.alias("writable"))


def upload_wanted(mode: Column, cache_errors: Column, lifecycle_errors: Column) -> Column:
    return (mode == "always") | ((mode == "on-error") & (cache_errors | lifecycle_errors))


def authentication_retry(status: Column, limited: Column) -> Column:
    """Whether a read is tried again with a new signed URL."""
    return status.isin(401, 403) & ~limited


def answer(kind: Column, limited: Column, retry_ms: Column) -> Column:
    """struct(status, retry_after) that a client gets for a failed read: action results degrade to a miss."""
    seconds = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.coalesce(retry_ms, F.lit(DEFAULT_PAUSE).cast("bigint")) / 1000))
    code = F.when(kind == "ac", 404).when(limited, 429).otherwise(503)
    return F.struct(code.alias("status"), F.when(code == 429, seconds).alias("retry_after"))


def abort_derived(aborted: Column, status: Column, limited: Column, conflict: Column, name: Column, message: Column) -> Column:
    """Whether an error only says that its own operation was cancelled; an answer of the service stays one."""
    said = (name == "AbortError") | message.rlike(r"(?i)\b(?:abort(?:ed)?|cancell?ed)\b")
    return aborted & status.isNull() & ~limited & ~conflict & F.coalesce(said, F.lit(False))


def policy_denied(message: Column) -> Column:
    return F.lower(message).startswith("cache write denied:")


#: Most wait between attempts of a commit, first wait between looks whether an entry is visible, and looks.
COMMIT_MAX, LOOK, LOOKS = 10_000, 100, 5


def commit_delay_ms(attempt: Column) -> Column:
    """Wait before a commit's call is tried again after `attempt` (from 0) failures."""
    return F.least(F.lit(float(COMMIT_MAX)), BACKOFF * F.pow(F.lit(2.0), attempt)).cast("bigint")


def look_delay_ms(look: Column) -> Column:
    """Wait after a look (from 0) that did not find an entry; null after the last."""
    return F.when(look < LOOKS - 1, (LOOK * F.pow(F.lit(2.0), look)).cast("bigint"))


def blob_error(status: Column, retry_ms_header: Column, retry_header: Column, now_ms: Column) -> Column:
    """struct(retryable, limited, retry_ms) of a failed call to the blob store; a call without an answer has no status."""
    exact = F.when(retry_ms_header.rlike(r"^[0-9]+\z"), retry_ms_header.try_cast("bigint"))
    pause = F.when(F.coalesce(retry_ms_header.rlike(r"^[0-9]+\z"), F.lit(False)), F.when(exact <= (1 << 53) - 1, exact)).otherwise(retry_after_ms(retry_header, now_ms))
    return F.struct((status.isNull() | status.isin(*RETRYABLE)).alias("retryable"), F.coalesce(status == 429, F.lit(False)).alias("limited"), pause.alias("retry_ms"))


def spooled(body: Column, expected: Column, most: Column) -> Column:
    """struct(size, sha256, status) of an uploaded body: 413 beyond `most` bytes, 400 if it has not the expected size (null: any), else 200; a refused one has no hash."""
    size = F.octet_length(body).cast("bigint")
    code = F.when(size > most, 413).when(size != expected, 400).otherwise(200)
    return F.struct(size.alias("size"), F.when(code == 200, F.sha2(body, 256)).alias("sha256"), code.alias("status"))
