"""Column functions over configuration texts, URLs and typed fields. Malformed input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import SAFE, safe_integer

#: Hosts that plain http may name, days that diagnostics are kept, ms of local retention at least.
LOOPBACK = ("127.0.0.1", "[::1]", "localhost")
RETENTION_DAYS, RETENTION_MOST, RETENTION_MS = 7, 90, 30_000
_URL = r"(?i)^(https?)://(?:([^/?#]*)@)?(\[[0-9a-f:.]+\]|[^/?#@:\[\]\s]+)(?::[0-9]{0,5})?(?:[/?#].*)?$"


def _given(raw: Column, fallback: str) -> Column:
    return F.when(raw.isNull() | (raw == ""), F.lit(fallback)).otherwise(raw)


def integer_input(raw: Column, fallback: str, least: int, most: int = SAFE) -> Column:
    """A setting within its bounds; empty: the fallback."""
    value = safe_integer(_given(raw, fallback))
    return F.when(value.between(least, most), value)


def boolean_input(raw: Column, fallback: str) -> Column:
    text = F.lower(_given(raw, fallback))
    return F.when(text == "true", True).when(text == "false", False)


def setting_problem(storage: Column, write_back: Column, object_size: Column, inflight: Column, pending: Column, target: Column) -> Column:
    """The first rule between settings that is broken; null: none."""
    return (
        F.when((storage == "pack") & ~write_back, "pack needs write-back")
        .when(inflight < object_size, "inflight below object")
        .when(pending < object_size, "pending below object")
        .when(target > pending, "target above pending")
    )


def diagnostic_mode(raw: Column) -> Column:
    mode = F.lower(_given(raw, "on-error"))
    return F.when(mode.isin("always", "never", "on-error"), mode).otherwise("on-error")


def diagnostic_retention(raw: Column) -> Column:
    days = F.when(raw.rlike(r"^[1-9][0-9]*\z"), raw.try_cast("bigint"))
    return F.when(days <= RETENTION_MOST, days).otherwise(F.lit(RETENTION_DAYS).cast("bigint"))


def artifact_name(prefix: str, run: Column, job: Column) -> Column:
    return F.when(run.rlike(r"^(0|[1-9][0-9]*)\z") & job.rlike(r"^[0-9a-f]{16}\z"), F.concat(F.lit(f"{prefix}-"), run, F.lit("-"), job))


def local_retention_ms(refresh_seconds: Column) -> Column:
    """How long a stored object stays local: two refreshes, and at least half a minute."""
    return F.greatest(F.lit(RETENTION_MS).cast("bigint"), refresh_seconds * 2000)


def signed_url(url: Column) -> Column:
    """'ok', 'missing', 'invalid', 'unsafe' (scheme or credentials) or 'insecure' (plain http to another host)."""
    scheme, user, host = (F.lower(F.regexp_extract(url, _URL, i)) for i in (1, 2, 3))
    return (
        F.when(url.isNull() | (url == ""), "missing")
        .when(~url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "invalid")
        .when(~url.rlike("(?i)^https?:"), "unsafe")
        .when(~url.rlike(_URL), "invalid")
        .when(~user.isin("", ":"), "unsafe")
        .when((scheme == "http") & ~host.isin(*LOOPBACK), "insecure")
        .otherwise("ok")
    )


def number_field(json: Column, name: str, least: int, most: int = SAFE) -> Column:
    """An integer field of a JSON record; numbers in quotes are none."""
    typed = F.get_json_object(json, f"$.{name}")
    quoted = json.rlike(rf'"{name}"\s*:\s*"')
    value = typed.try_cast("bigint")
    return F.when(~quoted & typed.rlike(r"^-?[0-9]+\z") & value.between(least, most), value)
