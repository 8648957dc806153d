"""Commits of entries in two phases, told from the log of their calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.status import BACKOFF, COMMIT_MAX, LOOKS
from .folds import fold

#: What follows a call: by phase and result the next state; 'look' polls whether the entry is visible and remembers why.
_NEXT = {
    ("reserve", "ok"): "upload", ("reserve", "limited"): "look", ("reserve", "conflict"): "look", ("reserve", "retryable"): "retry", ("reserve", "fatal"): "failed",
    ("upload", "ok"): "finalize", ("upload", "limited"): "look", ("upload", "conflict"): "failed", ("upload", "retryable"): "upload", ("upload", "fatal"): "failed",
    ("finalize", "ok"): "created", ("finalize", "limited"): "look", ("finalize", "conflict"): "look", ("finalize", "retryable"): "look", ("finalize", "fatal"): "failed",
}
#: Where a commit goes on whose entry did not become visible.
_UNSEEN = {("reserve", "limited"): "reserve", ("reserve", "conflict"): "retry", ("upload", "limited"): "upload", ("finalize", "limited"): "finalize", ("finalize", "conflict"): "failed", ("finalize", "retryable"): "finalize"}


def commits(calls: DataFrame, by: str) -> DataFrame:
    """Adds next and delay_ms to the calls of each commit (ord, result), in their order.

    The operation of a call is what the one before called for: reserve, upload, finalize or
    look (whether the entry is visible, at most five times). result is 'ok', 'conflict',
    'limited', 'retryable' or 'fatal'; of a look 'ok' says that the entry is there, 'miss'
    that it is not. next is the next operation, or how the commit ended: 'created',
    'already-exists', 'retry' (all of it may be tried again) or 'failed'; calls after the end
    repeat it. delay_ms is the wait before a call that is tried again after an error.
    """

    def start() -> dict:
        return {"at": "reserve", "why": None, "looks": 0, "tries": {"upload": 0, "finalize": 0}}

    def again(s: dict, phase: str, result: str) -> int | None:
        if result != "retryable" or phase not in s["tries"]:
            return None
        s["tries"][phase] += 1
        return min(COMMIT_MAX, BACKOFF * 2 ** (s["tries"][phase] - 1))

    def step(s: dict, result: str) -> tuple[str, int | None]:
        at, delay = s["at"], None
        if at == "look":
            s["looks"] += 1
            if result == "ok":
                s["at"] = "already-exists"
            elif result in ("retryable", "fatal", "conflict"):
                s["at"] = "retry" if result == "retryable" else "failed"
            elif s["looks"] == LOOKS:
                s["at"] = _UNSEEN[s["why"]]
                delay = again(s, *s["why"])
        elif (at, result) in _NEXT:
            s["at"] = _NEXT[at, result]
            if s["at"] == "look":
                s["why"], s["looks"] = (at, result), 0
            else:
                delay = again(s, at, result)
        return s["at"], delay

    return fold(calls.select(by, "ord", "result"), by, ["ord"], ["result"], start, step, next="string", delay_ms="long")


def outcomes(lines: DataFrame, by: str) -> DataFrame:
    """by, outcome and calls of every commit; one whose log ends before it does is 'open'."""
    last = F.max_by("next", "ord")
    return lines.groupBy(by).agg(F.when(last.isin("created", "already-exists", "retry", "failed"), last).otherwise("open").alias("outcome"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("waited_ms"))


def prepared(rows: DataFrame, by: str, namespace: Column) -> DataFrame:
    """Adds entry_key and entry_version to rows (kind, digest, pack_key: null outside packs): what a commit reserves."""
    packed = F.col("pack_key").isNotNull()
    key = F.when(packed, F.col("pack_key")).otherwise(keys.object_key(F.concat(F.lit("brc-v1-"), namespace), F.col("kind"), F.concat(F.lit("sha256-"), "digest")))
    version = F.when(packed, keys.version_of(keys.PACK_VERSION_LABEL)).otherwise(keys.version_of(keys.OBJECT_VERSION_LABEL))
    return rows.withColumn("entry_key", key).withColumn("entry_version", version)
