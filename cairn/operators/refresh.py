"""When a catalog is listed anew: age, apparent misses, pauses after failures and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold

#: Columns that calls have.
INPUTS = ["at_ms", "op", "generation", "result", "retry_ms", "hits", "fresh_hits"]


def timeline(calls: DataFrame, by: str, interval_ms: int) -> DataFrame:
    """Adds what a reader's catalog does at each of its calls, in their order: fetched, missed, served, found and error.

    calls: ord, at_ms, op, generation, result, retry_ms, hits, fresh_hits. op is 'snapshot'
    (list anew after the interval), 'refresh' (always), 'candidates' (when the filters of a
    snapshot that was there already say no) or 'after-miss' (when all candidates of
    `generation` were tried in vain and no newer one is there). result says what a listing
    at that time would give: 'ok', 'failed' or 'limited'; retry_ms its pause. hits are the
    candidates that the snapshot has, fresh_hits those of one listed at that time.

    Listings for misses share a cooldown of an interval. A failed one pauses all for its
    retry or an interval, a limited one for its retry; meanwhile, and after it, the snapshot
    that is there is served, or the error where there is none.

    fetched: a listing was tried; missed: for a miss; served: the generation (0: none);
    found: candidates; error: 'failed', 'limited' or null.
    """

    def start() -> dict:
        return {"generation": 0, "listed": None, "miss": None, "failed": None, "limited": None}

    def step(s: dict, at: int, op: str, previous: int | None, result: str, retry: int | None, hits: int, fresh: int) -> tuple:
        out = {"fetched": False, "error": None, "fresh": False}

        def listing() -> None:
            for pause in ("limited", "failed"):
                if s[pause] is not None and at < s[pause]:
                    out["error"] = pause if not s["generation"] else None
                    return
                s[pause] = None
            out["fetched"] = True
            if result == "ok":
                s["generation"] += 1
                s["listed"], s["failed"], out["fresh"] = at, None, True
                return
            until = at + (retry if result == "limited" else max(interval_ms, retry or 0))
            s[result] = until if s[result] is None else max(until, s[result])
            out["error"] = result if not s["generation"] else None

        def for_miss() -> bool:
            if s["generation"] and s["miss"] is not None and 0 <= at - s["miss"] < interval_ms:
                return False
            s["miss"] = at
            listing()
            return True

        missed, had = False, s["generation"] > 0
        if op == "snapshot" and not (had and 0 <= at - s["listed"] < interval_ms):
            listing()
        elif op == "refresh" or (op == "candidates" and not had):
            listing()
        elif op == "candidates" and hits == 0:
            missed = for_miss()
        elif op == "after-miss" and s["generation"] <= previous:
            missed = for_miss()
        served = 0 if out["error"] else s["generation"]
        asks = op in ("candidates", "after-miss") and not out["error"]
        return out["fetched"], missed, served, (fresh if out["fresh"] else hits) if asks else 0, out["error"]

    rows = calls.select(by, "ord", *INPUTS)
    return fold(rows, by, ["at_ms", "ord"], INPUTS, start, step, fetched="boolean", missed="boolean", served="long", found="long", error="string")


def catalog_counters(lines: DataFrame, by: str) -> DataFrame:
    """The counters of each reader's catalog over a timeline; its last generation is the snapshot that is served."""
    n = F.count_if
    return lines.groupBy(by).agg(
        n("fetched").alias("attempts"), n(F.col("fetched") & (F.col("result") == "ok")).alias("refreshes"), n(F.col("fetched") & (F.col("result") != "ok")).alias("errors"),
        n("missed").alias("miss_refreshes"), n(F.col("op").isin("candidates", "after-miss")).alias("queries"), F.sum("found").alias("candidates"), F.max("served").alias("generation"),
    )


def generations(listings: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows of the latest generation of each reader; listings: by, generation and rows of a catalog."""
    latest = listings.groupBy(by).agg(F.max("generation").alias("generation"))
    return listings.join(latest, [by, "generation"]).select(*listings.columns)


def distinct_refs(refs: DataFrame, by: str) -> DataFrame:
    """by, place and ref: the refs (current, base, default; null where there is none) that a reader lists, each once, in their order."""
    each = refs.select(by, F.posexplode(F.array("current", "base", "default")).alias("place", "ref")).where("ref is not null")
    return each.groupBy(by, "ref").agg(F.min("place").cast("long").alias("place")).select(by, "place", "ref")
