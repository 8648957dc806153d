"""Token buckets, pauses and state machines over arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import DEFAULT_PAUSE
from .folds import fold

MINUTE = 60_000


def grants(arrivals: DataFrame, writer: str, budget: int, burst: int, writers: int = 1) -> DataFrame:
    """Adds grant_ms of a token bucket of budget / writers tokens a minute, in closed form: one running maximum by writer.

    Times are counted in parts of a millisecond by the budget, so any rate is exact; a wait
    ends with the millisecond in which its token is there.
    """
    period = MINUTE * writers
    order = Window.partitionBy(writer).orderBy("at_ms", "ord")
    rows = arrivals.withColumn("__i", (F.row_number().over(order) - 1).cast("long")).withColumn("__t", F.col("at_ms") * F.lit(budget).cast("long"))
    latest = F.max(F.col("__t") - F.col("__i") * period).over(order.rowsBetween(Window.unboundedPreceding, -1))
    exact = F.greatest(F.col("__t"), F.col("__i") * period + F.coalesce(latest, F.col("__t")) - (burst - 1) * period)
    rows = rows.withColumn("__g", F.when(F.col("__i") == 0, F.col("__t")).otherwise(exact))
    return rows.withColumn("grant_ms", F.expr(f"-((-__g) div {budget}) + if(__g > 0 and __g % {budget} > 0, 1, 0)")).drop("__i", "__t", "__g")


def sleeps(granted: DataFrame, writer: str) -> DataFrame:
    """writer, sleeps and slept_ms: how often and how long its rows (at_ms, grant_ms) waited."""
    wait = F.col("grant_ms") - F.col("at_ms")
    return granted.groupBy(writer).agg(F.count_if(wait > 0).alias("sleeps"), F.sum(F.greatest(wait, F.lit(0))).alias("slept_ms"))


def paused_until(events: DataFrame, writer: str, jitter_ms: int = 0) -> DataFrame:
    """Adds until_ms: pauses only ever extend. With a jitter, column random (0 to 1) adds its share of it."""
    order = Window.partitionBy(writer).orderBy("at_ms", "ord").rowsBetween(Window.unboundedPreceding, 0)
    more = F.floor(F.col("random") * jitter_ms) if jitter_ms else F.lit(0)
    return events.withColumn("until_ms", F.max(F.col("at_ms") + F.col("pause_ms") + more).over(order))


def adaptive_rates(events: DataFrame, writer: str, configured: float) -> DataFrame:
    """Adds rate after each event: halved by a rate limit, a tenth of the configured rate more after a clean minute."""

    def step(s: list, at: int, limited: bool) -> tuple[float]:
        rate, last = s
        if limited:
            rate, last = rate / 2, at
        elif last is not None and at - last >= MINUTE and rate < configured:
            rate, last = min(configured, rate + configured / 10), at
        s[:] = rate, last
        return (rate,)

    return fold(events.select(writer, "ord", "at_ms", "limited"), writer, ["at_ms", "ord"], ["at_ms", "limited"], lambda: [configured, None], step, rate="double")


def pacer_snapshot(events: DataFrame, writer: str, configured: float, now_ms: int) -> DataFrame:
    """The gauges of each writer's pacer at now_ms, from its rates (rate), pauses (until_ms) and grants (at_ms, grant_ms, limited)."""
    seen = events.where(F.col("at_ms") <= now_ms)
    granted = F.col("grant_ms") <= now_ms
    slept = F.greatest(F.least(F.col("grant_ms"), F.lit(now_ms)) - F.col("at_ms"), F.lit(0))
    until = F.max("until_ms")
    return seen.groupBy(writer).agg(
        F.lit(float(configured)).alias("configured"), F.max_by("rate", F.struct("at_ms", "ord")).alias("current"), F.when(until > now_ms, until).alias("pause_until_ms"),
        F.count_if(F.col("limited")).alias("rate_limits"), F.count_if(granted).alias("granted"), F.count_if(~granted).alias("queued"), F.sum(slept).alias("slept_ms"),
    )


def circuit(events: DataFrame, by: str) -> DataFrame:
    """Adds state at each call: open within a trip's pause (1 s at least, a minute if it names none), one probe after it, closed by a success."""

    def step(s: list, at: int, limited: bool, pause: int | None) -> tuple[str]:
        until, tripped = s
        if tripped and at < until:
            return ("open",)
        state = "probe" if tripped else "closed"
        if limited:
            s[:] = max(until, at + max(1000, DEFAULT_PAUSE if pause is None else pause)), True
        else:
            s[1] = False
        return (state,)

    return fold(events.select(by, "ord", "at_ms", "limited", "pause_ms"), by, ["at_ms", "ord"], ["at_ms", "limited", "pause_ms"], lambda: [0, False], step, state="string")


def cooled_refreshes(misses: DataFrame, by: str, cooldown_ms: int) -> DataFrame:
    """Adds refreshed: a miss refreshes the catalog unless one did within the cooldown."""

    def step(s: list, at: int) -> tuple[bool]:
        go = s[0] is None or at - s[0] >= cooldown_ms
        if go:
            s[0] = at
        return (go,)

    return fold(misses.select(by, "ord", "at_ms"), by, ["at_ms", "ord"], ["at_ms"], lambda: [None], step, refreshed="boolean")


def coalesced(calls: DataFrame, by: str) -> DataFrame:
    """Adds flight: calls that overlap one in flight share it (islands of overlapping intervals)."""
    order = Window.partitionBy(by).orderBy("at_ms", "ord")
    latest = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (latest.isNull() | (F.col("at_ms") >= latest)).cast("bigint")
    return calls.withColumn("__new", fresh).withColumn("flight", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
