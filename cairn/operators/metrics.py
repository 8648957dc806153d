"""Counters and gauges of a daemon from its event log: every name is there, with 0 where nothing happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(log: DataFrame, by: str, of: str, names: tuple[str, ...]) -> DataFrame:
    """by and one column for each name: how often column `of` has it. Sums are made before the shuffle."""
    return log.groupBy(by).agg(*[F.count_if(F.col(of) == n).alias(n) for n in names])


def sums(log: DataFrame, by: str, of: str, amount: str, names: tuple[str, ...]) -> DataFrame:
    """by and one column for each name: the sum of `amount` over its rows."""
    return log.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col(of) == n, F.col(amount))), F.lit(0)).alias(n) for n in names])


def operations(calls: DataFrame, by: str, names: tuple[str, ...]) -> DataFrame:
    """by, calls of each operation, errors, rate_limited, and rate limits of each operation, from calls (op, error, limited)."""
    limited = [F.count_if((F.col("op") == n) & F.col("limited")).alias(f"{n}_limited") for n in names]
    return calls.groupBy(by).agg(*[F.count_if(F.col("op") == n).alias(n) for n in names], F.count_if("error").alias("errors"), F.count_if(F.col("error") & F.col("limited")).alias("rate_limited"), *limited)


def gauge(log: DataFrame, by: str, delta: Column, order: str) -> DataFrame:
    """by, last and peak of a running sum of `delta` in the order of a column; the peak is 0 at least."""
    from pyspark.sql import Window

    held = log.select(by, order, F.sum(delta).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("held"))
    return held.groupBy(by).agg(F.max_by("held", order).alias("last"), F.greatest(F.max("held"), F.lit(0)).alias("peak"))


def latest(log: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """by and the latest value of each column."""
    return log.groupBy(by).agg(*[F.max_by(c, order).alias(c) for c in columns])


def latched(log: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """by and, for each name, whether its condition ever held."""
    return log.groupBy(by).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()])


def queue_snapshot(log: DataFrame, by: str) -> DataFrame:
    """One row for each queue from its rows (ord, size, open, cas_sequence, completed): objects and bytes that are pending and that lie in the open batch, the durable and the accepted sequence."""
    left = ~F.col("completed")
    gap = F.min(F.when(left, F.col("cas_sequence")))
    last = F.coalesce(F.max("cas_sequence"), F.lit(0))
    return log.groupBy(by).agg(
        F.count_if(left).alias("pending"), F.coalesce(F.sum(F.when(left, F.col("size"))), F.lit(0)).alias("pending_bytes"), F.count_if(left & F.col("open")).alias("open_objects"),
        F.coalesce(F.sum(F.when(left & F.col("open"), F.col("size"))), F.lit(0)).alias("open_bytes"), F.coalesce(gap - 1, last).cast("long").alias("durable"), last.cast("long").alias("accepted"),
    )
