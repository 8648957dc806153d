"""Totally ordered running sums without a single-task window."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the order is cut into (a square); their sums are the only thing that is broadcast.
BUCKETS = 1024


def running_sums(rows: DataFrame, order: str, sums: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """Adds for each name the sum of its expression over all rows up to and with this one; order: a unique long.

    The cuts are quantiles of the order, so buckets have about as many rows each however the
    values lie; the driver takes these few numbers in a job of their own.
    """
    side = math.isqrt(buckets)
    n = side * side
    found = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).first()[0]
    found = found or []
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col(order)))
    # every side-th cut first, then those between two of them
    fine = constant([found[k : k + side - 1] for k in range(0, n, side)], "array<array<bigint>>")
    cut = rows.withColumn("__a", below(constant(found[side - 1 :: side], "array<bigint>"))).withColumn("__b", F.col("__a") * side + below(F.element_at(fine, F.col("__a") + 1))).drop("__a")
    # one row a bucket: at most `buckets` rows, whatever the input
    totals = cut.groupBy("__b").agg(*[F.sum(e).alias(f"__{n}") for n, e in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(e).over(within).alias(n) for n, e in sums.items()])
    joined = local.join(F.broadcast(offsets), "__b")
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).cast("bigint").alias(n) for n in sums])
