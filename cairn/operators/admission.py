"""Admission to a bounded store, sealing of batches, weighted semaphores, least recently used entries, capped journals."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def admitted(events: DataFrame, by: str, most: int) -> DataFrame:
    """Adds outcome to events (ord, op, id, size) of a store of `most` bytes.

    op 'accept': 'accepted' or 'full'; stored objects that are durable elsewhere go, in the
    order in which they became so, until the new one fits; one that is held is a 'duplicate'. op 'complete': 'durable' if the
    object is held, 'unknown' if not.
    """

    def start() -> dict:
        # whether a held object is durable, its size, durable ones in order, bytes in all
        return {"held": {}, "sizes": {}, "durable": deque(), "resident": 0}

    def step(s: dict, op: str, key: str, size: int) -> tuple[str]:
        held, sizes, durable = s["held"], s["sizes"], s["durable"]
        if op == "complete":
            if held.get(key) is False:
                held[key] = True
                durable.append(key)
            return ("durable" if key in held else "unknown",)
        if key in held:
            return ("duplicate",)
        while durable and size > most - s["resident"]:
            gone = durable.popleft()
            s["resident"] -= sizes.pop(gone)
            del held[gone]
        if size > most - s["resident"]:
            return ("full",)
        held[key], sizes[key] = False, size
        s["resident"] += size
        return ("accepted",)

    return fold(events.select(by, "ord", "op", "id", "size"), by, ["ord"], ["op", "id", "size"], start, step, outcome="string")


def sealed_batches(arrivals: DataFrame, by: str, objects: int, target: int, age_ms: int) -> DataFrame:
    """Adds batch (from 0) and seal_ms to arrivals (ord, at_ms, size).

    A batch is a prefix of the queue: it ends with `objects` rows, at `target` bytes, before
    a row that would exceed them, or `age_ms` after its first row. It is sealed when its
    rows or bytes reach the limit, else by age, and never before the batch ahead of it.
    """

    def step(s: dict, at: int, size: int) -> tuple[int, int, int | None]:
        if s["oldest"] is None or s["closed"] is not None or s["held"] + size > target or at - s["oldest"] >= age_ms:
            s.update(batch=s["batch"] + 1, n=0, held=0, oldest=at, closed=None)
        s["n"] += 1
        s["held"] += size
        if s["n"] >= objects or s["held"] >= target:
            s["closed"] = at
        return s["batch"], s["oldest"], s["closed"]

    rows = arrivals.select(by, "ord", "at_ms", "size")
    rows = fold(rows, by, ["at_ms", "ord"], ["at_ms", "size"], lambda: {"batch": -1, "n": 0, "held": 0, "oldest": None, "closed": None}, step, batch="long", __oldest="long", __closed="long")
    # a batch is bounded, so its seal comes from an aggregate and the order of batches from a running maximum
    own = rows.groupBy(by, "batch").agg(F.coalesce(F.max("__closed"), F.min("__oldest") + age_ms).alias("own"))
    seal = F.max("own").over(Window.partitionBy(by).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return rows.drop("__oldest", "__closed").join(own.select(by, "batch", seal.alias("seal_ms")), [by, "batch"]).select(by, "ord", "at_ms", "size", "batch", "seal_ms")


def semaphore(requests: DataFrame, by: str, capacity: int) -> DataFrame:
    """Adds granted_ms to requests (ord, at_ms, amount, hold_ms): first come, first served, the head blocks the rest.

    An amount of 0 is granted at once; one above the capacity never is (null).
    """

    def step(s: dict, at: int, amount: int, hold: int) -> tuple[int | None]:
        if not 0 < amount <= capacity:
            return (at if amount == 0 else None,)
        now, used, releases = at if s["ahead"] is None else max(at, s["ahead"]), s["used"], s["releases"]
        while releases and (releases[0][0] <= now or used + amount > capacity):
            end, freed = heapq.heappop(releases)
            now, used = max(now, end), used - freed
        heapq.heappush(releases, (now + hold, amount))
        s["used"], s["ahead"] = used + amount, now
        return (now,)

    rows = requests.select(by, "ord", "at_ms", "amount", "hold_ms")
    return fold(rows, by, ["at_ms", "ord"], ["at_ms", "amount", "hold_ms"], lambda: {"used": 0, "ahead": None, "releases": []}, step, granted_ms="long")


def most_recent(accesses: DataFrame, by: str, key: str, capacity: int) -> DataFrame:
    """The entries that a cache of `capacity` entries holds after all accesses, with rank 1 for the newest."""
    last = accesses.groupBy(by, key).agg(F.max("ord").alias("last"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("last")))
    return last.withColumn("rank", rank).where(F.col("rank") <= capacity)


def capped_journal(events: DataFrame, by: str, most: int, limit: Column) -> DataFrame:
    """by, place, message: the first `most` events and, where there are more, one row that says so."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    rows = events.withColumn("place", place).where(F.col("place") <= most + 1)
    return rows.select(by, "place", F.when(F.col("place") <= most, F.col("message")).otherwise(limit).alias("message"))


def reserved(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds outcome to requests (ord, key, version): 'reserved' for the first of an entry that does not exist, else 'conflict'."""
    known = existing.select("key", "version").distinct().withColumn("__known", F.lit(True))
    first = requests.groupBy("key", "version").agg(F.min("ord").alias("__first"))
    rows = requests.join(first, ["key", "version"]).join(known, ["key", "version"], "left")
    outcome = F.when(F.col("__known").isNull() & (F.col("ord") == F.col("__first")), "reserved").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("__known", "__first")
