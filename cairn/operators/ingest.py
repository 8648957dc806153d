"""The ordered ingest log: deduplication, sequences, barriers, batches and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .running import running_sums


def outcomes(log: DataFrame) -> DataFrame:
    """Adds outcome: the first row of an identity is accepted; later ones repeat it or conflict with it.

    The first row comes from an aggregation that combines before the shuffle, not from a
    window, so one identity may hold any share of the rows.
    """
    first = log.groupBy("kind", "digest").agg(F.min_by(F.struct("ord", "body_sha256", "size"), "ord").alias("first"))
    same = (F.col("body_sha256") == F.col("first.body_sha256")) & (F.col("size") == F.col("first.size"))
    outcome = F.when(F.col("ord") == F.col("first.ord"), "accepted").when(same, "duplicate").otherwise("conflict")
    return log.join(first, ["kind", "digest"]).withColumn("outcome", outcome).drop("first")


def sequenced(accepted: DataFrame) -> DataFrame:
    """Adds position (from 0), cas_sequence of content rows and cas_barrier of action rows, in the order of arrival."""
    cas = (F.col("kind") == "cas").cast("bigint")
    rows = running_sums(accepted, "ord", {"position": F.lit(1).cast("bigint"), "__cas": cas})
    return rows.select(*accepted.columns, (F.col("position") - 1).alias("position"), F.when(F.col("kind") == "cas", F.col("__cas")).alias("cas_sequence"), F.when(F.col("kind") == "ac", F.col("__cas")).alias("cas_barrier"))


def batches(rows: DataFrame, writer: str, most: int, target: int) -> DataFrame:
    """Adds batch (from 0 by writer): greedy prefixes of at most `most` rows that stay within `target` bytes; a first row always fits."""

    def step(state: list, size: int) -> tuple[int]:
        batch, n, held = state
        if n and (n >= most or held + size > target):
            batch, n, held = batch + 1, 0, 0
        state[:] = batch, n + 1, held + size
        return (batch,)

    return fold(rows.select(writer, "ord", "size"), writer, ["ord"], ["size"], lambda: [0, 0, 0], step, batch="long")


def open_batches(batched: DataFrame, writer: str) -> DataFrame:
    """writer, objects and bytes of the last batch of each writer, the one that is still open."""
    sums = batched.groupBy(writer, "batch").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))
    return sums.groupBy(writer).agg(F.max_by(F.struct("objects", "bytes"), "batch").alias("b")).select(writer, "b.objects", "b.bytes")


def watermark(rows: DataFrame, by: str) -> DataFrame:
    """The last sequence of the unbroken run of completed sequences from 1 on; 0 without one."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("sequence"))
    done = rows.where("completed").withColumn("place", place).where("sequence = place").groupBy(by).agg(F.max("sequence").alias("watermark"))
    return rows.select(by).distinct().join(done, by, "left").select(by, F.coalesce("watermark", F.lit(0)).cast("bigint").alias("watermark"))


def barrier_violations(rows: DataFrame, by: str) -> DataFrame:
    """Action rows whose barrier is above all content sequences before them."""
    before = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("cas_sequence").over(before), F.lit(0))
    return rows.withColumn("covered", covered).where((F.col("kind") == "ac") & (F.col("cas_barrier") > F.col("covered")))


def batch_problems(rows: DataFrame, by: str) -> DataFrame:
    """Adds problem to the rows of a batch (ord, kind, cas_sequence, cas_barrier; durable: sequence before the batch).

    The content sequences of a batch go on from the durable one without a gap, and no action
    row needs more than those before it.
    """
    order = Window.partitionBy(by).orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("cas_sequence").over(before), F.col("durable"))
    problem = F.when(F.col("cas_sequence").isNotNull() & (F.col("cas_sequence") != covered + 1), "sequence is not contiguous")
    return rows.withColumn("problem", problem.when(F.col("cas_barrier") > covered, "barrier is not durable"))


def blocked(problems: DataFrame, by: str) -> DataFrame:
    """by and blocked: 1 where the latest batch (batch, problem) crossed a barrier, else 0."""
    hit = problems.groupBy(by, "batch").agg(F.max((F.col("problem") == "barrier is not durable").cast("long")).alias("hit"))
    return hit.groupBy(by).agg(F.coalesce(F.max_by("hit", "batch"), F.lit(0)).cast("long").alias("blocked"))


def drained(rows: DataFrame, by: str, deadline: str, shown: int = 100) -> DataFrame:
    """What a drain leaves of rows (ord, kind, digest, size, accepted_ms, completed_ms): by, accepted, completed, remaining and the first identities that remain.

    Rows that came after the drain began (drain_ms) are refused; those that are not complete
    at its deadline remain, in the order of the queue.
    """
    taken = F.col("accepted_ms") < F.col("drain_ms")
    done = taken & F.coalesce(F.col("completed_ms") <= F.col(deadline), F.lit(False))
    left = rows.where(taken & ~done)
    place = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    first = left.withColumn("__n", place).where(F.col("__n") <= shown).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.concat("kind", F.lit(":"), "digest").alias("id")))), lambda x: x["id"]).alias("first_remaining"))
    sums = rows.groupBy(by).agg(
        F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("refused"), F.count_if(done).alias("completed"), F.count_if(taken & ~done).alias("remaining"),
        F.coalesce(F.sum(F.when(taken & ~done, F.col("size"))), F.lit(0)).alias("remaining_bytes"),
    )
    return sums.join(first, by, "left")


def recovery(rows: DataFrame, by: str) -> DataFrame:
    """Durable sequence of a log of pending rows: before the first content row, else the largest barrier, else 0."""
    return rows.groupBy(by).agg(F.coalesce(F.min("cas_sequence") - 1, F.max("cas_barrier"), F.lit(0)).cast("bigint").alias("durable"), F.count(F.lit(1)).alias("pending"))
