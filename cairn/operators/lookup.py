"""Catalog order and deduplication, filtered candidates and lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom


def newest_first() -> list:
    return [F.desc("created_at"), F.desc("id"), F.asc("key"), F.asc("ref"), F.asc("version")]


def distinct_ids(catalog: DataFrame) -> DataFrame:
    """The newest row of every id; of rows that differ in their size only, the smallest."""
    order = Window.partitionBy("id").orderBy(*newest_first(), F.asc("size_bytes"))
    return catalog.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


#: Filters that are broadcast at a time: 256 bytes each.
BLOCK = 16_384


def candidates(packs: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id and pack of every pack whose filter may hold the probe; packs: pack and bits.

    Filters are taken in blocks of at most BLOCK, 4 MB; each is broadcast as a matrix that
    says for every bit which filters have it, and a probe's candidates are the filters that
    all its bits have in common. Probes are never shuffled.
    """
    spark = probes.sparkSession
    kind = dict(packs.dtypes)["pack"]
    blocks = max(1, -(-packs.count() // BLOCK))
    asked = probes.select("probe_id", F.array_distinct(bloom.positions(F.col("kind"), F.col("digest"))).alias("bits"))
    schema = f"probe_id {dict(probes.dtypes)['probe_id']}, pack {kind}"
    out = spark.createDataFrame([], schema)
    dealt = packs.select("pack", "bits", F.pmod(F.xxhash64("pack"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).toArrow()
        if not rows.num_rows:
            continue
        has = np.zeros((bloom.BITS, rows.num_rows), bool)
        lists = rows["bits"].combine_chunks()
        has[lists.flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))] = True
        out = out.union(asked.mapInArrow(_tested(spark.sparkContext.broadcast((rows["pack"].combine_chunks(), np.packbits(has, axis=1)))), schema))
    return out


def _tested(shared):
    def run(batches):
        packs, has = shared.value
        for batch in batches:
            lists = batch.column(1)
            bits, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            # some hundred probes at a time
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                start = ends[lo:hi] - ends[0]
                rows = np.bitwise_and.reduceat(has[bits[start[0] : ends[hi] - ends[0]]], start - start[0], axis=0)
                probe, pack = np.nonzero(np.unpackbits(rows, axis=1, count=len(packs)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(probe)), packs.take(pa.array(pack))], ["probe_id", "pack"])

    return run


def held(probes: DataFrame, index: DataFrame) -> DataFrame:
    """probe_id with the index row (pack, ordinal, offset, length) of every pack that holds the probe."""
    return probes.select("probe_id", "kind", "digest").join(index.select("kind", "digest", "pack", "ordinal", "offset", "length"), ["kind", "digest"]).drop("kind", "digest")


def false_positives(found: DataFrame, members: DataFrame, probes: DataFrame) -> DataFrame:
    """Candidates whose pack does not hold the probe."""
    named = found.join(probes.select("probe_id", "kind", "digest"), "probe_id")
    return named.join(members.select("pack", "kind", "digest"), ["pack", "kind", "digest"], "left_anti")


def newest_valid(matches: DataFrame) -> DataFrame:
    """For every probe its newest matching pack that is intact; corrupt ones fall back to older."""
    order = Window.partitionBy("probe_id").orderBy(F.desc("created_at"), F.desc("pack"))
    return matches.where("intact").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def materialized(candidates: DataFrame, version: str) -> DataFrame:
    """probe_id, pack, tried, errors and false_positives: where each probe is found, and at what price.

    candidates: probe_id, turn (0, or 1 after a refresh), pack, key, version, created_at, intact and holds (whether the
    pack's index has the probe). Those of another version are skipped; so are in turn 1
    those that turn 0 tried. They are tried newest first until one is intact and holds the
    probe; a broken one is an error, one that does not hold it a false positive. pack is null where none does.
    Entries of one pack and date are tried by key; of one entry's rows the intact ones that hold the probe come first.
    """
    fit = candidates.where(F.col("version") == version)
    once = fit.groupBy("probe_id", "key", "version").agg(F.min_by(F.struct("turn", "created_at", "pack", "intact", "holds"), F.struct("turn", -F.col("created_at"), -F.col("pack"), ~F.col("intact"), ~F.col("holds"))).alias("c"))
    order = Window.partitionBy("probe_id").orderBy("turn", F.desc("created_at"), F.desc("pack"), "key")
    hit = (F.col("intact") & F.col("holds")).cast("int")
    rows = once.select("probe_id", "key", "c.*").withColumn("__hit", hit)
    before = F.coalesce(F.max("__hit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = rows.withColumn("__before", before).where("__before = 0")
    out = tried.groupBy("probe_id").agg(
        F.max(F.when(F.col("__hit") == 1, F.col("pack"))).alias("pack"), F.count(F.lit(1)).alias("tried"), F.count_if(~F.col("intact")).alias("errors"), F.count_if(F.col("intact") & ~F.col("holds")).alias("false_positives")
    )
    return candidates.select("probe_id").distinct().join(out, "probe_id", "left").na.fill(0, ["tried", "errors", "false_positives"])


def exact(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds found to requests (key, version): 'hit' for the very entry, 'not exact' where only entries whose key begins with it are there, 'miss' else."""
    known = entries.select("key", "version").distinct().withColumn("__hit", F.lit(True))
    rows = requests.join(known, ["key", "version"], "left")
    # a longer key offers itself under each of its beginnings that is asked for
    asked = requests.select("key", "version").distinct().withColumn("n", F.length("key"))
    lengths = asked.select("n").distinct()
    near = known.join(F.broadcast(lengths), F.length("key") > F.col("n")).select(F.substring("key", F.lit(1), F.col("n")).alias("key"), "version").distinct().withColumn("__near", F.lit(True))
    found = F.when(F.col("__hit"), "hit").when(F.col("__near"), "not exact").otherwise("miss")
    return rows.join(near, ["key", "version"], "left").withColumn("found", found).drop("__hit", "__near")


def attempts(reads: DataFrame, by: str) -> DataFrame:
    """by, outcome and errors of reads from their calls (ord, status, limited): a refused signature is tried once more with a new one and counts only if that fails too."""
    order = Window.partitionBy(by).orderBy("ord")
    refused = F.col("status").isin(401, 403) & ~F.col("limited")
    first = F.row_number().over(order) == 1
    rows = reads.withColumn("__first", first & refused).withColumn("__bad", F.col("status") >= 400)
    return rows.groupBy(by).agg(
        F.when(F.max_by("__bad", "ord"), F.when(F.max_by("limited", "ord"), "limited").otherwise("failed")).otherwise("served").alias("outcome"),
        F.count_if(F.col("__bad") & ~F.col("__first")).alias("errors"), F.count_if("__first").alias("refreshed"),
    )


def tiers(probes: DataFrame, local: DataFrame, packed: DataFrame, legacy: DataFrame) -> DataFrame:
    """Adds tier: local, pack, object or miss, the first that holds (kind, digest)."""
    out = probes
    for name, side in (("local", local), ("pack", packed), ("object", legacy)):
        out = out.join(side.select("kind", "digest", F.lit(name).alias(f"__{name}")).distinct(), ["kind", "digest"], "left")
    return out.withColumn("tier", F.coalesce("__local", "__pack", "__object", F.lit("miss"))).drop("__local", "__pack", "__object")
