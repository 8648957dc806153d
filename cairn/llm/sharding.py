"""Sharding by jump consistent hashing, with DataFrame functions only.

The key's 64-bit state advances by a linear congruential step, and every step jumps to the
next shard count at which the key would move; the last jump below the shard count is its
shard. Appending a shard moves keys only into it. No ring or table is kept.

Edge cases: a null doc_id counts as key 0; negative ids count modulo 2^64; null texts have
no bytes (size 1, crc32 0); repeated rows get the same shard and slots of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import materialize, pieces

#: The multiplier of the generator, 2^64 and 2^33.
MULTIPLIER, TWO64, TWO33 = 2862933555777941757, 1 << 64, 1 << 33
#: Rows of a shard that are numbered together.
SLOT_ROWS = 2000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key."""
    wide = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    whole = key.cast("decimal(38,0)")
    start = F.struct(F.when(whole < 0, whole + wide(TWO64)).otherwise(whole).cast("decimal(38,0)").alias("key"), F.lit(-1.0).alias("b"), F.lit(0.0).alias("j"))

    def step(s: Column, _: Column) -> Column:
        nxt = ((s["key"] * wide(MULTIPLIER) + wide(1)) % wide(TWO64)).cast("decimal(38,0)")
        top = F.floor(nxt / wide(TWO33)).cast("double")
        jump = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (top + 1))).cast("double")
        go = s["j"] < shards
        return F.struct(F.when(go, nxt).otherwise(s["key"]).cast("decimal(38,0)").alias("key"), F.when(go, s["j"]).otherwise(s["b"]).alias("b"), F.when(go, jump).otherwise(s["j"]).alias("j"))

    # every step jumps at least one shard further
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Puts documents into shards by doc_id; slots are numbered within each shard."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    rows = materialize(rows, "shards")
    parts = pieces(rows.count(), SLOT_ROWS * shards)
    # equal ids (a key may hold a third of all rows) are spread by what else tells rows apart
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id() % 64), F.lit(parts)).cast("int"))
    rows = materialize(rows, "shard-parts")
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each shard and part, a few thousandths of the rows; every shard is numbered by itself
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("at", at)
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
