"""The driver's tables seen as logs of an object store; Spark and SQL definitions side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as an ingest log: ord, at_ms, writer, kind, digest, body, body_sha256, size."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_id") % 4 == 0, "ac").otherwise("cas")
    return e.select(
        F.col("event_id").alias("ord"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("user_id").alias("writer"),
        kind.alias("kind"),
        F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("digest"),
        F.col("event_type"),
        F.col("props").alias("body"),
        F.sha2(F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props")), 256).alias("body_sha256"),
        (F.octet_length("props") + F.col("user_id") % 50).cast("long").alias("size"),
    )


LOG = """
log AS (
  SELECT event_id AS ord, epoch_us(ts) // 1000 AS at_ms, user_id AS writer,
         CASE WHEN event_id % 4 = 0 THEN 'ac' ELSE 'cas' END AS kind,
         sha256(concat_ws(':', CAST(user_id AS VARCHAR), event_type, props)) AS digest,
         event_type, props AS body,
         sha256(CASE WHEN event_id % 5 = 0 THEN props || '!' ELSE props END) AS body_sha256,
         CAST(strlen(props) + user_id % 50 AS BIGINT) AS size
  FROM events
)
"""

OUTCOMES = (
    LOG
    + """, outcome AS (
  SELECT *, CASE WHEN ord = first_value(ord) OVER w THEN 'accepted'
                 WHEN body_sha256 = first_value(body_sha256) OVER w AND size = first_value(size) OVER w THEN 'duplicate'
                 ELSE 'conflict' END AS outcome
  FROM log WINDOW w AS (PARTITION BY kind, digest ORDER BY ord)
)
"""
)

SEQUENCED = (
    OUTCOMES
    + """, sequenced AS (
  SELECT *, row_number() OVER (ORDER BY ord) - 1 AS position,
         CASE WHEN kind = 'cas' THEN CAST(sum(CAST(kind = 'cas' AS INT)) OVER (ORDER BY ord) AS BIGINT) END AS cas_sequence,
         CASE WHEN kind = 'ac' THEN CAST(coalesce(sum(CAST(kind = 'cas' AS INT)) OVER (ORDER BY ord), 0) AS BIGINT) END AS cas_barrier
  FROM outcome WHERE outcome = 'accepted'
)
"""
)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """orders as catalog rows: every id occurs under two refs and dates."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        (F.col("o_orderkey") % 5000).alias("id"),
        F.concat(F.lit("store-"), F.col("o_orderpriority"), F.lit("-"), (F.col("o_custkey") % 40).cast("string")).alias("key"),
        F.concat(F.lit("v"), F.col("o_orderkey") % 3).alias("version"),
        F.when(F.col("o_orderkey") % 2 == 0, "refs/heads/main").otherwise("refs/pull/7/merge").alias("ref"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )


CATALOG = """
catalog AS (
  SELECT o_orderkey % 5000 AS id, 'store-' || o_orderpriority || '-' || CAST(o_custkey % 40 AS VARCHAR) AS key,
         'v' || CAST(o_orderkey % 3 AS VARCHAR) AS version,
         CASE WHEN o_orderkey % 2 = 0 THEN 'refs/heads/main' ELSE 'refs/pull/7/merge' END AS ref,
         CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, epoch_us(o_orderdate) // 1000 AS created_at
  FROM orders
)
"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """part as members of packs of at most 200 objects: pack, created_at, ordinal, kind, digest, payload."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(
        F.floor(F.col("p_partkey") / 100).cast("long").alias("pack"),
        (F.col("p_partkey") % 100).cast("long").alias("ord"),
        F.lit("cas").alias("kind"),
        F.sha2(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")), 256).alias("digest"),
        F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).cast("binary").alias("payload"),
    )


MEMBERS = """
members AS (
  SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS pack, CAST(p_partkey % 100 AS BIGINT) AS ord, 'cas' AS kind,
         sha256(p_name || '/' || CAST(p_partkey AS VARCHAR)) AS digest, p_name || '/' || CAST(p_partkey AS VARCHAR) AS payload
  FROM part
)
"""
