"""Recovery of a queue from the manifests and data files of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import Record, sequence

#: Names of manifests, their bytes at most.
MANIFEST, MANIFEST_BYTES = r"^([0-9]{12})-(ac|cas)-([0-9a-f]{64})\.json\z", 8192


def pairing(files: DataFrame, by: str) -> DataFrame:
    """Adds role to files (by, name): 'manifest', 'data', 'orphan' (data without a manifest), 'stale' (an unfinished manifest) or 'other'."""
    name = F.col("name")
    stem = F.regexp_replace(name, r"\.(json|data)\z", "")
    kept = files.where(name.endswith(".json")).select(by, stem.alias("__stem")).distinct().withColumn("__kept", F.lit(True))
    rows = files.withColumn("__stem", stem).join(kept, [by, "__stem"], "left")
    data = F.when(F.col("__kept"), "data").otherwise("orphan")
    role = F.when(name.endswith(".json"), "manifest").when(name.endswith(".data"), data).when(name.endswith(".json.tmp"), "stale").otherwise("other")
    return rows.withColumn("role", role).drop("__stem", "__kept")


def manifest_problems(manifests: DataFrame, by: str, most: int) -> DataFrame:
    """Adds to manifests (by, directory, name, size: bytes of the manifest, body: its JSON, data_size: bytes of its data file, null if there is none) what they say and problem, null if all is well."""
    manifests = manifests.withColumn("__parsed", F.try_parse_json("body"))
    name, r = F.col("name"), Record(F.col("__parsed"))
    part = lambda i: F.regexp_extract(name, MANIFEST, i)
    path = F.concat("directory", F.lit("/"), name)
    read = manifests.select(
        by, "name", path.alias("path"), F.col("size").alias("bytes"), "data_size", part(1).try_cast("bigint").alias("ord"), part(2).alias("kind"), part(3).alias("digest"), name.rlike(MANIFEST).alias("named"), r.is_record().alias("record"),
        r.integer("size", 0, most).alias("object_size"), r.integer("acceptedAt").alias("at"), r.text("bodySha256").alias("body_sha256"), r.text("kind").alias("m_kind"), r.text("digest").alias("m_digest"), r.integer("order").alias("m_order"),
        r.text("manifestPath").alias("m_path"), r.text("path").alias("m_data"), sequence(r, "casSequence", False).alias("cas"), sequence(r, "casBarrier", True).alias("barrier"), r.type("casSequence").isNotNull().alias("has_cas"), r.type("casBarrier").isNotNull().alias("has_barrier"),
    )
    kind, c = F.col("kind"), F.col
    same = (
        (c("m_kind") == kind) & (c("m_digest") == c("digest")) & (c("m_order") == c("ord")) & (c("m_path") == c("path"))
        & (c("m_data") == F.regexp_replace("path", r"\.json\z", ".data")) & c("body_sha256").rlike(r"^[0-9a-f]{64}\z")
    )
    rules = [
        (c("named"), "name"), (c("bytes") <= MANIFEST_BYTES, "size of the manifest"), (c("record"), "record"), (c("object_size").isNotNull(), "size"), (c("at").isNotNull(), "time"),
        (same, "inconsistent"), ((kind != "cas") | (c("body_sha256") == c("digest")), "digest"), (c("data_size") == c("object_size"), "data"),
        (F.when(kind == "cas", c("cas").isNotNull() & ~c("has_barrier")).otherwise(c("barrier").isNotNull() & ~c("has_cas")), "sequence"),
    ]
    problem = F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), text) for good, text in rules])
    return read.select(by, "name", "ord", "kind", "digest", "object_size", "body_sha256", F.when(kind == "cas", c("cas")).alias("cas_sequence"), F.when(kind == "ac", c("barrier")).alias("cas_barrier"), problem.alias("problem"))


def recovered(checked: DataFrame, by: str, most: int) -> DataFrame:
    """The state of each queue from its checked manifests: by, problem, durable, accepted, next_order, pending and pending_bytes.

    A manifest's own problem, the first by name, counts before those between manifests, of
    which the first in order counts: orders are unique, content sequences go on from the
    durable one without a gap, no action needs more than those before it, no identity occurs
    twice and all objects fit into `most` bytes. A queue with a problem has no state.
    """
    own = checked.groupBy(by).agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("name"))).alias("__own"), F.coalesce(F.min("cas_sequence") - 1, F.max("cas_barrier"), F.lit(0)).cast("decimal(20,0)").alias("durable"))
    order = Window.partitionBy(by).orderBy("ord", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = checked.join(own, by)
    covered = F.coalesce(F.max("cas_sequence").over(before), F.col("durable"))
    again = F.row_number().over(Window.partitionBy(by, "kind", "digest").orderBy("ord", "name")) > 1
    between = F.coalesce(
        F.when(F.lag("ord").over(order) == F.col("ord"), "order is not unique"), F.when(F.col("cas_sequence") != covered + 1, "sequence is not contiguous"),
        F.when(F.col("cas_barrier") > covered, "barrier is not covered"), F.when(F.col("__again"), "duplicate object"),
        F.when(F.sum("object_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) > most, "too many bytes"),
    )
    rows = rows.withColumn("__again", again).withColumn("__between", between)
    place = F.when(F.col("__between").isNotNull(), F.struct("ord", "name"))
    found = rows.groupBy(by).agg(
        F.coalesce(F.first("__own"), F.min_by("__between", place)).alias("problem"), F.first("durable").alias("durable"), F.coalesce(F.max("cas_sequence"), F.first("durable")).alias("accepted"),
        (F.max("ord") + 1).alias("next_order"), F.count(F.lit(1)).alias("pending"), F.sum("object_size").alias("pending_bytes"),
    )
    state = [F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("durable", "accepted", "next_order", "pending", "pending_bytes")]
    return found.select(by, "problem", *state)
