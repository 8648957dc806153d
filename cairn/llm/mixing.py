"""Mixing sources to target weights by entropy balancing.

The rates closest to the documents' prior rates (relative entropy, each word counting once)
that give every source its target of words are exponentially tilted: prior x exp(lambda of
the source), at most 2. Newton's method solves the convex dual: in every step Spark sums
gradient and curvature by source over the words of each prior rate, and the multipliers of
all sources move at once; they stay in a table of sources, however many there are. Rates
then become whole copies: within parts of a source, from large to small documents, the
rounding error is carried to the next document, so a part ends within half of its smallest
document.

The prior rate of a document rises with its size, from a half to 1 at 100 words: where a
source gives less than all, fragments give way first.

Edge cases: null texts have size 0 and are taken 0 times a word; a null source is a source
of its own, last in order; a source without words has target 0; rows that repeat an id and
text share out the copies of all of them; an empty table gives no rows; other columns are
ignored (the stage keeps them as they are, row by row).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import materialize, release

WEIGHTS = (5, 2, 1)
#: Words of the mix in all, as a share of the words of all documents; most copies of a document.
SHARE, MOST = 1.5, 2
#: Words from which on a document has prior rate 1, and the rate that an empty one would have.
WHOLE, LEAST = 100, 0.5
#: Documents of a source whose rounding errors are carried on together.
PART_ROWS = 1000
#: Newton's steps at most, and the share of its target by which a source may miss it before rounding.
STEPS, NEAR = 60, 1e-9
#: Multipliers are held within these; a full source has FULL.
LOW, HIGH, FULL = -200.0, 200.0, 700.0
#: Rows that a repeated document is spread to at a time.
SPREAD = 4096


def word_count(text):
    # blanks at the ends leave no empty word: only runs of other characters count
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prior_rate(size: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(LEAST) + size * ((1 - LEAST) / WHOLE))


def _source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0 in the order of the source (by code point, null last), without a window over all sources."""
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("__at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "sources").withColumn("__p", F.shiftright("__at", 33))
    ahead, offsets = 0, []
    # a row for each partition of the sort
    for r in ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect():
        offsets.append((r["__p"], ahead))
        ahead += r["n"]
    starts = sources.sparkSession.createDataFrame(offsets, "__p long, __ahead long")
    rank = F.col("__ahead") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(starts), "__p").withColumn("rank", rank).drop("__p", "__at", "__ahead")


def targeted(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to sources (source, source_size): a share by weight, at most `most` times the size, the excess reshared."""
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("__w", weight), "ranked")
    room = F.col("source_size") * float(most)
    level = None
    while True:
        over = F.lit(False) if level is None else F.col("__w") * level > room
        s = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, room)).alias("capped"), F.sum(F.when(~over, F.col("__w"))).alias("free")).first()
        if not s["free"]:
            break
        now = (share * (s["all"] or 0) - (s["capped"] or 0.0)) / s["free"]
        if level is not None and now <= level:
            break
        # the level only rises, as capped sources leave words to the others
        level = now
    target = room if level is None else F.least(room, F.col("__w") * level)
    return ranked.withColumn("target", target.cast("double")).drop("__w", "rank")


def multipliers(table: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """Adds lam to sources (key, target): Newton's method for the dual over table (key, q: prior rate, s: words)."""
    reach = table.groupBy("key").agg((F.sum(F.when(F.col("q") > 0, F.col("s"))) * float(most)).alias("__reach"), F.sum(F.col("q") * F.col("s")).alias("__first"))
    columns = sources.columns
    first = F.when(F.col("target") >= F.coalesce("__reach", F.lit(0.0)) * (1 - 1e-12), FULL).when(F.col("target") <= 0, LOW)
    first = first.otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.log(F.col("target") / F.col("__first")))))
    state = sources.join(reach, "key").select(*columns, first.alias("lam"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    state = materialize(state, "multipliers")
    free = (F.col("lam") < HIGH) & (F.col("lam") > LOW)
    for _ in range(STEPS):
        rate = F.col("q") * F.exp("lam")
        sums = table.join(state, "key").groupBy("key").agg(
            F.sum(F.col("s") * F.least(F.lit(float(most)), rate)).alias("__words"), F.sum(F.when(rate < most, F.col("s") * rate).otherwise(0.0)).alias("__bend")
        )
        gap = F.col("__words") - F.col("target")
        # the gradient rises with lam: a step that leaves what is known of the root, or has no curvature, halves it
        low, high = F.when(gap < 0, F.greatest("low", "lam")).otherwise(F.col("low")), F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high"))
        moved = state.join(sums, "key").withColumns({"__gap": gap, "__low": low, "__high": high})
        newton = F.col("lam") - F.try_divide(F.col("__gap"), F.col("__bend"))
        inside = (F.col("__bend") > 0) & (newton > F.col("__low")) & (newton < F.col("__high"))
        done = ~free | (F.abs("__gap") <= NEAR * F.greatest(F.lit(1.0), F.col("target")))
        lam = F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("__low") + F.col("__high")) / 2)
        before = state
        state = materialize(moved.select(*columns, lam.alias("lam"), F.col("__low").alias("low"), F.col("__high").alias("high"), done.alias("done")), "multipliers")
        release(before)
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(*columns, "lam")


def balanced(docs: DataFrame, prior: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Units (key, doc_id, text_key, size, q, m: rows that repeat id and text) and sources (key, source_size, n, target, lam).

    prior: an expression over columns of docs; without one the rate is by size.
    """
    size = word_count(F.col("text"))
    rate = prior_rate(F.col("size")) if prior is None else prior.cast("double")
    rows = docs.withColumn("size", size).withColumn("q", rate).withColumn("text_key", F.xxhash64("doc_id", "text")).withColumn("key", _source_key(F.col("source")))
    # repeated rows are one unit: no part of a source grows with them
    units = rows.groupBy("key", "doc_id", "text_key", "size", "q").agg(F.count(F.lit(1)).alias("m"), F.first("source").alias("source"))
    units = materialize(units, "units")
    table = materialize(units.groupBy("key", "q").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("m")).cast("double").alias("s"), F.count(F.lit(1)).alias("n")), "priors")
    sources = table.groupBy("key").agg(F.first("source").alias("source"), F.sum("s").cast("long").alias("source_size"), F.sum("n").alias("n"))
    goals = targeted(sources).drop("source")
    return units.drop("source"), multipliers(table.drop("source", "n"), goals)


def round_part(part: pd.DataFrame) -> pd.DataFrame:
    """Copies of all rows of each unit of a part; the error goes from larger to smaller documents."""
    part = part.sort_values(["size", "doc_id", "text_key"], ascending=[False, True, True], kind="stable")
    owed, copies = 0.0, []
    for size, rate, m in zip(part["size"].tolist(), part["rate"].tolist(), part["m"].tolist()):
        owed += size * rate * m
        n = min(MOST * m, max(0, math.floor(owed / size + 0.5))) if size else min(MOST * m, round(rate * m))
        owed -= n * size
        copies.append(n)
    return part.assign(copies=copies)


def unit_copies(docs: DataFrame, prior: Column | None = None) -> DataFrame:
    """doc_id, text_key, size, m, source_size, target and copies (of all m rows together) of every unit."""
    units, sources = balanced(docs, prior)
    rate = F.least(F.lit(float(MOST)), F.col("q") * F.exp("lam"))
    parts = F.ceil(F.col("n") / PART_ROWS)
    # parts of a source are bounded: its units are spread over them by their hash
    rows = units.join(sources, "key").withColumn("rate", rate).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), parts))
    columns = ["doc_id", "text_key", "size", "m", "source_size", "target"]
    return rows.select("key", "part", "rate", *columns).groupBy("key", "part").applyInPandas(
        lambda p: round_part(p)[[*columns, "copies"]], "doc_id long, text_key long, size long, m long, source_size long, target double, copies long"
    )


def copies(docs: DataFrame, prior: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and copies of every row."""
    units = unit_copies(docs, prior)
    # a unit's rows, some thousand at a time
    chunks = units.withColumn("__c", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / SPREAD))))
    rows = chunks.withColumn("__i", F.explode(F.sequence(F.col("__c") * SPREAD, F.least(F.col("m"), (F.col("__c") + 1) * SPREAD) - 1)))
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("__i") < F.col("copies") % F.col("m")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", own.alias("copies"))


def op5_rows(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Null texts and texts without words have size 0 and stay by the rounded rate of their
    source; rows with a null source are a source; rows that agree in id and text keep their
    own other columns and share the copies of all, by chance where these are no multiple; an
    empty table stays empty.
    """
    n = unit_copies(docs).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "copies", "m")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("__hash"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("copy"), F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))
    out = rows.withColumn("__chance", chance).join(n, (F.col("row.doc_id").eqNullSafe(F.col("__id"))) & (F.col("__hash") == F.col("__key")))
    # a unit of one row has no rest
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("__chance") < (F.col("copies") % F.col("m")) / F.col("m")).cast("long")
    return out.withColumn("__i", F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select("row.*")
