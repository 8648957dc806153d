"""Document fingerprints by SpotSigs.

A spot signature is a common word (anchor) with the two content words that follow it,
anchors between them skipped. Anchors are the words of up to 5 bytes that occur in most
documents; their document frequencies are taken over all documents. The set of hashed
signatures, written in ascending order, is the fingerprint; likeness is the Jaccard
similarity of two sets, and sets are compared only where their sizes allow the threshold.

Anchors are met without their punctuation. Where no anchor is within REACH words, every word
starts a signature with the words after it, so texts of any language have signatures all
along; words of over LONG_WORD bytes beyond ASCII (scripts without blanks) count by character.

Edge cases: a text without signatures has one for its whole word sequence; null and blank
texts have none, the fingerprint is empty, and two empty sets have likeness 1; rows with
equal ids are ordered by their text's hash, descending as well; a null id comes last in descending order; one
document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import partitions, text_slices

ANCHORS, ANCHOR_BYTES, CHAIN = 64, 5, 2
#: Words around an anchor that need no signature of their own; bytes beyond which a word is taken by character.
REACH, LONG_WORD = 8, 48
_MARKS = string.punctuation.encode()
_LEAST = -(1 << 63)


def words_of(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    if any(len(w) > LONG_WORD and not w.isascii() for w in words):
        words = [x for w in words for x in ([c.encode() for c in w.decode()] if len(w) > LONG_WORD and not w.isascii() else [w])]
    return words


def common_words(docs: DataFrame, n: int = ANCHORS, longest: int = ANCHOR_BYTES) -> frozenset[bytes]:
    """The n words of at most `longest` bytes that most documents have; ties by the word."""

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for (texts,) in text_slices(batch, ("text",)):
                for t in texts:
                    if t:
                        seen.update({w for w in {x.strip(_MARKS) for x in words_of(t)} if 0 < len(w) <= longest})
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect())


def signatures(text: str, anchors: frozenset[bytes], length: int = CHAIN) -> np.ndarray:
    """The ascending distinct hashes of a text's spot signatures."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint32)
    bare = [w.strip(_MARKS) for w in words]
    spot = np.fromiter(map(anchors.__contains__, bare), bool, len(words))
    content = list(compress(words, (~spot).tolist()))
    at = np.flatnonzero(spot)
    begin = at - np.arange(len(at))
    fit = begin + length <= len(content)
    digest = xxhash.xxh32_intdigest
    found = [digest(b" ".join((bare[a], *content[c : c + length]))) for a, c in zip(at[fit].tolist(), begin[fit].tolist())]
    # words far from any anchor
    near = np.concatenate([[0], np.cumsum(spot)])
    i = np.arange(len(words))
    far = np.flatnonzero(near[np.minimum(i + REACH + 1, len(words))] == near[np.maximum(i - REACH, 0)])
    found += [digest(b"\1" + b" ".join(words[k : k + length + 1])) for k in far[far + length < len(words)].tolist()]
    return np.unique(np.array(found or [digest(b"\0" + b" ".join(words))], np.uint32))


def written(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a comparison where the sizes alone keep it below `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of ids whose signature sets (id, sigs array<long>, without equal sets) reach the threshold.

    Sets are dealt by the signatures of their prefix and by the band of their size; only
    neighbouring bands can reach the threshold. Rare signatures come first in a prefix.
    """
    sets = sets.where(F.size("sigs") > 0)
    df = sets.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = sets.select("id", F.explode("sigs").alias("s"), F.size("sigs").alias("len")).join(df, "s")
    ordered = rows.groupBy("id", "len").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("o"))
    prefix = (F.col("len") - F.ceil(F.col("len") * threshold) + 1).cast("int")
    band = F.floor(F.log("len") / -F.log(F.lit(threshold))).cast("int")
    keyed = ordered.select("id", "len", F.col("o.s").alias("sigs"), band.alias("band"), F.explode(F.slice("o", F.lit(1), prefix)).alias("p")).withColumn("s", F.col("p.s")).where("p.n > 1").drop("p")
    left = keyed.withColumn("key", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    other = keyed.select(F.col("id").alias("b"), F.col("len").alias("len_b"), F.col("sigs").alias("sigs_b"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("key"), "s")
    pairs = left.join(other, ["s", "key"]).where((F.col("id") < F.col("b")) & (F.least("len", "len_b") >= threshold * F.greatest("len", "len_b")))
    both = F.size(F.array_intersect("sigs", "sigs_b"))
    pairs = pairs.withColumn("likeness", both / (F.col("len") + F.col("len_b") - both)).where(F.col("likeness") >= threshold)
    return pairs.select(F.col("id").alias("a"), "b", "likeness").distinct()


class Ranges:
    """Ranges of rows (key, tie) in their order, of about as many rows each.

    Bounds are quantiles of the key, so keys that occur. A key that is several of them has as
    many ranges, by its tie: one key may have any share of the rows.
    """

    def __init__(self, rows: DataFrame):
        n = 4 * partitions(rows.sparkSession)
        at = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n).alias("at"), F.max("key").alias("top")).first()
        cuts = [*(at["at"] or []), *([] if at["top"] is None else [at["top"]])]
        self.bounds, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.base = np.cumsum(self.times) - self.times
        self.last: dict[int, tuple[int, int]] | None = None
        if (self.times > 1).any():
            # ranges by tie may be empty, and their last rows are not known from the bounds
            top = rows.select("key", "tie").mapInArrow(self._tops, "range long, key long, tie long").groupBy("range").agg(F.max(F.struct("key", "tie")).alias("m"))
            self.last = {r["range"]: (r["m"]["key"], r["m"]["tie"]) for r in top.collect()}
        self.used = np.array(sorted(self.last) if self.last else self.base, np.int64)

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.bounds, key)
        share = (tie.astype(np.float64) / 2.0**64 + 0.5) * self.times[k]
        part = np.minimum(share.astype(np.int64), self.times[k] - 1)
        return self.base[k] + np.where(key == self.bounds[k], part, 0)

    def _tops(self, batches):
        for batch in batches:
            key, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            to = self.of(key, tie)
            order = np.lexsort((tie, key, to))
            end = order[np.append(to[order][1:] != to[order][:-1], True)[: len(order)]]
            yield pa.RecordBatch.from_arrays([pa.array(x[end]) for x in (to, key, tie)], ["range", "key", "tie"])

    def last_rows(self, key: np.ndarray, tie: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Places of the rows that may be the last of their range, one of equal rows."""
        if self.last is None:
            return np.flatnonzero(self.bounds[np.searchsorted(self.base, to, side="right") - 1] == key)
        found = {}
        for r in np.unique(to).tolist():
            at = np.flatnonzero((to == r) & (key == self.last[r][0]) & (tie == self.last[r][1]))
            if len(at):
                found[r] = int(at[0])
        return np.array(list(found.values()), np.int64)

    def after(self, to: np.ndarray) -> np.ndarray:
        """The next range that has rows; after the last comes the first."""
        return self.used[(np.searchsorted(self.used, to) + 1) % max(1, len(self.used))]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its text with the second half from the next document, and their likenesses."""
    spark = docs.sparkSession
    anchors = spark.sparkContext.broadcast(common_words(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    ranges = Ranges(rows)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            start = 0
            for (texts,) in text_slices(batch, ("text",)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                key, tie = part.column(1).to_numpy(), part.column(2).to_numpy()
                to = ranges.of(key, tie)
                data = pa.array([pack((t or "").encode()) for t in texts], pa.binary())
                # the last row of a range precedes the next range's, the last of all the first; of equal rows one does
                last = ranges.last_rows(key, tie, to)
                at = pa.array(np.append(np.arange(len(texts)), last))
                target = np.append(to, ranges.after(to[last])).astype(np.int32)
                own = np.append(np.ones(len(texts), bool), np.zeros(len(last), bool))
                yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(own), *(part.column(c).take(at) for c in range(3)), data.take(at)], ["range", "own", "doc_id", "key", "tie", "data"])

    def compare(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known = anchors.value
        before = None
        for batch in batches:
            out = []
            for own, i, data in zip(*[batch.column(k).to_pylist() for k in (1, 2, 5)]):
                text = unpack(data).decode()
                sigs = signatures(text, known)
                if own:
                    half = len(text) // 2
                    edited = text[: len(text) - half] + before[0][:half]
                    changed = signatures(edited, known)
                    out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(sigs), written(changed), likeness(sigs, changed), likeness(sigs, before[1])))
                before = text, sigs
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = rows.mapInArrow(deal, "range int, own boolean, doc_id long, key long, tie long, data binary")
    ordered = dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "own", "key", "tie")
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
