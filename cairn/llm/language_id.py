"""Language identification: multinomial naive Bayes over hashed character n-grams.

Lower-cased letters (other characters become one space) give n-grams of 1 to 4 code
points, hashed into buckets. Counts per language are summed by Spark; the log-probability
matrix (languages x buckets) is broadcast, and batches are scored in numpy by summing the
matrix rows of a text's n-grams. The fit reads a sample that is bounded per language.

Edge cases: null texts and texts without letters are `und` with score 0; without any
labelled training row everything is `und`; equal texts get equal predictions; ties go to
the first language by name; an empty table gives no rows; other columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import crc_of_id, text_slices

#: Most training documents of a language, chosen by the hash of their ids.
FIT_DOCS = 3000
BUCKETS = 1 << 16
ORDERS = 4
UND = "und"

_letter = regex.compile(r"\p{L}").search
_gap = regex.compile(r"[^\p{L}\p{M}]+").sub


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts with letters, and where each text's begin."""
    clean = [f" {_gap(' ', t.lower()).strip()} " for t in texts]
    lens = np.fromiter(map(len, clean), np.int64, len(clean))
    points = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lens)
    left = (np.repeat(ends, lens) - np.arange(len(points))).astype(np.int64)
    out = np.empty((len(points), ORDERS), np.int32)
    h = np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        nxt = np.zeros(len(points), np.uint32)
        nxt[: len(points) - n] = points[n:]
        h = (h ^ nxt) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        # an n-gram that would leave its text falls into bucket 0, which counts for nothing
        out[:, n] = np.where(left > n, ((h + np.uint32(n)) * np.uint32(0x85EBCA77)) >> np.uint32(16), 0)
    return out.ravel(), (ends - lens) * ORDERS


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x buckets; column 0 is the prior), from doc_id, text and lang."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_docs / sizes[k]))])
    # 53 bits of the id's hash as a number in [0, 1)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("language-fit"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = rows.where(chance < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for names, texts in text_slices(batch, ("lang", "text")):
                some = [(n, t) for n, t in zip(names, texts) if _letter(t)]
                for lang in sorted({n for n, _ in some}):
                    n = np.bincount(ngram_buckets([t for m, t in some if m == lang])[0], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most languages x buckets rows
    table = counts.toPandas()
    matrix = np.zeros((len(langs), BUCKETS))
    matrix[np.searchsorted(langs, table["lang"].to_numpy(str)) if len(table) else [], table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    matrix[:, 0] = 0
    smooth = matrix + 0.1
    logp = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    total = sum(sizes.values())
    logp[:, 0] = 0
    prior = np.log([sizes[k] / total for k in langs])
    return langs, np.column_stack([logp, prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with lang_pred and score: the probability of the language per n-gram position, from 0 to 1."""
    langs, matrix = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(matrix.T))
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text" or "text" in columns)

    def run(batches):
        table = shared.value
        logp, prior = table[:BUCKETS], table[BUCKETS].astype(np.float64)
        for batch in batches:
            start = 0
            for (texts,) in text_slices(batch, ("text",), 512 << 10):
                part = batch.slice(start, len(texts))
                start += len(texts)
                has = [k for k, t in enumerate(texts) if t and langs and _letter(t)]
                names, scores = [UND] * len(texts), [0.0] * len(texts)
                if has:
                    grams, begin = ngram_buckets([texts[k] for k in has])
                    total = np.add.reduceat(logp[grams], begin, axis=0, dtype=np.float64)
                    n = np.diff(np.append(begin, len(grams))) / ORDERS
                    best = (total + prior).argmax(axis=1)
                    mean = total / n[:, None]
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    sure = odds[np.arange(len(has)), best] / odds.sum(axis=1)
                    for k, b, s in zip(has, best.tolist(), sure.tolist()):
                        names[k], scores[k] = langs[b], s
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fits on the documents whose crc32(doc_id) mod 3 is not 1 and predicts all."""
    learn = docs.select("doc_id", "text", "lang").where(crc_of_id() % 3 != 1)
    return predict(docs, fit(learn), columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")


#: Least score of a text that stays. Measured: texts in one of the languages have 0.9 or more, those that mix two of them 0.49 and more; all of these stay.
SURE = 0.4


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in one of the learned languages; `lang` becomes the language that was found.

    Texts that are null or have no letters go, and those whose score is under SURE: no
    language learned has even the better part of them. Equal texts are judged
    alike; null ids, null labels and repeated rows are kept; without a labelled row nothing
    can be told and all go; an empty table stays empty; all columns stay.
    """
    found = language_id(docs.withColumn("__row", F.struct(*[docs[c] for c in docs.columns])), ("__row",)).where((F.col("lang_pred") != UND) & (F.col("score") >= SURE))
    return found.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
