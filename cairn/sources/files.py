"""Readers of pack files, error journals and daemon logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redact
from ..functions.records import Record
from ..operators import packs as format_
from ..operators.packs import index_rows


def packs(spark: SparkSession, path: str) -> DataFrame:
    """pack (its path) and content of pack files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("pack"), "content")


def pack_entries(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all pack files; a malformed file fails the read."""
    return index_rows(packs(spark, path), "pack")


def ranges(requests: DataFrame) -> DataFrame:
    """Adds payload and problem to requests (path, offset, length): the bytes of a range, read without the rest of the file.

    problem: 'range' (negative, empty or beyond 53 bits), 'missing' (no such file) or
    'truncated' (the file ends before the range does); payload is null then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            out = []
            for path, offset, length in zip(col("path"), col("offset"), col("length")):
                if offset is None or length is None or offset < 0 or length < 1 or offset + length >= 1 << 53:
                    out.append((None, "range"))
                    continue
                fs, name = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
                try:
                    with fs.open_input_file(name) as f:
                        raw = f.read_at(length, offset) if offset < f.size() else b""
                except FileNotFoundError:
                    out.append((None, "missing"))
                    continue
                out.append((raw, None) if len(raw) == length else (None, "truncated"))
            payload, problem = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(problem, pa.string())], [*batch.schema.names, "payload", "problem"])

    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return requests.mapInArrow(run, f"{schema}, payload binary, problem string")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content and whether it is complete."""
    return spark.read.format("binaryFile").load(path).select("path", "content", (F.octet_length("content") == F.col("length")).alias("complete"))


def pack_indexes(spark: SparkSession, path: str, most: int = 256) -> DataFrame:
    """Index rows of all pack files from two ranges of each: its trailer and its index. Files that are no packs, or of more than `most` rows, have one row with problem."""
    trailer = ranges(sizes(spark, path).select("path", F.col("length").alias("file_size"), (F.col("length") - format_.TRAILER).alias("offset"), F.lit(format_.TRAILER).cast("long").alias("length")))
    located = format_.trailers(trailer, most)
    index = ranges(located.where("problem is null").select("path", "file_size", F.col("index_offset").alias("offset"), F.col("index_length").alias("length"), "index_sha256"))
    return format_.index_entries(index).unionByName(located.where("problem is not null").select("path", "problem"), allowMissingColumns=True)


def pack_payloads(entries: DataFrame) -> DataFrame:
    """Adds payload and problem to index rows (path, kind, digest, offset, length, body_sha256): each payload is one range, checked by length and hash."""
    read = ranges(entries.where("length > 0")).unionByName(entries.where("length = 0").withColumn("payload", F.lit(b"")).withColumn("problem", F.lit(None).cast("string")))
    good = format_.verified(F.col("payload"), F.col("length"), F.col("body_sha256"), F.col("kind"), F.col("digest"))
    return read.withColumn("problem", F.coalesce("problem", F.when(~good, "hash")))


def pending(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files (directory, name) of queues' directories, and their manifests with the sizes of their data files, as recovery takes them."""
    directory, name = F.regexp_replace(F.col("path"), "/[^/]*$", ""), F.substring_index("path", "/", -1)
    local = F.regexp_replace(directory, "^file:/+", "/")
    files = sizes(spark, path).select(local.alias("directory"), name.alias("name"), "length")
    body = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    body = body.select(local.alias("directory"), name.alias("name"), F.col("length").alias("size"), F.when(F.col("length") <= 8192, F.col("content").cast("string")).alias("body"))
    data = files.where(F.col("name").endswith(".data")).select("directory", F.regexp_replace("name", r"\.data\z", ".json").alias("name"), F.col("length").alias("data_size"))
    return files, body.join(data, ["directory", "name"], "left")


def tail(spark: SparkSession, path: str, most: int) -> DataFrame:
    """path and text: the last `most` bytes of files, without a first line that is cut."""
    names = sizes(spark, path).where("length > 0")
    asked = names.select("path", F.greatest(F.lit(0).cast("long"), F.col("length") - most).alias("offset"), F.least(F.col("length"), F.lit(most).cast("long")).alias("length"))
    text = F.decode(F.col("payload"), "utf-8")
    cut = F.when(text.contains("\n"), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise("")
    return ranges(asked).where("problem is null").select("path", F.when(F.col("offset") > 0, cut).otherwise(text).alias("text"))


def journal(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Events of NDJSON journals, `most` of each file and one more that may say so: lines with a malformed needed field are skipped, other fields that are malformed are null, texts are redacted again."""
    r = Record(F.col("parsed"))
    name = lambda f: F.when(r.text(f).rlike(redact.FIELD), r.text(f))
    at = F.when(F.try_to_timestamp(r.text("timestamp")).isNotNull(), r.text("timestamp"))
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("parsed"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    events = lines.select(
        "file", "line", at.alias("timestamp"), name("area").alias("area"), name("operation").alias("operation"), F.when(r.text("kind").isin("ac", "cas"), r.text("kind")).alias("kind"),
        F.when(r.text("digestPrefix").rlike(r"^[0-9a-f]{12}\z"), r.text("digestPrefix")).alias("digestPrefix"), name("fallback").alias("fallback"), name("name").alias("name"),
        F.substring(redact.diagnostic_text(r.text("message")), 1, 500).alias("message"), r.integer("statusCode", 100, 599).alias("statusCode"), r.flag("retryable").alias("retryable"),
        r.flag("rateLimited").alias("rateLimited"), r.integer("retryAfterMs").alias("retryAfterMs"), r.flag("conflict").alias("conflict"), r.flag("aborted").alias("aborted"),
    )
    needed = [F.col(c).isNotNull() for c in ("timestamp", "area", "operation", "name", "message", "aborted")]
    for n in needed:
        events = events.where(n)
    first = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return events.withColumn("n", first).where(F.col("n") <= most + 1).drop("n", "line")


def diagnostics(journal: DataFrame, messages: DataFrame, about: DataFrame, by: str) -> DataFrame:
    """by and document: one JSON text of each job from its journal, log messages (at, message) and about (version, created, reason, phase, errors, metrics: JSON without identities)."""
    fields = [c for c in journal.columns if c not in (by, "at")]
    errors = journal.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("errors_"))
    said = messages.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "message"))), lambda x: x["message"]).alias("said"))
    rows = about.join(errors, by, "left").join(said, by, "left")
    lifecycle = F.struct("phase", F.transform("errors", lambda e: F.substring(redact.diagnostic_text(e), 1, 500)).alias("errors"))
    none = F.array()
    document = F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.col("version").alias("actionVersion"), F.col("created").alias("createdAt"), "reason", lifecycle.alias("lifecycle"),
        F.try_parse_json("metrics").alias("metrics"), F.coalesce("errors_", none).alias("errors"), F.coalesce("said", none.cast("array<string>")).alias("daemonMessages"),
    ))
    return rows.select(by, document.alias("document"))


def log_messages(spark: SparkSession, path: str, prefixes: tuple[str, ...], last: int = 100) -> DataFrame:
    """The last lines that begin with one of the prefixes, redacted; at most `last`, in their order in each file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    known = rows.where(F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("value"), p)), True))
    newest = known.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at")))).where(F.col("n") <= last)
    return newest.select("file", "at", F.substring(redact.diagnostic_text(F.col("value")), 1, 500).alias("message"))
