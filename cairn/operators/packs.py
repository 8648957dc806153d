"""The pack format: payloads, an index of fixed rows, a trailer; integers are big-endian."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.bloom import filter_of

#: Fixed values of the format.
INDEX_MAGIC, PACK_MAGIC, HEADER, ROW, TRAILER, VERSION = b"BRC2IDX1", b"BRC2PACK", 16, 96, 64, 1
_HEAD, _ROW, _TAIL = struct.Struct(">8sIH2x"), struct.Struct(">B3xI32sQQ32s8x"), struct.Struct(">8sI4xQQ32s")
KINDS = ("ac", "cas")


def encode(records: Iterable[tuple[str, bytes, bytes]]) -> bytes:
    """A pack of (kind, digest, payload) in the order given; content objects must match their digests."""
    body, rows = bytearray(), []
    for n, (kind, digest, payload) in enumerate(records):
        sha = hashlib.sha256(payload).digest()
        if kind == "cas" and sha != digest:
            raise ValueError(f"object {n} does not match its digest")
        rows.append((KINDS.index(kind), digest, n, len(body), len(payload), sha))
        body += payload
    rows.sort()
    if any(a[:2] == b[:2] for a, b in zip(rows, rows[1:])):
        raise ValueError("an identity occurs twice")
    index = _HEAD.pack(INDEX_MAGIC, len(rows), ROW) + b"".join(_ROW.pack(k, n, d, o, s, h) for k, d, n, o, s, h in rows)
    return bytes(body) + index + _TAIL.pack(PACK_MAGIC, VERSION, len(body), len(index), hashlib.sha256(index).digest())


def decode(pack: bytes) -> list[tuple[str, int, str, int, int, str]]:
    """Index rows (kind, ordinal, digest, offset, length, body_sha256) after all checks of the format."""
    if len(pack) < TRAILER + HEADER:
        raise ValueError("too short for a pack")
    magic, version, offset, size, sha = _TAIL.unpack(pack[-TRAILER:])
    if magic != PACK_MAGIC or version != VERSION or _TAIL.pack(magic, version, offset, size, sha) != pack[-TRAILER:]:
        raise ValueError("malformed trailer")
    index = pack[offset : offset + size]
    if offset + size + TRAILER != len(pack) or hashlib.sha256(index).digest() != sha:
        raise ValueError("the index does not fit the trailer")
    return decode_index(index, offset)


def trailers(read: DataFrame, most: int) -> DataFrame:
    """path, file_size, index_offset, index_length, index_sha256 and problem from the last bytes (payload) of files."""

    def number(at: int, n: int) -> Column:
        return F.conv(F.hex(F.substring("payload", at + 1, n)), 16, 10).try_cast("bigint")

    offset, length = number(16, 8), number(24, 8)
    head = F.substring("payload", 1, 16) == F.lit(struct.pack(">8sI4x", PACK_MAGIC, VERSION))
    rows = read.select("path", "file_size", offset.alias("index_offset"), length.alias("index_length"), F.lower(F.hex(F.substring("payload", 33, 32))).alias("index_sha256"), head.alias("head"), "problem")
    fits = (F.col("index_offset") + F.col("index_length") + TRAILER == F.col("file_size")) & (F.col("index_length") >= HEADER)
    problem = F.when(F.col("problem").isNotNull(), "not a pack").when(~F.coalesce(F.col("head") & fits, F.lit(False)), "trailer").when(F.col("index_length") > HEADER + ROW * most, "too many objects")
    return rows.withColumn("problem", problem).drop("head")


def index_entries(read: DataFrame) -> DataFrame:
    """Index rows, or one row with problem, of files from the bytes of their index (payload, index_sha256; offset: where it begins)."""

    def run(frames):
        for f in frames:
            out = []
            for path, raw, at, sha, bad in zip(f["path"], f["payload"], f["offset"], f["index_sha256"], f["problem"]):
                try:
                    if bad is not None or hashlib.sha256(bytes(raw)).hexdigest() != sha:
                        raise ValueError("hash of the index")
                    out += [(path, *r, None) for r in decode_index(bytes(raw), int(at))]
                except ValueError as e:
                    out.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "kind", "ordinal", "digest", "offset", "length", "body_sha256", "problem"]).astype({"ordinal": "Int64", "offset": "Int64", "length": "Int64"})

    return read.mapInPandas(run, "path string, kind string, ordinal long, digest string, offset long, length long, body_sha256 string, problem string")


def decode_index(index: bytes, end: int) -> list[tuple[str, int, str, int, int, str]]:
    """Index rows after all checks; the payloads must end at `end`."""
    if len(index) < HEADER:
        raise ValueError("malformed index")
    head, count, width = _HEAD.unpack(index[:HEADER])
    if head != INDEX_MAGIC or width != ROW or len(index) != HEADER + count * ROW or _HEAD.pack(head, count, width) != index[:HEADER]:
        raise ValueError("malformed index")
    rows = [_ROW.unpack_from(index, HEADER + i * ROW) for i in range(count)]
    if any(_ROW.pack(*r) != index[HEADER + i * ROW : HEADER + (i + 1) * ROW] or r[0] > 1 for i, r in enumerate(rows)):
        raise ValueError("malformed index row")
    if any((a[0], a[2]) >= (b[0], b[2]) for a, b in zip(rows, rows[1:])):
        raise ValueError("index rows are not in order")
    at = 0
    for n, r in enumerate(sorted(rows, key=lambda r: r[1])):
        if r[1] != n or r[3] != at:
            raise ValueError("payloads are not contiguous")
        if KINDS[r[0]] == "cas" and r[2] != r[5]:
            raise ValueError("a digest is not the hash of its body")
        at += r[4]
    if at != end:
        raise ValueError("payloads do not end at the index")
    return [(KINDS[k], n, d.hex(), o, s, h.hex()) for k, n, d, o, s, h in rows]


def seal(objects: DataFrame, pack: str) -> DataFrame:
    """pack and content: one pack file of each group of objects (ord, kind, digest, payload)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        content = encode((k, bytes.fromhex(d), bytes(p)) for k, d, p in zip(part["kind"], part["digest"], part["payload"]))
        return pd.DataFrame({pack: [part[pack].iloc[0]], "content": [content]})

    cols = objects.select(pack, "ord", "kind", "digest", "payload")
    return cols.groupBy(pack).applyInPandas(one, f"{pack} {dict(cols.dtypes)[pack]}, content binary")


def index_rows(packs: DataFrame, pack: str) -> DataFrame:
    """The index of every pack file (pack, content)."""

    def read(frames):
        for f in frames:
            rows = [(p, *r) for p, c in zip(f[pack], f["content"]) for r in decode(bytes(c))]
            yield pd.DataFrame(rows, columns=[pack, "kind", "ordinal", "digest", "offset", "length", "body_sha256"])

    return packs.select(pack, "content").mapInPandas(read, f"{pack} {dict(packs.dtypes)[pack]}, kind string, ordinal long, digest string, offset long, length long, body_sha256 string")


def payloads(packs: DataFrame, pack: str) -> DataFrame:
    """pack, kind, digest, payload and good of every object of pack files (pack, content), cut out as the index is read: content goes no further."""

    def read(frames):
        for f in frames:
            for p, c in zip(f[pack], f["content"]):
                raw = bytes(c)
                rows = [(p, kind, digest, raw[at : at + n], hashlib.sha256(raw[at : at + n]).hexdigest() == sha and (kind != "cas" or sha == digest)) for kind, _, digest, at, n, sha in decode(raw)]
                yield pd.DataFrame(rows, columns=[pack, "kind", "digest", "payload", "good"])

    return packs.select(pack, "content").mapInPandas(read, f"{pack} {dict(packs.dtypes)[pack]}, kind string, digest string, payload binary, good boolean")


def write(objects: DataFrame, pack: str, folder: str, namespace_hash: str, run: str, job: str) -> DataFrame:
    """Writes the groups of objects (ord, kind, digest, payload) as pack files into a shared folder: pack, path, bytes, objects and key.

    A file gets its name (sequence and identity) by a rename when it is complete, so a task
    that is run again leaves the same files. pack is the sequence.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        records = [(k, bytes.fromhex(d), bytes(p)) for k, d, p in zip(part["kind"], part["digest"], part["payload"])]
        content = encode(records)
        ident = hashlib.sha256(content).hexdigest()[:16]
        path = os.path.join(folder, f"{int(part[pack].iloc[0]):06d}-{ident}.pack")
        os.makedirs(folder, exist_ok=True)
        handle, unfinished = tempfile.mkstemp(dir=folder, suffix=".tmp")
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(unfinished, path)
        return pd.DataFrame({pack: [part[pack].iloc[0]], "path": [path], "bytes": [len(content)], "objects": [len(records)], "ident": [ident], "filter": [filter_of((k, d) for k, d, _ in records)]})

    cols = objects.select(pack, "ord", "kind", "digest", "payload")
    rows = cols.groupBy(pack).applyInPandas(one, f"{pack} {dict(cols.dtypes)[pack]}, path string, bytes long, objects long, ident string, filter binary")
    key = keys.pack_key(F.lit(namespace_hash), F.lit(run), F.lit(job), F.col(pack).cast("string"), F.col("filter"), F.col("ident"))
    return rows.withColumn("key", key).drop("filter", "ident")


def payload_range(content: Column, offset: Column, length: Column) -> Column:
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def verified(payload: Column, length: Column, body_sha256: Column, kind: Column, digest: Column) -> Column:
    """Whether a payload has its length and hash, and a content object its digest."""
    sha = F.sha2(payload, 256)
    return (F.octet_length(payload) == length) & (sha == body_sha256) & ((kind != "cas") | (sha == digest))


def contiguous(entries: DataFrame, by: str) -> DataFrame:
    """by and whether its entries (ordinal, offset, length) are numbered from 0 and lie back to back."""
    order = Window.partitionBy(by).orderBy("ordinal")
    place = (F.row_number().over(order) - 1) == F.col("ordinal")
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == F.col("offset")
    return entries.withColumn("__ok", place & start).groupBy(by).agg(F.bool_and("__ok").alias("contiguous"))


def entry_problems(entries: DataFrame, by: str) -> DataFrame:
    """Adds problem to index rows (by, kind, ordinal, digest, offset, length, body_sha256), null where all is well.

    Ordinals go from 0 without a gap, payloads lie back to back in their order, a content
    object's digest is the hash of its body, and no identity occurs twice.
    """
    order = Window.partitionBy(by).orderBy("ordinal", "kind", "digest")
    place = F.row_number().over(order) - 1
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = F.count(F.lit(1)).over(Window.partitionBy(by, "kind", "digest")) > 1
    rows = entries.withColumns({"__place": place, "__start": start, "__again": again})
    problem = F.when(~F.col("kind").isin(*KINDS), "kind").when(F.col("ordinal") != F.col("__place"), "ordinal").when(F.col("offset") != F.col("__start"), "offset")
    problem = problem.when((F.col("kind") == "cas") & (F.col("digest") != F.col("body_sha256")), "digest").when(F.col("__again"), "identity")
    return rows.withColumn("problem", problem).drop("__place", "__start", "__again")


def checked_sources(objects: DataFrame) -> DataFrame:
    """Adds problem to objects (payload, size, body_sha256): what changed since they were accepted, 'short', 'long' or 'changed'."""
    n = F.octet_length("payload")
    problem = F.when(n < F.col("size"), "short").when(n > F.col("size"), "long").when(F.sha2("payload", 256) != F.col("body_sha256"), "changed")
    return objects.withColumn("problem", problem)
