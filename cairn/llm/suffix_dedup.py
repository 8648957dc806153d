"""Removal of repeated 50-byte strings by merging Burrows-Wheeler transforms.

1. Windows. Every 50-byte window of a text belongs to the smallest hash of the 24-byte
   strings in it, so equal windows of any two documents have the same key. Neighbouring
   windows with one key form a run. Runs (not texts) are dealt by key; equal runs
   collapse into one string owned by its smallest document, and all other documents have
   it repeated in whole. Keys that a single document has are done.
2. Merge. The distinct strings that share a key lie in shards. Each shard is sorted once
   for its Burrows-Wheeler transform. The interleave of all shards is then refined: from
   the order of suffixes by h bytes the order by h + q bytes follows by a stable
   distribution of the interleave by the q bytes in front, taken from the transforms. A
   boundary between neighbours appears in the round in which their common prefix ends, so
   after 50 bytes the stretches without a boundary are the repeated intervals.
3. Marks. In every interval the windows of documents above the smallest one are marked;
   marks and texts meet by block of rows, and the bytes that marked windows cover are removed.

A row is told by its doc_id and, where rows with different texts share an id or it is null,
by the hash of its text. A key that very many different strings share is dealt anew by its
whole windows. Rows are sorted by bucket before they reach Python, which holds one bucket
at a time; the number of buckets grows with the bytes of the texts.

Edge cases: null and empty texts have 0 bytes; texts under 50 bytes lose nothing; rows
with the same doc_id, or with none, take nothing from each other and each keeps its own
marks; a null doc_id counts as larger than all others; an empty table gives no rows; other
columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import SLICE_BYTES, materialize, partitions, text_slices, whole_groups

WINDOW = 50
#: Bytes of the strings whose smallest hash keys a window (shorter ones meet by chance in a large corpus), and how many of them a window has.
GRAM = 24
GRAMS = WINDOW - GRAM + 1
#: Bytes by which a round of the merge goes on.
STEP = 5
#: Most windows of a run; different strings of a key from which on it is dealt by windows; bytes of a shard, and of the shards merged at a time.
RUN, HOT, SHARD, MERGE = 256, 2000, 16 << 10, 128 << 10
#: Ids with several texts that are broadcast at most (beyond it all rows are told by their texts); bytes of text of a bucket.
SHARED, BUCKET = 1 << 20, 16 << 20
#: Windows of a text that are looked at together.
PIECE = 256 << 10
#: Marks or wants that are held at most before they become blobs; bytes of strings whose windows are compared at a time.
HELD, SIEVE = 1 << 20, 1 << 20
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Runs:
    """Finds the runs of windows with one key in texts."""

    def __init__(self):
        self.up, self.down = _powers(1 << 19)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Position in texts, first window, number of windows, key and content hash of every run."""
        out = []
        # a long text goes in pieces that overlap by all but one byte of a window
        pieces = [(k, at) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - WINDOW + 1), PIECE)]
        lo = size = 0
        for hi, (k, at) in enumerate(pieces, 1):
            size += min(PIECE + WINDOW - 1, len(texts[k]) - at)
            if size >= PIECE or hi == len(pieces):
                part = pieces[lo:hi]
                which, first, *rest = self._chunk([texts[k][at : at + PIECE + WINDOW - 1] for k, at in part])
                of, shift = np.array(part, np.int64).reshape(-1, 2).T
                out.append((of[which], first + shift[which], *rest))
                lo, size = hi, 0
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        return tuple(np.concatenate([np.zeros(0, k), *(o[i] for o in out)]).astype(k) for i, k in enumerate(kinds))

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        empty = tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(buf) < WINDOW:
            return empty
        h = buf.astype(np.uint64) + _U(1)
        total = np.zeros(len(buf) + 1, np.uint64)
        if len(self.up) < len(buf) + 1:
            self.up, self.down = _powers(len(buf) + 1)
        np.cumsum(h * self.up[: len(buf)], out=total[1:])
        n = 1
        while n * 2 <= GRAM:
            h = h[:-n] * _U(pow(_BASE, n, 1 << 64)) + h[n:]
            n *= 2
        if n < GRAM:
            h = h[: len(h) - (GRAM - n)] * _U(pow(_BASE, GRAM, 1 << 64)) + h[GRAM - n :]
        least = _mixed(h)
        n = 1
        while n * 2 <= GRAMS:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < GRAMS:
            least = np.minimum(least[: len(least) - (GRAMS - n)], least[GRAMS - n :])
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        long = lens >= WINDOW
        # windows of one document: from first to past
        first, past, which = (ends - lens)[long], (ends - WINDOW + 1)[long], np.flatnonzero(long)
        if not len(first):
            return empty
        change = np.append(True, least[1:] != least[:-1])
        change[first] = True
        start = np.flatnonzero(change)
        at = np.searchsorted(first, start, side="right") - 1
        good = (at >= 0) & (start < past[at])
        start, at = start[good], at[good]
        stop = np.minimum(np.append(start[1:], len(least)), past[at])
        count = stop - start
        if (count > RUN).any():
            parts = -(-count // RUN)
            offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            stop, at = np.repeat(stop, parts), np.repeat(at, parts)
            start = np.repeat(start, parts) + offset * RUN
            count = np.minimum(stop - start, RUN)
        content = (total[start + count + WINDOW - 1] - total[start]) * self.down[start]
        return which[at], start - first[at], count, least[start], _mixed(content ^ (count.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of the same length as one compressed blob."""
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_ENTRY = ("<i8", "<i8", "<u8", "<u8", "<u4", "<u2")  # doc, tag, key, content, first window, windows
_SPAN = ("<i8", "<i8", "<u4", "<u4")  # doc, tag, first window, windows
_WANT = ("<i8", "<i8", "<u4", "<u4", "<u8")  # and the key; 0: deal by windows


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first is major) and, in that order, where the first key starts anew."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.append(True, k[1:] != k[:-1])[: len(k)]


def _block_of(doc: np.ndarray, tag: np.ndarray, blocks: int) -> np.ndarray:
    """Block of every row, as Spark's pmod(xxhash64(doc, tag), blocks)."""
    one, two, three, four, five = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << _U(r)) | (x >> _U(64 - r))
    h = np.full(len(doc), 42, np.uint64)
    for x in (doc, tag):
        h = h + five + _U(8)
        h ^= turn(x.astype(np.int64).view(np.uint64) * two, 31) * one
        h = turn(h, 27) * one + four
        h = (h ^ (h >> _U(33))) * two
        h = (h ^ (h >> _U(29))) * three
        h ^= h >> _U(32)
    return h.view(np.int64) % blocks


def _by_block(blocks: int, kinds: tuple[str, ...], doc: np.ndarray, tag: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Blocks of rows that occur and for each the blob of its rows' doc, tag and arrays."""
    block = _block_of(doc, tag, blocks)
    order = np.lexsort((arrays[0], tag, doc, block))
    b = block[order]
    cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)]), len(b)).tolist()
    cols = [a[order].astype(k) for a, k in zip((doc, tag, *arrays), kinds)]
    return b[cuts[:-1]].tolist(), [_pack(*(c[lo:hi] for c in cols)) for lo, hi in zip(cuts, cuts[1:])]


class Gathered:
    """Holds rows of `kinds` until there are HELD, so that the number of blobs does not follow the slices and groups they come from."""

    def __init__(self, blocks: int, kinds: tuple[str, ...]):
        self.blocks, self.kinds, self.parts, self.size = blocks, kinds, [], 0

    def add(self, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Takes rows; the blocks and blobs that are due."""
        if len(arrays[0]):
            self.parts.append([a.astype(k) for a, k in zip(arrays, self.kinds)])
            self.size += len(arrays[0])
        return self.rest() if self.size >= HELD else ([], [])

    def rest(self) -> tuple[list[int], list[bytes]]:
        parts, self.parts, self.size = self.parts, [], 0
        return _by_block(self.blocks, self.kinds, *map(np.concatenate, zip(*parts))) if parts else ([], [])


def _joined(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, tag, first and number of the runs of neighbouring windows."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1))[: len(at)]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(at)) - 1
    return doc[start], tag[start], at[start], at[last[: len(start)]] - at[start] + 1


def _met(batches, name: str, kinds: tuple[str, ...]):
    """From rows in the order of block, a block's blobs before its rows: each batch with the places of its rows, and their arrays of the blobs (or None)."""
    block, blobs, index = None, [], None
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        blocks, docs, tags, data = (column(c).to_pylist() for c in ("block", "doc", "tag", name))
        rows = []
        for at, blob in enumerate(data):
            if blocks[at] != block:
                block, blobs, index = blocks[at], [], None
            if blob is not None:
                blobs.append(blob)
                continue
            if index is None:
                index, parts = {}, [_unpack(b, *kinds) for b in blobs]
                doc, tag, *arrays = (np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]).astype(k) for i, k in enumerate(kinds))
                order = np.lexsort((tag, doc))
                doc, tag = doc[order], tag[order]
                arrays = [a[order] for a in arrays]
                cuts = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(doc)]), len(doc)).tolist()
                for lo, hi in zip(cuts, cuts[1:]):
                    index[int(doc[lo]), int(tag[lo])] = [a[lo:hi] for a in arrays]
                blobs = []
            rows.append((at, index.get((docs[at], tags[at]))))
        yield batch, rows


def _meeting(blobs: DataFrame, texts: DataFrame, name: str, n: int) -> DataFrame:
    """Rows (block, doc, tag, ...) and blobs (block, `name`) by block, a block's blobs first, for _met."""
    both = texts.unionByName(blobs, allowMissingColumns=True)
    return _dealt(both, n, "block").sortWithinPartitions("block", F.col(name).isNull(), "doc", "tag")


def _dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df in n partitions, the numbers of a column in turn: a hash would leave some partitions empty and give others several."""
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int"))


def _even(size: int, each: int, n: int) -> int:
    """Pieces of about `each` bytes, as many in each of n partitions."""
    return n * max(1, round(size / each / n))


class Rows:
    """The documents with doc (null as LAST) and tag, which tell a row's id and text apart; and the number of buckets."""

    def __init__(self, docs: DataFrame):
        text = F.xxhash64("text")
        ids = docs.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.sum(F.octet_length("text")).alias("bytes"))
        ids = materialize(ids, "ids")
        several = ids.where("a != b and doc_id is not null").select("doc_id").limit(SHARED + 1).toArrow()["doc_id"].to_pylist()
        size = ids.agg(F.sum("bytes").alias("n")).first()["n"] or 0
        # every slice and group of runs has a blob for each of these, so there are no more than memory asks for
        n = partitions(docs.sparkSession)
        self.buckets, self.blocks = _even(size, BUCKET // 2, n), _even(size, BUCKET, n)
        rows = docs
        told = F.col("doc_id").isNull()
        if len(several) > SHARED:
            told = F.lit(True)
        elif several:
            shared = docs.sparkSession.createDataFrame([(i,) for i in several], "__shared long")
            rows = docs.join(F.broadcast(shared), F.col("doc_id") == F.col("__shared"), "left")
            told = told | F.col("__shared").isNotNull()
        self.docs = rows.withColumn("__doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("__tag", F.when(told, text).otherwise(F.lit(0).cast("bigint"))).drop("__shared").withColumn("__block", F.pmod(F.xxhash64("__doc", "__tag"), F.lit(self.blocks).cast("bigint")))


def _dealt_runs(buckets: int, blocks: int):
    """Map side: runs of a slice, collapsed, as blobs by bucket; what repeats within the slice as marks by block (bucket -1 - block)."""

    def run(batches):
        runs, spans = Runs(), Gathered(blocks, _SPAN)
        rows = lambda to, data: pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])
        for batch in batches:
            for docs, tags, texts in text_slices(batch, ("__doc", "__tag", "text")):
                k, first, count, key, content = runs.of([(t or "").encode() for t in texts])
                if not len(k):
                    continue
                doc, tag = np.array(docs, np.int64)[k], np.array(tags, np.int64)[k]
                # equal runs stand together, the smallest document first
                order = np.lexsort((doc, content, key))
                doc, tag, first, count, key, content = (a[order] for a in (doc, tag, first, count, key, content))
                same = np.append(False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]))
                group = np.flatnonzero(~same)
                owner = np.repeat(doc[group], np.diff(np.append(group, len(doc))))
                repeated = same & (doc != owner)
                blobs, to = [], []
                bucket = (key % _U(buckets)).astype(np.int64)
                sent = ~repeated
                order, new = _sorted_groups(bucket[sent])
                cuts = np.append(np.flatnonzero(new), len(order)).tolist()
                parts = [a[sent][order] for a in (doc, tag, key, content, first, count)]
                at = bucket[sent][order]
                for a, b in zip(cuts, cuts[1:]):
                    to.append(int(at[a]))
                    blobs.append(_pack(*(p[a:b].astype(t) for p, t in zip(parts, _ENTRY))))
                found, data = spans.add(doc[repeated], tag[repeated], first[repeated], count[repeated])
                yield rows(to + [-1 - b for b in found], blobs + data)
        found, data = spans.rest()
        yield rows([-1 - b for b in found], data)

    return run


def _judged_runs(blocks: int):
    """Reduce side, a bucket at a time: marks of repeated runs (marks) and the strings that a merge needs (wants), by block."""

    def run(batches):
        held = Gathered(blocks, _SPAN), Gathered(blocks, _WANT)

        def rows(kind, found, blobs):
            none, data = pa.nulls(len(found), pa.binary()), pa.array(blobs, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), none if kind else data, data if kind else none], ["block", "marks", "wants"])

        for table in whole_groups(batches, "bucket"):
            passed = table.filter(pa.compute.less(table["bucket"], 0))
            for b in passed.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(-1 - b["bucket"].to_numpy()), b["data"], pa.nulls(b.num_rows, pa.binary())], ["block", "marks", "wants"])
            entries = [_unpack(x.as_py(), *_ENTRY) for x in table.filter(pa.compute.greater_equal(table["bucket"], 0))["data"]]
            if entries:
                for kind, arrays in enumerate(_judged(*(np.concatenate([e[i] for e in entries]) for i in range(len(_ENTRY))))):
                    yield rows(kind, *held[kind].add(*arrays))
        for kind in (0, 1):
            yield rows(kind, *held[kind].rest())

    return run


def _judged(doc: np.ndarray, tag: np.ndarray, key: np.ndarray, content: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Arrays of the marks and of the wants of whole keys."""
    order = np.lexsort((doc, content, key))
    doc, tag, key, content, first, count = (a[order] for a in (doc, tag, key, content, first, count))
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(start, len(key)))
    several = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), sizes)
    same = np.append(False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]))
    variants = np.repeat(np.add.reduceat(~same, start, dtype=np.int64), sizes)
    lead = np.flatnonzero(~same)
    owner = np.repeat(doc[lead], np.diff(np.append(lead, len(doc))))
    marked = several & (doc != owner)
    # the owner may have the same run at several places
    wanted = several & (doc == owner) & (variants > 1)
    name = np.where(variants > HOT, _U(0), np.maximum(key, _U(1)))
    yield [a[marked] for a in (doc, tag, first, count)]
    yield [a[wanted] for a in (doc, tag, first, count, name)]


def _dealt_strings(buckets: int):
    """Cuts the wanted strings out of the texts and deals them by key; a row's strings are of some documents."""
    names = ["bucket", "key", "doc", "tag", "first", "string"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, list] = {}
        size, before = 0, None

        def flush():
            rows = list(held.items())
            column = lambda k, t: pa.array([[x[k] for x in r] for _, r in rows], pa.list_(t))
            signed = pa.array([[x[0] - (1 << 64) if x[0] >> 63 else x[0] for x in r] for _, r in rows], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), signed, column(1, pa.int64()), column(2, pa.int64()), column(3, pa.int64()), column(4, pa.binary())], names)

        for batch, rows in _met(batches, "wants", _WANT):
            docs, tags, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "tag", "data"))
            for at, wants in rows:
                d, t = docs[at].as_py(), tags[at].as_py()
                # repeated rows stand together and have the same strings
                if wants is None or (d, t) == before:
                    continue
                before = d, t
                text = unpack(texts[at].as_py())
                for s, n, key in zip(*[a.tolist() for a in wants]):
                    if key:
                        held.setdefault(xxhash.xxh64_intdigest(key.to_bytes(8, "little")) % buckets, []).append((key, d, t, s, text[s : s + n + WINDOW - 1]))
                        size += n + 2 * WINDOW
                    else:
                        for w in range(s, s + n):
                            piece = text[w : w + WINDOW]
                            key_of = xxhash.xxh64_intdigest(piece)
                            held.setdefault(key_of % buckets, []).append((key_of, d, t, w, piece))
                        size += n * 2 * WINDOW
                    if size >= SLICE_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return run


class Shard:
    """Strings in the order of their suffixes (by WINDOW bytes), with what stands in front of each."""

    def __init__(self, strings: list[bytes], number: int):
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        # 0xFF is in no UTF-8 text; so many of them that no suffix reads beyond
        pad = WINDOW + 8
        buf = np.frombuffer(b"\xff" * STEP + b"".join(s + b"\xff" * pad for s in strings), np.uint8)
        begin = STEP + np.cumsum(lens + pad) - (lens + pad)
        total = int((lens + 1).sum())
        string = np.repeat(np.arange(len(strings)), lens + 1)
        offset = np.arange(total) - np.repeat(np.cumsum(lens + 1) - (lens + 1), lens + 1)
        place = begin[string] + offset
        eight = np.zeros(len(buf) - 7, np.uint64)
        for j in range(8):
            eight |= buf[j : len(buf) - 7 + j].astype(np.uint64) << _U(56 - 8 * j)
        cols = [eight[place + j] for j in range(0, WINDOW - 7, 8)]
        if WINDOW % 8:
            cols.append(eight[place + WINDOW - WINDOW % 8] >> _U(64 - 8 * (WINDOW % 8)))
        order = np.lexsort((string, *cols[::-1]))
        self.string, self.offset = string[order], offset[order]
        place = place[order]
        # the bytes in front of each suffix; -1 where its string has not so many
        self.front = np.where(self.offset >= STEP, (eight[place - STEP] >> _U(64 - 8 * STEP)).astype(np.int64), -1)
        # suffixes of under STEP bytes are told apart from the start, in the order of the strings
        short = np.flatnonzero(offset > np.repeat(lens, lens + 1) - STEP)
        self.short = (eight[begin[string[short]] + offset[short]] >> _U(64 - 8 * STEP)).astype(np.int64)
        self.number = number


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes and, at each, whether it differs from the one before within WINDOW bytes."""
    n = sum(len(s.string) for s in shards)
    front = np.concatenate([s.front for s in shards])
    short = np.concatenate([s.short for s in shards])
    _, codes = np.unique(np.concatenate([front, short]), return_inverse=True)
    if codes.max(initial=0) < 1 << 16:
        codes = codes.astype(np.uint16)
    ahead, fixed = codes[: len(front)], codes[len(front) :]
    kind = np.uint8 if len(shards) < 256 else np.uint16
    of_short = np.concatenate([np.full(len(s.short), k, kind) for k, s in enumerate(shards)])
    order = np.concatenate([np.full(len(s.string), k, kind) for k, s in enumerate(shards)])
    block = np.zeros(n, np.int64)
    for _ in range(WINDOW // STEP):
        # the j-th place of a shard in the interleave holds the shard's j-th suffix
        at = np.argsort(order, kind="stable")
        code, real = np.empty(n, codes.dtype), np.empty(n, bool)
        code[at], real[at] = ahead, front >= 0
        code = np.concatenate([fixed, code[real]])
        who = np.concatenate([of_short, order[real]])
        came = np.concatenate([-1 - np.arange(len(fixed)), block[real]])
        to = np.argsort(code, kind="stable")
        order, code, came = who[to], code[to], came[to]
        new = np.append(True, (code[1:] != code[:-1]) | (came[1:] != came[:-1]))
        block = np.cumsum(new)
    return order, new


def repeated(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every window that also starts in a string of a smaller document."""
    shards, lo, size = [], 0, 0
    for hi, s in enumerate(strings, 1):
        size += len(s)
        if size >= SHARD or hi == len(strings):
            shards.append((lo, Shard(strings[lo:hi], len(shards))))
            lo, size = hi, 0
    order, new = merge([s for _, s in shards])
    at = np.argsort(order, kind="stable")
    string, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    string[at] = np.concatenate([s.string + lo for lo, s in shards])
    offset[at] = np.concatenate([s.offset for _, s in shards])
    start = np.flatnonzero(new)
    owner = docs[string]
    least = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.append(start, len(owner))))
    found = owner > least
    return string[found], offset[found]


def mergeable(buf: np.ndarray, lens: np.ndarray, docs: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Which strings (of lens bytes, end to end in buf) may have a window of another document: one of the same rolling hash.

    Equal windows have equal hashes, so a string without one has nothing for the merge to find.
    """
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[: len(buf)], out=total[1:])
    windows = np.maximum(lens - WINDOW + 1, 0)
    string = np.repeat(np.arange(len(lens)), windows)
    at = np.arange(len(string)) + np.repeat(np.cumsum(lens) - lens - (np.cumsum(windows) - windows), windows)
    h = (total[at + WINDOW] - total[at]) * down[at]
    order = np.argsort(h)
    h, string = h[order], string[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    out = np.zeros(len(lens), bool)
    if len(start):
        owner = docs[string]
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        out[string[np.repeat(several, np.diff(np.append(start, len(h))))]] = True
    return out


def _merged_strings(blocks: int):
    """Merges the strings of a bucket at a time, whole keys together, and gives marks by block."""

    def run(batches):
        spans, powers = Gathered(blocks, _SPAN), _powers(2 * SIEVE)
        rows = lambda to, blobs: pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], ["block", "marks"])
        for held in whole_groups(batches, "bucket"):
            for found in merged(held, *powers):
                yield rows(*spans.add(*found))
        yield rows(*spans.rest())

    def sieved(string, size, key, doc, up, down):
        # whole keys of about SIEVE bytes at a time; larger keys go to the merge as they are
        out = np.ones(len(key), bool)
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        lo = 0
        while lo < len(key):
            base = size[lo - 1] if lo else 0
            ends = bounds[np.searchsorted(bounds, lo, side="right") :]
            hi = int(ends[max(0, int(np.searchsorted(size[ends - 1], base + SIEVE, side="right")) - 1)])
            if size[hi - 1] - base <= 2 * SIEVE:
                buf = np.frombuffer(b"".join(string.slice(lo, hi - lo).to_pylist()), np.uint8)
                out[lo:hi] = mergeable(buf, np.diff(size[lo:hi], prepend=base), doc[lo:hi], up, down)
            lo = hi
        return out

    def merged(held, *powers):
        flat = lambda name: held[name].combine_chunks().flatten()
        key, doc, tag, first = (flat(n).to_numpy(zero_copy_only=False) for n in ("key", "doc", "tag", "first"))
        string = flat("string")
        order = np.lexsort((doc, key))
        key, doc, tag, first = key[order], doc[order], tag[order], first[order]
        string = string.take(pa.array(order))
        size = np.cumsum(pa.compute.binary_length(string).to_numpy(zero_copy_only=False).astype(np.int64))
        good = sieved(string, size, key, doc, *powers)
        key, doc, tag, first = key[good], doc[good], tag[good], first[good]
        string = string.filter(pa.array(good))
        size = np.cumsum(pa.compute.binary_length(string).to_numpy(zero_copy_only=False).astype(np.int64))
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        lo = 0
        while lo < len(key):
            base = size[lo - 1] if lo else 0
            # keys up to MERGE bytes, one at least
            ends = bounds[np.searchsorted(bounds, lo, side="right") :]
            hi = int(ends[max(0, int(np.searchsorted(size[ends - 1], base + MERGE, side="right")) - 1)])
            which, offset = repeated(string.slice(lo, hi - lo).to_pylist(), doc[lo:hi])
            if len(which):
                yield _joined(doc[lo:hi][which], tag[lo:hi][which], first[lo:hi][which] + offset)
            lo = hi

    return run


def removed_mask(size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bytes of a text that marked windows cover."""
    edge = np.zeros(size + 1, np.int64)
    s, n = first.astype(np.int64), count.astype(np.int64)
    np.add.at(edge, np.minimum(s, size), 1)
    np.add.at(edge, np.minimum(s + n + WINDOW - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def marks(rows: Rows) -> DataFrame:
    """block and marks: doc, tag and marked windows of rows of the block, as blobs."""
    n = partitions(rows.docs.sparkSession)
    dealt = rows.docs.select("__doc", "__tag", "text").mapInArrow(_dealt_runs(rows.buckets, rows.blocks), "bucket long, data binary")
    judged = _dealt(dealt, n, "bucket").sortWithinPartitions("bucket").mapInArrow(_judged_runs(rows.blocks), "block long, marks binary, wants binary")
    judged = materialize(judged, "runs", free=True)
    wants = judged.where("wants is not null").select("block", "wants")
    texts = _meeting(wants, _compressed(rows).select("block", "doc", "tag", "data"), "wants", n)
    strings = texts.mapInArrow(_dealt_strings(rows.buckets), "bucket long, key array<long>, doc array<long>, tag array<long>, first array<long>, string array<binary>")
    merged = _dealt(strings, n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged_strings(rows.blocks), "block long, marks binary")
    return judged.where("marks is not null").select("block", "marks").union(merged)


def _compressed(rows: Rows) -> DataFrame:
    """doc_id, block, doc, tag and the text's bytes, compressed before they are shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            start = 0
            for (texts,) in text_slices(batch, ("text",)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([pack((t or "").encode()) for t in texts], pa.binary())], ["doc_id", "block", "doc", "tag", "data"])

    return rows.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__block", "__doc", "__tag", "text").mapInArrow(run, "doc_id long, block long, doc long, tag long, data binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch, rows in _met(batches, "marks", _SPAN):
            out = []
            texts = batch.column(batch.schema.get_field_index("data"))
            for at, found in rows:
                text = unpack(texts[at].as_py())
                if found:
                    gone = removed_mask(len(text), *found)
                    spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                else:
                    spans, kept = 0, text
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array([at for at, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = Rows(docs)
    joined = _meeting(marks(rows), _compressed(rows), "marks", partitions(docs.sparkSession))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes; letters of which a part goes go whole. n_chars follows the text."""
    rows, columns = Rows(docs), docs.columns
    texts = rows.docs.select(F.col("__block").alias("block"), F.col("__doc").alias("doc"), F.col("__tag").alias("tag"), F.struct(*[rows.docs[c] for c in columns]).alias("row"))
    joined = _meeting(marks(rows), texts, "marks", partitions(docs.sparkSession))

    def run(batches):
        for batch, met in _met(batches, "marks", _SPAN):
            held = batch.column(batch.schema.get_field_index("row")).take(pa.array([at for at, _ in met], pa.int64()))
            part = pa.RecordBatch.from_arrays(held.flatten(), columns)
            start = 0
            for (texts,) in text_slices(part, ("text",)):
                out = []
                for t, (_, found) in zip(texts, met[start : start + len(texts)]):
                    if t is not None and found:
                        raw = t.encode()
                        t = np.frombuffer(raw, np.uint8)[~removed_mask(len(raw), *found)].tobytes().decode("utf-8", "ignore")
                    out.append(t)
                cols = dict(zip(columns, part.slice(start, len(texts)).columns))
                start += len(texts)
                cols["text"] = pa.array(out, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(run, docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated 50-byte strings.

    Null and short texts stay as they are; a text that is repeated in whole becomes empty and
    its row stays; rows with equal or null ids keep their own marks; an empty table stays empty;
    all columns stay, n_chars follows the text.
    """
    return deduplicated(docs)
