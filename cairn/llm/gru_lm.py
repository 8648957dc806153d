"""Document scoring with a gated recurrent language model and a class-factored softmax.

Texts are split into words once: slices of documents, as numbers of the slice's distinct
words, are written to the shared folder. Counts of all words of all training documents give
the vocabulary (the most frequent words), the word classes (equal numbers of words by
frequency), the first output biases and the shares of rare words. The recurrent weights are
fitted by truncated backpropagation on all training documents, each whole and once: a round
takes its part of the documents of every slice, a slice is a shard, and weights are averaged
after every round, so what is learned from grows with the input. Scoring runs whole
documents, many side by side and longest first, and carries the state from window to
window. A word outside the vocabulary is one symbol of the network times the word's share
among such words, so the model is a distribution over all words.

Words are counted by the 64-bit hash of their bytes. Rare words do not fit a broadcast:
they and the counts meet by hash, in blobs of one bucket each.

Edge cases: null and blank texts are one end token; without training documents counts are
0 and the network is uniform; repeated rows are scored alike; rows with equal or null ids
keep their own scores; an empty table gives no rows; other columns are ignored; texts of
any length are scored whole; a null id is not held out.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import crc_of_id, materialize, one_thread, partitions, text_slices

#: Words of the network (with the end and the symbol of rare words), classes, size of the state.
WORDS, CLASSES, STATE = 1024, 32, 16
#: Words whose counts are broadcast.
FREQUENT = 65536
#: Bytes of text of a slice; rounds, each over its own part of all training documents.
SLICE, ROUNDS = 8 << 20, 4
#: Streams of documents that are trained side by side at most, words of a window, windows of a shard at least where it is small, words of a piece of a document.
STREAMS, SPAN, WINDOWS, PIECE = 256, 16, 64, 1024
#: Step of the optimizer in the first round.
RATE = 0.02
#: Steps after which a scoring run turns its states into probabilities, once they are enough.
SCORE_SPAN, SCORE_ROWS = 16, 8192
RARE, END = 0, 1


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 8)


class Batch:
    """Tokens of texts as numbers of the distinct words of the batch."""

    def __init__(self, texts: list[str | None]):
        code: dict[bytes, int] = defaultdict(count().__next__)
        number = code.__getitem__
        self.docs = []
        for t in texts:
            words = (t or "").encode().lower().split()
            self.docs.append(np.fromiter(map(number, words), np.int32, len(words)))
        self.hashes = np.fromiter(map(_hash, code), np.uint64, len(code))


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _cut(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))[: len(b)].tolist()
    for lo, hi in zip(start, [*start[1:], len(b)]):
        yield int(b[lo]), order[lo:hi]


def tokenized(docs: DataFrame, held_out: Column, buckets: int) -> DataFrame:
    """Slices of docs as words, written once.

    A slice (bucket is null) has the doc_id, held_out, key (a number of the row) and words of
    its documents, hashes of its distinct words and, of each word of all its texts, the number
    of the distinct one. Rows with a bucket have the hashes of that bucket and their counts in
    a slice's training documents.
    """
    schema = "bucket long, ids array<long>, held array<boolean>, keys array<long>, lens array<int>, hashes binary, words binary"
    names = ["bucket", "ids", "held", "keys", "lens", "hashes", "words"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for ids, held, texts in text_slices(batch, ("doc_id", "held", "text"), SLICE):
                part = Batch(texts)
                held = [bool(h) for h in held]
                lens = np.fromiter(map(len, part.docs), np.int32, len(part.docs))
                flat = np.concatenate([np.zeros(0, np.int32), *part.docs])
                rows = [(None, ids, held, list(range(first, first + len(ids))), lens, _blob(part.hashes), _blob(flat.astype("<u4")))]
                first += len(ids)
                n = np.bincount(flat[np.repeat(~np.array(held, bool), lens)], minlength=len(part.hashes))
                some = np.flatnonzero(n)
                for b, at in _cut((part.hashes[some] % np.uint64(buckets)).astype(np.int64)):
                    rows.append((b, None, None, None, None, _blob(part.hashes[some[at]], n[some[at]].astype("<u4")), None))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return materialize(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text").mapInArrow(run, schema), "lm-words")


def _slices(batches):
    """ids, held, keys, lens, hashes and words of every slice of a task."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, held, keys, lens, hashes, words = (batch.column(batch.schema.get_field_index(c))[k] for c in ("ids", "held", "keys", "lens", "hashes", "words"))
            arrays = (np.array(x.values.to_numpy(zero_copy_only=False)) for x in (held, keys, lens))
            yield ids.values, *arrays, _arrays(hashes.as_py(), "<u8")[0], _arrays(words.as_py(), "<u4")[0]


def word_counts(tokens: DataFrame) -> DataFrame:
    """bucket and data: hashes (ascending) and counts of all training words, each in the bucket of its hash."""

    def add(batches):
        held: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[b].append(x)
        for b in sorted(held):
            parts = [_arrays(x, "<u8", "<u4") for x in held.pop(b)]
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(float), len(h)).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_blob(h, n)], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["bucket", "data", "types", "total"])

    dealt = tokens.where("bucket is not null").select("bucket", F.col("hashes").alias("data"))
    return dealt.repartition(partitions(tokens.sparkSession), "bucket").mapInArrow(add, "bucket long, data binary, types long, total long")


def frequent(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the n most frequent words, the most frequent first; ties by hash."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                h, c = _arrays(x, "<u8", "<i8")
                top = np.lexsort((h.view("<i8"), -c))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(c[top])], ["h", "c"])

    top = counts.select("data").mapInArrow(run, "h long, c long").orderBy(F.desc("c"), "h").limit(n).toArrow()
    return top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()


class Network:
    """Weights, views of one flat array; words are numbered by class: word w is in class w // per."""

    def __init__(self, bias_counts: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.per = WORDS // CLASSES
        c = np.zeros(WORDS)
        c[: len(bias_counts)] = bias_counts
        c = (c + 0.5).reshape(CLASSES, self.per)
        first = {
            # inputs of the gates by word, recurrent weights, classes, words within a class; features come first throughout
            "T": rng.normal(0, 0.08, (3 * STATE, WORDS)), "U": rng.normal(0, 0.08, (3 * STATE, STATE)),
            "C": rng.normal(0, 0.008, (CLASSES, STATE)), "bc": np.log(c.sum(1) / c.sum())[:, None],
            "W": rng.normal(0, 0.008, (CLASSES, self.per, STATE)), "bw": np.log(c / c.sum(1, keepdims=True))[:, :, None],
        }
        self.shapes = {n: v.shape for n, v in first.items()}
        self.flat = np.concatenate([v.ravel() for v in first.values()]).astype(np.float32)
        self.w = self.views(self.flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n, s in self.shapes.items():
            size = math.prod(s)
            out[n] = flat[at : at + size].reshape(s)
            at += size
        return out

    def __getstate__(self):
        return self.per, self.shapes, self.flat

    def __setstate__(self, state):
        self.per, self.shapes, self.flat = state
        self.w = self.views(self.flat)

    def copy(self) -> Network:
        out = Network.__new__(Network)
        out.__setstate__((self.per, self.shapes, self.flat.copy()))
        return out


def _logistic(x: np.ndarray) -> None:
    """In place; beyond the range of the exponential it is 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _step(h: np.ndarray, x: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of the gated unit; x: inputs of the gates. Returns the new state, both gates, the candidate and the recurrent product of the candidate, on which the reset gate acts."""
    a = U @ h
    gates = a[: 2 * STATE] + x[: 2 * STATE]
    _logistic(gates)
    back = a[2 * STATE :]
    m = gates[:STATE] * back
    m += x[2 * STATE :]
    # a hyperbolic tangent is a logistic function of twice its argument, from -1 to 1
    m *= 2
    _logistic(m)
    m *= 2
    m -= 1
    new = h - m
    new *= gates[STATE:]
    new += m
    return new, gates, m, back


def _softmax(x: np.ndarray) -> np.ndarray:
    """Turns columns of logits into probabilities, in place, and returns the log of the sum of each column's exponentials."""
    top = x.max(axis=0)
    x -= top
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    np.log(total, out=total)
    total += top
    return total


class _Classes:
    """Targets in the order of their class, with the stretch of each class."""

    def __init__(self, target: np.ndarray, per: int):
        cls = (target // per).astype(np.uint8 if CLASSES <= 256 else np.int32)
        self.order = np.argsort(cls, kind="stable")
        self.cls = cls[self.order].astype(np.int64)
        self.inner = (target % per)[self.order]
        self.start = np.flatnonzero(np.append(True, self.cls[1:] != self.cls[:-1]))[: len(target)]
        self.parts = list(zip(self.cls[self.start].tolist(), self.start.tolist(), [*self.start[1:].tolist(), len(target)]))

    def logits(self, h: np.ndarray, w: dict) -> np.ndarray:
        out = np.empty((w["bw"].shape[1], h.shape[1]), h.dtype)
        for c, a, b in self.parts:
            np.matmul(w["W"][c], h[:, a:b], out=out[:, a:b])
            out[:, a:b] += w["bw"][c]
        return out


def _log_prob(w: dict, per: int, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | state): of its class, and of it within the class; a column of h is a state."""
    k = _Classes(target, per)
    place = np.arange(len(target))
    h = np.take(h, k.order, axis=1)
    x = w["C"] @ h
    x += w["bc"]
    found = x[k.cls, place].astype(np.float64)
    found -= _softmax(x)
    x = k.logits(h, w)
    found += x[k.inner, place]
    found -= _softmax(x)
    out = np.empty(len(target))
    out[k.order] = found
    return out


def gradient(net: Network, h: np.ndarray, x_in: np.ndarray, target: np.ndarray, on: np.ndarray, keep: np.ndarray, g: dict) -> tuple[np.ndarray, float, int]:
    """Fills g with the gradient of the mean loss of a window (steps x streams) and returns the states after it, the sum of its losses and its words.

    h: states before, a column each; x_in: words before each step; on: whether there is a word; keep: 0 where the state begins anew, else 1.
    """
    w, per, kind = net.w, net.per, net.flat.dtype
    steps, rows = x_in.shape
    x = np.take(w["T"], x_in, axis=1)
    h0, states = np.empty((STATE, steps, rows), kind), np.empty((STATE, steps, rows), kind)
    kept = []
    for t in range(steps):
        before = h * keep[t]
        h0[:, t] = before
        h, gates, m, back = _step(before, x[:, t], w["U"])
        states[:, t] = h
        kept.append((before, gates, m, back))
    at = np.flatnonzero(on.ravel())
    words = len(at)
    k = _Classes(target.ravel()[at], per)
    at = at[k.order]
    H, place = np.take(states.reshape(STATE, -1), at, axis=1), np.arange(words)
    p = w["C"] @ H
    p += w["bc"]
    loss = -p[k.cls, place].sum(dtype=np.float64) + _softmax(p).sum(dtype=np.float64)
    p[k.cls, place] -= 1
    p *= kind.type(1 / words)
    np.matmul(p, H.T, out=g["C"])
    np.sum(p, axis=1, keepdims=True, out=g["bc"])
    dH = w["C"].T @ p
    q = k.logits(H, w)
    loss += -q[k.inner, place].sum(dtype=np.float64) + _softmax(q).sum(dtype=np.float64)
    q[k.inner, place] -= 1
    q *= kind.type(1 / words)
    g["W"][:], g["bw"][:] = 0, 0
    for c, a, b in k.parts:
        part = q[:, a:b]
        np.matmul(part, H[:, a:b].T, out=g["W"][c])
        dH[:, a:b] += w["W"][c].T @ part
    g["bw"][k.cls[k.start], :, 0] = np.add.reduceat(q, k.start, axis=1).T
    d_states = np.zeros((STATE, steps * rows), kind)
    d_states[:, at] = dH
    d_states = d_states.reshape(STATE, steps, rows)
    dx, da = np.empty((3 * STATE, steps, rows), kind), np.empty((3 * STATE, steps, rows), kind)
    carry = np.zeros((STATE, rows), kind)
    for t in range(steps - 1, -1, -1):
        before, gates, m, back = kept[t]
        r, z = gates[:STATE], gates[STATE:]
        carry += d_states[:, t]
        slope = gates - gates * gates
        dm = carry - carry * z
        dm -= dm * m * m
        one = np.empty((3 * STATE, rows), kind)
        np.multiply(dm, back, out=one[:STATE])
        np.subtract(before, m, out=one[STATE : 2 * STATE])
        one[STATE : 2 * STATE] *= carry
        one[: 2 * STATE] *= slope
        one[2 * STATE :] = dm
        dx[:, t] = one
        one[2 * STATE :] *= r
        da[:, t] = one
        carry *= z
        carry += w["U"].T @ one
        carry *= keep[t]
    np.matmul(da.reshape(3 * STATE, -1), h0.reshape(STATE, -1).T, out=g["U"])
    flat = x_in.ravel()
    order = np.argsort(flat.astype(np.uint16) if WORDS <= 1 << 16 else flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    g["T"][:] = 0
    g["T"][:, flat[start]] = np.add.reduceat(np.take(dx.reshape(3 * STATE, -1), order, axis=1), start, axis=1)
    return h, loss, words


def train(net: Network, docs: list[np.ndarray], rate: float) -> int:
    """One pass of truncated backpropagation over whole documents (numbers of words, the end last), laid in streams; returns the words.

    Long documents lie in several streams, in pieces of up to PIECE words: a piece begins with the word before it and an empty state.
    """
    total = sum(map(len, docs))
    if not total:
        return 0
    flat = np.concatenate(docs).astype(np.int64)
    before = np.append(END, flat[:-1])
    pieces = [(at + k, min(PIECE, len(d) - k)) for d, at in zip(docs, np.cumsum([0, *map(len, docs)]).tolist()) for k in range(0, len(d), PIECE)]
    go_on = np.ones(total, net.flat.dtype)
    go_on[[p for p, _ in pieces]] = 0
    n = max(1, min(STREAMS, len(pieces), max(8, total // (SPAN * WINDOWS))))
    streams: list[list[np.ndarray]] = [[] for _ in range(n)]
    fill = [(0, k) for k in range(n)]
    for p, size in pieces:
        held, k = fill[0]
        streams[k].append(np.arange(p, p + size))
        heapq.heapreplace(fill, (held + size, k))
    rows = sorted((np.concatenate(s) for s in streams if s), key=len, reverse=True)
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    place = np.concatenate(rows)
    begin = np.cumsum(lens) - lens
    g_flat = np.zeros_like(net.flat)
    g = net.views(g_flat)
    m1, m2, scratch = np.zeros_like(net.flat), np.zeros_like(net.flat), np.empty_like(net.flat)
    h, steps, done = np.zeros((STATE, len(rows)), net.flat.dtype), 0, 0
    for lo in range(0, int(lens[0]), SPAN):
        # the streams that have not ended, and as many steps as the longest of them has
        live = int(np.searchsorted(-lens, -lo, side="left"))
        where = lo + np.arange(min(SPAN, int(lens[0]) - lo))[:, None]
        on = where < lens[None, :live]
        at = place[np.where(on, begin[None, :live] + where, 0)]
        h, _, words = gradient(net, h[:, :live], before[at], flat[at], on, go_on[at], g)
        norm = math.sqrt(float(np.dot(g_flat, g_flat)))
        if norm > 1:
            g_flat /= norm
        steps += 1
        np.subtract(g_flat, m1, out=scratch)
        scratch *= 0.1
        m1 += scratch
        np.multiply(g_flat, g_flat, out=scratch)
        scratch -= m2
        scratch *= 0.001
        m2 += scratch
        np.sqrt(m2, out=scratch)
        scratch *= 1 / math.sqrt(1 - 0.999**steps)
        scratch += 1e-8
        np.divide(m1, scratch, out=scratch)
        scratch *= rate / (1 - 0.9**steps)
        net.flat -= scratch
        done += words
    return done


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document (numbers of words, the end last)."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    return score_flat(net, np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64), lens)


def score_flat(net: Network, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The same of documents that lie one after another."""
    w, per = net.w, net.per
    out = np.zeros(len(lens))
    if not len(lens):
        return out
    order = np.argsort(-lens, kind="stable")
    begin = (np.cumsum(lens) - lens)[order]
    size = lens[order]
    h = np.zeros((STATE, len(lens)), net.flat.dtype)
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left").tolist()
    states, targets, owners, held = [], [], [], 0
    x = np.full(len(lens), END)
    for t, n in enumerate(live):
        h = _step(h[:, :n], np.take(w["T"], x[:n], axis=1), w["U"])[0]
        x = flat[begin[:n] + t]
        states.append(h)
        targets.append(x)
        owners.append(n)
        held += n
        if (len(owners) >= SCORE_SPAN and held >= SCORE_ROWS) or t + 1 == len(live):
            lp = _log_prob(w, per, np.concatenate(states, axis=1), np.concatenate(targets))
            at = 0
            for m in owners:
                out[:m] += lp[at : at + m]
                at += m
            states, targets, owners, held = [], [], [], 0
    back = np.empty(len(lens))
    back[order] = out
    return back


class Vocabulary:
    """What all tasks know of the words: the frequent ones' hashes and counts, and the sums."""

    def __init__(self, h: np.ndarray, c: np.ndarray, types: int, total: int, train_docs: int):
        self.types, self.total = types + (train_docs > 0), total + train_docs
        self.end = train_docs
        inside = min(WORDS - 2, len(h))
        #: number of each frequent word in the network
        number = np.where(np.arange(len(h)) < inside, np.arange(len(h)) + 2, RARE)
        order = np.argsort(h)
        self.h, self.c, self.number = h[order], c[order], number[order]
        #: rare words: of all counts and types those outside the network
        self.rare_total, self.rare_types = total - int(c[:inside].sum()), types - inside
        self.network_counts = np.concatenate([[self.rare_total, train_docs], c[:inside]])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in the network and count of each word; count -1 if it is not frequent."""
        if not len(self.h):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        hit = self.h[at] == hashes
        return np.where(hit, self.number[at], RARE), np.where(hit, self.c[at], -1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def share(self, c: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share among the rare."""
        return np.log10((c + 0.5) / (self.rare_total + 0.5 * (self.rare_types + 1)))


def _with_ends(words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Numbers of words with the end after each document."""
    out = np.full(len(words) + len(lens), END, np.int64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(lens)), lens)] = words
    return out


def _round(sent, turn: int):
    """Passes over a round's documents of each slice of a task, each from the weights that were sent; one row of words and sum of weights by words."""

    def run(batches):
        one_thread()
        known, net = sent.value
        words, total, first = 0, None, None
        for _, held, keys, lens, hashes, flat in _slices(batches):
            mine = ~held & ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(ROUNDS) == turn)
            if not mine.any():
                continue
            number = known.look_up(hashes)[0]
            ends = np.cumsum(lens, dtype=np.int64)
            docs = [np.append(number[flat[ends[k] - lens[k] : ends[k]]], END) for k in np.flatnonzero(mine)]
            np.random.default_rng(turn).shuffle(docs)
            own = net.copy()
            n = train(own, docs, RATE / (1 + turn))
            part = own.flat.astype(np.float64) * n
            first = int(keys[0]) if first is None else first
            words, total = words + n, part if total is None else total + part
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "w"])

    return run


def _added(batches):
    """The sum of rows (part, n, w), in their order."""
    part, words, total = None, 0, None
    for batch in batches:
        for p, n, w in zip(*(batch.column(k) for k in range(3))):
            part = p.as_py() if part is None else part
            words += n.as_py()
            flat = np.frombuffer(w.as_buffer())
            total = flat.copy() if total is None else total + flat
    if words:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "w"])


def fit(tokens: DataFrame, vocabulary: Vocabulary) -> Network:
    """Rounds over all training documents, weights averaged after each; net.trained has the words of each round."""
    spark = tokens.sparkSession
    net = Network(vocabulary.network_counts)
    trained = []
    slices = tokens.where("bucket is null")
    some = math.isqrt(partitions(spark)) + 1
    for turn in range(ROUNDS if vocabulary.end else 0):
        sent = spark.sparkContext.broadcast((vocabulary, net))
        sums = slices.mapInArrow(_round(sent, turn), "part long, n long, w binary")
        for n in (some, 1):
            sums = sums.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_added, "part long, n long, w binary")
        found = sums.first()
        if found is not None:
            net = net.copy()
            net.flat[:] = np.frombuffer(found["w"]) / found["n"]
            trained.append(found["n"])
        sent.unpersist()
    net.trained = trained
    return net


def _scored(known, buckets: int):
    """Rows of documents, and (with a bucket) the occurrences of words that are not broadcast."""
    names = ["bucket", "doc_id", "key", "held_out", "n_tokens", "n_known", "base_score", "score", "data"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())

    def run(batches):
        one_thread()
        v, net = known.value
        for ids, held, keys, lens, hashes, flat in _slices(batches):
            number, c = v.look_up(hashes)
            own = np.repeat(np.arange(len(lens)), lens)
            often = c >= 0
            base, share = np.where(often, v.base(np.maximum(c, 0)), 0.0), np.where(often & (number == RARE), v.share(np.maximum(c, 0)), 0.0)
            sums = [np.bincount(own, x[flat], len(lens)) for x in (base, share, (often & (c > 0)).astype(float))]
            network = score_flat(net, _with_ends(number[flat], lens), lens.astype(np.int64) + 1) / math.log(10)
            n = len(lens)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kinds[0]), ids, *(pa.array(x, k) for x, k in zip((keys, held, lens.astype(np.int64) + 1, sums[2].astype(np.int64) + (v.end > 0), sums[0] + float(v.base(np.array(v.end))), sums[1] + network), kinds[2:8])), pa.nulls(n, kinds[8])],
                names,
            )
            at = np.flatnonzero(~often[flat])
            far, keys = hashes[flat[at]], keys[own[at]]
            rows = [(b, _blob(far[o], keys[o])) for b, o in _cut((far % np.uint64(buckets)).astype(np.int64))]
            if rows:
                none = [pa.nulls(len(rows), k) for k in kinds[1:8]]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], kinds[0]), *none, pa.array([x for _, x in rows], kinds[8])], names)

    return run


def _met(known):
    """The rare words of documents and the counts of one bucket: sums by document."""

    def run(batches):
        v = known.value[0]
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for batch in batches:
            for b, kind, x in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                held[b][kind].append(x)
        for b in sorted(held):
            table, words = held.pop(b)
            if not words:
                continue
            parts = [_arrays(x, "<u8", "<i8") for x in words]
            hashes, key = (np.concatenate([p[i] for p in parts]) for i in range(2))
            c = np.zeros(len(hashes), np.int64)
            if table:
                known_h, known_c = _arrays(table[0], "<u8", "<i8")
                at = np.minimum(np.searchsorted(known_h, hashes), len(known_h) - 1)
                c = np.where(known_h[at] == hashes, known_c[at], 0)
            ids, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.bincount(at, c > 0, len(ids)).astype(np.int64)), pa.array(np.bincount(at, v.base(c), len(ids))), pa.array(np.bincount(at, v.share(c), len(ids)))],
                ["key", "known", "base", "share"],
            )

    return run


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores all documents, learning from those that are not held out (a condition on columns of docs)."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    tokens = tokenized(docs, held_out, buckets)
    counts = materialize(word_counts(tokens), "word-counts", free=True)
    sums = counts.agg(F.sum("types").alias("types"), F.sum("total").alias("total")).first()
    learn = tokens.where("bucket is null").select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n").alias("n")).first()["n"]
    h, c = frequent(counts, FREQUENT)
    vocabulary = Vocabulary(h, c, sums["types"] or 0, sums["total"] or 0, learn or 0)
    known = spark.sparkContext.broadcast((vocabulary, fit(tokens, vocabulary)))
    schema = "bucket long, doc_id long, key long, held_out boolean, n_tokens long, n_known long, base_score double, score double, data binary"
    scored = materialize(tokens.where("bucket is null").mapInArrow(_scored(known, buckets), schema), "scored")
    rare = scored.where("bucket is not null").select("bucket", F.lit(1).alias("kind"), "data")
    both = counts.select("bucket", F.lit(0).alias("kind"), "data").union(rare).repartition(n, "bucket")
    extra = both.mapInArrow(_met(known), "key long, known long, base double, share double").groupBy("key").agg(*[F.sum(x).alias(x) for x in ("known", "base", "share")])
    more = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.where("bucket is null").join(extra, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("known")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("base")).alias("base_score"), (F.col("score") + more("share")).alias("score"),
    )


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_of_id() % 5 == 1)
