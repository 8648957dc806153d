"""Near-duplicate detection with SimHash and a Gray-order hierarchical index.

Fingerprints come from XXH64 (seed 42) of 3-word shingles. Any two that differ in at most
2 bits agree in two of four 16-bit blocks, so distinct fingerprints are dealt by each of
the six pairs of blocks; a pair of blocks that very many share is split once more by pairs
of bytes of the other two blocks. Within such a group fingerprints are sorted by
Gray rank and every 8 form a node, nodes form higher nodes, and so on. A node factors out
the bits that all its members share; a search goes down from the roots, adds the
differences in the bits a node newly fixes, and drops a whole group beyond 2. Links become
star edges to the group's smallest linked fingerprint; components over all groups come
from rounds of small-star and large-star steps, each written to the shared folder.

Edge cases: null and blank texts have fingerprint zero and are linked like others; texts
of one or two words give one shingle; equal texts are linked; repeated rows are
kept; where an id has rows with different texts each row has the component of its text; a
null doc_id is kept with the component of its group; an empty table gives no rows; other columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import materialize, release, text_slices, whole_groups

BITS = 2
#: A node of the index has so many children.
FAN = 8
#: Groups of more fingerprints are split by further bits.
SPLIT = 128


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of a text; a bit is 1 if over half the shingles have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = zip(*(words[i : i + n] for i in range(width))) if len(words) >= width else [words]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(b" ".join(s), seed) for s in shingles), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for ids, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(list(map(fingerprint, texts)), np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def near_pairs(group: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i > j of all pairs of near_pair_blocks."""
    found = list(near_pair_blocks(group, fp, bits))
    none = np.zeros(0, np.int64)
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (none, none)


def near_pair_blocks(group: np.ndarray, fp: np.ndarray, bits: int = BITS, block: int = 1 << 15):
    """Yields positions i > j of fingerprints of the same group that differ in at most `bits` bits, `block` fingerprints i at a time.

    group must not descend, and fp must ascend by Gray rank within a group.
    """
    n = len(fp)
    if n < 2:
        return
    # levels of nodes: fixed bits and their values, the node's first and last child below, its group
    shared, value, own = [np.full(n, ~np.uint64(0))], [fp], [group]
    children = []
    while len(own[-1]) > 1 and (own[-1][1:] == own[-1][:-1]).any():
        g = own[-1]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        within = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        start = np.flatnonzero(within % FAN == 0)
        one = np.bitwise_and.reduceat(value[-1], start)
        any_ = np.bitwise_or.reduceat(value[-1], start)
        fixed = np.bitwise_and.reduceat(shared[-1], start) & ~(one ^ any_)
        shared.append(fixed)
        value.append(one & fixed)
        own.append(g[start])
        children.append((start, np.append(start[1:], len(g))))
    # every fingerprint starts at the root of its group
    roots = np.searchsorted(own[-1], group)
    for lo in range(0, n, block):
        q = np.arange(lo, min(n, lo + block))
        node = roots[q]
        have = np.bitwise_count((fp[q] ^ value[-1][node]) & shared[-1][node])
        above = shared[-1][node]
        keep = have <= bits
        q, node, have, above = q[keep], node[keep], have[keep].astype(np.int64), above[keep]
        for level in range(len(own) - 2, -1, -1):
            begin, end = children[level][0][node], children[level][1][node]
            count = end - begin
            q, have, above = np.repeat(q, count), np.repeat(have, count), np.repeat(above, count)
            node = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            # only bits that the node fixes beyond its parent add differences
            have = have + np.bitwise_count((fp[q] ^ value[level][node]) & shared[level][node] & ~above)
            keep = have <= bits
            q, node, have = q[keep], node[keep], have[keep]
            above = shared[level][node]
        half = q > node
        yield q[half], node[half]


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position in the component of each of n positions linked by a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _gray_groups(batches):
    """From rows (g, fp) in the order of g, whole groups in one task: fingerprints in the order of the index, and positions of its pairs."""
    for table in whole_groups(batches, "g", 4 << 20):
        gs, x = table["g"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(x), gs))
        gs, x = gs[order], x[order]
        yield x, *near_pairs(gs, x)


def _star_edges(batches):
    """An edge to the smallest linked fingerprint of the group."""
    for x, i, j in _gray_groups(batches):
        root = roots_of(len(x), i, j)
        some = root != np.arange(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)), pa.array(x[root[some]].view(np.int64))], ["a", "b"])


def _near_edges(batches):
    """A least spanning forest of the pairs of a group, each within BITS."""
    for x, i, j in _gray_groups(batches):
        kept = _forest(np.arange(len(x)), i, j, np.bitwise_count(x[i] ^ x[j]))
        yield pa.RecordBatch.from_arrays([pa.array(x[i[kept]].view(np.int64)), pa.array(x[j[kept]].view(np.int64))], ["a", "b"])


def _block(x, k: int):
    return F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame, edges=_star_edges) -> DataFrame:
    """Edges a-b between distinct fingerprints whose components are those of all links of at most 2 bits."""
    fp = F.col("fp")
    pairs = list(combinations(range(4), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.xxhash64(F.lit(k), _block(fp, i), _block(fp, j)).alias("g")) for k, (i, j) in enumerate(pairs)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.g")
    sizes = dealt.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    dealt = dealt.join(sizes, "g")
    # the other two blocks are four bytes, of which at most 2 hold a differing bit: two bytes agree
    rest = [[b for b in range(4) if b not in p] for p in pairs]
    split = []
    for k, (i, j) in enumerate(rest):
        bytes_ = [F.shiftrightunsigned(fp, 16 * b + 8 * half).bitwiseAND(F.lit(0xFF)) for b in (i, j) for half in (0, 1)]
        split.append(F.array(*[F.xxhash64(F.col("g"), F.lit(m), bytes_[x], bytes_[y]) for m, (x, y) in enumerate(combinations(range(4), 2))]))
    further = F.element_at(F.array(*split), F.col("t") + 1)
    groups = F.when(F.col("n") > SPLIT, further).otherwise(F.array("g"))
    dealt = dealt.select("fp", F.explode(groups).alias("g"))
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(edges, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges a-b, by alternating stars."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        # large star: neighbours above a node move to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, move to its smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        now = materialize(small, "edges")
        # stars are done when every node has one edge and no root has one
        again = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").union(now.join(now.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        done = again.isEmpty()
        release(edges)
        edges = now
        if done:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._cairn_path = edges._cairn_path
            return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of the component."""
    rows = materialize(fingerprints(docs), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(links(fps.select("fp")))
    linked = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    label = linked.join(smallest, "root").select("fp", "component_id")
    out = rows.join(label, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Near copies: words of a shingle, least Jaccard similarity of the shingle sets (as a float and in lowest terms).
WORDS, LEAST = 5, 0.8
PART, WHOLE = 4, 5
#: Bits of a set's parity map, comparisons held at a time.
PARITY, HELD = 512, 1 << 19
#: Bytes of whole groups that a worker holds.
TABLE = 4 << 20
#: Documents whose shingles are counted to know the common ones, and how many of these are known.
COUNTED, COMMON = 20_000, 1 << 20


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Ascending distinct XXH64 of the shingles of a text (of fewer words: of the whole sequence)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    shingles = zip(*(words[i : i + n] for i in range(width))) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), 42) for x in shingles), np.uint64, n))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and counts of shingles that occur often in some documents; they order the prefixes and decide no link."""
    share = min(1.0, COUNTED / max(1, docs.count()))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("near"), "text"), 11) / F.lit(float(1 << 53))

    def run(batches):
        for batch in batches:
            for (texts,) in text_slices(batch, ("text",)):
                h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(shingle_set, texts)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    counts = docs.where(chance < share).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefix(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set: two sets of a similarity of at least LEAST have one in common in theirs."""
    known, count = common
    n = len(h)
    c = np.zeros(n, np.int64)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        c = np.where(known[at] == h, count[at], 0)
    return h[np.lexsort((h, c))][: n - -(-PART * n // WHOLE) + 1 if n else 0]


def parity(h: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set has an odd number of it. Two maps differ in at most as many bits as their sets in shingles."""
    odd = np.bincount((h % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _sketched(common):
    """Adds to every row its set's hash, size, parity map, fingerprint and prefix."""

    def run(batches):
        for batch in batches:
            text = batch.column(0).field("text")
            small = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["at", "text"])
            s, size, maps, fps, fronts = [], [], [], [], []
            for _, texts in text_slices(small, ("at", "text")):
                for t in texts:
                    h = shingle_set(t)
                    s.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                    size.append(len(h))
                    maps.append(parity(h))
                    fps.append(majority(h))
                    fronts.append(prefix(h, common.value))
            ends = np.cumsum([0, *map(len, fronts)])
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *fronts]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(s, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(maps, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], ["row", "s", "size", "map", "fp", "g"])

    return run


def _by_shingle(table: pa.Table):
    """Columns g, s, size, at of all rows, each set once in a group, groups together and small sets first; and the places of the rows."""
    cols = {c: table[c].to_numpy() for c in table.column_names if c != "map"}
    order = np.lexsort((cols["s"], cols["size"], cols["g"]))
    g, s = cols["g"][order], cols["s"][order]
    order = order[np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]))]
    return {c: v[order] for c, v in cols.items()}, order


def _partners(g: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the first row of its group whose size allows the similarity; all from there to the row do."""
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))
    key = group * (1 << 32) + size
    return np.searchsorted(key, group * (1 << 32) + -(-PART * size.astype(np.int64) // WHOLE))


def _shared(batches):
    """From rows (g, s, size, at) in the order of g, whole groups in one task: those whose shingle another set of fitting size has."""
    for table in whole_groups(batches, "g"):
        c, _ = _by_shingle(table)
        first = _partners(c["g"], c["size"])
        have = np.arange(len(first)) - first
        # a row is wanted as the larger or as the smaller side
        wanted = np.zeros(len(first) + 1, np.int64)
        np.add.at(wanted, first[have > 0], 1)
        np.add.at(wanted, np.flatnonzero(have > 0) + 1, -1)
        keep = np.cumsum(wanted)[:-1] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[x][keep]) for x in ("g", "s", "size", "at")], ["g", "s", "size", "at"])


def _forest(root: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the edges a-b of a least spanning forest by distance d; root: each node's smallest node so far, which follows."""
    kept = []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while len(at):
            at = at[root[a[at]] != root[b[at]]]
            if not len(at):
                break
            # every component takes its first edge to a smaller one, so no cycles close
            x, y = root[a[at]], root[b[at]]
            high, low = np.maximum(x, y), np.minimum(x, y)
            top, first = np.unique(high, return_index=True)
            kept.append(at[first])
            root[top] = low[first]
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _candidates(every: bool):
    """From rows (g, s, size, at, map, root) in the order of g, whole groups in one task: pairs that may reach the similarity.

    every: all pairs of different roots; otherwise a spanning forest of them, the least of each run of pairs.
    """

    def run(batches):
        for table in whole_groups(batches, "g", TABLE):
            yield from pairs(table)

    def known(g, root):
        # in each group the first row of every root
        order = np.lexsort((root, g))
        start = np.flatnonzero(np.append(True, (g[order][1:] != g[order][:-1]) | (root[order][1:] != root[order][:-1])))
        out = np.empty(len(g), np.int64)
        out[order] = np.repeat(np.minimum.reduceat(order, start), np.diff(np.append(start, len(g))))
        return out

    def pairs(table):
        c, order = _by_shingle(table)
        g, s, at, root = c["g"], c["s"], c["at"].astype(np.int64), c["root"]
        size = c["size"].astype(np.int64)
        maps = np.concatenate([np.frombuffer(b"".join(m.to_pylist()), np.uint64) for m in table["map"].chunks]).reshape(-1, PARITY // 64)[order]
        first = _partners(g, size)
        ends = np.cumsum(np.arange(len(g)) - first)
        tree = None if every else known(g, root)
        lo = 0
        while lo < len(g):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + HELD, side="right")))
            n = np.arange(lo, hi) - first[lo:hi]
            many = int(n.sum())
            heads = np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(np.arange(lo, hi), n)
            other = np.arange(many) - heads + first[owner]
            # of the common shingle that comes first in both, no set has one before it that the other has
            most = 1 + np.minimum(size[owner] - at[owner], size[other] - at[other]) - 1
            both = size[owner] + size[other]
            keep = (most * (PART + WHOLE) >= PART * both) & (root[owner] != root[other])
            owner, other, both = owner[keep], other[keep], both[keep]
            parts = []
            for k in range(0, len(owner), 1 << 18):
                parts.append(np.bitwise_count(maps[owner[k : k + (1 << 18)]] ^ maps[other[k : k + (1 << 18)]]).sum(axis=1, dtype=np.int64))
            d = np.concatenate([np.zeros(0, np.int64), *parts])
            # sets that differ in d shingles share (both - d) / 2
            keep = (both - d) * (PART + WHOLE) >= 2 * PART * both
            owner, other, d = owner[keep], other[keep], d[keep]
            if not every:
                keep = _forest(tree, owner, other, d)
                owner, other = owner[keep], other[keep]
            if len(owner):
                p, q = s[owner], s[other]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])
            lo = hi

    return run


def _packed(batches):
    """Compresses the texts of rows (s, text)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], ["s", "text"])


def _verified(batches):
    """Keeps the pairs whose shingle sets have a Jaccard similarity of at least LEAST."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        a, b, x, y = (batch.column(k) for k in range(4))
        good = []
        for k in range(batch.num_rows):
            p, q = (shingle_set(unpack(t[k].as_py()).decode()) for t in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= LEAST * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs as a struct `row`, each with `keep`: whether it stays for its group of near copies.

    Rows of equal shingle sets are one node, with the SimHash of the set. Sets whose
    fingerprints the Gray-order index finds within BITS are linked where their exact sets
    reach the similarity. Pairs that fingerprints miss by chance follow: every two sets that
    reach it have a common shingle among the rarest fifth of each, so all pairs that meet
    there and are still apart are candidates; only those are dropped that sizes, places in
    the prefix or parity maps prove to be below it. A spanning forest of each shingle's
    candidates is checked on the exact sets first, then every other candidate whose sides are
    still apart. The row with the smallest doc_id of a component stays (nulls last).
    """
    fields = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    schema = T.StructType([fields.schema["row"], T.StructField("s", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("map", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("g", T.ArrayType(T.LongType()))])
    rows = materialize(fields.mapInArrow(_sketched(common), schema).withColumn("n", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "n")
    nodes = materialize(rows.select("s", "map", "fp", order.alias("o")).groupBy("s").agg(F.first("map").alias("map"), F.first("fp").alias("fp"), F.min("o").alias("o")), "sets")
    dealt = rows.select("s", "size", F.posexplode("g").alias("at", "g")).select("g", "s", "size", "at").repartition("g").sortWithinPartitions("g")
    shared = materialize(dealt.mapInArrow(_shared, "g long, s long, size int, at int"), "shared", free=True)

    def indexed() -> DataFrame:
        """Pairs of sets that the index of fingerprints links."""
        heads = materialize(nodes.groupBy("fp").agg(F.min("s").alias("head"), F.count(F.lit(1)).alias("n")), "fps")
        equal = nodes.select("s", "fp").join(heads.where("n > 1"), "fp").where("s != head").select(F.col("s").alias("p"), F.col("head").alias("q"))
        head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"of_{c}"))
        near = links(heads.select("fp"), _near_edges).join(head("a"), "a").join(head("b"), "b").select(F.col("of_a").alias("p"), F.col("of_b").alias("q"))
        out = materialize(equal.union(near).select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), "pairs", free=True)
        release(heads)
        return out

    def pairs(roots: DataFrame, every: bool) -> DataFrame:
        held = shared.join(nodes.select("s", "map"), "s")
        held = held.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        found = held.select("g", "s", "size", "at", "map", "root").repartition("g").sortWithinPartitions("g").mapInArrow(_candidates(every), "a long, b long")
        return found.distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
        wanted = nodes.join(ends, "s", "left_semi").select("s", F.col("o.n").alias("n"))
        texts = materialize(rows.select("n", F.col("row.text").alias("text")).join(wanted, "n").select("s", "text").mapInArrow(_packed, "s long, text binary"), "texts", free=True)
        sides = pairs.join(texts.select(F.col("s").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("s").alias("b"), F.col("text").alias("y")), "b")
        out = materialize(sides.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "links", free=True)
        release(texts)
        return out

    near = indexed()
    linked = [verified(near)]
    known = components(linked[0])
    first = materialize(pairs(known, every=False), "pairs", free=True)
    release(known)
    linked.append(verified(first))
    known = components(linked[0].union(linked[1]))
    rest = materialize(pairs(known, every=True).join(first.union(near), ["a", "b"], "left_anti"), "pairs", free=True)
    release(known, near, first, shared)
    linked.append(verified(rest))
    roots = components(linked[0].union(linked[1]).union(linked[2]))
    release(rest, *linked)
    grouped = nodes.select("s", "o").join(roots, nodes["s"] == roots["node"], "left")
    stays = grouped.groupBy(F.coalesce("root", "s")).agg(F.min("o").alias("o")).select(F.col("o.n").alias("n"), F.lit(True).alias("keep"))
    return rows.select("row", "n").join(stays, "n", "left").select("row", F.coalesce("keep", F.lit(False)).alias("keep"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies (five words, 0.8)."""
    return near_copies(docs).where("keep").select("row.*")
