"""Exact top-k search by inner product with multi-resolution segment statistics.

For x and y of norms |x| and |y| the squared distance is |x|^2 + |y|^2 - 2 x.y, so a lower
bound of the distance is an upper bound of the product. Over a segment of L components with
means m and standard deviations s, x.y <= L m_x m_y + L s_x s_y. Levels of 1, 4 and 16
segments are tried in turn, coarse to fine; pairs whose bound stays below the query's k-th
best product so far are dropped, and exact integer products are taken of the survivors.

Candidates are dealt into blocks of bounded bytes, by place and not by id, and every query
goes to every block. A task sorts its rows by Spark: the candidates of a block come first
and are held, the queries stream past them. Nothing goes through the driver.

Edge cases: null vectors and vectors with a null, NaN or infinite component take no part;
vectors are compared with those of their own length; ties go to the smaller vec_id; equal
ids are not compared with each other; rows that repeat an id count once, with the best score
of their vectors, as candidates and as queries; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import one_thread, partitions, pieces

#: Bytes of the candidates of a block.
BLOCK_BYTES = 32 << 20
SEGMENTS = (1, 4, 16)
#: Candidates, and queries, that a task compares at a time: before bounds are known all pairs of a tile survive.
TILE = 256


def statistics(x: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each level a matrix of means and deviations, scaled so that a product of two rows is a bound."""
    out = []
    for n in SEGMENTS:
        cuts = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)
        size = np.diff(cuts).astype(float)
        mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
        square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
        dev = np.sqrt(np.maximum(square - mean * mean, 0))
        out.append(np.hstack([mean, dev]) * np.sqrt(np.hstack([size, size])))
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of paired rows; Python integers where 64 bits could overflow."""
    if not len(q):
        return np.zeros(0, np.int64)
    top = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if top < 2**62:
        return np.einsum("ij,ij->i", q, c)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c)]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in whole], np.int64)


class Best:
    """The k best of each query so far: scores descending, ids ascending on ties."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == -(2**63) else -score, q))
        q, ids, score = q[order], ids[order], score[order]
        same = np.append(False, (q[1:] == q[:-1]) & (ids[1:] == ids[:-1]))[: len(q)]
        q, ids, score = q[~same], ids[~same], score[~same]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = rank < self.k
        self.q, self.id, self.score = q[top], ids[top], score[top]
        full = rank == self.k - 1
        self.least[q[full]] = score[full]


class Tile:
    """Vectors of one length with their statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        whole = x.astype(float)
        self.stats, self.norm = statistics(whole), np.linalg.norm(whole, axis=1)


def search(query: Tile, other: Tile, best: Best) -> None:
    """Compares a tile of queries with a tile of candidates, coarse to fine."""
    # rounding of the bounds is far below this share of the norms
    slack = 1e-9 * (query.norm[:, None] * other.norm[None, :] + 1)
    bound = query.stats[0] @ other.stats[0].T + slack
    qi, ci = np.nonzero(bound >= best.least[:, None])
    for own, theirs in zip(query.stats[1:], other.stats[1:]):
        if len(qi) * 4 > bound.size:
            fine = (own @ theirs.T + slack)[qi, ci]
        else:
            fine = np.einsum("ij,ij->i", own[qi], theirs[ci]) + slack[qi, ci]
        keep = fine >= best.least[qi]
        qi, ci = qi[keep], ci[keep]
    keep = query.ids[qi] != other.ids[ci]
    qi, ci = qi[keep], ci[keep]
    score = exact(query.x[qi], other.x[ci])
    keep = score >= best.least[qi]
    best.add(qi[keep], other.ids[ci[keep]], score[keep])


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: float = 256.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query; vectors: vec_id and embedding."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    # components beyond 2^62 are held there; a guard stands in each as filters and projections may run in any order
    most = float(1 << 62)
    whole = F.transform(x, lambda v: F.floor(F.when(v.isNotNull() & ~F.isnan(v.cast("double")), F.greatest(F.lit(-most), F.least(F.lit(most), v.cast("double") * scale)))).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & (F.size(x) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    spark = vectors.sparkSession
    asked = is_query(F.col("vec_id"))
    size = rows.agg(F.sum(F.size("v")).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(asked).alias("queries")).first()
    # so many blocks that they are bounded; where that is few, some more for the tasks as long as the copies of the queries do not outgrow the rows
    blocks = max(pieces(8 * (size["n"] or 0), block_bytes), min(partitions(spark), size["rows"] // max(1, size["queries"])))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    held = rows.select(place.alias("block"), F.lit(False).alias("query"), "vec_id", "v")
    queries = rows.where(asked).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "v")
    dealt = held.union(queries).repartition(blocks, "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(_against(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(k: int):
    def run(batches):
        one_thread()
        block, tiles, waiting = None, {}, {}

        def answered(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*waiting.pop(dim)))
            query, best = Tile(ids, x), Best(len(ids), k)
            for n, other in enumerate(tiles.get(dim, ())):
                # statistics are made once, when the first queries come
                if not isinstance(other, Tile):
                    other = tiles[dim][n] = Tile(*other)
                search(query, other, best)
            return pa.RecordBatch.from_arrays([pa.array(ids[best.q], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for own, query, ids, x in _runs(batch):
                if own != block:
                    yield from map(answered, list(waiting))
                    block, tiles = own, {}
                dim = x.shape[1]
                for lo in range(0, len(ids), TILE):
                    part = ids[lo : lo + TILE], x[lo : lo + TILE]
                    if not query:
                        tiles.setdefault(dim, []).append(part)
                        continue
                    waiting.setdefault(dim, []).append(part)
                    if sum(len(i) for i, _ in waiting[dim]) >= TILE:
                        yield answered(dim)
        yield from map(answered, list(waiting))

    return run


def _runs(batch: pa.RecordBatch):
    """Runs of rows of one block, kind and length: block, whether they are queries, ids and a matrix."""
    block, query, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
    ends = batch.column(3).offsets.to_numpy()
    flat = batch.column(3).values.to_numpy(zero_copy_only=False)
    dim = np.diff(ends)
    new = np.append(True, (block[1:] != block[:-1]) | (query[1:] != query[:-1]) | (dim[1:] != dim[:-1]))[: len(ids)]
    start = np.flatnonzero(new).tolist()
    for a, b in zip(start, [*start[1:], len(ids)]):
        yield int(block[a]), bool(query[a]), ids[a:b].copy(), flat[ends[a] : ends[b]].reshape(b - a, -1).copy()


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
