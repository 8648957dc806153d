"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch (a run of spaces with the word after it) lie in one
flat symbol array. Every round each sequence applies its lowest-ranked pair, the leftmost
on ties, all sequences at once; when no sequence has a pair left, the surviving symbols
are counted. Symbols without a piece count one token for each of their UTF-8 bytes.

Edge cases: null and empty texts have 0 bytes and 0 tokens; rows are independent, so
repeated rows repeat their counts; an empty table gives no rows; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._util import text_slices

NONE = np.int64(1) << 40
SPACE = "▁"
#: Pre-tokens: merges cannot cross the start of a run of spaces, nor a line feed.
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: From this many symbols on a pre-token is merged with a heap, as rounds would be too many.
LONG = 256
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBER = 400_000


class PieceCounter:
    """Counts tokens as the piece model would, from its vocabulary and scores alone."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [(-sp.get_score(i), i) for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        words = [sp.id_to_piece(i) for _, i in sorted(normal)]
        self.id = {w: k for k, w in enumerate(words)}
        self.n_pieces = len(words)
        for c in sorted({c for w in words for c in w}):
            self.id.setdefault(c, len(self.id))
        self.names = list(self.id)
        self.base = np.int64(len(self.id) + 1)
        self.chars = np.full(0x110000, -1, np.int64)
        for w, k in self.id.items():
            if len(w) == 1:
                self.chars[ord(w)] = k
        pairs = {}
        for rank, w in enumerate(words):
            for cut in range(1, len(w)):
                a, b = self.id.get(w[:cut]), self.id.get(w[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.base) + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        inside = {(ord(w[i]) << 21) | ord(w[i + 1]) for w in words for i in range(len(w) - 1)}
        self.inside = np.array(sorted(inside), np.int64)
        self.memory: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, which is also the merged symbol; NONE if there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each of the (non-empty) pre-tokens."""
        out = np.zeros(len(units), np.int64)
        if not units:
            return out
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), lens)
        first = np.ones(len(points), bool)
        if len(points) > 1:
            # no piece holds these two characters side by side: no merge crosses here
            two = (points[:-1] << 21) | points[1:]
            at = np.minimum(np.searchsorted(self.inside, two), len(self.inside) - 1)
            first[1:] = (owner[1:] != owner[:-1]) | (self.inside[at] != two)
        sym = self.chars[points]
        # a character without any symbol stands alone, at the price of its bytes
        cost = np.where((sym >= 0) & (sym < self.n_pieces), 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(points)))
        single = sizes == 1
        np.add.at(out, owner[starts[single]], cost[starts[single]])
        for s, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            out[owner[s]] += self._count_long(sym[s : s + n].tolist(), cost[s : s + n].tolist())
        some = ~single & (sizes <= LONG)
        mask = np.repeat(some, sizes)
        sym, cost = sym[mask], cost[mask]
        sizes, own = sizes[some], owner[starts[some]]
        if not len(sym):
            return out
        last = np.cumsum(sizes) - 1
        rank = np.full(len(sym), NONE, np.int64)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[last] = NONE
        while len(sym):
            begin = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, begin)
            live = least < NONE
            if not live.all():
                np.add.at(out, own[~live], np.add.reduceat(cost, begin)[~live])
                mask = np.repeat(live, sizes)
                sym, cost, rank = sym[mask], cost[mask], rank[mask]
                sizes, own, least = sizes[live], own[live], least[live]
                if not len(sym):
                    break
            seq = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(rank == least[seq])
            hit = hit[np.append(True, seq[hit][1:] != seq[hit][:-1])]
            sym[hit] = least
            cost[hit] = 1
            rank[hit] = rank[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, cost, rank = sym[keep], cost[keep], rank[keep]
            sizes = sizes - 1
            end = np.cumsum(sizes)
            now = hit - np.arange(len(hit))
            right = now < end - 1
            rank[now[right]] = self._rank(sym[now[right]], sym[now[right] + 1])
            rank[now[~right]] = NONE
            left = now > end - sizes
            rank[now[left] - 1] = self._rank(sym[now[left] - 1], sym[now[left]])
        return out

    def _count_long(self, sym: list[int], cost: list[int]) -> int:
        """The same merges for one very long sequence, ordered by a heap."""
        base, pairs, n = int(self.base), self.pairs, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int, j: int) -> int | None:
            return pairs.get(sym[i] * base + sym[j]) if sym[i] >= 0 and sym[j] >= 0 else None

        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], cost[i], cost[j] = r, -2, 1, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (q, i, r, sym[after[i]]))
            if before[i] >= 0 and (q := rank(before[i], i)) is not None:
                heapq.heappush(heap, (q, before[i], sym[before[i]], r))
        return sum(cost)

    def count(self, texts: list[str]) -> list[int]:
        split = [UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        here = set().union(*split)
        if len(self.memory) > REMEMBER:
            self.memory = {u: n for u, n in self.memory.items() if u in here}
        known = self.memory
        fresh = list(here.difference(known))
        known.update(zip(fresh, self.count_units(fresh).tolist()))
        return [sum(map(known.__getitem__, u)) for u in split]


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text."""

    def run(batches):
        count = counter(model_file).count
        for batch in batches:
            for ids, texts in text_slices(batch):
                texts = [t or "" for t in texts]
                n = count(texts)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
