"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a slice of a partition lie in one linked symbol list. An index
maps each pair's rank to all positions where it stands. Ranks are taken in ascending
order; a rank is applied at all its positions, left to right, and the lists of the pairs
that its merges make are extended. Encoded pre-tokens are remembered between slices.

Edge cases: null and empty texts have no tokens and decode to the empty text; repeated
rows repeat their results; the strings of added tokens inside a text become those tokens;
an empty table gives no rows; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._util import text_slices

REMEMBER = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.made, self.parts, keys, born = [], [], [], {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            if max(born.get(pair[0], -1), born.get(pair[1], -1)) >= r or new in born:
                raise ValueError("merges are not in the order in which their parts arise")
            born[new] = r
            keys.append(pair[0] << 32 | pair[1])
            self.made.append(new)
            self.parts.append(pair)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], order.astype(np.int64)
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.bytes[i] = bytes(to_byte[c] for c in token)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in added.items():
            self.bytes[i] = content.encode()
        self.added = added
        self.added_in = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = splitter(pattern)
        self.forget()

    def forget(self, keep: list[str] = ()) -> None:
        """Drops the remembered pre-tokens but those in `keep`."""
        old = getattr(self, "code", {})
        kept = [u for u in keep if u in old]
        codes = [old[u] for u in kept]
        # a unit that is not yet known gets the next number when it is looked up
        self.units, self.code = kept, defaultdict(count(len(kept)).__next__, {u: k for k, u in enumerate(kept)})
        self.ids = [self.ids[c] for c in codes] if codes else []
        self.text = [self.text[c] for c in codes] if codes else []
        self.plain = [self.plain[c] for c in codes] if codes else []

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of each (non-empty) pre-token, all merged together through the pair index."""
        if not units:
            return []
        # byte 0xFF is in no UTF-8 text and parts the units
        raw = np.frombuffer(b"\xff" + b"\xff".join(u.encode() for u in units) + b"\xff", np.uint8)
        sym = np.array(self.first, np.int32)[raw]
        sym[raw == 255] = -1
        after, before = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            some = ranks >= 0
            if not some.any():
                return
            ranks, positions = ranks[some], positions[some]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for hi, r in zip([*cuts.tolist(), len(ranks)], ranks[np.append(0, cuts)].tolist()):
                if r in where:
                    where[r].append(positions[lo:hi])
                else:
                    where[r] = [positions[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        add(self._rank(sym[:-1], sym[1:]), np.arange(len(sym) - 1, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = where.pop(r)
            (a, b), new = self.parts[r], self.made[r]
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            nxt = after[at]
            good = (sym[at] == a) & (sym[nxt] == b)
            if a == b and len(at) > 1:
                # in a run of the same symbol each second pair is used up by the one before it
                at, nxt = at[good], nxt[good]
                chained = np.append(False, nxt[:-1] == at[1:])
                index = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, index))
                good = (index - run) % 2 == 0
            at, nxt = at[good], nxt[good]
            if not len(at):
                continue
            far = after[nxt]
            sym[at], sym[nxt] = new, -2
            after[at], before[far] = far, at
            prev = before[at]
            made = np.full(len(at), new, np.int32)
            add(np.concatenate([self._rank(made, sym[far]), self._rank(sym[prev], made)]), np.concatenate([at, prev]))
        sym = sym[sym != -2]
        ends = np.flatnonzero(sym == -1)
        flat = sym.tolist()
        return [tuple(flat[i + 1 : j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """Each text as the numbers of its pre-tokens, whose ids are then in self.ids."""
        split, added = self.split, self.added
        number = self.code.__getitem__
        out = []
        for t in texts:
            if self.added_in is not None and any(c in t for c in added):
                found = [[(p,)] if k % 2 else split(p) for k, p in enumerate(self.added_in.split(t))]
                found = list(chain.from_iterable(found))
            else:
                found = split(t)
            out.append(np.fromiter(map(number, found), np.int32, len(found)))
        units = self.units
        units.extend(islice(self.code, len(units), None))
        fresh = units[len(self.ids) :]
        plain = [u for u in fresh if isinstance(u, str)]
        ids = iter(self.encode_units(plain))
        for u in fresh:
            x = next(ids) if isinstance(u, str) else (added[u[0]],)
            self.ids.append(x)
            self.text.append(",".join(map(str, x)))
            self.plain.append(b"".join(map(self.bytes.__getitem__, x)))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [list(chain.from_iterable(map(self.ids.__getitem__, c.tolist()))) for c in self.codes(texts)]
        self.tidy(())
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and of what they decode to; the decoded bytes of a pre-token's ids are made once."""
        out = []
        all_codes = self.codes(texts)
        for c in all_codes:
            c = c.tolist()
            ids = ",".join(map(self.text.__getitem__, c))
            back = b"".join(map(self.plain.__getitem__, c))
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()))
        self.tidy(all_codes)
        return out

    def tidy(self, used) -> None:
        """Keeps memory bounded: when too many pre-tokens are remembered, those that occur at least twice in the last texts stay."""
        if len(self.units) > REMEMBER:
            seen = np.bincount(np.concatenate([*used, np.zeros(0, np.int32)]), minlength=len(self.units))
            self.forget([self.units[k] for k in np.flatnonzero(seen > 1).tolist()][:REMEMBER])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def splitter(pattern: str):
    """findall of the pattern; texts of characters below U+0250 take an equal pattern that the faster library knows."""
    full = regex.compile(pattern).findall
    below = [chr(i) for i in range(0x250)]
    classes = {}
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        classes[name] = "".join(re.escape(c) for c in below if regex.fullmatch(name, c))
    plain = pattern.replace("\\S", "[^" + classes["\\s"] + "]")
    plain = re.sub(r"\[\^[^\]]*\\p[^\]]*\]", lambda m: "[^" + "".join(classes.values()) + "]" if m[0] == r"[^\s\p{L}\p{N}]" else m[0], plain)
    for name, members in classes.items():
        plain = plain.replace(name, f"[{members}]")
    if "\\p" in plain:
        return full
    fast, other = re.compile(plain).findall, re.compile("[^\\x00-\u024f]").search
    return lambda text: full(text) if other(text) else fast(text)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every whole text."""

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            for ids, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(t.encode([x or "" for x in texts]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of token ids; a null list is the empty text."""

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            # some hundred rows at a time, as texts may be long
            for lo in range(0, batch.num_rows, 256):
                ids, tokens = (c.slice(lo, 256) for c in batch.columns)
                texts = [t.decode(tokens[k].as_py() or []) for k in range(len(tokens))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens and the digests of ids and decoded text."""

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            for ids, texts in text_slices(batch):
                n, encoded, decoded = zip(*t.digests([x or "" for x in texts]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_bpe(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, as bpe_digests gives them.

    Null and empty texts have no tokens and the digests of empty texts; rows with equal or null
    ids and repeated rows have a row each; an empty table gives none; other columns are ignored.
    """
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
