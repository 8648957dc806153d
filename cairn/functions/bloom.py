"""The 2048-bit filter over object identities, as bit positions or packed bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import kind_code

#: Fixed values of the filter: label, bits and number of hashes.
LABEL, BITS, HASHES = b"brc2-bloom-v1\0", 2048, 5


def positions(kind: Column, digest: Column) -> Column:
    """The bits of an identity (digest: 64 hex digits)."""
    code = F.unhex(F.lpad(F.hex(kind_code(kind)), 2, "0"))

    def one(i: int) -> Column:
        head = F.sha2(F.concat(F.lit(LABEL), F.lit(bytes([i])), code, F.unhex(digest)), 256)
        return (F.conv(F.substring(head, 1, 4), 16, 10).cast("int") % BITS).cast("int")

    return F.array(*[one(i) for i in range(HASHES)])


def build(members: DataFrame, *by: str) -> DataFrame:
    """by and bits: the ascending set bits of the filter over the members (kind, digest) of each group; at most 2048."""
    return members.select(*by, F.explode(positions(F.col("kind"), F.col("digest"))).alias("bit")).groupBy(*by).agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def packed(bits: Column) -> Column:
    """256 bytes of a filter, the lowest bit of a byte first."""
    byte = lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 8) == k), F.lit(0), lambda a, b: a + F.pow(F.lit(2.0), b % 8).cast("int"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), ""))


def may_contain(bits: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, bits)) == 0


def filter_of(members: Iterable[tuple[str, bytes]]) -> bytes:
    """The packed filter of some (kind, digest)."""
    out = bytearray(BITS // 8)
    for kind, digest in members:
        for i in range(HASHES):
            head = hashlib.sha256(LABEL + bytes([i, ("ac", "cas").index(kind)]) + digest).digest()
            bit = int.from_bytes(head[:2], "big") % BITS
            out[bit // 8] |= 1 << bit % 8
    return bytes(out)
