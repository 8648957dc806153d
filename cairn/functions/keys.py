"""Column functions over object identities, keys and header values. Malformed input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the key format.
KEY_PREFIX, KEY_MAX, KEY_DIGITS, FILTER_BYTES, BLOOM_LETTERS = "brc2", 512, 20, 256, 342
_KEY = rf"^{KEY_PREFIX}-([0-9a-f]{{8,64}})-pack-([0-9]{{1,20}})-([0-9a-f]{{8,64}})-([0-9]{{6,20}})-([A-Za-z0-9_-]{{{BLOOM_LETTERS}}})-([0-9a-f]{{16,64}})\z"
_PATH = r"^/cache/(ac|cas)/([0-9a-f]{64})\z"
SAFE = (1 << 53) - 1
#: Labels whose hashes are the versions of stored objects and of packs.
OBJECT_VERSION_LABEL, PACK_VERSION_LABEL = "brc-raw-object-v1", "bazel-remote-pack-v1-raw-sha256"


def object_path(path: Column) -> Column:
    """struct(kind, digest) of a strict object path."""
    return F.when(path.rlike(_PATH), F.struct(F.regexp_extract(path, _PATH, 1).alias("kind"), F.regexp_extract(path, _PATH, 2).alias("digest")))


def safe_integer(text: Column) -> Column:
    """A canonical unsigned decimal that fits 53 bits."""
    value = text.try_cast("bigint")
    return F.when(text.rlike(r"^(0|[1-9][0-9]*)\z") & (value <= SAFE), value)


def key_integer(text: Column) -> Column:
    return F.when(text.rlike(r"^(0|[1-9][0-9]*)\z") & (F.length(text) <= KEY_DIGITS), text)


def unsigned64(value: Column) -> Column:
    wide = value.try_cast("decimal(38,0)")
    return F.when(wide.between(0, F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")), wide.cast("decimal(20,0)"))


def digest_hex(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9a-f]{64}\z"), value)


def version_of(label: str) -> Column:
    """The version identity of a format, from its label."""
    return F.sha2(F.lit(label).cast("binary"), 256)


def kind_name(code: Column) -> Column:
    return F.when(code == 0, "ac").when(code == 1, "cas")


def repository_part(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9_.-]+\z"), value)


def process_id(text: Column) -> Column:
    value = text.try_cast("bigint")
    return F.when(text.rlike(r"^[1-9][0-9]*\z") & (value <= (1 << 31) - 1), value)


def kind_code(kind: Column) -> Column:
    return F.when(kind == "ac", 0).when(kind == "cas", 1)


def object_key(namespace: Column, kind: Column, digest: Column) -> Column:
    key = F.concat_ws("-", namespace, kind, digest)
    return F.when((F.length(key) <= KEY_MAX) & ~key.contains(","), key)


def namespace_hash(namespace: Column) -> Column:
    return F.substring(F.sha2(namespace, 256), 1, 16)


def hashed_component(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9a-f]{8,64}\z"), value)


def base64url(raw: Column) -> Column:
    """Canonical, without padding or line breaks."""
    return F.translate(F.base64(raw), "+/=\r\n", "-_")


def key_prefix(ns_hash: Column) -> Column:
    return F.concat(F.lit(f"{KEY_PREFIX}-"), hashed_component(ns_hash), F.lit("-pack-"))


def filter_bytes(raw: Column) -> Column:
    """A filter of exactly FILTER_BYTES bytes."""
    return F.when(F.octet_length(raw) == FILTER_BYTES, raw)


def decoded_filter(text: Column) -> Column:
    """The bytes of a filter's text; null if it is not the canonical text of one."""
    letters = F.when(text.rlike(rf"^[A-Za-z0-9_-]{{{BLOOM_LETTERS}}}\z"), text)
    raw = filter_bytes(F.try_to_binary(F.concat(F.translate(letters, "-_", "+/"), F.lit("==")), F.lit("base64")))
    return F.when(base64url(raw) == text, raw)


def pack_key(ns_hash: Column, run: Column, job: Column, sequence: Column, bloom: Column, pack_id: Column) -> Column:
    """Key of a pack; null if a part is malformed or the key is too long. run and sequence are decimal texts."""
    number = key_integer(sequence)
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    ident = F.when(pack_id.rlike(r"^[0-9a-f]{16,64}\z"), pack_id)
    key = F.concat(key_prefix(ns_hash), key_integer(run), F.lit("-"), hashed_component(job), F.lit("-"), padded, F.lit("-"), base64url(filter_bytes(bloom)), F.lit("-"), ident)
    return F.when(F.length(key) <= KEY_MAX, key)


def parse_pack_key(key: Column) -> Column:
    """struct of a pack key's parts; null if it is not one in canonical form."""
    part = lambda i: F.regexp_extract(key, _KEY, i)
    run, seq = part(2), part(4)
    bare = F.regexp_replace(seq, "^0+(?=.)", "")
    canonical = (F.length(key) <= KEY_MAX) & key.rlike(_KEY) & key_integer(run).isNotNull() & decoded_filter(part(5)).isNotNull() & (F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare) == seq)
    return F.when(canonical, F.struct(part(1).alias("namespace_hash"), run.alias("run_id"), part(3).alias("job_hash"), bare.alias("sequence"), part(5).alias("bloom"), part(6).alias("pack_id")))
