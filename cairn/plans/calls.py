"""Queries over commits, reads and stored bodies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, status
from ..operators import commits, lookup, packs
from . import tables as t
from .register import query

_RESULTS = ("ok", "limited", "ok", "retryable", "ok", "conflict", "miss", "ok", "miss", "fatal")
_CALLS = f"""{t.LOG}, calls AS (SELECT ord // 16 AS entry, ord, [{", ".join(map(repr, _RESULTS))}][CAST((size + ord * 7) % {len(_RESULTS)} + 1 AS INT)] AS result, row_number() OVER (PARTITION BY ord // 16 ORDER BY ord) AS i FROM log),
f AS (SELECT entry, CAST(0 AS BIGINT) AS i, 'reserve' AS st, '' AS why, 0 AS looks, 0 AS up, 0 AS fin, CAST(NULL AS BIGINT) AS delay_ms FROM (SELECT DISTINCT entry FROM calls)
 UNION ALL SELECT entry, i, now, CASE WHEN now = 'look' AND st <> 'look' THEN st || ' ' || result ELSE why END, CASE WHEN now = 'look' AND st <> 'look' THEN 0 WHEN st = 'look' THEN looks + 1 ELSE looks END,
  up + CASE WHEN waits = 'upload' THEN 1 ELSE 0 END, fin + CASE WHEN waits = 'finalize' THEN 1 ELSE 0 END, CASE waits WHEN 'upload' THEN CAST(least(10000, 250 * pow(2, up)) AS BIGINT) WHEN 'finalize' THEN CAST(least(10000, 250 * pow(2, fin)) AS BIGINT) END
 FROM (SELECT *, CASE WHEN st = 'upload' AND result = 'retryable' THEN 'upload' WHEN st = 'look' AND looks = 4 AND result IN ('miss', 'limited') AND why = 'finalize retryable' THEN 'finalize' END AS waits,
  CASE WHEN st IN ('created', 'already-exists', 'retry', 'failed') THEN st
   WHEN st = 'look' THEN CASE WHEN result = 'ok' THEN 'already-exists' WHEN result = 'retryable' THEN 'retry' WHEN result IN ('fatal', 'conflict') THEN 'failed' WHEN looks < 4 THEN 'look' WHEN why = 'reserve conflict' THEN 'retry' WHEN why = 'finalize conflict' THEN 'failed' ELSE split_part(why, ' ', 1) END
   WHEN result = 'miss' THEN st
   WHEN st = 'reserve' THEN CASE result WHEN 'ok' THEN 'upload' WHEN 'retryable' THEN 'retry' WHEN 'fatal' THEN 'failed' ELSE 'look' END
   WHEN st = 'upload' THEN CASE result WHEN 'ok' THEN 'finalize' WHEN 'limited' THEN 'look' WHEN 'retryable' THEN 'upload' ELSE 'failed' END
   ELSE CASE result WHEN 'ok' THEN 'created' WHEN 'fatal' THEN 'failed' ELSE 'look' END END AS now
  FROM (SELECT c.entry, c.i, c.result, f.st, f.why, f.looks, f.up, f.fin FROM f JOIN calls c ON c.entry = f.entry AND c.i = f.i + 1)))"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    result = F.element_at(F.array(*map(F.lit, _RESULTS)), ((F.col("size") + F.col("ord") * 7) % len(_RESULTS) + 1).cast("int"))
    return t.log(spark, d).select(F.floor(F.col("ord") / 16).alias("entry"), "ord", result.alias("result"))


@query(f"WITH RECURSIVE {_CALLS} SELECT entry, c.ord, c.result, f.st AS next, f.delay_ms FROM f JOIN calls c USING (entry, i)")
def commit_calls(spark: SparkSession, d: str) -> DataFrame:
    return commits.commits(_calls(spark, d), "entry")


@query(f"WITH RECURSIVE {_CALLS} SELECT entry, CASE WHEN arg_max(st, i) IN ('created', 'already-exists', 'retry', 'failed') THEN arg_max(st, i) ELSE 'open' END AS outcome, count(*) AS calls, CAST(coalesce(sum(delay_ms), 0) AS BIGINT) AS waited_ms FROM f WHERE i > 0 GROUP BY entry")
def commit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return commits.outcomes(commits.commits(_calls(spark, d), "entry"), "entry")


@query(f"""WITH {t.LOG} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'pack-' || CAST(ord AS VARCHAR) ELSE 'brc-v1-main-' || kind || '-sha256-' || digest END AS entry_key, sha256(CASE WHEN ord % 3 = 0 THEN 'bazel-remote-pack-v1-raw-sha256' ELSE 'brc-raw-object-v1' END) AS entry_version FROM log""")
def prepared_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = t.log(spark, d).withColumn("pack_key", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("pack-"), F.col("ord").cast("string"))))
    return commits.prepared(rows, "ord", F.lit("main")).select("ord", "entry_key", "entry_version")


_STATUS = "[408, 429, 503, 404, NULL, 500][CAST(event_id % 6 + 1 AS INT)]"


@query(f"""SELECT event_id, s IS NULL OR s IN (408, 500, 502, 503, 504) AS retryable, coalesce(s = 429, false) AS limited, CASE WHEN ms IS NOT NULL AND regexp_full_match(ms, '[0-9]+') THEN CASE WHEN TRY_CAST(ms AS BIGINT) <= 9007199254740991 THEN TRY_CAST(ms AS BIGINT) END ELSE CASE WHEN event_id % 2 = 0 THEN user_id * 1000 END END AS retry_ms,
CAST(least(10000, 250 * pow(2, event_id % 9)) AS BIGINT) AS delay_ms, CASE WHEN event_id % 5 < 4 THEN CAST(100 * pow(2, event_id % 5) AS BIGINT) END AS look_ms
FROM (SELECT *, {_STATUS} AS s, CASE user_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '9007199254740992' WHEN 2 THEN '1s' END AS ms FROM events)""")
def blob_errors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    s = F.element_at(F.array(*[F.lit(x).cast("int") for x in (408, 429, 503, 404, None, 500)]), (F.col("event_id") % 6 + 1).cast("int"))
    ms = F.expr("CASE user_id % 4 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN '9007199254740992' WHEN 2 THEN '1s' END")
    b = status.blob_error(s, ms, F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")), F.lit(0).cast("bigint"))
    return e.select("event_id", b.alias("b"), status.commit_delay_ms(F.col("event_id") % 9).alias("delay_ms"), status.look_delay_ms(F.col("event_id") % 5).alias("look_ms")).select("event_id", "b.*", "delay_ms", "look_ms")


@query("""SELECT event_id, CAST(strlen(props) AS BIGINT) AS size, CASE WHEN strlen(props) <= 10 + event_id % 20 AND (event_id % 3 > 0 OR strlen(props) = 10 + event_id % 4) THEN sha256(props) END AS sha256,
CASE WHEN strlen(props) > 10 + event_id % 20 THEN 413 WHEN event_id % 3 = 0 AND strlen(props) <> 10 + event_id % 4 THEN 400 ELSE 200 END AS status FROM events""")
def spooled_bodies(spark: SparkSession, d: str) -> DataFrame:
    expected = F.when(F.col("event_id") % 3 == 0, 10 + F.col("event_id") % 4)
    body = status.spooled(F.col("props").cast("binary"), expected, 10 + F.col("event_id") % 20)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", body.alias("b")).select("event_id", "b.*")


_CANDIDATES = f"""{t.CATALOG}, c AS (SELECT 'p' || CAST(id % 300 AS VARCHAR) AS probe_id, CASE WHEN ref = 'refs/heads/main' THEN 0 ELSE 1 END AS turn, id AS pack, key, version, created_at, id % 5 <> 0 AS intact, size_bytes % 3 = 0 AS holds FROM catalog),
o AS (SELECT *, row_number() OVER (PARTITION BY probe_id, key, version ORDER BY turn, created_at DESC, pack DESC) AS k FROM c WHERE version = 'v1'),
r AS (SELECT *, coalesce(max(CASE WHEN intact AND holds THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id ORDER BY turn, created_at DESC, pack DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE k = 1)"""


@query(f"""WITH {_CANDIDATES}, s AS (SELECT probe_id, max(CASE WHEN intact AND holds THEN pack END) AS pack, count(*) AS tried, count_if(NOT intact) AS errors, count_if(intact AND NOT holds) AS false_positives FROM r WHERE before = 0 GROUP BY probe_id)
SELECT probe_id, pack, coalesce(tried, 0) AS tried, coalesce(errors, 0) AS errors, coalesce(false_positives, 0) AS false_positives FROM (SELECT DISTINCT probe_id FROM c) LEFT JOIN s USING (probe_id)""")
def materialized_objects(spark: SparkSession, d: str) -> DataFrame:
    c = t.catalog(spark, d).select(
        F.concat(F.lit("p"), (F.col("id") % 300).cast("string")).alias("probe_id"), F.when(F.col("ref") == "refs/heads/main", 0).otherwise(1).alias("turn"), F.col("id").alias("pack"), "key", "version", "created_at",
        (F.col("id") % 5 != 0).alias("intact"), (F.col("size_bytes") % 3 == 0).alias("holds"),
    )
    return lookup.materialized(c, "v1")


@query("""WITH q AS (SELECT c_custkey, CAST(c_custkey % 700 AS VARCHAR) AS key, 'v' || CAST(c_custkey % 2 AS VARCHAR) AS version FROM customer), e AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key, 'v' || CAST(o_orderkey % 2 AS VARCHAR) AS version FROM orders WHERE o_orderkey % 3 = 0)
SELECT c_custkey, key, version, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.key = q.key AND e.version = q.version) THEN 'hit' WHEN EXISTS (SELECT 1 FROM e WHERE e.version = q.version AND starts_with(e.key, q.key)) THEN 'not exact' ELSE 'miss' END AS found FROM q""")
def exact_lookups(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 700).cast("string").alias("key"), F.concat(F.lit("v"), F.col("c_custkey") % 2).alias("version"))
    entries = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit("v"), F.col("o_orderkey") % 2).alias("version"))
    return lookup.exact(asked, entries).select("c_custkey", "key", "version", "found")


_READS = f"{t.LOG}, c AS (SELECT ord // 2 AS read, ord, [401, 200, 403, 500, 200, 429][CAST((ord + size) % 6 + 1 AS INT)] AS status, size % 5 = 0 OR (ord + size) % 6 = 5 AS limited FROM log), r AS (SELECT *, status IN (401, 403) AND NOT limited AND row_number() OVER (PARTITION BY read ORDER BY ord) = 1 AS first_, status >= 400 AS bad FROM c)"


@query(f"WITH {_READS} SELECT read, CASE WHEN NOT arg_max(bad, ord) THEN 'served' WHEN arg_max(limited, ord) THEN 'limited' ELSE 'failed' END AS outcome, count_if(bad AND NOT first_) AS errors, count_if(first_) AS refreshed FROM r GROUP BY read")
def read_attempts(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, (401, 200, 403, 500, 200, 429))), ((F.col("ord") + F.col("size")) % 6 + 1).cast("int"))
    rows = t.log(spark, d).select(F.floor(F.col("ord") / 2).alias("read"), "ord", s.alias("status"), ((F.col("size") % 5 == 0) | ((F.col("ord") + F.col("size")) % 6 == 5)).alias("limited"))
    return lookup.attempts(rows, "read")


_RAW = "unhex(CASE p_partkey % 4 WHEN 0 THEN 'abcd' WHEN 1 THEN repeat(sha256(p_name), 9) ELSE repeat(sha256(p_name), 8) END)"
_B64 = f"replace(replace(replace(base64({_RAW}), '=', ''), '+', '-'), '/', '_')"
_TEXT = f"CASE WHEN p_partkey % 4 = 2 THEN substr({_B64}, 1, 341) || 'B' ELSE {_B64} END"


@query(f"""SELECT p_partkey, strlen(x) = 342 AND p_partkey % 4 = 3 AS decodes, CASE WHEN p_partkey % 4 = 3 THEN upper(repeat(sha256(p_name), 8)) END AS raw, p_partkey % 4 >= 2 AS has_key, p_partkey % 4 = 3 AS parses FROM (SELECT *, {_TEXT} AS x FROM part)""")
def filter_texts(spark: SparkSession, d: str) -> DataFrame:
    """Filters of two, 288 and 256 bytes, and texts whose last letter has bits beyond the last byte."""
    hashed = F.sha2("p_name", 256)
    k = F.col("p_partkey") % 4
    raw = F.unhex(F.when(k == 0, "abcd").when(k == 1, F.repeat(hashed, 9)).otherwise(F.repeat(hashed, 8)))
    plain = keys.base64url(raw)
    text = F.when(k == 2, F.concat(F.substring(plain, 1, 341), F.lit("B"))).otherwise(plain)
    bare = F.substring(hashed, 1, 16)
    key = keys.pack_key(bare, F.lit("7"), bare, F.lit("3"), raw, bare)
    spoilt = F.concat(F.lit("brc2-"), bare, F.lit("-pack-7-"), bare, F.lit("-000003-"), text, F.lit("-"), bare)
    found = keys.decoded_filter(text)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", found.isNotNull().alias("decodes"), F.hex(found).alias("raw"), key.isNotNull().alias("has_key"), keys.parse_pack_key(spoilt).isNotNull().alias("parses"))


_ENTRIES = f"""{t.MEMBERS}, e AS (SELECT pack, CASE WHEN ord % 31 = 7 THEN 'xx' ELSE kind END AS kind, row_number() OVER w - 1 + CASE WHEN pack % 3 = 1 AND ord > 60 THEN 1 ELSE 0 END AS ordinal, CASE WHEN ord % 29 = 3 THEN sha256(digest) ELSE digest END AS digest,
CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY pack ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN ord % 23 = 5 THEN 1 ELSE 0 END AS BIGINT) AS "offset", strlen(payload) AS length, CASE WHEN ord % 19 = 2 THEN 'other' ELSE CASE WHEN ord % 29 = 3 THEN sha256(digest) ELSE digest END END AS body_sha256
FROM members WINDOW w AS (PARTITION BY pack ORDER BY ord)), f AS (SELECT * FROM e UNION ALL SELECT pack, kind, ordinal + 1000, digest, "offset", length, body_sha256 FROM e WHERE ordinal = 4)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("pack").orderBy("ord")
    n = F.octet_length("payload").cast("long")
    digest = F.when(F.col("ord") % 29 == 3, F.sha2("digest", 256)).otherwise(F.col("digest"))
    e = t.members(spark, d).select(
        "pack", F.when(F.col("ord") % 31 == 7, "xx").otherwise(F.col("kind")).alias("kind"), (F.row_number().over(w) - 1 + F.when((F.col("pack") % 3 == 1) & (F.col("ord") > 60), 1).otherwise(0)).cast("long").alias("ordinal"), digest.alias("digest"),
        (F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("ord") % 23 == 5, 1).otherwise(0)).alias("offset"), n.alias("length"), F.when(F.col("ord") % 19 == 2, "other").otherwise(digest).alias("body_sha256"),
    )
    return e.union(e.where("ordinal = 4").withColumn("ordinal", F.col("ordinal") + 1000))


@query(f"""WITH {_ENTRIES}, w AS (SELECT *, row_number() OVER o - 1 AS place, coalesce(sum(length) OVER (PARTITION BY pack ORDER BY ordinal, kind, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_, count(*) OVER (PARTITION BY pack, kind, digest) AS times FROM f WINDOW o AS (PARTITION BY pack ORDER BY ordinal, kind, digest))
SELECT pack, ordinal, kind, digest, CASE WHEN kind NOT IN ('ac', 'cas') THEN 'kind' WHEN ordinal <> place THEN 'ordinal' WHEN "offset" <> start_ THEN 'offset' WHEN kind = 'cas' AND digest <> body_sha256 THEN 'digest' WHEN times > 1 THEN 'identity' END AS problem FROM w""")
def entry_problems(spark: SparkSession, d: str) -> DataFrame:
    return packs.entry_problems(_entries(spark, d), "pack").select("pack", "ordinal", "kind", "digest", "problem")


@query(f"""WITH {t.LOG} SELECT ord, CASE WHEN strlen(body) < size - writer % 7 THEN 'short' WHEN strlen(body) > size - writer % 7 THEN 'long' WHEN sha256(body) <> body_sha256 THEN 'changed' END AS problem FROM log""")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = t.log(spark, d).select("ord", F.col("body").cast("binary").alias("payload"), (F.col("size") - F.col("writer") % 7).alias("size"), "body_sha256")
    return packs.checked_sources(rows).select("ord", "problem")


@query(f"""WITH {t.MEMBERS}, i AS (SELECT pack, kind, digest, row_number() OVER (PARTITION BY pack ORDER BY ord) - 1 AS ordinal, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY pack ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", strlen(payload) AS length FROM members)
SELECT m.pack * 100 + m.ord AS probe_id, i.pack, i.ordinal, i."offset", i.length FROM members m JOIN i ON i.kind = m.kind AND i.digest = m.digest""")
def held_objects(spark: SparkSession, d: str) -> DataFrame:
    m = t.members(spark, d)
    return lookup.held(m.select((F.col("pack") * 100 + F.col("ord")).alias("probe_id"), "kind", "digest"), packs.index_rows(packs.seal(m, "pack"), "pack"))
