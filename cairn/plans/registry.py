"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom, keys, redact, status
from ..operators import ingest, lookup, packs, pacing
from . import calls, control, service  # noqa: F401  register their queries
from . import tables as t
from .register import oracle_sql, queries, query  # noqa: F401


# --- ingest log


@query(f"WITH {t.OUTCOMES} SELECT ord, kind, digest, outcome FROM outcome")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.outcomes(t.log(spark, d)).select("ord", "kind", "digest", "outcome")


def _sequenced(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sequenced(ingest.outcomes(t.log(spark, d)).where("outcome = 'accepted'"))


@query(f"WITH {t.SEQUENCED} SELECT ord, kind, position, cas_sequence, cas_barrier FROM sequenced")
def ingest_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _sequenced(spark, d).select("ord", "kind", "position", "cas_sequence", "cas_barrier")


@query(f"""WITH RECURSIVE {t.LOG}, n AS (SELECT writer, ord, size, row_number() OVER (PARTITION BY writer ORDER BY ord) AS i FROM log),
f AS (SELECT writer, ord, size, i, CAST(0 AS BIGINT) AS batch, 1 AS c, size AS held FROM n WHERE i = 1
 UNION ALL SELECT n.writer, n.ord, n.size, n.i,
   CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN f.batch + 1 ELSE f.batch END,
   CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN 1 ELSE f.c + 1 END,
   CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN n.size ELSE f.held + n.size END
 FROM f JOIN n ON n.writer = f.writer AND n.i = f.i + 1)
SELECT writer, ord, size, batch FROM f""")
def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    return ingest.batches(t.log(spark, d), "writer", 8, 250)


_SEQ = "SELECT writer, row_number() OVER (PARTITION BY writer ORDER BY ord) AS sequence, ord % 17 <> 3 AS completed FROM log"


@query(f"""WITH {t.LOG}, s AS ({_SEQ}), c AS (SELECT writer, sequence, row_number() OVER (PARTITION BY writer ORDER BY sequence) AS place FROM s WHERE completed)
SELECT w.writer, CAST(coalesce(max(c.sequence), 0) AS BIGINT) AS watermark FROM (SELECT DISTINCT writer FROM s) w
LEFT JOIN c ON c.writer = w.writer AND c.sequence = c.place GROUP BY w.writer""")
def durable_watermark(spark: SparkSession, d: str) -> DataFrame:
    rows = t.log(spark, d).select("writer", F.row_number().over(Window.partitionBy("writer").orderBy("ord")).alias("sequence"), (F.col("ord") % 17 != 3).alias("completed"))
    return ingest.watermark(rows, "writer")


@query(f"""WITH {t.SEQUENCED}, k AS (SELECT * FROM sequenced WHERE ord % 3 <> 1),
c AS (SELECT *, coalesce(max(cas_sequence) OVER (PARTITION BY writer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM k)
SELECT writer, ord, cas_barrier, CAST(covered AS BIGINT) AS covered FROM c WHERE kind = 'ac' AND cas_barrier > covered""")
def barrier_violations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.barrier_violations(_sequenced(spark, d).where("ord % 3 <> 1"), "writer").select("writer", "ord", "cas_barrier", F.col("covered").cast("long").alias("covered"))


@query(f"""WITH {t.SEQUENCED} SELECT writer, CAST(coalesce(min(cas_sequence) - 1, max(cas_barrier), 0) AS BIGINT) AS durable, count(*) AS pending
FROM sequenced WHERE ord % 7 = 0 GROUP BY writer""")
def recovery_state(spark: SparkSession, d: str) -> DataFrame:
    return ingest.recovery(_sequenced(spark, d).where("ord % 7 = 0"), "writer")


@query(f"""WITH {t.LOG}, p AS (SELECT writer, ord, sum(CASE WHEN ord % 3 = 2 THEN -size ELSE size END) OVER (PARTITION BY writer ORDER BY ord) AS held FROM log)
SELECT writer, CAST(max(held) AS BIGINT) AS peak, CAST(arg_max(held, ord) AS BIGINT) AS gauge FROM p GROUP BY writer""")
def pending_gauge(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("ord") % 3 == 2, -F.col("size")).otherwise(F.col("size"))
    held = t.log(spark, d).select("writer", "ord", F.sum(delta).over(Window.partitionBy("writer").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)).alias("held"))
    return held.groupBy("writer").agg(F.max("held").alias("peak"), F.max_by("held", "ord").alias("gauge"))


@query(f"""WITH {t.LOG} SELECT ord, kind, digest FROM log WHERE ord % 9 = 0 ORDER BY ord LIMIT 100""")
def remaining_objects(spark: SparkSession, d: str) -> DataFrame:
    return t.log(spark, d).where("ord % 9 = 0").orderBy("ord").limit(100).select("ord", "kind", "digest")


@query(f"""WITH {t.LOG}, g AS (SELECT ord, kind, writer, CAST(coalesce(max(CAST(kind = 'cas' AND event_type = 'error' AS INT)) OVER (PARTITION BY writer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BOOLEAN) AS failed FROM log)
SELECT ord, writer, failed AS suppressed FROM g WHERE kind = 'ac'""")
def integrity_gate(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("writer").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max(((F.col("kind") == "cas") & (F.col("event_type") == "error")).cast("int")).over(before), F.lit(0)).cast("boolean")
    return t.log(spark, d).withColumn("suppressed", failed).where("kind = 'ac'").select("ord", "writer", "suppressed")


# --- pacing


@query(f"""WITH {t.LOG}, i AS (SELECT writer, ord, at_ms, row_number() OVER w - 1 AS i FROM log WINDOW w AS (PARTITION BY writer ORDER BY at_ms, ord)),
m AS (SELECT *, max(at_ms - i * 60000) OVER (PARTITION BY writer ORDER BY at_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i)
SELECT writer, ord, CAST(CASE WHEN i = 0 THEN at_ms ELSE greatest(at_ms, i * 60000 + m - 60000) END AS BIGINT) AS grant_ms FROM m""")
def pacer_grants(spark: SparkSession, d: str) -> DataFrame:
    return pacing.grants(t.log(spark, d), "writer", 1, 2).select("writer", "ord", F.col("grant_ms").cast("long").alias("grant_ms"))


@query(f"WITH {t.LOG} SELECT writer, ord, CAST(max(at_ms + size * 1000) OVER (PARTITION BY writer ORDER BY at_ms, ord) AS BIGINT) AS until_ms FROM log")
def pacer_pauses(spark: SparkSession, d: str) -> DataFrame:
    return pacing.paused_until(t.log(spark, d).withColumn("pause_ms", F.col("size") * 1000), "writer").select("writer", "ord", "until_ms")


def _limited(spark: SparkSession, d: str) -> DataFrame:
    return t.log(spark, d).select("writer", "ord", "at_ms", (F.col("event_type") == "error").alias("limited"), (F.col("size") * 100).alias("pause_ms"))


@query(f"""WITH RECURSIVE {t.LOG}, n AS (SELECT writer, ord, at_ms, event_type = 'error' AS limited, row_number() OVER (PARTITION BY writer ORDER BY at_ms, ord) AS i FROM log),
f AS (SELECT writer, ord, at_ms, limited, i, CASE WHEN limited THEN 60.0::DOUBLE ELSE 120.0::DOUBLE END AS rate, CASE WHEN limited THEN at_ms END AS last FROM n WHERE i = 1
 UNION ALL SELECT n.writer, n.ord, n.at_ms, n.limited, n.i,
  CASE WHEN n.limited THEN f.rate / 2 WHEN f.last IS NOT NULL AND n.at_ms - f.last >= 60000 AND f.rate < 120 THEN least(120.0::DOUBLE, f.rate + 12) ELSE f.rate END,
  CASE WHEN n.limited THEN n.at_ms WHEN f.last IS NOT NULL AND n.at_ms - f.last >= 60000 AND f.rate < 120 THEN n.at_ms ELSE f.last END
 FROM f JOIN n ON n.writer = f.writer AND n.i = f.i + 1)
SELECT writer, ord, at_ms, limited, round(rate, 6) AS rate FROM f""")
def pacer_rates(spark: SparkSession, d: str) -> DataFrame:
    return pacing.adaptive_rates(_limited(spark, d), "writer", 120.0).withColumn("rate", F.round("rate", 6))


@query(f"""WITH RECURSIVE {t.LOG}, n AS (SELECT writer, ord, at_ms, event_type = 'error' AS limited, size * 100 AS pause_ms, row_number() OVER (PARTITION BY writer ORDER BY at_ms, ord) AS i FROM log),
f AS (SELECT writer, ord, at_ms, limited, pause_ms, i, 'closed' AS state, limited AS tripped, CASE WHEN limited THEN at_ms + greatest(1000, pause_ms) ELSE 0 END AS until FROM n WHERE i = 1
 UNION ALL SELECT n.writer, n.ord, n.at_ms, n.limited, n.pause_ms, n.i,
  CASE WHEN f.tripped AND n.at_ms < f.until THEN 'open' WHEN f.tripped THEN 'probe' ELSE 'closed' END,
  CASE WHEN f.tripped AND n.at_ms < f.until THEN true ELSE n.limited END,
  CASE WHEN f.tripped AND n.at_ms < f.until THEN f.until WHEN n.limited THEN greatest(f.until, n.at_ms + greatest(1000, n.pause_ms)) ELSE f.until END
 FROM f JOIN n ON n.writer = f.writer AND n.i = f.i + 1)
SELECT writer, ord, at_ms, limited, pause_ms, state FROM f""")
def circuit_states(spark: SparkSession, d: str) -> DataFrame:
    return pacing.circuit(_limited(spark, d), "writer")


@query(f"""WITH RECURSIVE {t.LOG}, n AS (SELECT writer, ord, at_ms, row_number() OVER (PARTITION BY writer ORDER BY at_ms, ord) AS i FROM log),
f AS (SELECT writer, ord, at_ms, i, true AS refreshed, at_ms AS last FROM n WHERE i = 1
 UNION ALL SELECT n.writer, n.ord, n.at_ms, n.i, n.at_ms - f.last >= 3600000, CASE WHEN n.at_ms - f.last >= 3600000 THEN n.at_ms ELSE f.last END FROM f JOIN n ON n.writer = f.writer AND n.i = f.i + 1)
SELECT writer, ord, at_ms, refreshed FROM f""")
def refresh_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return pacing.cooled_refreshes(t.log(spark, d), "writer", 3_600_000)


@query(f"""WITH {t.LOG}, n AS (SELECT writer, ord, at_ms, at_ms + size * 60000 AS end_ms FROM log),
m AS (SELECT *, max(end_ms) OVER (PARTITION BY writer ORDER BY at_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM n)
SELECT writer, ord, CAST(sum(CAST(latest IS NULL OR at_ms >= latest AS INT)) OVER (PARTITION BY writer ORDER BY at_ms, ord) AS BIGINT) AS flight FROM m""")
def single_flight(spark: SparkSession, d: str) -> DataFrame:
    return pacing.coalesced(t.log(spark, d).withColumn("end_ms", F.col("at_ms") + F.col("size") * 60_000), "writer").select("writer", "ord", "flight")


# --- statuses


_STATUS = "(list_value(200,408,409,429,403,500,404,503))[CAST(event_id % 8 AS INT) + 1]"


@query(f"""SELECT event_id, CASE WHEN s = 429 THEN 'rate_limited' WHEN s = 409 THEN 'conflict' WHEN s IN (408,500,502,503,504) THEN 'retryable' WHEN s >= 400 THEN 'fatal' ELSE 'ok' END AS class,
CASE WHEN s = 429 OR (s = 403 AND user_id % 3 = 0) THEN CASE WHEN user_id % 2 = 0 THEN user_id * 1000 ELSE 60000 END END AS pause_ms,
CAST(least(60000, greatest(least(2000, 250 * pow(2, event_id % 6)), CASE WHEN user_id % 2 = 0 THEN user_id * 1000 ELSE 0 END)) AS BIGINT) AS delay_ms
FROM (SELECT *, {_STATUS} AS s FROM events)""")
def response_policy(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    s = F.element_at(F.array(*[F.lit(x) for x in (200, 408, 409, 429, 403, 500, 404, 503)]), (F.col("event_id") % 8 + 1).cast("int"))
    retry = F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 1000)
    limited_retry = F.when((s == 429) | (F.col("user_id") % 3 == 0), retry)
    remaining = F.when(F.col("user_id") % 3 == 0, "0").otherwise("5")
    return e.select("event_id", status.error_class(s, F.lit("")).alias("class"), status.rate_limit_pause_ms(s, limited_retry, remaining, F.lit(None).cast("bigint")).alias("pause_ms"), status.retry_delay_ms(F.col("event_id") % 6, retry).alias("delay_ms"))


@query("""SELECT event_id, h AS header, CASE WHEN regexp_full_match(h, '[0-9]+') THEN CAST(h AS BIGINT) * 1000
 WHEN contains(h, ',') THEN CAST(greatest(0, user_id * 1000) AS BIGINT) END AS retry_ms
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'Sun, ' || strftime(TIMESTAMP '2026-07-26 12:00:00' + to_seconds(user_id), '%d %b %Y %H:%M:%S') || ' GMT' WHEN 2 THEN '1.5' ELSE 'soon' END AS h FROM events)""")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    now = F.lit(1785067200000).cast("bigint")
    date = F.date_format(F.timestamp_millis(now + F.col("user_id") * 1000), "dd MMM yyyy HH:mm:ss")
    h = F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sun, "), date, F.lit(" GMT"))).when(F.col("event_id") % 4 == 2, "1.5").otherwise("soon")
    return e.select("event_id", h.alias("header"), status.retry_after_ms(h, now).alias("retry_ms"))


_MODES = "(VALUES ('auto'), ('read-only'), ('read-write')) m(mode), (VALUES ('push'), ('pull_request'), ('schedule')) e(event), (VALUES ('refs/heads/main'), ('refs/heads/topic')) r(ref), (VALUES (true), (false)) p(protected), (VALUES ('none'), ('read'), ('write'), ('write-only'), ('')) q(runtime)"


@query(f"""SELECT mode, event, ref, protected, runtime, runtime NOT IN ('none','write-only') AS readable,
 (mode = 'read-write' OR (mode = 'auto' AND event = 'push' AND protected AND ref = 'refs/heads/main')) AND event <> 'pull_request' AND runtime NOT IN ('none','read') AS writable FROM {_MODES}""")
def permission_table(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {_MODES}")
    p = status.permissions(F.col("mode"), F.col("event"), F.col("ref"), F.lit("main"), F.col("protected"), F.col("runtime"))
    return rows.withColumn("p", p).select("mode", "event", "ref", "protected", "runtime", "p.readable", "p.writable")


@query("SELECT mode, c AS cache_errors, l AS lifecycle_errors, mode = 'always' OR (mode = 'on-error' AND (c OR l)) AS upload FROM (VALUES ('always'), ('never'), ('on-error')) m(mode), (VALUES (true), (false)) a(c), (VALUES (true), (false)) b(l)")
def upload_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("SELECT mode, c AS cache_errors, l AS lifecycle_errors FROM (VALUES ('always'), ('never'), ('on-error')) m(mode), (VALUES (true), (false)) a(c), (VALUES (true), (false)) b(l)")
    return rows.withColumn("upload", status.upload_wanted(F.col("mode"), F.col("cache_errors"), F.col("lifecycle_errors")))


# --- keys


@query(f"""WITH {t.LOG}, p AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN '/cache/' || kind || '/' || upper(digest) WHEN ord % 7 = 1 THEN '/cache/' || kind || '/' || digest || '?x' ELSE '/cache/' || kind || '/' || digest END AS path FROM log)
SELECT ord, nullif(regexp_extract(path, '^/cache/(ac|cas)/([0-9a-f]{{64}})$', 1), '') AS kind, nullif(regexp_extract(path, '^/cache/(ac|cas)/([0-9a-f]{{64}})$', 2), '') AS digest FROM p""")
def object_paths(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("ord") % 7 == 0, F.upper("digest")).when(F.col("ord") % 7 == 1, F.concat("digest", F.lit("?x"))).otherwise(F.col("digest"))
    path = F.concat(F.lit("/cache/"), "kind", F.lit("/"), tail)
    return t.log(spark, d).select("ord", keys.object_path(path).alias("o")).select("ord", "o.kind", "o.digest")


@query("""SELECT event_id, CASE WHEN regexp_full_match(x, '0|[1-9][0-9]*') AND TRY_CAST(x AS BIGINT) <= 9007199254740991 THEN TRY_CAST(x AS BIGINT) END AS n,
CASE WHEN regexp_full_match(x, '0|[1-9][0-9]*') AND length(x) <= 20 THEN x END AS digits
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0' || CAST(user_id AS VARCHAR) WHEN 1 THEN '-1' WHEN 2 THEN '9007199254740992' WHEN 3 THEN '123456789012345678901' ELSE CAST(user_id AS VARCHAR) END AS x FROM events)""")
def canonical_integers(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    x = F.when(k == 0, F.concat(F.lit("0"), u)).when(k == 1, "-1").when(k == 2, "9007199254740992").when(k == 3, "123456789012345678901").otherwise(u)
    return e.select("event_id", keys.safe_integer(x).alias("n"), keys.key_integer(x).alias("digits"))


@query(f"WITH {t.LOG} SELECT ord, substr(sha256('ns-' || CAST(writer AS VARCHAR)), 1, 16) AS namespace_hash, 'ns-' || kind || '-' || digest AS key, CASE kind WHEN 'ac' THEN 0 ELSE 1 END AS code FROM log")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    ns = F.concat(F.lit("ns-"), F.col("writer").cast("string"))
    return t.log(spark, d).select("ord", keys.namespace_hash(ns).alias("namespace_hash"), keys.object_key(F.lit("ns"), F.col("kind"), F.col("digest")).alias("key"), keys.kind_code(F.col("kind")).alias("code"))


_ENC = "translate(replace(base64(unhex(repeat(sha256(p_name), 8))), '=', ''), '+/', '-_')"
_PACKKEY = f"'brc2-' || substr(sha256(p_brand), 1, 16) || '-pack-' || CAST(p_partkey AS VARCHAR) || '-' || substr(sha256(p_type), 1, 16) || '-' || lpad(CAST(p_size AS VARCHAR), 6, '0') || '-' || {_ENC} || '-' || substr(sha256(p_name), 1, 16)"


@query(f"SELECT p_partkey, substr(sha256(p_brand), 1, 16) AS namespace_hash, CAST(p_partkey AS VARCHAR) AS run_id, CAST(p_size AS VARCHAR) AS sequence, {_ENC} AS bloom, {_PACKKEY} AS key, starts_with({_PACKKEY}, 'brc2-' || substr(sha256(p_brand), 1, 16) || '-pack-') AS prefixed FROM part")
def pack_keys(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    raw = F.unhex(F.repeat(F.sha2("p_name", 256), 8))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    key = keys.pack_key(short("p_brand"), F.col("p_partkey").cast("string"), short("p_type"), F.col("p_size").cast("string"), raw, short("p_name"))
    rows = p.select("p_partkey", "p_brand", key.alias("key")).withColumn("x", keys.parse_pack_key(F.col("key")))
    return rows.select("p_partkey", "x.namespace_hash", "x.run_id", "x.sequence", "x.bloom", "key", F.col("key").startswith(keys.key_prefix(short("p_brand"))).alias("prefixed"))


# --- filters and lookups

_POS = ", ".join(f"CAST(('0x' || substr(sha256(CAST('brc2-bloom-v1' AS BLOB) || unhex('00') || unhex('0{i}') || unhex(CASE kind WHEN 'ac' THEN '00' ELSE '01' END) || unhex(digest)), 1, 4)) AS INTEGER) % 2048" for i in range(5))
_BLOOM = f"{t.MEMBERS}, pos AS (SELECT *, [{_POS}] AS p FROM members), bits AS (SELECT DISTINCT pack, unnest(p) AS bit FROM pos)"
# every member is a probe
_CAND = f"{_BLOOM}, probe AS (SELECT pack * 100 + ord AS probe_id, kind, digest, list_distinct(p) AS p FROM pos), cand AS (SELECT q.probe_id, b.pack FROM (SELECT probe_id, len(p) AS need, unnest(p) AS bit FROM probe) q JOIN bits b USING (bit) GROUP BY q.probe_id, b.pack, q.need HAVING count(*) = q.need)"


@query(f"WITH {_BLOOM} SELECT pack, count(*) AS set_bits, CAST(sum(bit) AS BIGINT) AS bit_sum FROM bits GROUP BY pack")
def bloom_filters(spark: SparkSession, d: str) -> DataFrame:
    b = bloom.build(t.members(spark, d), "pack")
    return b.select("pack", F.size("bits").cast("long").alias("set_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x).alias("bit_sum"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return t.members(spark, d).select((F.col("pack") * 100 + F.col("ord")).alias("probe_id"), "kind", "digest")


@query(f"WITH {_CAND} SELECT probe_id, pack FROM cand")
def bloom_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lookup.candidates(bloom.build(t.members(spark, d), "pack"), _probes(spark, d))


@query(f"WITH {_CAND} SELECT c.probe_id, c.pack FROM cand c JOIN probe q USING (probe_id) WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.pack = c.pack AND m.digest = q.digest)")
def bloom_false_positives(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.candidates(bloom.build(t.members(spark, d), "pack"), _probes(spark, d))
    return lookup.false_positives(found, t.members(spark, d), _probes(spark, d)).select("probe_id", "pack")


@query(f"WITH {t.CATALOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, id DESC, key, ref, version) AS n FROM catalog) SELECT id, key, version, ref, size_bytes, created_at FROM n WHERE n = 1 AND starts_with(key, 'store-1')")
def catalog_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return lookup.distinct_ids(t.catalog(spark, d)).where(F.col("key").startswith("store-1"))


@query(f"WITH {t.CATALOG} SELECT * FROM catalog ORDER BY created_at DESC, id DESC, key, ref, version LIMIT 100")
def catalog_newest(spark: SparkSession, d: str) -> DataFrame:
    return t.catalog(spark, d).orderBy(*lookup.newest_first()).limit(100)


@query(f"WITH {t.CATALOG}, m AS (SELECT key AS probe_id, id AS pack, created_at, id % 5 <> 0 AS intact FROM catalog), n AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY created_at DESC, pack DESC) AS n FROM m WHERE intact) SELECT probe_id, pack, created_at FROM n WHERE n = 1")
def newest_valid_pack(spark: SparkSession, d: str) -> DataFrame:
    m = t.catalog(spark, d).select(F.col("key").alias("probe_id"), F.col("id").alias("pack"), "created_at", (F.col("id") % 5 != 0).alias("intact"))
    return lookup.newest_valid(m).select("probe_id", "pack", "created_at")


@query(f"""WITH {t.LOG} SELECT ord, CASE WHEN EXISTS (SELECT 1 FROM log x WHERE x.ord % 11 = 0 AND x.kind = log.kind AND x.digest = log.digest) THEN 'local'
 WHEN EXISTS (SELECT 1 FROM log x WHERE x.ord % 5 = 0 AND x.kind = log.kind AND x.digest = log.digest) THEN 'pack'
 WHEN EXISTS (SELECT 1 FROM log x WHERE x.ord % 3 = 0 AND x.kind = log.kind AND x.digest = log.digest) THEN 'object' ELSE 'miss' END AS tier FROM log""")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = t.log(spark, d)
    return lookup.tiers(rows.select("ord", "kind", "digest"), rows.where("ord % 11 = 0"), rows.where("ord % 5 = 0"), rows.where("ord % 3 = 0")).select("ord", "tier")


@query(f"WITH {t.LOG} SELECT ord, writer FROM log WHERE ord % 2 = 0 AND writer NOT IN (SELECT writer FROM log WHERE ord % 41 = 1)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = t.log(spark, d)
    return rows.where("ord % 2 = 0").join(rows.where("ord % 41 = 1").select("writer"), "writer", "left_anti").select("ord", "writer")


# --- content


@query(f"WITH {t.LOG} SELECT ord, sha256(body) AS sha256, sha256(body) = body_sha256 AND strlen(body) + writer % 50 = size AS verified FROM log")
def payload_verification(spark: SparkSession, d: str) -> DataFrame:
    ok = packs.verified(F.col("body").cast("binary"), F.col("size") - F.col("writer") % 50, F.col("body_sha256"), F.lit("ac"), F.col("digest"))
    return t.log(spark, d).select("ord", F.sha2("body", 256).alias("sha256"), ok.alias("verified"))


def _sealed(spark: SparkSession, d: str) -> DataFrame:
    return packs.seal(t.members(spark, d), "pack")


@query(f"""WITH {t.MEMBERS} SELECT pack, 'cas' AS kind, row_number() OVER w - 1 AS ordinal, digest, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY pack ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", strlen(payload) AS length, sha256(payload) AS body_sha256
FROM members WINDOW w AS (PARTITION BY pack ORDER BY ord)""")
def pack_index(spark: SparkSession, d: str) -> DataFrame:
    return packs.index_rows(_sealed(spark, d), "pack")


@query(f"WITH {t.MEMBERS} SELECT pack, digest, payload FROM members")
def pack_payloads(spark: SparkSession, d: str) -> DataFrame:
    return packs.payloads(_sealed(spark, d), "pack").where("good").select("pack", "digest", F.col("payload").cast("string").alias("payload"))


@query(f"WITH {t.MEMBERS} SELECT pack, true AS contiguous, CAST(sum(strlen(payload)) + 16 + 96 * count(*) + 64 AS BIGINT) AS bytes FROM members GROUP BY pack")
def pack_layout(spark: SparkSession, d: str) -> DataFrame:
    sealed = _sealed(spark, d)
    return packs.contiguous(packs.index_rows(sealed, "pack"), "pack").join(sealed.select("pack", F.octet_length("content").cast("long").alias("bytes")), "pack")


# --- redaction

_MSG = "body || ' GET https://h.example/' || digest || '?sig=abc&x=1 Bearer ' || digest || ' key ' || digest || ' password: hunter' || CAST(writer AS VARCHAR)"


@query(f"WITH {t.LOG} SELECT ord, body || ' GET <redacted-url> Bearer <redacted> key <redacted-digest> password=<redacted>' AS message, body || ' GET <redacted-url> Bearer <redacted> key ' || digest || ' password: hunter' || CAST(writer AS VARCHAR) AS short FROM log")
def redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    msg = F.concat("body", F.lit(" GET https://h.example/"), "digest", F.lit("?sig=abc&x=1 Bearer "), "digest", F.lit(" key "), "digest", F.lit(" password: hunter"), F.col("writer").cast("string"))
    return t.log(spark, d).select("ord", redact.diagnostic_text(msg).alias("message"), redact.error_message(msg).alias("short"))


@query("SELECT event_id, CASE WHEN regexp_full_match(x, '[a-z][a-z0-9-]{0,47}') THEN x ELSE 'unknown' END AS area FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS x FROM events)")
def safe_fields(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", redact.field_or(x, "unknown").alias("area"))


# --- counters and derived metrics


@query(f"""WITH {t.LOG} SELECT kind, count_if(event_type <> 'error' AND ord % 3 <> 0) AS hits, count_if(event_type <> 'error' AND ord % 3 = 0) AS misses, count_if(event_type = 'error') AS errors,
CAST(coalesce(sum(size) FILTER (event_type <> 'error' AND ord % 3 <> 0), 0) AS BIGINT) AS bytes, CAST(sum(writer) AS BIGINT) AS latency_ms FROM log GROUP BY kind""")
def read_counters(spark: SparkSession, d: str) -> DataFrame:
    good, hit = F.col("event_type") != "error", F.col("ord") % 3 != 0
    return t.log(spark, d).groupBy("kind").agg(F.count_if(good & hit).alias("hits"), F.count_if(good & ~hit).alias("misses"), F.count_if(~good).alias("errors"), F.coalesce(F.sum(F.when(good & hit, F.col("size"))), F.lit(0)).alias("bytes"), F.sum("writer").alias("latency_ms"))


@query(f"WITH {t.OUTCOMES} SELECT kind, count_if(outcome = 'accepted') AS successes, count_if(outcome = 'conflict') AS conflicts, count_if(outcome = 'duplicate') AS deduplicated, CAST(sum(size) AS BIGINT) AS bytes FROM outcome GROUP BY kind")
def write_counters(spark: SparkSession, d: str) -> DataFrame:
    return ingest.outcomes(t.log(spark, d)).groupBy("kind").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("accepted", "successes"), ("conflict", "conflicts"), ("duplicate", "deduplicated"))], F.sum("size").alias("bytes"))


@query("SELECT event_type AS operation, count(*) AS calls, count_if(value > 30) AS errors, count_if(value > 40) AS rate_limited FROM events GROUP BY event_type")
def call_counters(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") > 30).alias("errors"), F.count_if(F.col("value") > 40).alias("rate_limited"))


@query(f"WITH {t.LOG}, c AS (SELECT writer, ord, sum(size) OVER (PARTITION BY writer ORDER BY ord) AS total FROM log WHERE ord % 5 <> 4) SELECT writer, ord, CAST(total - coalesce(lag(total) OVER (PARTITION BY writer ORDER BY ord), 0) AS BIGINT) AS delta FROM c")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("writer").orderBy("ord")
    c = t.log(spark, d).where("ord % 5 <> 4").select("writer", "ord", F.sum("size").over(w).alias("total"))
    return c.select("writer", "ord", (F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).alias("delta"))


@query(f"WITH {t.LOG} SELECT k.kind, e.event_type, coalesce(c.n, 0) AS n FROM (VALUES ('ac'), ('cas')) k(kind), (VALUES ('view'), ('error'), ('drain')) e(event_type) LEFT JOIN (SELECT kind, event_type, count(*) AS n FROM log GROUP BY 1, 2) c ON c.kind = k.kind AND c.event_type = e.event_type")
def zero_filled_counters(spark: SparkSession, d: str) -> DataFrame:
    names = spark.sql("SELECT * FROM (VALUES ('ac'), ('cas')) k(kind), (VALUES ('view'), ('error'), ('drain')) e(event_type)")
    c = t.log(spark, d).groupBy("kind", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return names.join(c, ["kind", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


_SUMMARY = f"""WITH {t.LOG}, s AS (SELECT writer, greatest(1.0 / 60, (max(at_ms) - min(at_ms)) / 60000.0) AS minutes, count_if(event_type = 'click') AS reservations, count_if(event_type = 'view') AS lookups,
count_if(event_type = 'error') AS limited, count_if(ord % 6 = 0) AS operations, count_if(ord % 8 = 0) AS packs, count(*) AS objects, sum(size) AS bytes, bool_or(event_type = 'error') AS errors FROM log GROUP BY writer)
SELECT writer, round(reservations / minutes, 6) AS reservations_per_min, round(lookups / minutes, 6) AS lookups_per_min, greatest(limited, operations) AS rate_limits,
round(CASE WHEN packs = 0 THEN 0 ELSE objects / packs END, 6) AS objects_per_pack, round(CASE WHEN packs = 0 THEN 0 ELSE bytes / packs END, 6) AS bytes_per_pack,
reservations / minutes >= 160 OR lookups / minutes >= 1200 AS pressure, errors AS unhealthy FROM s"""


@query(_SUMMARY)
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda x: F.count_if(F.col("event_type") == x)
    s = t.log(spark, d).groupBy("writer").agg(
        F.greatest(F.lit(1.0 / 60), (F.max("at_ms") - F.min("at_ms")) / F.lit(60000.0)).alias("minutes"), is_("click").alias("r"), is_("view").alias("l"), is_("error").alias("limited"),
        F.count_if(F.col("ord") % 6 == 0).alias("ops"), F.count_if(F.col("ord") % 8 == 0).alias("packs"), F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"),
    )
    per = lambda c: F.round(F.when(F.col("packs") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(c), F.col("packs"))), 6)
    r, l = F.col("r") / F.col("minutes"), F.col("l") / F.col("minutes")  # noqa: E741
    return s.select(
        "writer", F.round(r, 6).alias("reservations_per_min"), F.round(l, 6).alias("lookups_per_min"), F.greatest("limited", "ops").alias("rate_limits"), per("objects").alias("objects_per_pack"), per("bytes").alias("bytes_per_pack"),
        ((r >= 160) | (l >= 1200)).alias("pressure"), (F.col("limited") > 0).alias("unhealthy"),
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The job summary by writer."""
    return job_summary(spark, d)
