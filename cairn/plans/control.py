"""Queries over control records, queues of manifests and a catalog's refreshes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, records
from ..operators import ingest, metrics, pacing, recovery, refresh
from . import tables as t
from .register import query

#: Fields of a daemon's settings: a good value and values that are not.
_DAEMON = {
    "namespace": ('"main.v1"', ['"-x"', "7", None]), "maxObjectSize": ("1000", ["0", '"1000"', "1.5"]), "maxInflightBytes": ("1000", ["999", None]), "maxPendingBytes": ("5000", ["10", "true"]),
    "storageMode": ('"object"', ['"disk"', None]), "writeBack": ("true", ['"true"', "1"]), "packTargetBytes": ("5000", ["5001", "0"]), "controlDirectory": ('"/run/d"', ['"run"']),
    "shutdownToken": ('"0123456789abcdef0123456789abcdef"', ['"short"', '"0123456789abcdef0123456789abcde*"']), "instanceId": ('"00000000-0000-0000-0000-00000000000a"', ['"0"']),
    "githubApiUrl": ('"https://api.example/v3"', ['"http://api.example"', '"https://u:p@api.example"', '"api"']), "githubRepository": ('"a/b"', ['"a"', '"a/b/c"']), "currentRef": ('"refs/heads/x"', ['"x"', None]),
    "baseRef": ('"refs/heads/main"', ['"refs/tags/v"', "null"]), "defaultRef": ('"refs/heads/main"', ['"main"']), "runId": ('"12"', ['"012"', "12"]), "jobHash": ('"0123456789abcdef"', ['"0123"', '"0123456789ABCDEF"']),
    "port": ("0", ["65536", "-1"]), "uploadConcurrency": ("4", ["0"]), "downloadConcurrency": ("256", ["257"]), "repositoryUploadBudget": ("120", ["201"]), "expectedWriters": ("1", ["0"]), "uploadBurst": ("2", ["2.5"]),
    "flushTimeoutSeconds": ("60", ["3601"]), "packMaxObjects": ("256", ["257"]), "packMaxAgeSeconds": ("8", ["301"]), "catalogRefreshSeconds": ("30", ["0"]), "remoteTimeoutSeconds": ("30", [None]),
    "readable": ("true", ["null"]), "writable": ("false", ['"no"']), "failJobOnCacheError": ("false", ["0"]),
}
_READY = {
    "port": ("8080", ["0", '"8080"', "65536"]), "url": ('"http://127.0.0.1:8080/"', ['"https://127.0.0.1:8080/"', '"http://localhost:8080/"', '"http://127.0.0.1:8081"', '"http://127.0.0.1:8080/x"', '"http://127.0.0.1:8080/?q"', "1"]),
    "pid": ("77", ["0", "2147483648", None]), "readable": ("true", ["1"]), "writable": ("true", [None]), "instanceId": ('"i"', ["3"]), "startedAt": ('"2026-01-02T03:04:05Z"', ["5"]),
}


def _json(fields: dict, by: str = "event_id") -> str:
    """An expression for both engines: a JSON record of which at most one field is not good, picked by a number."""
    total = 4 + sum(len(bad) for _, bad in fields.values())
    parts, slot = [], 4
    for name, (good, bad) in fields.items():
        shown = lambda v: "''" if v is None else f"""'"{name}":{v},'"""  # noqa: B023, E731
        cases = " ".join(f"WHEN {slot + i} THEN {shown(v)}" for i, v in enumerate(bad))
        slot += len(bad)
        parts.append(f"CASE {by} % {total} {cases} ELSE {shown(good)} END" if bad else shown(good))
    return "concat('{', " + ", ".join(parts) + ", '\"end\":0}')"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _is(f: str, kind: str) -> str:
    kinds = {"text": "'VARCHAR'", "flag": "'BOOLEAN'", "number": "'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT'", "record": "'OBJECT'", "list": "'ARRAY'"}[kind]
    return f"coalesce(json_type(j, '$.{f}') IN ({kinds}), false)"


def _text(f: str) -> str:
    return f"json_extract_string(j, '$.{f}')"


def _number(f: str) -> str:
    return f"CASE WHEN {_is(f, 'number')} THEN CAST({_text(f)} AS DOUBLE) END"


def _integer(f: str, least, most=9007199254740991) -> str:
    return f"coalesce({_number(f)} = floor({_number(f)}) AND {_number(f)} BETWEEN {least} AND {most}, false)"


def _match(f: str, pattern: str) -> str:
    return f"{_is(f, 'text')} AND regexp_full_match({_text(f)}, '{pattern}')"


def _rules(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({good}, false) THEN '{name}'" for name, good in rules) + " END"


_DAEMON_RULES = [
    ("record", "json_type(j) = 'OBJECT'"), ("namespace", _match("namespace", "[A-Za-z0-9][A-Za-z0-9._-]{0,127}")), ("maxObjectSize", _integer("maxObjectSize", 1)), ("maxInflightBytes", _integer("maxInflightBytes", _number("maxObjectSize"))),
    ("maxPendingBytes", _integer("maxPendingBytes", _number("maxObjectSize"))), ("storageMode", _match("storageMode", "object|pack")), ("writeBack", _is("writeBack", "flag")),
    ("pack needs write-back", f"{_text('storageMode')} <> 'pack' OR {_text('writeBack')} = 'true'"), ("packTargetBytes", _integer("packTargetBytes", 1, _number("maxPendingBytes"))), ("controlDirectory", _match("controlDirectory", "/.*")),
    ("shutdownToken", _match("shutdownToken", "[A-Za-z0-9_-]{32,}")), ("instanceId", _match("instanceId", "[0-9a-f-]{36}")), ("githubApiUrl", _match("githubApiUrl", "https://[^/@]+(/.*)?")),
    ("githubRepository", _match("githubRepository", "[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+")), ("currentRef", _match("currentRef", "refs/.*")), ("baseRef", f"json_type(j, '$.baseRef') IS NULL OR {_match('baseRef', 'refs/heads/.*')}"),
    ("defaultRef", _match("defaultRef", "refs/.*")), ("runId", _match("runId", "0|[1-9][0-9]{0,19}")), ("jobHash", _match("jobHash", "[0-9a-f]{16,64}")),
    *[(f, _integer(f, *b)) for f, b in {"port": (0, 65535), "uploadConcurrency": (1, 128), "downloadConcurrency": (1, 256), "repositoryUploadBudget": (1, 200), "expectedWriters": (1, 256), "uploadBurst": (1, 200), "flushTimeoutSeconds": (1, 3600), "packMaxObjects": (1, 256), "packMaxAgeSeconds": (1, 300), "catalogRefreshSeconds": (1, 3600), "remoteTimeoutSeconds": (1, 3600)}.items()],
    *[(f, _is(f, "flag")) for f in ("readable", "writable", "failJobOnCacheError")],
]


@query(f"SELECT event_id, {_rules(_DAEMON_RULES)} AS problem FROM (SELECT event_id, CAST({_json(_DAEMON)} AS JSON) AS j FROM events)")
def daemon_settings(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", records.daemon_problem(F.expr(_json(_DAEMON))).alias("problem"))


_READY_RULES = [
    ("record", "json_type(j) = 'OBJECT'"), ("port", _integer("port", 1, 65535)), ("url", f"{_is('url', 'text')} AND {_text('url')} IN ('http://127.0.0.1:' || {_text('port')}, 'http://127.0.0.1:' || {_text('port')} || '/')"),
    ("pid", _integer("pid", 1, 2147483647)), ("readable", _is("readable", "flag")), ("writable", _is("writable", "flag")), ("instanceId", _is("instanceId", "text")), ("startedAt", _is("startedAt", "text")),
]


@query(f"SELECT event_id, {_rules(_READY_RULES)} AS problem FROM (SELECT event_id, CAST({_json(_READY)} AS JSON) AS j FROM events)")
def daemon_reports(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", records.ready_problem(F.expr(_json(_READY))).alias("problem"))


# --- metrics


def _metrics(by: str = "event_id") -> str:
    """An expression for both engines: a snapshot of metrics in which counters are seldom above 0, and some fields are not good."""
    number = lambda slot: f"CASE {by} % 97 WHEN {slot} THEN '-1' WHEN {slot + 1} THEN '3' WHEN {slot + 2} THEN '\"0\"' ELSE '0' END"
    slot, groups = 0, []
    for g, names in records.GROUPS.items():
        parts = []
        for c in names:
            # a slot for each counter would outgrow the cycle; they overlap, so that several may be wrong at once
            value = "CASE WHEN user_id % 5 = 0 THEN '2' ELSE '0' END" if c == "remainingObjects" else number(slot % 95)
            parts.append(f"""'"{c}":', {value}""")
            slot += 2
        more = ""
        if g == "writeBack":
            ids = f"CASE {by} % 7 WHEN 1 THEN concat('\"cas:', sha256_, '\"') WHEN 2 THEN concat('\"cas:', sha256_, '\",\"cas:', sha256_, '\"') WHEN 3 THEN '\"cas:x\"' WHEN 4 THEN concat('\"ac:', sha256_, '\",\"cas:', sha256_, '\"') ELSE '' END"
            more = f""", ',"remainingObjectIds":[', {ids}, '],"configuredEntriesPerMinute":', CASE {by} % 89 WHEN 0 THEN '-0.5' ELSE '17.5' END, ',"currentEntriesPerMinute":', CASE {by} % 83 WHEN 0 THEN 'null' ELSE '0' END"""
        groups.append(f"""'"{g}":{{', {", ',', ".join(parts)}{more}, '}},'""")
    kinds = "'{\"hits\":1,\"misses\":0,\"successes\":0,\"conflicts\":0,\"errors\":', CASE user_id % 9 WHEN 0 THEN '1' ELSE '0' END, ',\"bytes\":5,\"latencyMs\":1}'"
    sides = ", ',', ".join(f"""'"{side}":{{"ac":', {kinds}, ',"cas":', {kinds}, '}}'""" for side in ("reads", "writes"))
    flags = ", ".join(f"""'"{f}":', CASE {by} % {p} WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE 'false' END, ','""" for f, p in zip(records.FLAGS, (3, 71, 73, 79, 61, 59)))
    top = ", ".join(f"""'"{c}":', CASE {by} % {p} WHEN 0 THEN '1.5' WHEN 1 THEN '4' ELSE '0' END, ','""" for c, p in zip(records.TOP_COUNTERS, (53, 47, 43)))
    stopped = f"""CASE {by} % 11 WHEN 0 THEN '' WHEN 1 THEN '"stoppedAt":"soon",' ELSE '"stoppedAt":"2026-01-02T03:04:05Z",' END"""
    return f"""concat('{{"schemaVersion":', CASE {by} % 67 WHEN 0 THEN '3' ELSE '4' END, ',"startedAt":"2026-01-02T03:04:05Z",', {stopped}, {", ".join(groups)}, {sides}, ',', {flags}, {top}, '"end":0}}')"""


def _count(f: str) -> str:
    """A counter, as SQL reads it fastest; negative, fractional and quoted numbers have other types."""
    return f"json_type(j, '$.{f}') = 'UBIGINT' AND TRY_CAST({_text(f)} AS BIGINT) <= 9007199254740991"


_IDS = "CAST(json_extract(j, '$.writeBack.remainingObjectIds') AS VARCHAR[])"
_METRIC_RULES = [
    ("record", "json_type(j) = 'OBJECT'"), ("schemaVersion", f"{_number('schemaVersion')} = 4"), *[(g, _is(g, "record")) for g in records.GROUPS], ("writeBack.remainingObjects", _count("writeBack.remainingObjects")),
    ("remaining identities", f"len({_IDS}) <= 100 AND len(list_filter({_IDS}, lambda x: NOT regexp_full_match(x, '(ac|cas):[0-9a-f]{{64}}'))) = 0"), ("remaining identities repeat", f"len(list_distinct({_IDS})) = len({_IDS})"),
    ("too many remaining identities", f"len({_IDS}) <= {_number('writeBack.remainingObjects')}"), ("stoppedAt", f"json_type(j, '$.stoppedAt') IS NULL OR TRY_CAST({_text('stoppedAt')} AS TIMESTAMPTZ) IS NOT NULL"), ("startedAt", f"TRY_CAST({_text('startedAt')} AS TIMESTAMPTZ) IS NOT NULL"),
    *[(f, _is(f, "flag")) for f in records.FLAGS], *[(f"{g}.{c}", _count(f"{g}.{c}")) for g, names in records.GROUPS.items() for c in names],
    *[(f"{s}.{k}.{c}", _count(f"{s}.{k}.{c}")) for s in ("reads", "writes") for k in ("ac", "cas") for c in records.KIND_COUNTERS],
    *[(f"writeBack.{f}", f"{_number('writeBack.' + f)} >= 0") for f in ("configuredEntriesPerMinute", "currentEntriesPerMinute")], *[(c, _count(c)) for c in records.TOP_COUNTERS],
]
_ERRORS = " OR ".join([
    "json_type(j, '$.stoppedAt') IS NULL", *[f"(json_type(j, '$.{c}') = 'UBIGINT' AND {_text(c)} <> '0')" for c in ("backend.errors", "backend.rateLimited", "integrityFailures", "writeBack.remainingObjects", "reads.ac.errors", "reads.cas.errors", "writes.ac.errors", "writes.cas.errors")],
    *[f"({_is(f, 'flag')} AND {_text(f)} = 'true')" for f in ("diagnosticJournalFailed", "casWriteFailed", "readCircuitOpen", "writeCircuitOpen")],
])
_SNAPSHOTS = "SELECT event_id, user_id, CAST({} AS JSON) AS j FROM (SELECT *, sha256(props) AS sha256_ FROM events)"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("sha256_", F.sha2("props", 256)).select("event_id", F.expr(_metrics()).alias("j"))


@query(f"SELECT event_id, {_rules(_METRIC_RULES)} AS problem FROM ({_SNAPSHOTS.format(_metrics())})")
def metrics_checks(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d).select("event_id", records.metrics_problem(F.col("j")).alias("problem"))


@query(f"WITH c AS MATERIALIZED (SELECT event_id, j, {_rules(_METRIC_RULES)} AS p FROM ({_SNAPSHOTS.format(_metrics())})), w AS MATERIALIZED (SELECT * FROM c WHERE p IS NULL) SELECT event_id, p IS NULL AS wellformed, {_ERRORS} AS unhealthy, len({_IDS}) AS named FROM w")
def metrics_health(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed snapshots, whether they tell of errors, and how many objects they name (none once they are sanitized)."""
    j = F.col("j")
    rows = _snapshots(spark, d).withColumn("p", records.metrics_problem(j)).where("p is null").select("event_id", "j", "p")
    named = lambda x: F.size(F.from_json(F.get_json_object(x, "$.writeBack.remainingObjectIds"), "array<string>"))
    clean = records.without_identities(j)
    return rows.where((named(clean) == 0) & records.metrics_problem(clean).isNull()).select("event_id", F.col("p").isNull().alias("wellformed"), records.cache_errors(j).alias("unhealthy"), named(j).cast("long").alias("named"))


# --- the runner's settings

_EVENT = """CASE event_id % 6 WHEN 0 THEN '{"repository":{"default_branch":"main"},"pull_request":{"base":{"ref":"release"}}}' WHEN 1 THEN '{"repository":{"default_branch":7}}' WHEN 2 THEN '[1]' WHEN 3 THEN '{"pull_request":{"base":{"ref":""}}}' WHEN 4 THEN '{"repository":null,"pull_request":{"base":"x"}}' ELSE '{"repository":{"default_branch":"trunk"}}' END"""
_BASE = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'develop' END"


@query(f"""SELECT event_id, event_type AS event_name, concat('refs/heads/', event_type) AS ref, event_id % 3 = 0 AS protected,
coalesce(nullif(CASE WHEN json_type(j, '$.pull_request.base.ref') = 'VARCHAR' THEN {_text("pull_request.base.ref")} END, ''), nullif(base, '')) AS base_branch,
CASE WHEN json_type(j, '$.repository.default_branch') = 'VARCHAR' THEN {_text("repository.default_branch")} END AS default_branch
FROM (SELECT *, CAST({_EVENT} AS JSON) AS j, {_BASE} AS base FROM events)""")
def event_contexts(spark: SparkSession, d: str) -> DataFrame:
    protected = F.expr("CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' END")
    e = records.event_context(F.expr(_EVENT), F.col("event_type"), F.concat(F.lit("refs/heads/"), "event_type"), protected, F.expr(_BASE))
    return _events(spark, d).select("event_id", e.alias("e")).select("event_id", "e.event_name", "e.ref", "e.protected", "e.base_branch", "e.default_branch")


_FLAG = "CASE event_id % 7 WHEN 0 THEN 'False' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE 'true' END"
_RESULTS = "CASE user_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat('http://r', CAST(user_id AS STRING), '.example/x') WHEN 2 THEN 'http://127.0.0.1:8080' WHEN 3 THEN 'http://a.localhost/' WHEN 4 THEN 'ftp://h.example/' WHEN 5 THEN 'no url' WHEN 6 THEN concat('https://u', CAST(user_id AS STRING), '@h.example/') ELSE concat('https://h', CAST(user_id AS STRING), '.example/?q=a@b') END"
_SERVER = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://GitHub.com' WHEN 2 THEN 'https://own.ghe.com/x' WHEN 3 THEN 'https://ghe.example' ELSE 'http://localhost:3000' END"


@query(f"""WITH s AS (SELECT event_id, {_FLAG} AS flag, {_RESULTS} AS url, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'token' END AS token, lower(regexp_extract(coalesce({_SERVER}, 'https://github.com'), '^[a-zA-Z]+://([^/:?#]+)', 1)) AS server FROM events),
u AS (SELECT *, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS authority FROM s),
h AS (SELECT *, contains(authority, '@') AS credentials, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')) AS host FROM u)
SELECT event_id, CASE WHEN flag IS NULL OR lower(flag) IN ('', 'false', '0') THEN 'disabled' WHEN url = '' THEN 'no url' WHEN token = '' THEN 'no token' WHEN scheme = '' THEN 'invalid url' WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
WHEN credentials THEN 'credentials' WHEN scheme = 'http' AND host NOT IN ('127.0.0.1', '[::1]', 'localhost') AND NOT ends_with(host, '.localhost') THEN 'insecure'
WHEN server <> 'github.com' AND NOT ends_with(server, '.ghe.com') AND server <> 'localhost' AND NOT ends_with(server, '.localhost') THEN 'server' END AS problem FROM h""")
def cache_endpoints(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("event_id") % 11 == 0, "").otherwise("token")
    return _events(spark, d).select("event_id", records.endpoint_problem(F.expr(_FLAG), F.expr(_RESULTS), token, F.expr(_SERVER)).alias("problem"))


_PART = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('repo_', CAST(p_partkey AS STRING)) WHEN 2 THEN 'a/b' ELSE '' END"
_PID = "CASE p_partkey % 5 WHEN 0 THEN concat('0', CAST(p_size AS STRING)) WHEN 1 THEN '2147483648' WHEN 2 THEN '2147483647' WHEN 3 THEN concat(CAST(p_size AS STRING), ' ') ELSE CAST(p_partkey AS STRING) END"
_API = "CASE p_partkey % 5 WHEN 0 THEN 'https://api.example' WHEN 1 THEN concat('https://api.example/v', CAST(p_size AS STRING), '?q=1#f') WHEN 2 THEN 'http://api.example/' WHEN 3 THEN 'https://u:p@api.example/' ELSE 'https://api.example/x/' END"


@query(f"""SELECT p_partkey, CASE WHEN regexp_full_match(part, '[A-Za-z0-9_.-]+') THEN part END AS part, CASE WHEN regexp_full_match(pid, '[1-9][0-9]*') AND TRY_CAST(pid AS BIGINT) <= 2147483647 THEN TRY_CAST(pid AS BIGINT) END AS pid,
CASE WHEN starts_with(api, 'https://') AND NOT contains(api, '@') THEN rtrim(regexp_replace(api, '[?#].*', ''), '/') || '/' END AS base, sha256('brc-raw-object-v1') AS object_version, sha256('bazel-remote-pack-v1-raw-sha256') AS pack_version
FROM (SELECT p_partkey, {_PART} AS part, {_PID} AS pid, {_API} AS api FROM part)""")
def control_values(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(
        "p_partkey", keys.repository_part(F.expr(_PART)).alias("part"), keys.process_id(F.expr(_PID)).alias("pid"), records.api_base(F.expr(_API)).alias("base"),
        keys.version_of(keys.OBJECT_VERSION_LABEL).alias("object_version"), keys.version_of(keys.PACK_VERSION_LABEL).alias("pack_version"),
    )


# --- queues of manifests

# a queue of each writer: its rows in order, of which some manifests are spoilt; sequences are counted by writer
_QUEUE = f"""{t.LOG}, once AS (SELECT * FROM log QUALIFY writer % 5 = 0 OR row_number() OVER (PARTITION BY writer, kind, digest ORDER BY ord) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY ord) AS n, sum(CASE WHEN kind = 'cas' THEN 1 ELSE 0 END) OVER (PARTITION BY writer ORDER BY ord ROWS UNBOUNDED PRECEDING) AS seen FROM once),
queued AS (SELECT *, CASE WHEN kind = 'cas' THEN digest ELSE body_sha256 END AS sha FROM numbered WHERE n % 2 = 0 OR writer % 4 > 0)"""
_NAME = "concat(lpad(CAST(CASE WHEN writer % 10 = 1 AND n > 3 THEN ord - ord % 2 ELSE ord END AS STRING), 12, '0'), '-', kind, '-', CASE WHEN writer % 10 = 2 AND n = 5 THEN 'abc' ELSE digest END, '.json')"
_BODY = """concat('{"kind":"', kind, '","digest":"', digest, '","order":', CAST(CASE WHEN writer % 10 = 1 AND n > 3 THEN ord - ord % 2 ELSE ord END AS STRING), ',"size":', CASE WHEN writer % 10 = 3 AND n = 4 THEN '"7"' ELSE CAST(size AS STRING) END,
 ',"acceptedAt":', CAST(CASE WHEN writer % 10 = 8 AND n = 2 THEN -1 ELSE at_ms END AS STRING), ',"bodySha256":"', CASE WHEN writer % 10 = 4 AND n = 6 THEN body_sha256 ELSE sha END, '","path":"', directory, '/', CASE WHEN writer % 10 = 9 AND n = 8 THEN 'x' ELSE '' END, substr(name, 1, length(name) - 5), '.data","manifestPath":"', directory, '/', name, '",',
 CASE WHEN kind = 'cas' THEN concat('"casSequence":"', CAST(CASE WHEN writer % 10 = 5 AND n > 6 THEN seen + 1 ELSE seen END AS STRING), '"') ELSE concat('"casBarrier":"', CASE WHEN writer % 10 = 6 THEN CAST(seen + 1 AS STRING) ELSE CAST(seen AS STRING) END, '"') END, '}')"""
_STORE = 20_000
_FILES = f"""{_QUEUE}, manifest AS (SELECT * EXCLUDE (body), {_BODY} AS body FROM (SELECT *, {_NAME} AS name, concat('/q/', CAST(writer AS STRING)) AS directory FROM queued))"""


def _once(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("writer", "kind", "digest").orderBy("ord"))
    return t.log(spark, d).withColumn("again", again).where("writer % 5 = 0 OR again = 1").drop("again")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("writer").orderBy("ord")
    seen = F.sum((F.col("kind") == "cas").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = _once(spark, d).withColumn("n", F.row_number().over(w)).withColumn("seen", seen).where("n % 2 = 0 OR writer % 4 > 0")
    rows = rows.withColumn("sha", F.when(F.col("kind") == "cas", F.col("digest")).otherwise(F.col("body_sha256")))
    return rows.withColumn("name", F.expr(_NAME)).withColumn("directory", F.expr("concat('/q/', CAST(writer AS STRING))")).withColumn("body", F.expr(_BODY))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    data = F.when((F.col("writer") % 10 == 7) & (F.col("n") == 3), None).otherwise(F.col("size"))
    rows = _queue(spark, d).select("writer", "directory", "name", "body", F.octet_length("body").alias("size"), data.alias("data_size"))
    return recovery.manifest_problems(rows, "writer", 1 << 40)


_PARSED = f"""{_FILES}, parsed AS (SELECT writer, name, body, CAST(body AS JSON) AS j, TRY_CAST(substr(name, 1, 12) AS BIGINT) AS ord, split_part(name, '-', 2) AS kind, replace(split_part(name, '-', 3), '.json', '') AS digest, directory, CASE WHEN writer % 10 = 7 AND n = 3 THEN NULL ELSE size END AS data_size FROM manifest),
checked AS (SELECT *, CAST(json_extract_string(j, '$.casSequence') AS BIGINT) AS cas_sequence, CAST(json_extract_string(j, '$.casBarrier') AS BIGINT) AS cas_barrier, TRY_CAST(json_extract_string(j, '$.size') AS BIGINT) AS object_size,
CASE WHEN NOT regexp_full_match(name, '[0-9]{{12}}-(ac|cas)-[0-9a-f]{{64}}\\.json') THEN 'name' WHEN strlen(body) > 8192 THEN 'size of the manifest' WHEN json_type(j, '$.size') <> 'UBIGINT' THEN 'size' WHEN json_type(j, '$.acceptedAt') <> 'UBIGINT' THEN 'time'
 WHEN json_extract_string(j, '$.kind') <> kind OR json_extract_string(j, '$.digest') <> digest OR CAST(json_extract_string(j, '$.order') AS BIGINT) <> ord OR json_extract_string(j, '$.manifestPath') <> directory || '/' || name OR json_extract_string(j, '$.path') <> directory || '/' || replace(name, '.json', '.data') THEN 'inconsistent'
 WHEN kind = 'cas' AND json_extract_string(j, '$.bodySha256') <> digest THEN 'digest' WHEN data_size IS NULL OR data_size <> CAST(json_extract_string(j, '$.size') AS BIGINT) THEN 'data' END AS problem FROM parsed)"""


@query(f"WITH {_PARSED} SELECT writer, name, problem FROM checked")
def queue_manifests(spark: SparkSession, d: str) -> DataFrame:
    return _manifests(spark, d).select("writer", "name", "problem")


@query(f"""WITH {_PARSED}, d AS (SELECT writer, coalesce(min(cas_sequence) - 1, max(cas_barrier), 0) AS durable, arg_min(problem, name) FILTER (problem IS NOT NULL) AS own FROM checked GROUP BY writer),
r AS (SELECT c.*, d.durable, d.own, row_number() OVER (PARTITION BY c.writer ORDER BY c.ord, c.name) AS i FROM checked c JOIN d USING (writer)),
w AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.writer = r.writer AND o.i = r.i - 1 AND o.ord = r.ord) THEN 'order is not unique'
 WHEN cas_sequence <> 1 + coalesce(max(cas_sequence) OVER p, durable) THEN 'sequence is not contiguous' WHEN cas_barrier > coalesce(max(cas_sequence) OVER p, durable) THEN 'barrier is not covered'
 WHEN row_number() OVER (PARTITION BY writer, kind, digest ORDER BY i) > 1 THEN 'duplicate object' WHEN sum(object_size) OVER (PARTITION BY writer ORDER BY i) > {_STORE} THEN 'too many bytes' END AS across
 FROM r WINDOW p AS (PARTITION BY writer ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT writer, coalesce(any_value(own), arg_min(across, i) FILTER (across IS NOT NULL)) AS problem, any_value(durable) AS durable, coalesce(max(cas_sequence), any_value(durable)) AS accepted, max(ord) + 1 AS next_order, count(*) AS pending, CAST(sum(object_size) AS BIGINT) AS pending_bytes FROM w GROUP BY writer)
SELECT writer, problem, CASE WHEN problem IS NULL THEN durable END AS durable, CASE WHEN problem IS NULL THEN accepted END AS accepted, CASE WHEN problem IS NULL THEN next_order END AS next_order, CASE WHEN problem IS NULL THEN pending END AS pending, CASE WHEN problem IS NULL THEN pending_bytes END AS pending_bytes FROM g""")
def recovered_queues(spark: SparkSession, d: str) -> DataFrame:
    out = recovery.recovered(_manifests(spark, d), "writer", _STORE)
    return out.select("writer", "problem", *[F.col(c).cast("long").alias(c) for c in ("durable", "accepted", "next_order", "pending", "pending_bytes")])


_SUFFIX = "['.json', '.data', '.data', '.json.tmp', '.log']"


@query(f"""WITH {t.LOG}, f AS (SELECT writer, CAST(ord // 3 AS STRING) || {_SUFFIX}[CAST(ord % 5 + 1 AS INT)] AS name FROM log)
SELECT writer, name, CASE WHEN ends_with(name, '.json') THEN 'manifest' WHEN ends_with(name, '.data') THEN CASE WHEN EXISTS (SELECT 1 FROM f o WHERE o.writer = f.writer AND o.name = replace(f.name, '.data', '.json')) THEN 'data' ELSE 'orphan' END WHEN ends_with(name, '.json.tmp') THEN 'stale' ELSE 'other' END AS role FROM f""")
def queue_files(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".json", ".data", ".data", ".json.tmp", ".log"))), (F.col("ord") % 5 + 1).cast("int"))
    return recovery.pairing(t.log(spark, d).select("writer", F.concat(F.floor(F.col("ord") / 3).cast("string"), suffix).alias("name")), "writer").select("writer", "name", "role")


_BATCHED = f"{_QUEUE}, b AS (SELECT writer, ord, kind, n // 8 AS batch, CASE WHEN kind = 'cas' THEN CASE WHEN writer % 5 = 1 AND n % 19 = 0 THEN seen + 1 ELSE seen END END AS cas_sequence, CASE WHEN kind = 'ac' THEN CASE WHEN writer % 5 = 2 AND n % 13 = 0 THEN seen + 4 ELSE seen END END AS cas_barrier FROM numbered), k AS (SELECT *, coalesce(min(cas_sequence) OVER (PARTITION BY writer, batch) - 1, max(cas_barrier) OVER (PARTITION BY writer, batch), 0) AS durable FROM b), q AS (SELECT *, coalesce(max(cas_sequence) OVER (PARTITION BY writer, batch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), durable) AS covered FROM k), problems AS (SELECT *, CASE WHEN cas_sequence <> covered + 1 THEN 'sequence is not contiguous' WHEN cas_barrier > covered THEN 'barrier is not durable' END AS problem FROM q)"


def _problems(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("writer").orderBy("ord")
    seen = F.sum((F.col("kind") == "cas").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = _once(spark, d).withColumn("n", F.row_number().over(w)).withColumn("seen", seen)
    wrong = lambda k, n, more: F.when((F.col("writer") % 5 == k) & (F.col("n") % n == 0), F.col("seen") + more).otherwise(F.col("seen"))
    rows = rows.select("writer", "ord", "kind", F.floor(F.col("n") / 8).alias("batch"), F.when(F.col("kind") == "cas", wrong(1, 19, 1)).alias("cas_sequence"), F.when(F.col("kind") == "ac", wrong(2, 13, 4)).alias("cas_barrier"))
    rows = rows.withColumn("part", F.concat_ws("/", "writer", "batch"))
    group = Window.partitionBy("part")
    durable = F.coalesce(F.min("cas_sequence").over(group) - 1, F.max("cas_barrier").over(group), F.lit(0))
    return ingest.batch_problems(rows.withColumn("durable", durable), "part")


@query(f"WITH {_BATCHED} SELECT writer, ord, batch, problem FROM problems")
def batch_problems(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).select("writer", "ord", "batch", "problem")


@query(f"WITH {_BATCHED}, h AS (SELECT writer, batch, max(CASE WHEN problem = 'barrier is not durable' THEN 1 ELSE 0 END) AS hit FROM problems GROUP BY 1, 2) SELECT writer, CAST(arg_max(hit, batch) AS BIGINT) AS blocked FROM h GROUP BY writer")
def blocked_gauge(spark: SparkSession, d: str) -> DataFrame:
    return ingest.blocked(_problems(spark, d), "writer")


@query(f"""WITH {t.LOG}, e AS (SELECT writer, max(at_ms) - 86400000 AS begun FROM log GROUP BY writer), r AS (SELECT l.*, begun, begun + 3600000 AS deadline, CASE WHEN event_type <> 'error' THEN at_ms + size * 60000 END AS done FROM log l JOIN e USING (writer)),
k AS (SELECT *, at_ms < begun AS taken, coalesce(at_ms < begun AND done <= deadline, false) AS finished FROM r), l AS (SELECT writer, kind || ':' || digest AS id, row_number() OVER (PARTITION BY writer ORDER BY ord) AS place FROM k WHERE taken AND NOT finished)
SELECT writer, count_if(taken) AS accepted, count_if(NOT taken) AS refused, count_if(finished) AS completed, count_if(taken AND NOT finished) AS remaining, CAST(coalesce(sum(size) FILTER (taken AND NOT finished), 0) AS BIGINT) AS remaining_bytes,
(SELECT string_agg(id, ' ' ORDER BY place) FROM l WHERE l.writer = k.writer AND place <= 3) AS first_remaining FROM k GROUP BY writer""")
def queue_drains(spark: SparkSession, d: str) -> DataFrame:
    log = t.log(spark, d)
    ends = log.groupBy("writer").agg((F.max("at_ms") - 86_400_000).alias("drain_ms"))
    done = F.when(F.col("event_type") != "error", F.col("at_ms") + F.col("size") * 60_000)
    rows = log.join(ends, "writer").withColumns({"accepted_ms": F.col("at_ms"), "completed_ms": done, "deadline": F.col("drain_ms") + 3_600_000})
    return ingest.drained(rows, "writer", "deadline", 3).withColumn("first_remaining", F.array_join("first_remaining", " "))


# --- a catalog's refreshes

_CALL = "['candidates', 'after-miss', 'snapshot', 'refresh', 'candidates', 'candidates'][CAST(ord % 6 + 1 AS INT)]"
_RESULT = "CASE WHEN event_type = 'error' THEN 'failed' WHEN ord % 10 = 7 THEN 'limited' ELSE 'ok' END"
_INTERVAL = 7_200_000
_CALLS = f"""{t.LOG}, calls AS (SELECT writer, ord, at_ms, {_CALL} AS op, CASE WHEN ord % 6 = 1 THEN ord % 9 END AS generation, {_RESULT} AS result, CASE WHEN ord % 10 = 7 THEN size * 100000 END AS retry_ms, CASE WHEN ord % 4 < 2 THEN 0 ELSE size % 5 END AS hits, size % 3 AS fresh_hits, row_number() OVER (PARTITION BY writer ORDER BY at_ms, ord) AS i FROM log),
f AS (SELECT writer, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(NULL AS BIGINT) AS listed, CAST(NULL AS BIGINT) AS miss, CAST(NULL AS BIGINT) AS failed_until, CAST(NULL AS BIGINT) AS limited_until, false AS fetched, false AS missed, CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS found, false AS fresh FROM (SELECT DISTINCT writer FROM calls)
 UNION ALL SELECT writer, i, g1, CASE WHEN good THEN at_ms ELSE listed END, CASE WHEN missed1 THEN at_ms ELSE miss END,
  CASE WHEN good THEN NULL WHEN bad THEN greatest(coalesce(failed_until, 0), at_ms + greatest({_INTERVAL}, coalesce(retry_ms, 0))) ELSE failed_until END, CASE WHEN slow THEN greatest(coalesce(limited_until, 0), at_ms + retry_ms) ELSE limited_until END,
  fetch1, missed1, error1, CASE WHEN op IN ('candidates', 'after-miss') AND error1 IS NULL THEN CASE WHEN good THEN fresh_hits ELSE hits END ELSE 0 END, good
 FROM (SELECT *, fetch1 AND result = 'ok' AS good, fetch1 AND result = 'failed' AS bad, fetch1 AND result = 'limited' AS slow, CASE WHEN fetch1 AND result = 'ok' THEN g + 1 ELSE g END AS g1,
   CASE WHEN g > 0 OR NOT wants THEN NULL WHEN NOT fetch1 THEN CASE WHEN at_ms < limited_until THEN 'limited' ELSE 'failed' END WHEN result <> 'ok' THEN result END AS error1
  FROM (SELECT *, wants AND NOT coalesce(at_ms < limited_until, false) AND NOT coalesce(at_ms < failed_until, false) AS fetch1
   FROM (SELECT *, for_miss AS missed1, for_miss OR plain AS wants
    FROM (SELECT *, ((op = 'candidates' AND g > 0 AND hits = 0) OR (op = 'after-miss' AND g <= generation)) AND NOT (g > 0 AND miss IS NOT NULL AND at_ms - miss < {_INTERVAL}) AS for_miss, (op = 'snapshot' AND NOT (g > 0 AND at_ms - listed < {_INTERVAL})) OR op = 'refresh' OR (op = 'candidates' AND g = 0) AS plain
     FROM (SELECT c.*, f.g, f.listed, f.miss, f.failed_until, f.limited_until FROM f JOIN calls c ON c.writer = f.writer AND c.i = f.i + 1))))))"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("candidates", "after-miss", "snapshot", "refresh", "candidates", "candidates"))), (F.col("ord") % 6 + 1).cast("int"))
    return t.log(spark, d).select(
        "writer", "ord", "at_ms", op.alias("op"), F.when(F.col("ord") % 6 == 1, F.col("ord") % 9).alias("generation"), F.expr(_RESULT).alias("result"), F.when(F.col("ord") % 10 == 7, F.col("size") * 100_000).alias("retry_ms"),
        F.when(F.col("ord") % 4 < 2, F.lit(0).cast("long")).otherwise(F.col("size") % 5).alias("hits"), (F.col("size") % 3).alias("fresh_hits"),
    )


@query(f"WITH RECURSIVE {_CALLS} SELECT writer, c.ord, f.fetched, f.missed, CASE WHEN f.error IS NULL THEN f.g ELSE 0 END AS served, f.found, f.error FROM f JOIN calls c USING (writer, i)")
def catalog_timeline(spark: SparkSession, d: str) -> DataFrame:
    return refresh.timeline(_calls(spark, d), "writer", _INTERVAL).select("writer", "ord", "fetched", "missed", "served", "found", "error")


@query(f"""WITH RECURSIVE {_CALLS}, x AS (SELECT f.*, c.op, c.result FROM f JOIN calls c USING (writer, i)) SELECT writer, count_if(fetched) AS attempts, count_if(fresh) AS refreshes, count_if(fetched AND result <> 'ok') AS errors, count_if(missed) AS miss_refreshes, count_if(op IN ('candidates', 'after-miss')) AS queries, CAST(sum(found) AS BIGINT) AS candidates, max(CASE WHEN error IS NULL THEN g ELSE 0 END) AS generation FROM x GROUP BY writer""")
def catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    return refresh.catalog_counters(refresh.timeline(_calls(spark, d), "writer", _INTERVAL), "writer")


@query(f"WITH {t.CATALOG}, l AS (SELECT ref, id % 7 AS generation, id FROM catalog), m AS (SELECT ref, max(generation) AS generation FROM l WHERE generation < 6 OR ref <> 'refs/heads/main' GROUP BY ref) SELECT l.ref, l.generation, l.id FROM l JOIN m USING (ref, generation)")
def latest_generation(spark: SparkSession, d: str) -> DataFrame:
    rows = t.catalog(spark, d).select("ref", (F.col("id") % 7).alias("generation"), "id").where("generation < 6 OR ref <> 'refs/heads/main'")
    return refresh.generations(rows, "ref", ["id"])


@query("""WITH r AS (SELECT o_orderkey, 'refs/pull/' || CAST(o_custkey % 9 AS VARCHAR) || '/merge' AS cur, CASE WHEN o_orderkey % 3 > 0 THEN 'refs/heads/' || CAST(o_custkey % 2 AS VARCHAR) END AS base, CASE WHEN o_orderkey % 5 = 0 THEN 'refs/pull/' || CAST(o_custkey % 9 AS VARCHAR) || '/merge' ELSE 'refs/heads/0' END AS def FROM orders),
u AS (SELECT o_orderkey, 0 AS place, cur AS ref FROM r UNION ALL SELECT o_orderkey, 1, base FROM r UNION ALL SELECT o_orderkey, 2, def FROM r) SELECT o_orderkey, CAST(min(place) AS BIGINT) AS place, ref FROM u WHERE ref IS NOT NULL GROUP BY o_orderkey, ref""")
def relevant_refs(spark: SparkSession, d: str) -> DataFrame:
    pull = F.concat(F.lit("refs/pull/"), (F.col("o_custkey") % 9).cast("string"), F.lit("/merge"))
    base = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("refs/heads/"), (F.col("o_custkey") % 2).cast("string")))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", pull.alias("current"), base.alias("base"), F.when(F.col("o_orderkey") % 5 == 0, pull).otherwise("refs/heads/0").alias("default"))
    return refresh.distinct_refs(rows, "o_orderkey")


# --- counters and gauges

_NAMES = ("health", "shutdown", "get", "put", "rejected", "aborted")
_OPS = ("reserve", "upload", "finalize", "lookup", "download")
_OF = lambda names, by: f"[{', '.join(repr(n) for n in names)}][CAST({by} % {len(names)} + 1 AS INT)]"


def _of(names: tuple[str, ...], by: str):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(by) % len(names) + 1).cast("int"))


@query(f"WITH {t.LOG} SELECT writer, {', '.join(f'count_if(r = {n!r}) AS {n}' for n in _NAMES)} FROM (SELECT writer, {_OF(_NAMES, 'size')} AS r FROM log) GROUP BY writer")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(t.log(spark, d).withColumn("r", _of(_NAMES, "size")), "writer", "r", _NAMES)


@query(f"""WITH {t.LOG}, c AS (SELECT writer, {_OF(_OPS, 'ord')} AS op, event_type = 'error' AS error, size % 2 = 0 AS limited FROM log)
SELECT writer, {', '.join(f'count_if(op = {n!r}) AS {n}' for n in _OPS)}, count_if(error) AS errors, count_if(error AND limited) AS rate_limited, {', '.join(f'count_if(op = {n!r} AND limited) AS {n}_limited' for n in _OPS)} FROM c GROUP BY writer""")
def operation_counters(spark: SparkSession, d: str) -> DataFrame:
    calls = t.log(spark, d).select("writer", _of(_OPS, "ord").alias("op"), (F.col("event_type") == "error").alias("error"), (F.col("size") % 2 == 0).alias("limited"))
    return metrics.operations(calls, "writer", _OPS)


@query(f"WITH {t.LOG} SELECT writer, CAST(coalesce(sum(size) FILTER (k = 'trailer'), 0) AS BIGINT) AS trailer, CAST(coalesce(sum(size) FILTER (k = 'index'), 0) AS BIGINT) AS index, CAST(coalesce(sum(size) FILTER (k = 'payload'), 0) AS BIGINT) AS payload FROM (SELECT writer, size, ['trailer', 'index', 'payload'][CAST(ord % 3 + 1 AS INT)] AS k FROM log) GROUP BY writer")
def range_bytes(spark: SparkSession, d: str) -> DataFrame:
    names = ("trailer", "index", "payload")
    return metrics.sums(t.log(spark, d).withColumn("k", _of(names, "ord")), "writer", "k", "size", names)


@query(f"WITH {t.LOG}, h AS (SELECT writer, ord, sum(CASE WHEN ord % 2 = 0 THEN size ELSE -size END) OVER (PARTITION BY writer ORDER BY ord) AS held FROM log) SELECT writer, CAST(arg_max(held, ord) AS BIGINT) AS last, CAST(greatest(max(held), 0) AS BIGINT) AS peak FROM h GROUP BY writer")
def inflight_gauge(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gauge(t.log(spark, d), "writer", F.when(F.col("ord") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "ord")


@query(f"WITH {t.LOG} SELECT writer, coalesce(bool_or(kind = 'cas' AND event_type = 'error'), false) AS cas_failed, coalesce(bool_or(ord % 37 = 5), false) AS journal_failed, arg_max(event_type = 'error', ord) AS circuit_open FROM log GROUP BY writer")
def daemon_flags(spark: SparkSession, d: str) -> DataFrame:
    log = t.log(spark, d).withColumn("circuit_open", F.col("event_type") == "error")
    failed = metrics.latched(log, "writer", cas_failed=(F.col("kind") == "cas") & (F.col("event_type") == "error"), journal_failed=F.col("ord") % 37 == 5)
    return failed.join(metrics.latest(log, "writer", "ord", "circuit_open"), "writer")


@query(f"""WITH {t.LOG}, q AS (SELECT writer, size, n > 0.75 * max(n) OVER (PARTITION BY writer) AS open, CASE WHEN kind = 'cas' THEN seen END AS cas_sequence, event_type <> 'error' AS completed FROM (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY ord) AS n, sum(CASE WHEN kind = 'cas' THEN 1 ELSE 0 END) OVER (PARTITION BY writer ORDER BY ord) AS seen FROM log))
SELECT writer, count_if(NOT completed) AS pending, CAST(coalesce(sum(size) FILTER (NOT completed), 0) AS BIGINT) AS pending_bytes, count_if(NOT completed AND open) AS open_objects, CAST(coalesce(sum(size) FILTER (NOT completed AND open), 0) AS BIGINT) AS open_bytes,
CAST(coalesce(min(cas_sequence) FILTER (NOT completed) - 1, max(cas_sequence), 0) AS BIGINT) AS durable, CAST(coalesce(max(cas_sequence), 0) AS BIGINT) AS accepted FROM q GROUP BY writer""")
def queue_snapshots(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("writer").orderBy("ord")
    n, seen = F.row_number().over(w), F.sum((F.col("kind") == "cas").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = t.log(spark, d).withColumn("n", n).withColumn("seen", seen).withColumn("open", F.col("n") > 0.75 * F.max("n").over(Window.partitionBy("writer")))
    return metrics.queue_snapshot(rows.withColumns({"cas_sequence": F.when(F.col("kind") == "cas", F.col("seen")), "completed": F.col("event_type") != "error"}), "writer")


@query(f"""WITH RECURSIVE {t.LOG}, n AS (SELECT writer, ord, size, row_number() OVER (PARTITION BY writer ORDER BY ord) AS i FROM log),
f AS (SELECT writer, size, i, CAST(0 AS BIGINT) AS batch, 1 AS c, size AS held FROM n WHERE i = 1
 UNION ALL SELECT n.writer, n.size, n.i, CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN 1 ELSE f.c + 1 END, CASE WHEN f.c >= 8 OR f.held + n.size > 250 THEN n.size ELSE f.held + n.size END FROM f JOIN n ON n.writer = f.writer AND n.i = f.i + 1)
SELECT writer, CAST(arg_max(c, i) AS BIGINT) AS objects, arg_max(held, i) AS bytes FROM f GROUP BY writer""")
def open_batches(spark: SparkSession, d: str) -> DataFrame:
    return ingest.open_batches(ingest.batches(t.log(spark, d), "writer", 8, 250), "writer")


# --- pacing at any rate

# budget, writers and burst; times of arrival are seconds of a minute, so that buckets run dry
_RATES = ((7, 1, 2), (120, 7, 3), (70000, 1, 1))
_ARRIVALS = f"{t.LOG}, a AS (SELECT writer, ord, at_ms // 60000 AS at_ms FROM log)"
_GRANTS = " UNION ALL ".join(
    f"""SELECT {b} AS budget, {k} AS writers, writer, ord, at_ms, CAST(ceil(CASE WHEN i = 0 THEN at_ms * CAST({b} AS HUGEINT) ELSE greatest(at_ms * {b}, i * {60000 * k} + m - {(burst - 1) * 60000 * k}) END / CAST({b} AS DECIMAL(18, 0))) AS BIGINT) AS grant_ms
FROM (SELECT *, max(at_ms * {b} - i * {60000 * k}) OVER (PARTITION BY writer ORDER BY at_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY at_ms, ord) - 1 AS i FROM a))"""
    for b, k, burst in _RATES
)


def _granted(spark: SparkSession, d: str) -> DataFrame:
    arrivals = t.log(spark, d).select("writer", "ord", F.floor(F.col("at_ms") / 60_000).alias("at_ms"))
    out = None
    for b, k, burst in _RATES:
        one = pacing.grants(arrivals, "writer", b, burst, k).select(F.lit(b).alias("budget"), F.lit(k).alias("writers"), "writer", "ord", "at_ms", "grant_ms")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_ARRIVALS} SELECT budget, writers, writer, ord, grant_ms FROM ({_GRANTS})")
def pacer_grants_at_rates(spark: SparkSession, d: str) -> DataFrame:
    return _granted(spark, d).select("budget", "writers", "writer", "ord", "grant_ms")


@query(f"WITH {_ARRIVALS} SELECT budget, writers, writer, count_if(grant_ms > at_ms) AS sleeps, CAST(sum(greatest(grant_ms - at_ms, 0)) AS BIGINT) AS slept_ms FROM ({_GRANTS}) GROUP BY ALL")
def pacer_sleeps(spark: SparkSession, d: str) -> DataFrame:
    rows = _granted(spark, d).withColumn("by", F.struct("budget", "writers", "writer"))
    return pacing.sleeps(rows, "by").select("by.budget", "by.writers", "by.writer", "sleeps", "slept_ms")


@query(f"WITH {t.LOG} SELECT writer, ord, CAST(max(at_ms + coalesce(CASE WHEN ord % 3 = 0 THEN size * 1000 END, 60000) + CAST(floor((ord % 100) / 100.0 * 1000) AS BIGINT)) OVER (PARTITION BY writer ORDER BY at_ms, ord) AS BIGINT) AS until_ms FROM log")
def jittered_pauses(spark: SparkSession, d: str) -> DataFrame:
    pause = F.coalesce(F.when(F.col("ord") % 3 == 0, F.col("size") * 1000), F.lit(pacing.DEFAULT_PAUSE))
    rows = t.log(spark, d).withColumns({"pause_ms": pause, "random": F.col("ord") % 100 / F.lit(100.0)})
    return pacing.paused_until(rows, "writer", 1000).select("writer", "ord", "until_ms")


@query(f"""WITH {t.LOG}, e AS (SELECT writer, ord, at_ms, event_type = 'error' AS limited, 120.0 - ord % 7 AS rate, max(at_ms + size * 100000) OVER (PARTITION BY writer ORDER BY at_ms, ord) AS until_ms, at_ms + size * 50000 AS grant_ms FROM log), n AS (SELECT quantile_disc(at_ms, 0.5) AS now FROM log WHERE writer > 0), s AS (SELECT * FROM e, (SELECT 1704500000000 AS now) WHERE at_ms <= now)
SELECT writer, 120.0::DOUBLE AS configured, CAST(arg_max(rate, (at_ms, ord)) AS DOUBLE) AS current, CAST(CASE WHEN max(until_ms) > any_value(now) THEN max(until_ms) END AS BIGINT) AS pause_until_ms, count_if(limited) AS rate_limits, count_if(grant_ms <= now) AS granted, count_if(grant_ms > now) AS queued, CAST(sum(greatest(least(grant_ms, now) - at_ms, 0)) AS BIGINT) AS slept_ms FROM s GROUP BY writer""")
def pacer_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = pacing.paused_until(t.log(spark, d).withColumn("pause_ms", F.col("size") * 100_000), "writer")
    rows = rows.withColumns({"limited": F.col("event_type") == "error", "rate": (120 - F.col("ord") % 7).cast("double"), "grant_ms": F.col("at_ms") + F.col("size") * 50_000})
    return pacing.pacer_snapshot(rows, "writer", 120.0, 1_704_500_000_000)
