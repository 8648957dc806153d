import hashlib

import duckdb
import pandas as pd
import pytest

from cairn.functions import keys, redact, status
from cairn.operators import ingest, packs, pacing
from cairn.plans import registry
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    cell = lambda v: None if v is None or pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert _rows(registry.queries()[name](spark, DIR).toPandas()) == _rows(duck.execute(registry.oracle_sql()[name]).df())


def test_pack_round_trip_and_corruption():
    sha = lambda b: hashlib.sha256(b).digest()
    records = [("cas", sha(b"first CAS"), b"first CAS"), ("ac", b"\xff" * 32, b"opaque ActionResult"), ("cas", sha(b""), b"")]
    raw = packs.encode(records)
    rows = packs.decode(raw)
    assert len(raw) == 28 + 16 + 96 * 3 + 64 and [r[:2] for r in rows] == [("ac", 1), *sorted((("cas", 0), ("cas", 2)), key=lambda r: records[r[1]][1])]
    for bad in (raw[:-1], b"x" + raw[1:], raw[:30] + b"\xff" + raw[31:], b""):
        if bad[:1] != b"x":
            with pytest.raises(ValueError):
                packs.decode(bad)
    with pytest.raises(ValueError):
        packs.encode([("cas", b"\0" * 32, b"x")])
    with pytest.raises(ValueError):
        packs.encode([records[1], records[1]])


def test_bloom_positions(spark):
    from cairn.functions import bloom

    digest = hashlib.sha256(b"first CAS").hexdigest()
    row = spark.createDataFrame([("cas", digest), ("ac", "f" * 64)], "kind string, digest string").select(bloom.positions(F.col("kind"), F.col("digest")).alias("p")).collect()
    assert [r["p"] for r in row] == [[936, 880, 1806, 39, 25], [6, 1944, 2033, 1369, 750]]


def test_grants_pauses_and_barrier(spark):
    four = spark.createDataFrame([("w", k, 0) for k in range(4)], "writer string, ord long, at_ms long")
    assert [r["grant_ms"] for r in pacing.grants(four, "writer", 30, 2).orderBy("ord").collect()] == [0, 0, 2000, 4000]
    log = spark.createDataFrame([(0, "cas", "a", "x", 1), (1, "cas", "b", "x", 1), (2, "ac", "a", "x", 1), (3, "ac", "a", "y", 1), (4, "ac", "a", "x", 1)], "ord long, kind string, digest string, body_sha256 string, size long")
    judged = ingest.outcomes(log)
    assert [r["outcome"] for r in judged.orderBy("ord").collect()] == ["accepted", "accepted", "accepted", "conflict", "duplicate"]
    got = ingest.sequenced(judged.where("outcome = 'accepted'")).orderBy("ord").collect()
    assert [(r["cas_sequence"], r["cas_barrier"]) for r in got] == [(1, None), (2, None), (None, 2)]


def test_redaction_and_statuses(spark):
    one = spark.range(1)
    text = F.lit("upload https://x.y/z?sig=1 with Bearer abc 'C:\\secret\\f' in ./a/b and /etc/passwd")
    assert one.select(redact.diagnostic_text(text)).first()[0] == "upload <redacted-url> with Bearer <redacted> '<redacted-path>' in .<redacted-path> and <redacted-path>"
    now = F.lit(1785067200000).cast("bigint")
    heads = ["15", "Sun, 26 Jul 2026 12:00:09 GMT", "Sun, 26 Jul 2020 12:00:09 GMT", "1.5", "not-a-date", None]
    assert [one.select(status.retry_after_ms(F.lit(h).cast("string"), now)).first()[0] for h in heads] == [15000, 9000, 0, None, None, None]
    assert one.select(keys.parse_pack_key(F.lit("brc2-not-a-pack"))).first()[0] is None


def test_stream_outcomes(spark, tmp_path):
    from cairn.streaming import ingest as stream

    rows = [(0, "cas", "a", "x", 1), (1, "cas", "a", "x", 1), (2, "cas", "a", "y", 1), (3, "ac", "a", "x", 1)]
    schema = "ord long, kind string, digest string, body_sha256 string, size long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.outcomes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["ord"], r["outcome"]) for r in spark.table("outcomes").collect()) == [(0, "accepted"), (1, "duplicate"), (2, "conflict"), (3, "accepted")]


def test_journal(spark, tmp_path):
    from cairn.sources import files

    good = '{"timestamp":"2026-01-02T03:04:05Z","area":"a","operation":"get","name":"error","message":"at https://a.b/c","statusCode":900,"aborted":false}'
    # a line without a proper area, or without a time, is none
    (tmp_path / "j").write_text("\n".join([good, good.replace('"a"', '"BAD"'), good.replace("2026", "t"), "not json", ""]))
    rows = files.journal(spark, str(tmp_path / "j")).collect()
    assert [(r["area"], r["message"], r["statusCode"]) for r in rows] == [("a", "at <redacted-url>", None)]


def test_admission_reclaims_in_order_of_durability(spark):
    from cairn.operators import admission

    log = [(0, "accept", "a", 6), (1, "accept", "b", 4), (2, "accept", "c", 1), (3, "complete", "b", 0), (4, "complete", "a", 0), (5, "accept", "c", 5), (6, "accept", "a", 6), (7, "complete", "z", 0), (8, "accept", "c", 5)]
    rows = spark.createDataFrame([("w", *r) for r in log], "w string, ord long, op string, id string, size long")
    got = [r["outcome"] for r in admission.admitted(rows, "w", 10).orderBy("ord").collect()]
    # b goes, then a, to make room for c; then a does not fit beside it
    assert got == ["accepted", "accepted", "full", "durable", "durable", "accepted", "full", "unknown", "duplicate"]


def test_semaphore_equals_a_clock(spark):
    import random

    from cairn.operators import admission

    rng = random.Random(3)
    calls = sorted((rng.randrange(60), k, rng.randrange(7), rng.randrange(1, 9)) for k in range(80))
    queue, running, want, used = [], [], {}, 0
    for now in range(1000):
        used -= sum(a for end, a in running if end == now)
        running = [r for r in running if r[0] > now]
        for at, k, amount, hold in calls:
            if at == now and amount == 0:
                want[k] = now
            elif at == now and amount <= 5:
                queue.append((k, amount, hold))
            elif at == now:
                want[k] = None
        while queue and used + queue[0][1] <= 5:
            k, amount, hold = queue.pop(0)
            want[k], used = now, used + amount
            running.append((now + hold, amount))
    rows = spark.createDataFrame([("w", k, at, amount, hold) for at, k, amount, hold in calls], "w string, ord long, at_ms long, amount long, hold_ms long")
    assert {r["ord"]: r["granted_ms"] for r in admission.semaphore(rows, "w", 5).collect()} == want


def test_catalog_pages_drop_bad_records_and_refuse_bad_pages(spark):
    from cairn.sources import catalog

    good = '{"id":1,"key":"k","version":"v","ref":"r","size_in_bytes":2,"created_at":"2026-01-02T03:04:05Z"}'
    bad = [good.replace(":1,", ":-1,"), good.replace('"k"', "7"), good.replace("2026-01", "soon"), "5", "null"]
    page = lambda body: spark.createDataFrame([(body,)], "body string")
    rows = catalog.records(page('{"total_count":9,"actions_caches":[%s]}' % ",".join([good, *bad]))).collect()
    assert [(r["id"], r["key"], r["size_bytes"]) for r in rows] == [(1, "k", 2)]
    with pytest.raises(Exception, match="malformed"):
        catalog.records(page('{"total_count":-1,"actions_caches":[]}')).collect()


def test_every_member_is_looked_up(spark):
    found = registry.queries()["bloom_candidates"](spark, DIR)
    own = found.where("pack = floor(probe_id / 100)").count()
    assert own == spark.read.parquet(f"{DIR}/part.parquet").count()


def test_ties_of_the_catalog_are_settled_by_the_rows(spark):
    from cairn.operators import lookup

    entries = [(1, "k", "v1", "r", size, 5) for size in (4, 2, 9)]
    for step in (1, -1):
        catalog = spark.createDataFrame(entries[::step], "id long, key string, version string, ref string, size_bytes long, created_at long").coalesce(1)
        assert [r["size_bytes"] for r in lookup.distinct_ids(catalog).collect()] == [2]


def test_ties_of_candidates_are_settled_by_the_rows(spark):
    from cairn.operators import lookup

    tried = [("p", 0, 7, key, "v1", 5, True, holds) for key, holds in (("b", True), ("a", False), ("a", True), ("c", True))]
    for step in (1, -1):
        candidates = spark.createDataFrame(tried[::step], "probe_id string, turn int, pack long, key string, version string, created_at long, intact boolean, holds boolean").coalesce(1)
        assert [tuple(r) for r in lookup.materialized(candidates, "v1").collect()] == [("p", 7, 1, 0, 0)]
