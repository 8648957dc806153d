import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import bloom, keys, records
from cairn.operators import commits, pacing, refresh


@pytest.mark.parametrize("budget,writers,burst", [(7, 1, 2), (120, 7, 1), (70_000, 1, 3), (1, 1, 1)])
def test_grants_equal_a_clock(spark, budget, writers, burst):
    rnd = random.Random(budget)
    arrivals = sorted(rnd.randrange(40_000) for _ in range(120))
    rate, want, tokens, at = budget / writers / 60_000, [], float(burst), arrivals[0]
    for a in arrivals:
        now = max(a, at)
        tokens, at = min(burst, tokens + (now - at) * rate), now
        if tokens + 1e-9 < 1:
            wait = -int(-((1 - tokens) / rate) // 1)
            # the clock wakes in the first millisecond in which the token is there
            while min(burst, tokens + (wait - 1) * rate) + 1e-9 >= 1:
                wait -= 1
            tokens, at = min(burst, tokens + wait * rate), at + wait
        tokens = max(0.0, tokens - 1)
        want.append(at)
    rows = spark.createDataFrame([("w", k, a) for k, a in enumerate(arrivals)], "writer string, ord long, at_ms long")
    got = [r["grant_ms"] for r in pacing.grants(rows, "writer", budget, burst, writers).orderBy("ord").collect()]
    assert got == want


def test_grants_at_seven_a_minute(spark):
    rows = spark.createDataFrame([("w", k, 0) for k in range(60)], "writer string, ord long, at_ms long")
    got = {r["ord"]: r["grant_ms"] for r in pacing.grants(rows, "writer", 7, 2).collect()}
    assert got[59] == 497_143 and got[2] == 8572


def test_folds_of_a_hot_writer_cross_batches(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("writer"), F.col("id").alias("ord"), (F.col("id") * 61_000).alias("at_ms"), (F.col("id") % 1000 == 0).alias("limited"))
    out = pacing.adaptive_rates(rows, "writer", 120.0)
    assert out.count() == 40_000
    assert [round(r["rate"], 6) for r in out.where("ord in (0, 1, 4, 5, 6, 1000)").orderBy("ord").collect()] == [60.0, 72.0, 108.0, 120.0, 120.0, 60.0]
    none = spark.createDataFrame([("w", 0, 0, True, None), ("w", 1, 59_999, False, None), ("w", 2, 60_000, False, None)], "writer string, ord long, at_ms long, limited boolean, pause_ms long")
    assert [r["state"] for r in pacing.circuit(none, "writer").orderBy("ord").collect()] == ["closed", "open", "probe"]


def test_refreshes_of_a_catalog(spark):
    # the interval is 100 ms; a, a, (+101) a, b
    calls = [("candidates", 0, 1000, 0), ("candidates", 0, 1000, 0), ("candidates", 0, 1101, 2), ("candidates", 0, 1101, 0), ("after-miss", 3, 1150, 0), ("refresh", 0, 1160, 0), ("after-miss", 0, 1300, 1)]
    rows = spark.createDataFrame([("w", k, at, op, g, "ok", None, hits, 1) for k, (op, g, at, hits) in enumerate(calls)], "writer string, ord long, at_ms long, op string, generation long, result string, retry_ms long, hits long, fresh_hits long")
    got = refresh.timeline(rows, "writer", 100).orderBy("ord").collect()
    assert [r["fetched"] for r in got] == [True, True, False, True, False, True, False]
    assert [r["missed"] for r in got] == [False, True, False, True, False, False, False]
    assert [r["served"] for r in got] == [1, 2, 2, 3, 3, 4, 4]
    # without a snapshot a failure is the answer until its pause ends; with one it is served
    calls = [("snapshot", 0, "limited", 7000), ("snapshot", 6999, "ok", None), ("snapshot", 7000, "failed", None), ("snapshot", 7099, "ok", None), ("snapshot", 7100, "ok", None), ("refresh", 7150, "limited", 500), ("refresh", 7300, "ok", None)]
    rows = spark.createDataFrame([("w", k, at, op, None, result, retry, 0, 0) for k, (op, at, result, retry) in enumerate(calls)], rows.schema)
    got = refresh.timeline(rows, "writer", 100).orderBy("ord").collect()
    assert [(r["fetched"], r["served"], r["error"]) for r in got] == [(True, 0, "limited"), (False, 0, "limited"), (True, 0, "failed"), (False, 0, "failed"), (True, 1, None), (True, 1, None), (False, 1, None)]


def test_commits_end_as_their_calls_say(spark):
    logs = {
        "plain": ["ok", "ok", "ok"], "there": ["conflict", "miss", "ok"], "lost": ["conflict", *["miss"] * 5], "slow": ["limited", *["miss"] * 5, "ok", "retryable", "retryable", "ok", "ok"],
        "late": ["ok", "ok", "retryable", *["miss"] * 5, "ok"], "refused": ["ok", "fatal"], "half": ["ok", "ok"], "taken": ["ok", "ok", "conflict", *["miss"] * 5],
    }
    rows = spark.createDataFrame([(n, k, r) for n, log in logs.items() for k, r in enumerate(log)], "entry string, ord long, result string")
    got = {r["entry"]: (r["outcome"], r["waited_ms"]) for r in commits.outcomes(commits.commits(rows, "entry"), "entry").collect()}
    assert got == {"plain": ("created", 0), "there": ("already-exists", 0), "lost": ("retry", 0), "slow": ("created", 750), "late": ("created", 250), "refused": ("failed", 0), "half": ("open", 0), "taken": ("failed", 0)}


def test_records_and_filters(spark):
    one = spark.range(1)
    bad = [None, "", "not json", "[1]", "null", "7"]
    assert [one.select(records.daemon_problem(F.lit(x).cast("string"))).first()[0] for x in bad] == ["record"] * 6
    assert [one.select(records.metrics_problem(F.lit(x).cast("string"))).first()[0] for x in bad] == ["record"] * 6
    raw = bloom.filter_of([("cas", bytes(32)), ("ac", bytes(32))])
    members = spark.createDataFrame([("p", "cas", "0" * 64), ("p", "ac", "0" * 64)], "pack string, kind string, digest string")
    row = bloom.build(members, "pack").select(bloom.packed(F.col("bits")).alias("raw"), bloom.may_contain(F.col("bits"), bloom.positions(F.lit("ac"), F.lit("0" * 64))).alias("has"), bloom.may_contain(F.col("bits"), bloom.positions(F.lit("ac"), F.lit("1" * 64))).alias("not")).first()
    assert bytes(row["raw"]) == raw and row["has"] and not row["not"]
    text = one.select(keys.base64url(F.lit(raw))).first()[0]
    assert len(text) == 342 and bytes(one.select(keys.decoded_filter(F.lit(text))).first()[0]) == raw
    assert one.select(keys.safe_integer(F.lit("5\n")).alias("a"), keys.digest_hex(F.lit("a" * 64)).alias("b"), keys.digest_hex(F.lit("A" * 64)).alias("c"), keys.unsigned64(F.lit("18446744073709551615")).cast("string").alias("d"), keys.unsigned64(F.lit("18446744073709551616")).alias("e"), keys.kind_name(F.lit(1)).alias("f")).first() == (None, "a" * 64, None, "18446744073709551615", None, "cas")


def test_events_messages_and_flags(spark):
    from cairn.functions import redact

    one = spark.range(1)
    e = redact.event(F.lit("back end"), F.lit("get"), F.lit("zz"), F.lit("A" * 64), F.lit("TypeError"), F.lit("aborted at https://x.y/z"), F.lit(99), F.lit(False))
    assert tuple(one.select(e.alias("e")).first()["e"]) == ("unknown", "get", None, None, "type-error", "aborted at <redacted-url>", None, True)
    assert one.select(redact.service_message(F.lit("Bearer abc http://x.y/z " + "w" * 400))).first()[0] == ("Bearer <redacted> <redacted-url> " + "w" * 400)[:300]
    assert [one.select(records.boolean_field(F.lit(x), "f")).first()[0] for x in ('{"f":true}', '{"f":"true"}', '{"g":1}', "x")] == [True, None, None, None]


def test_running_sums_of_skewed_orders(spark):
    from cairn.operators.running import running_sums

    rnd = random.Random(4)
    orders = sorted({*range(3000), -(1 << 60), 1 << 60, *(rnd.randrange(1 << 40) for _ in range(500))})
    rows = spark.createDataFrame([(o, k % 7) for k, o in enumerate(orders)], "ord long, n long").repartition(5)
    got = {r["ord"]: r["total"] for r in running_sums(rows, "ord", {"total": F.col("n")}).collect()}
    total = 0
    for k, o in enumerate(orders):
        total += k % 7
        assert got[o] == total
    assert running_sums(rows.where("ord = 5"), "ord", {"total": F.col("n")}).count() == 1
    assert running_sums(rows.where("false"), "ord", {"total": F.col("n")}).count() == 0
