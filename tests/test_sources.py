import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from cairn.operators import packs, recovery
from cairn.sources import catalog, files


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("packs"))
    rows = [(p, k, "cas", _sha(b"%d-%d" % (p, k)), b"%d-%d" % (p, k)) for p in (3, 4) for k in range(20)] + [(3, 90, "ac", "f" * 64, b"opaque"), (4, 90, "cas", _sha(b""), b"")]
    objects = spark.createDataFrame(rows, "pack long, ord long, kind string, digest string, payload binary")
    found = packs.write(objects, "pack", folder, "a81f7e9d", "73400291", "18ca73ff")
    return folder, rows, found.collect()


def test_packs_are_written_once_and_read_by_ranges(spark, written, tmp_path):
    folder, rows, found = written
    for r in found:
        raw = open(r["path"], "rb").read()
        assert len(raw) == r["bytes"] and r["path"].endswith(f"{r['pack']:06d}-{_sha(raw)[:16]}.pack") and r["key"].endswith(_sha(raw)[:16])
    index = files.pack_indexes(spark, folder)
    assert index.where("problem is not null").count() == 0
    assert sorted((r["kind"], r["digest"]) for r in index.collect()) == sorted((k, d) for _, _, k, d, _ in rows)
    payloads = files.pack_payloads(index.drop("problem"))
    assert sorted(bytes(r["payload"]) for r in payloads.where("problem is null").collect()) == sorted(p for *_, p in rows)
    whole = packs.payloads(files.packs(spark, folder), "pack")
    assert whole.where("good").count() == len(rows)
    assert sorted((r["kind"], r["digest"]) for r in files.pack_entries(spark, folder).collect()) == sorted((k, d) for _, _, k, d, _ in rows)
    # spoilt files: a byte of the index, a payload's byte, a short file, no pack at all
    raw = open(found[0]["path"], "rb").read()
    at = int.from_bytes(raw[-48:-40], "big")
    for name, bad in (("index", raw[: at + 20] + b"\xff" + raw[at + 21 :]), ("payload", b"\xff" + raw[1:]), ("short", raw[:40]), ("cut", raw[:-1]), ("none", b"x" * 500)):
        (tmp_path / f"{name}.pack").write_bytes(bad)
    index = files.pack_indexes(spark, str(tmp_path))
    problems = {r["path"].split("/")[-1]: r["problem"] for r in index.where("problem is not null").collect()}
    assert problems == {"index.pack": "hash of the index", "short.pack": "not a pack", "cut.pack": "trailer", "none.pack": "trailer"}
    broken = files.pack_payloads(index.where("problem is null").drop("problem")).where("problem is not null")
    assert [(r["ordinal"], r["problem"]) for r in broken.collect()] == [(0, "hash")]
    assert files.pack_indexes(spark, folder, 5).where("problem = 'too many objects'").count() == 2


def test_ranges_tell_what_is_wrong(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789")
    path = str(tmp_path / "a")
    asked = [(path, 2, 3), (path, 8, 3), (path, -1, 2), (path, 0, 0), (path + "x", 0, 1), (path, 10, 1), (path, 0, 10)]
    got = files.ranges(spark.createDataFrame(asked, "path string, offset long, length long").coalesce(1)).collect()
    assert [(r["payload"] and bytes(r["payload"]), r["problem"]) for r in got] == [(b"234", None), (None, "truncated"), (None, "range"), (None, "range"), (None, "missing"), (None, "truncated"), (b"0123456789", None)]
    assert files.whole(spark, path).first()["complete"]


def test_tails_lose_a_cut_line(spark, tmp_path):
    (tmp_path / "a").write_text("first\nsecond\nthird\n")
    (tmp_path / "b").write_text("one long line")
    (tmp_path / "c").write_text("")
    got = {r["path"].split("/")[-1]: r["text"] for r in files.tail(spark, str(tmp_path), 9).collect()}
    assert got == {"a": "third\n", "b": ""}
    assert {r["path"].split("/")[-1]: r["text"] for r in files.tail(spark, str(tmp_path), 100).collect()} == {"a": "first\nsecond\nthird\n", "b": "one long line"}


def test_journal_checks_every_field_and_is_capped(spark, tmp_path):
    good = {"timestamp": "2026-01-02T03:04:05Z", "area": "backend", "operation": "get", "name": "error", "message": "at https://a.b/c", "aborted": False}
    lines = [good, {**good, "area": "BAD"}, {**good, "aborted": "no"}, {**good, "timestamp": "soon"}, {**good, "message": 5}, {**good, "statusCode": 900, "kind": "x", "retryable": 1, "digestPrefix": "abc"}, {**good, "statusCode": 503, "kind": "ac", "retryable": True, "digestPrefix": "a" * 12, "more": 1}]
    (tmp_path / "j").write_text("\n".join([json.dumps(x) for x in lines] + ["not json", "[1]", ""]))
    rows = files.journal(spark, str(tmp_path / "j")).collect()
    assert [(r["message"], r["statusCode"], r["kind"], r["retryable"], r["digestPrefix"]) for r in rows] == [("at <redacted-url>", None, None, None, None)] * 2 + [("at <redacted-url>", 503, "ac", True, "a" * 12)]
    (tmp_path / "k").write_text("\n".join([json.dumps(good)] * 30))
    assert files.journal(spark, str(tmp_path / "k"), 10).count() == 11


def test_log_messages_keep_the_last(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"Cache daemon failed: {k} at /etc/x\nother {k}\n" for k in range(150)))
    rows = files.log_messages(spark, str(tmp_path / "log"), ("Cache daemon failed:",)).orderBy("at").collect()
    assert [r["message"] for r in rows] == [f"Cache daemon failed: {k} at <redacted-path>" for k in range(50, 150)]


def test_diagnostics_are_one_document_a_job(spark):
    journal = spark.createDataFrame([(1, 2, "later"), (1, 1, "sooner")], "job long, at long, message string")
    said = spark.createDataFrame([(1, 1, "m")], "job long, at long, message string")
    about = spark.createDataFrame([(1, "1.0", "now", "errors", "post", ["see https://x.y/z"], '{"a":1}'), (2, "1.0", "now", "always", "post", [], None)], "job long, version string, created string, reason string, phase string, errors array<string>, metrics string")
    got = {r["job"]: json.loads(r["document"]) for r in files.diagnostics(journal, said, about, "job").collect()}
    assert got[1]["lifecycle"] == {"phase": "post", "errors": ["see <redacted-url>"]} and got[1]["metrics"] == {"a": 1}
    assert [e["message"] for e in got[1]["errors"]] == ["sooner", "later"] and got[1]["daemonMessages"] == ["m"]
    assert got[2]["errors"] == [] and got[2]["daemonMessages"] == [] and "metrics" not in got[2]


def test_recovery_from_a_directory(spark, tmp_path):
    def manifest(folder, order, kind, body, sequence, **more):
        digest = _sha(body) if kind == "cas" else "e" * 63 + str(order % 10)
        path = folder / f"{order:012d}-{kind}-{digest}"
        field = {"casSequence": str(sequence)} if kind == "cas" else {"casBarrier": str(sequence)}
        data = {"kind": kind, "digest": digest, "order": order, "size": len(body), "acceptedAt": 5, "bodySha256": _sha(body), "path": f"{path}.data", "manifestPath": f"{path}.json", **field, **more}
        path.with_suffix(".json").write_text(json.dumps(data))
        path.with_suffix(".data").write_bytes(body)
        return path

    names = ("good", "gap", "cover", "twice", "bytes", "changed", "late", "actions")
    folders = {n: tmp_path / n for n in names}
    for f in folders.values():
        f.mkdir()
    manifest(folders["good"], 4, "cas", b"a", 7), manifest(folders["good"], 6, "ac", b"r", 7), manifest(folders["good"], 9, "cas", b"bb", 8)
    (folders["good"] / "lost.data").write_bytes(b"x")
    (folders["good"] / "x.json.tmp").write_bytes(b"{")
    manifest(folders["gap"], 1, "cas", b"a", 1), manifest(folders["gap"], 2, "cas", b"b", 3)
    manifest(folders["cover"], 1, "cas", b"a", 1), manifest(folders["cover"], 2, "ac", b"r", 2)
    manifest(folders["twice"], 1, "ac", b"r", 0), manifest(folders["twice"], 11, "ac", b"r", 0)
    manifest(folders["bytes"], 1, "cas", b"a" * 60, 1), manifest(folders["bytes"], 2, "cas", b"b" * 60, 2)
    manifest(folders["changed"], 1, "cas", b"a", 1).with_suffix(".data").write_bytes(b"longer")
    manifest(folders["late"], 1, "cas", b"a", 1, casBarrier="1")
    manifest(folders["actions"], 3, "ac", b"r", 5), manifest(folders["actions"], 5, "ac", b"s", 4)
    listed, manifests = files.pending(spark, f"{tmp_path}/*")
    checked = recovery.manifest_problems(manifests, "directory", 1000)
    got = {r["directory"].split("/")[-1]: r for r in recovery.recovered(checked, "directory", 100).collect()}
    assert {n: got[n]["problem"] for n in names} == {"good": None, "gap": "sequence is not contiguous", "cover": "barrier is not covered", "twice": "duplicate object", "bytes": "too many bytes", "changed": "data", "late": "sequence", "actions": None}
    assert [int(got["good"][c]) for c in ("durable", "accepted", "next_order", "pending", "pending_bytes")] == [6, 8, 10, 3, 4]
    assert [int(got["actions"][c]) for c in ("durable", "accepted", "next_order")] == [5, 5, 6] and got["gap"]["durable"] is None
    roles = recovery.pairing(listed, "directory").where("role in ('orphan', 'stale')").collect()
    assert sorted(r["name"] for r in roles) == ["lost.data", "x.json.tmp"]


class _Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.asked.append((q["ref"], q["key"], int(q["page"])))
        name, page = q["ref"].split("/")[-1], int(q["page"])
        if name == "limited":
            self.send_response(429)
            self.send_header("Retry-After", "7")
            self.end_headers()
            return
        if name == "moved":
            self.send_response(302)
            self.send_header("Location", "http://127.0.0.1:1/")
            self.end_headers()
            return
        one = lambda k, **more: {"id": k, "key": f"p-{k}", "version": "v", "ref": q["ref"], "size_in_bytes": 1, "created_at": "2026-01-02T03:04:05Z", **more}
        rows, total = {"main": ([one(k) for k in range(100)] if page == 1 else [one(100)], 101), "endless": ([one(k) for k in range(100)], 10**6), "full": ([one(k) for k in range(100)], 100)}.get(name, ([one(1), one(2, ref="refs/heads/other"), one(3, key="q-3"), one(4, id="4"), "x"], 5))
        body = json.dumps({"total_count": total, "actions_caches": rows}).encode()
        if name == "huge":
            body = body + b" " * 5000
        if name == "broken":
            body = b'{"total_count":1}'
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/caches"
    server.shutdown()


def test_catalog_lists_pages_and_pushes_filters(spark, service):
    _Service.asked.clear()
    every = catalog.listing(spark, service, ["refs/heads/main", "refs/heads/few", "refs/heads/full", "refs/heads/main"], "p-")
    assert sorted((r["ref"].split("/")[-1], n) for r, n in [(r, r["count"]) for r in every.groupBy("ref").count().collect()]) == [("few", 1), ("full", 100), ("main", 101)]
    assert sorted(_Service.asked) == [("refs/heads/few", "p-", 1), ("refs/heads/full", "p-", 1), ("refs/heads/main", "p-", 1), ("refs/heads/main", "p-", 2)]
    _Service.asked.clear()
    some = every.where((F.col("ref") == "refs/heads/main") & F.col("key").startswith("p-10"))
    assert sorted(r["key"] for r in some.collect()) == ["p-10", "p-100"]
    assert sorted(_Service.asked) == [("refs/heads/main", "p-10", 1), ("refs/heads/main", "p-10", 2)]


@pytest.mark.parametrize("ref,message", [("limited", "rate limited"), ("moved", "status 302"), ("endless", "more pages"), ("huge", "too large"), ("broken", "malformed")])
def test_catalog_errors(spark, service, ref, message):
    rows = catalog.listing(spark, service, [f"refs/heads/{ref}"], "p-", maxPages="3", maxBytes="20000" if ref != "huge" else "2000")
    with pytest.raises(Exception, match=message):
        rows.collect()


def test_catalog_pauses():
    now = 1785067200.0
    assert catalog.pause_of(429, {"Retry-After": "7", "x-ratelimit-reset": "1785067300"}, now) == 7000
    assert catalog.pause_of(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "1785067300"}, now) == 100_000
    assert catalog.pause_of(403, {}, now) is None and catalog.pause_of(429, {}, now) == 60_000 and catalog.pause_of(500, {"Retry-After": "7"}, now) is None
    assert catalog.pause_of(429, {"Retry-After": "Sun, 26 Jul 2026 12:00:09 GMT"}, now) == 9000


def test_snapshot_counts_keys_that_are_none(spark):
    bloom = "A" * 342
    key = f"brc2-a81f7e9d-pack-1-18ca73ff-000003-{bloom}-d33f9c1e8a7b0000"
    at = "timestamp'2026-01-02 00:00:00'"
    rows = spark.sql(f"SELECT * FROM VALUES (1L, '{key}', 'v', 'r', 1L, {at}), (1L, '{key}', 'v', 'r', 1L, {at} - interval 1 day), (2L, 'brc2-a81f7e9d-pack-x', 'v', 'r', 1L, {at}), (3L, 'else', 'v', 'r', 1L, {at}) AS t(id, key, version, ref, size_bytes, created_at)")
    good, bad = catalog.snapshot(rows, "brc2-a81f7e9d-pack-")
    assert [(r["id"], r["pack"]["sequence"]) for r in good.collect()] == [(1, "3")] and bad.first()["invalid_keys"] == 1
