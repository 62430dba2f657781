import gzip
import random
import re
import zlib
from datetime import datetime, timedelta

import pytest

from sievemill.llm import warc

T0 = datetime(2024, 1, 1)


def test_round_trip(tmp_path, spark):
    rows = [("urn:1", "response", "http://a/", "2024-01-01T00:00:00Z", 200, {"ETag": '"x"', "Content-Type": "text/html"}, b"<p>\r\n\r\nWARC/1.1 \xff"), ("urn:2", "revisit", "http://a/", "2024-01-02T00:00:00Z", 304, {"ETag": '"x"'}, b""), ("urn:3", "metadata", "http://a/", "2024-01-02T00:00:00Z", None, {}, b"k: v")]
    for compress in (True, False):
        data = b"".join(warc.render(*r, compress=compress) for r in rows)
        assert [tuple(x.values()) for x in warc.parse(data)] == rows
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.render(*r) for r in rows))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_id, r.status, bytes(r.body)) for r in got] == [(r[0], r[4], r[6]) for r in rows] and got[0].headers["ETag"] == '"x"'


def test_canonical(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2", None, "mailto:x#y"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url("u")).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", None, "mailto:x"]


def brute(rows):
    out = {}
    for rid, kind, url, at, status, headers, body in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url and None not in (url, at, r[3]) and r[3] < at]
        last = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        tag, modified = (headers or {}).get("ETag"), (headers or {}).get("Last-Modified")
        if last is None:
            out[rid] = ("missing", None)
        elif tag and (last[5] or {}).get("ETag"):
            out[rid] = ("resolved", last[0]) if tag == last[5]["ETag"] else ("changed", None)
        elif modified and (last[5] or {}).get("Last-Modified"):
            out[rid] = ("resolved", last[0]) if modified == last[5]["Last-Modified"] else ("changed", None)
        else:
            out[rid] = ("unproved", None)
    return out


def test_resolution_matches_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        url = rng.choice(["http://a/x", "http://a/x", "http://b/y", None, "http://c/z"])
        at = rng.choice([None, *[T0 + timedelta(hours=rng.randrange(60)) for _ in range(12)]])
        headers = rng.choice([None, {}, {"ETag": rng.choice("pq")}, {"Last-Modified": rng.choice("mn")}, {"ETag": "p", "Last-Modified": "m"}])
        rows.append((f"r{i:03}", kind, url, at, rng.choice([200, 200, 404]) if kind == "response" else 304, headers, bytes([i % 256])))
    records = spark.createDataFrame([(*r, "x") for r in rows], warc.SCHEMA + ", outcome string")
    for seconds in (warc.BUCKET_SECONDS, 10**9):
        got = warc.resolve(records, seconds).collect()
        assert {r.record_id: (r.outcome, r.response_id) for r in got} == brute(rows) and len(got) == sum(r[1] == "revisit" for r in rows)
    bodies = {r[0]: r[6] for r in rows}
    assert all((bytes(r.body) == bodies[r.response_id]) if r.response_id else r.body is None for r in got)
    assert warc.resolve(records.limit(0)).count() == 0


def test_only_permitted_headers_are_renewed(spark):
    rows = [("a", "response", "http://a/", T0, 200, {"ETag": "1", "Content-Length": "9", "X-Old": "y", "cache-control": "a"}, b"123456789"), ("b", "revisit", "http://a/", T0 + timedelta(1), 304, {"etag": "W/1", "Content-Length": "0", "Cache-Control": "b", "X-New": "z"}, None)]
    (r,) = warc.resolve(spark.createDataFrame(rows, warc.SCHEMA)).collect()
    assert r.outcome == "resolved" and dict(r.headers) == {"cache-control": "b", "content-length": "9", "etag": "W/1", "x-old": "y"}


def test_bad_records_are_reported_and_passed_over():
    good = [warc.render(f"r{i}", "response", f"http://a/{i}", "2024-01-01T00:00:00Z", 200, {"ETag": "x"}, b"body" * i, compress=False) for i in range(3)]
    no_length = good[1].replace(b"Content-Length: ", b"Content-Length: x")
    kinds = lambda data: [(r["kind"], r["record_id"]) for r in warc.parse(data)]
    ok = [("response", f"r{i}") for i in range(3)]
    assert kinds(b"".join(good)) == ok and kinds(b"") == []
    assert kinds(good[0] + no_length + good[2]) == [ok[0], ("malformed", "r1"), ok[2]]
    assert kinds(good[0] + b"junk\nmore junk\n" + good[2]) == [ok[0], ("malformed", None), ok[2]]
    assert kinds(good[0] + good[2][:-8]) == [ok[0], ("malformed", "r2")]
    assert kinds(b"".join(gzip.compress(g) for g in good)) == ok == kinds(gzip.compress(b"".join(good)))
    for wrong in (b"Content-Length: 9999999", b"Content-Length: 130", b"Content-Length: 10"):  # beyond the end, into the next record, too short
        worse = re.sub(rb"Content-Length: [0-9]+", wrong, good[1], count=1)
        assert kinds(good[0] + worse + good[2]) == [ok[0], ("malformed", "r1"), ok[2]], wrong


def ids_of(data):
    return [(r["kind"], r["record_id"]) for r in warc.parse(data)]


@pytest.mark.parametrize("n, size", [(4, 5), (50, 300), (6, 200_000)])
@pytest.mark.parametrize("damage", ["middle", "start", "checksum", "cut", "length"])
def test_exactly_the_damaged_member_is_lost(n, size, damage):
    rng = random.Random(n)
    members = [warc.render(f"r{i}", "response", f"http://a/{i}", "2024-01-01T00:00:00Z", 200, {"ETag": "x"}, rng.randbytes(size)) for i in range(n)]
    assert ids_of(b"".join(members)) == [("response", f"r{i}") for i in range(n)]
    for k in range(n):
        m = bytearray(members[k])
        if damage == "middle":
            m[len(m) // 2 : len(m) // 2 + 4] = bytes(255 - b for b in m[len(m) // 2 : len(m) // 2 + 4])
        elif damage == "start":
            m[0:3] = b"abc"
        elif damage == "checksum":
            m[-8] ^= 1
        elif damage == "cut":
            del m[len(m) * 2 // 3 :]
        else:
            m[-1] ^= 64
        got = ids_of(b"".join([*members[:k], bytes(m), *members[k + 1 :]]))
        assert [x for x in got if x[0] == "response"] == [("response", f"r{i}") for i in range(n) if i != k]
        assert sum(x[0] == "malformed" for x in got) >= 1 and all(x[1] in (None, f"r{k}") for x in got if x[0] == "malformed")
    packed = b"".join(members)
    for cut in range(0, len(packed), max(7, len(packed) // 200)):
        whole = sum(1 for i in range(n) if sum(map(len, members[: i + 1])) <= cut)
        got = ids_of(packed[:cut])
        assert [x for x in got if x[0] == "response"] == [("response", f"r{i}") for i in range(whole)]


def test_records_over_several_members_and_long_members(monkeypatch):
    good = [warc.render(f"r{i}", "response", f"http://a/{i}", "2024-01-01T00:00:00Z", 200, {}, b"body" * 50, compress=False) for i in range(6)]
    text = b"".join(good)
    pieces = [gzip.compress(text[i : i + 97]) for i in range(0, len(text), 97)]
    assert [x[1] for x in ids_of(b"".join(pieces) + b"\0" * 100)] == [f"r{i}" for i in range(6)]
    pieces[5] = pieces[5][:-8] + bytes(8)
    got = ids_of(b"".join(pieces))
    assert [x for x in got if x[0] == "response"] == [("response", f"r{i}") for i in (0, 2, 3, 4, 5)] and ("malformed", "r1") in got
    monkeypatch.setattr(warc, "HELD_BYTES", 100)
    monkeypatch.setattr(warc, "_STEP", 64)
    one = gzip.compress(text)
    assert [x[1] for x in ids_of(one)] == [f"r{i}" for i in range(6)]
    assert ids_of(one[:-30])[:1] == [("response", "r0")] and ids_of(one[:-30])[-1][0] == "malformed"


def test_chunked_and_compressed_bodies():
    body = lambda headers, data: next(iter(warc.parse(warc.render("r", "response", "http://a/", "2024-01-01T00:00:00Z", 200, headers, data))))["body"]
    assert body({"Transfer-Encoding": "chunked"}, b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert body({"Content-Encoding": "gzip"}, gzip.compress(b"abc")) == b"abc" and body({"Content-Encoding": "gzip"}, b"abc") == b"abc"
    assert body({"Content-Encoding": "deflate"}, zlib.compress(b"abc")) == b"abc" and body({"Transfer-Encoding": "chunked"}, b"no") == b"no"


def test_repeated_records_and_long_bodies(spark):
    rows = [("a", "response", "http://a/", T0, 200, {"ETag": e}, b) for e, b in [("1", b"x" * 2_000_000), ("2", b"two"), ("2", b"three"), ("2", b"two")]]
    rows += [("b", "revisit", "http://a/", T0 + timedelta(1), 304, {"ETag": "2"}, None)]
    got = {tuple((r.outcome, bytes(r.body))) for n in (1, 3, 7) for r in warc.resolve(spark.createDataFrame(rows, warc.SCHEMA).repartition(n)).collect()}
    assert len(got) == 1 and got <= {("resolved", b"two"), ("resolved", b"three")}
