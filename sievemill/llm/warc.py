"""WARC records: reading, writing, and the resolution of not-modified revisits.

A server that answers 304 sends no body. Such a revisit takes the body of the latest earlier full
response for its canonical URL, if the validators agree, and that response's headers with those
that a 304 may renew replaced."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the time buckets by which the captures of one URL are dealt over tasks.
BUCKET_SECONDS = 6 * 3600
#: Header fields that a 304 response may renew; all others stay as the full response sent them.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")
#: Query parameters that don't change a page.
TRACKING = r"utm_[^=&]*|gclid|fbclid|ref"

SCHEMA = "record_id string, kind string, url string, at timestamp, status int, headers map<string,string>, body binary"


def canonical_url(url: str) -> Column:
    """One form of the URLs that lead to the same page: host without www. and default port,
    path without a last slash, parameters sorted and without those for tracking, no scheme and no fragment. A
    null URL stays null; one without ``://`` is kept as it is, without its fragment."""
    text = F.regexp_replace(F.col(url), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(text, r"(?s)^.*?://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(text, r"(?s)^.*?://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(text, r"(?s)\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(text, F.lit("://")), F.concat(host, path, tail)).otherwise(text)


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(full: Column, fresh: Column) -> Column:
    """The full response's fields, with those of a 304 that it may renew, sorted by name. Names
    are in lower case on both sides."""
    renewed = F.map_filter(fresh, lambda k, v: k.isin(*RENEWED))
    old = F.map_filter(full, lambda k, v: ~F.map_contains_key(renewed, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, renewed))))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit in ``records`` (columns as in SCHEMA, others are not read).

    record_id, url, canonical string, at, outcome string, response_id string (null unless the
    outcome is resolved), response_at, headers (merged), body. Outcomes: ``resolved``; ``changed`` (the latest
    earlier full response has another entity tag, or without tags another Last-Modified);
    ``unproved`` (no validator on both sides); ``missing`` (no earlier full response).

    A full response has kind ``response`` and status 200. Of several at one time the one with the
    largest record_id counts; one at the revisit's own time is not earlier. Null URLs and times find
    nothing. Of repeated records with one id, time and validators one stands, by the hash of its body. Bodies of any length are
    carried whole. Header names are matched without regard to case; of names that differ by case only, one stands. No rows: no rows.
    The captures of a URL are dealt into time buckets: a bucket takes the last full response before it from
    a table with a row for each bucket, so that a URL with very many captures meets in no task."""
    kept = records.select("record_id", "kind", "url", "at", "status", _lower_names("headers").alias("headers"))
    rows = kept.select(
        "record_id", "kind", "url", canonical_url("url").alias("canonical"), "at", "status", "headers",
        _weak(F.col("headers")["etag"]).alias("etag"), F.trim(F.col("headers")["last-modified"]).alias("modified"),
        F.floor(F.unix_seconds("at") / F.lit(bucket_seconds)).alias("bucket"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    mark = F.struct("at", "record_id", "etag", "modified")
    usable = rows.filter("canonical is not null and at is not null")
    last = usable.filter(full).groupBy("canonical", "bucket").agg(F.max(mark).alias("last"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    asked = usable.filter(F.col("kind") == "revisit")
    wanted = asked.select("canonical", "bucket").distinct()
    known = last.join(wanted, ["canonical", "bucket"], "full").withColumn("earlier", F.max("last").over(before)).select("canonical", "bucket", "earlier")
    inside = Window.partitionBy("canonical", "bucket").orderBy("at", F.when(full, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    events = usable.filter(full | (F.col("kind") == "revisit"))
    placed = events.withColumn("here", F.max(F.when(full, mark)).over(inside)).filter(F.col("kind") == "revisit")
    found = placed.join(known, ["canonical", "bucket"], "left").withColumn("source", F.coalesce(F.greatest("here", "earlier"), "here", "earlier"))
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("canonical").isNull() | F.col("at").isNull()))
    columns = ["record_id", "url", "canonical", "at", "headers", "etag", "modified"]
    found = found.select(*columns, "source").unionByName(lost.select(*columns).withColumn("source", F.lit(None).cast(found.schema["source"].dataType)))
    source = F.col("source")
    outcome = (
        F.when(source.isNull(), "missing")
        .when(F.col("etag").isNotNull() & source["etag"].isNotNull(), F.when(F.col("etag") == source["etag"], "resolved").otherwise("changed"))
        .when(F.col("modified").isNotNull() & source["modified"].isNotNull(), F.when(F.col("modified") == source["modified"], "resolved").otherwise("changed"))
        .otherwise("unproved")
    )
    found = found.withColumn("outcome", outcome).withColumn("response_id", F.when(F.col("outcome") == "resolved", source["record_id"])).withColumn("response_at", F.when(F.col("outcome") == "resolved", source["at"]))
    sent = records.filter(full).select(F.col("record_id").alias("a_id"), F.col("at").alias("a_at"), _lower_names("headers").alias("full_headers"), "body")
    answers = sent.select("a_id", "a_at", _weak(F.col("full_headers")["etag"]).alias("a_etag"), F.trim(F.col("full_headers")["last-modified"]).alias("a_modified"), "full_headers", "body")
    whole = F.min_by(F.struct("full_headers", "body"), F.xxhash64("body", F.map_entries("full_headers")))  # of repeated records one, always the same
    answers = answers.groupBy("a_id", "a_at", "a_etag", "a_modified").agg(whole.alias("a")).select("a_id", "a_at", "a_etag", "a_modified", "a.full_headers", "a.body")
    found = found.withColumns({"s_etag": source["etag"], "s_modified": source["modified"]})
    same = (F.col("response_id") == F.col("a_id")) & (F.col("response_at") == F.col("a_at")) & F.col("s_etag").eqNullSafe(F.col("a_etag")) & F.col("s_modified").eqNullSafe(F.col("a_modified"))
    joined = found.join(answers, same, "left")
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("full_headers"), F.col("headers"))).otherwise(F.col("headers"))
    return joined.select("record_id", "url", "canonical", "at", "outcome", "response_id", "response_at", headers.alias("headers"), "body")


def _lower_names(headers: str) -> Column:
    """Header names in lower case; of names that differ by case only, the first in code point
    order stands."""
    entries = F.array_sort(F.map_entries(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def _block(stream: io.BufferedIOBase) -> tuple[str, dict[str, str]] | None:
    """A first line and its header fields, up to an empty line."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    first, fields = line.decode("utf-8", "replace").strip(), {}
    name = ""
    for line in iter(stream.readline, b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and name:  # a folded line
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            fields[name.strip()] = value.strip()
    return first, fields


_BAD = {"record_id": None, "kind": "malformed", "url": None, "at": None, "status": None, "headers": {}, "body": None}
_MAGIC = b"\x1f\x8b\x08"
#: Bytes of a gzip member's content up to which none of its records counts before its checksum is known to be right.
HELD_BYTES = 64 << 20
_STEP = 1 << 20


def _known(head: bytes) -> tuple[dict, dict[str, str]]:
    """(record_id, url and at, all named fields) of a record's head."""
    _, fields = _block(io.BytesIO(head)) or ("", {})
    named = {k.lower(): v for k, v in fields.items()}
    return {"record_id": named.get("warc-record-id", "").strip("<>") or None, "url": named.get("warc-target-uri", "").strip("<>") or None, "at": named.get("warc-date")}, named


class _Records:
    """Records of a stream that comes in pieces; what is not yet a whole record waits."""

    def __init__(self) -> None:
        self.data, self.at, self.lost = bytearray(), 0, False

    def take(self, piece: bytes, last: bool = False) -> Iterator[dict]:
        del self.data[: self.at]
        self.data += piece
        self.at = 0
        while (found := self._next(last)) is not None:
            yield from found

    def broken(self) -> Iterator[dict]:
        """The stream does not go on: what waits is a damaged record."""
        rest, self.data, self.at = bytes(self.data[self.at :]), bytearray(), 0
        if rest.strip() and not self.lost:
            yield _BAD | _known(rest)[0] if rest.lstrip().startswith(b"WARC/") else dict(_BAD)
        self.lost = False

    def _next(self, last: bool) -> list[dict] | None:
        """The rows of what comes next; None if more is needed."""
        end = self.data.find(b"\n", self.at)
        if end < 0 and not (last and self.at < len(self.data)):
            return None
        end = len(self.data) if end < 0 else end + 1
        line = bytes(self.data[self.at : end])
        if not line.startswith(b"WARC/"):
            if not last and not line.endswith(b"\n"):
                return None
            self.at = end
            if not line.strip() or self.lost:
                return []
            self.lost = True  # once for all lines up to the next record
            return [dict(_BAD)]
        ends = [x + len(m) for m in (b"\n\r\n", b"\n\n") if (x := self.data.find(m, self.at)) >= 0]
        if not ends and not last:
            return None
        body = min(ends, default=len(self.data))
        known, named = _known(bytes(self.data[self.at : body]))
        size = named.get("content-length", "")
        if not ends or not (size.isascii() and size.isdigit()):
            self.at, self.lost = body, True
            return [_BAD | known]
        stop = body + int(size)
        if len(self.data) < stop + 2 and not last:
            return None
        after = bytes(self.data[stop : stop + 2])
        if len(self.data) < stop or not (after == b"" or after[:1] == b"\n" or after == b"\r\n"):  # not its true length: the next record is somewhere behind its head
            self.at, self.lost = body, True
            return [_BAD | known]
        payload, self.at, self.lost = bytes(self.data[body:stop]), stop, False
        status, headers, content = None, {}, payload
        if named.get("content-type", "").startswith("application/http") and payload:
            inner = io.BytesIO(payload)
            first, headers = _block(inner) or ("", {})
            words = first.split()
            status = int(words[1]) if len(words) > 1 and words[0].startswith("HTTP/") and words[1].isascii() and words[1].isdigit() and len(words[1]) < 10 else None
            content = _decoded(inner.read(), {k.lower(): v.lower() for k, v in headers.items()})
        return [_BAD | known | {"kind": named.get("warc-type"), "status": status, "headers": headers, "body": content}]


def _member(data: memoryview, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the content of the gzip member at ``at``, and with the last of them where it ends (before: -1). Raises zlib.error
    where it is damaged or cut, its checksum included."""
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        if at >= len(data):
            raise zlib.error("cut")
        step = data[at : at + _STEP]
        piece = inflate.decompress(step)
        at += len(step) - len(inflate.unused_data)
        yield piece, at if inflate.eof else -1


def _member_after(data: memoryview, raw: bytes, at: int) -> int:
    """Where the next gzip member begins that holds a record at its start, or is sound; -1 without any."""
    while (at := raw.find(_MAGIC, at)) >= 0:
        try:
            pieces = _member(data, at)
            if next(pieces)[0].lstrip().startswith(b"WARC/"):
                return at
            for _ in pieces:
                pass
            return at
        except zlib.error:
            at += 1
    return -1


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, compressed record by record or not; rows of SCHEMA. ``at`` is an
    ISO string. The body of an HTTP record is what follows its own header, without chunked framing and gzip or deflate coding.

    A record that is damaged or cut short, whose length is not one or not its own, or that something follows that is no record, gives a row
    of kind ``malformed``, with its record_id and url if known and without a body. Reading goes on at the next record: after a wrong length at
    the next line that begins one, after a damaged gzip member at the next member. A member counts as a whole: up to HELD_BYTES of content
    none of its records is given before its checksum is right; of a longer one those before the damage are."""
    records, first = _Records(), data.find(_MAGIC)
    if first < 0 or re.search(rb"^WARC/", data[:first], re.M):  # not compressed
        for at in range(0, len(data), _STEP):
            yield from records.take(data[at : at + _STEP])
        yield from records.take(b"", last=True)
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        if not any(view[at : at + _STEP]) and not any(view[at:]):  # padding
            break
        held, size, end = [], 0, -1
        try:
            for piece, end in _member(view, at):
                if held is not None:
                    held.append(piece)
                    size += len(piece)
                    if size > HELD_BYTES:
                        yield from records.take(b"".join(held))
                        held = None
                else:
                    yield from records.take(piece)
            yield from records.take(b"".join(held or []))
            at = end
        except zlib.error:
            if held is not None:
                waiting = bool(bytes(records.data[records.at :]).strip())
                yield from records.broken()  # a record that began in the member before
                records.data = bytearray(b"".join(held))
                if not waiting or records.data.lstrip().startswith(b"WARC/"):
                    yield from records.broken() if records.data.strip() else [dict(_BAD)]
                records.data = bytearray()
            else:
                yield from records.broken()
            at = _member_after(view, data, at + 1)
    yield from records.take(b"", last=True)


def _decoded(body: bytes, headers: dict[str, str]) -> bytes:
    """A body without chunked framing and content coding; as it is where it does not have what its header says."""
    if "chunked" in headers.get("transfer-encoding", ""):
        inner, parts = io.BytesIO(body), []
        while size := inner.readline().split(b";")[0].strip():
            try:
                n = int(size, 16)
            except ValueError:
                parts = None
                break
            if n <= 0:
                break
            parts.append(inner.read(n))
            inner.readline()
        body = body if parts is None else b"".join(parts)
    try:
        if "gzip" in headers.get("content-encoding", ""):
            return gzip.decompress(body)
        if "deflate" in headers.get("content-encoding", ""):
            return zlib.decompress(body)
    except (EOFError, OSError, zlib.error):
        pass
    return body


def render(record_id: str, kind: str, url: str, at: str, status: int | None, headers: dict[str, str], body: bytes, compress: bool = True) -> bytes:
    """A record as WARC/1.1 bytes, which ``parse`` reads back."""
    if status is None:
        payload, content = body or b"", "application/octet-stream"
    else:
        lines = "".join(f"{k}: {v}\r\n" for k, v in (headers or {}).items())
        payload, content = f"HTTP/1.1 {status} -\r\n{lines}\r\n".encode() + (body or b""), "application/http; msgtype=response"
    extra = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n" if kind == "revisit" else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {at}\r\nWARC-Target-URI: {url}\r\n{extra}Content-Type: {content}\r\nContent-Length: {len(payload)}\r\n\r\n"
    out = head.encode() + payload + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (SCHEMA), bad ones as rows of kind ``malformed``. A file is read by one task, which holds it as it is stored and
    unpacks it piece by piece: write files of about a GB at most."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                rows = []
                for row in parse(bytes(data)):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, SCHEMA.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
