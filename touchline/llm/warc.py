"""WARC archives: a writer with revisit records and a salvage reader.

The writer puts each record into a gzip member of its own, so that every record can be found and read alone; a record whose
payload another one also has becomes a revisit of the one with the largest page_id. The reader checks each member (gzip
checksum, version line, header block, lengths, payload digest). After a failed check it searches for the next place where
a valid member or version line begins, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_side, written
from .files import opened, own_name

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")  # what precedes it may be cut off, so it need not begin a line
DATE = "1970-01-01T00:00:00Z"  # records carry no time of their own; a fixed one keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ROLL = 64 << 20
CHUNK = 1 << 20

RECORDS = "path string, at long, end long, warc_type string, record_id string, uri string, refers_to string, digest string, http_length long, payload binary, problem string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit holds the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', uri)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, start: int = 0) -> tuple[dict | None, str, int]:
    """(fields, problem, length) of the record at ``start`` of ``data``; fields are None if a check fails."""
    m = VERSION.match(data, start)
    if not m:
        return None, "no version line", 0
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return None, "header block not closed", 0
    head = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon and line:
            return None, "header line without a colon", 0
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, "no content length", 0
    at = end + 4
    block = data[at : at + int(size)]
    if len(data) < at + int(size) + 4:
        return None, "record cut short", 0
    if data[at + int(size) : at + int(size) + 4] != b"\r\n\r\n":
        return None, "record not closed", 0
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", http)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = head.get("warc-type")
    if kind == "response" and digest and sha1_base32(payload) != digest:
        return None, "payload digest differs", 0
    fields = {
        "warc_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "uri": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
        "digest": digest, "http_length": int(length[1]) if length else None, "payload": payload if kind == "response" else None,
    }
    return fields, "", at + int(size) + 4 - start


def contents(data: bytes) -> list[dict]:
    """The records of a member's content and the gaps between them, in order; a gap has only a problem, which tells its place."""
    out, at = [], 0
    while at < len(data):
        fields, why, used = parse(data, at)
        if fields is not None:
            out.append({"problem": ""} | fields)
            at += used
            continue
        begun, problem = at, why
        while fields is None and at < len(data):
            line = VERSION.search(data, at + 1)
            at = line.start() if line else len(data)
            fields = parse(data, at)[0]
        out.append({"problem": f"{problem} (content {begun} to {at})"})
    return out


def _gunzip(data: bytes) -> tuple[bytes | None, int, bool]:
    """(content, bytes used, more input needed) of the gzip member at the start of ``data``."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data)
    except zlib.error:
        return None, 0, False
    return (out, len(data) - len(z.unused_data), False) if z.eof else (None, 0, True)


def salvage(read, path: str = "", chunk: int = CHUNK, most: int = (1 << 31) + (1 << 20)):
    """Records and gaps of an archive as dicts of RECORDS. ``read(n)`` gives the next bytes, none at the end.

    Holds one record or member, with its content, and a chunk at a time; one that is not closed within ``most`` bytes, more
    than a value of a table can have, fails its check. Gaps have a null warc_type and the failed check in ``problem``. All records and gaps inside one member carry
    the member's place, as its content has none of its own in the archive.
    """
    buffer, base, ended = b"", 0, False  # base: the place of buffer[0] in the archive
    bad, problem = None, ""

    def more() -> None:
        nonlocal buffer, ended
        got = read(max(chunk, len(buffer)))  # doubling: a long record is not copied again and again
        ended = not got
        buffer += got

    def gap(end: int):
        return {"path": path, "at": bad, "end": end, "problem": problem}

    while True:
        if len(buffer) < 16 and not ended:
            more()
            continue
        if not buffer:
            break
        rows, why, used = [], "", 0
        if buffer[:3] == GZIP:
            content, used, open_ = _gunzip(buffer)
            if open_ and not ended and len(buffer) < most:
                more()
                continue
            if content is None:
                why = "member not closed" if open_ else "bad member"
            else:
                rows = contents(content)
                if not any("warc_type" in r for r in rows):
                    rows, why = [], parse(content)[1]
        elif VERSION.match(buffer):
            fields, why, used = parse(buffer)
            if why in ("header block not closed", "record cut short") and not ended and len(buffer) < most:
                more()
                continue
            rows = [{"problem": ""} | fields] if fields is not None else []
        else:
            why = "no member or version line"
        if rows:
            if bad is not None:
                yield gap(base)
                bad = None
            for r in rows:
                yield {"path": path, "at": base, "end": base + used} | r
            buffer, base = buffer[used:], base + used
            continue
        if bad is None:
            bad, problem = base, why
        while not (step := _next_start(buffer, 1)) and not ended:
            keep = min(len(buffer), 17)  # what could be the beginning of a start, and a byte before it
            base, buffer = base + len(buffer) - keep, buffer[len(buffer) - keep :]
            more()
        step = step or len(buffer)
        buffer, base = buffer[step:], base + step
    if bad is not None:
        yield gap(base)


def _next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` on that looks like a member or a version line, or 0."""
    line = VERSION.search(data, at)
    places = [p for p in (data.find(GZIP, at), line.start() if line else -1) if p > 0]
    return min(places, default=0)


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Archives of (page_id, uri, payload, refers_to) rows in ``folder``; the manifest (path, records, bytes) as a written table.

    Files roll over at ``roll`` bytes. The manifest lists the files of the attempts that count; others are left aside.
    """

    def run(batches):
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page, uri, payload, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path, n, size = own_name(folder, ".warc.gz"), 0, 0
                    out = opened(path, write=True)
                data, page, to = payload.as_py(), page.as_py(), to.as_py()
                kind = "response" if to is None else "revisit"
                made = member(record(kind, _urn(page), uri.as_py() or "", data, sha1_base32(data), None if to is None else _urn(to)))
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    rows = pages.select("page_id", "uri", "payload", "refers_to")
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def read_warc(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (RECORDS) of the archives in column ``path``; each is read as a stream by one task."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    rows, held = [], 0
                    for r in salvage(source.read, path):
                        held += len(r.get("payload") or b"")
                        if r.get("payload") is not None and not payloads:
                            r["http_length"], r["payload"] = len(r["payload"]), None
                        rows.append(r)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(parts, "path").mapInArrow(run, RECORDS)


def quarantined(records: DataFrame) -> DataFrame:
    """The gaps of what ``read_warc`` found: (path, at, end, problem)."""
    return records.where("warc_type IS NULL").select("path", "at", "end", "problem")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, uri, payload, refers_to) rows: refers_to is null for responses.

    Of the pages with equal payloads of at least ``least`` bytes the one with the largest page_id is the response; rows that
    repeat it are responses too. Null html counts as empty; a null page_id is smaller than any other. Only digests are shuffled
    to find the payloads that repeat; their list is broadcast if it is small, so that payloads stay where they are read.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("key", F.sha2("html", 256))
    last = p.select("page_id", "key").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    last = small_side(written(last, "warc-repeated"))
    out = p.join(last, "key", "left").withColumn("payload", F.col("html").cast("binary"))
    to = F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return out.select("page_id", "uri", "payload", to.alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty, a null url as none; rows that repeat and rows with a null page_id have a record each; other
    columns are ignored; an empty table gives an empty result. What the reader finds, gaps too, is written as a table without
    the payloads; a gap, or a number of records other than that of the manifest, raises an error.
    """
    manifest = write_warc(revisits(pages, least), folder or scratch(pages.sparkSession, "warc"))
    r = written(read_warc(manifest, payloads=False).drop("payload"), "warc-read")
    gaps, found = quarantined(r).limit(20).collect(), r.where("warc_type IS NOT NULL").count()
    if gaps or found != (manifest.agg(F.sum("records")).first()[0] or 0):
        raise ValueError(f"archives came back with {found} records and gaps {[tuple(g) for g in gaps]}")
    r = r.where("warc_type IN ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)$', 1) AS BIGINT)")
    return r.select(page("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
