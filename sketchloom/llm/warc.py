"""WARC archives: writing pages as records, and reading them back with segment reassembly.

`write_archive` writes one record per page. Of pages with equal payloads that with the largest id is a `response`,
the others are `revisit` records that name it. Payloads travel as HTTP/1.1 responses in chunked transfer framing; a
block above `segment_bytes` is cut into a first record and `continuation` records (WARC-Segment-Number,
WARC-Segment-Origin-ID, and WARC-Segment-Total-Length on the last). Files are gzipped WARC/1.1 written by Spark's own
writer, so any file system that Spark writes to will do.

`read_archive` parses the files, groups the records of a segmented block by the identifier of their origin, orders
them by segment number, verifies numbering and total length, and decodes the chunked framing. Only segmented records
are shuffled. Payloads are grouped by a narrow (digest, id) aggregate; page bodies move at most once.

A record that cannot be read (no version line, no length, a block cut short, a gzip stream that breaks off) gives a row
of type `broken` or of its stated type with `complete` false, and parsing goes on at the next version line; a bad file
does not end the job. Header bytes that are not UTF-8 are replaced.

Defined results: a null page body is an empty payload; a null url gives no target; a null id sorts below all others
(all null: all are responses), and pages that tie on the largest id of their payload are all responses; a segmented
block that lacks a segment or whose length differs from its total has `complete` false, with null payload, length and
digest; repeated rows are records of their own; a very long body is cut into segments and held whole by the task that
joins them; an empty table gives an archive without records; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize, work_dir, write_out

CRLF = b"\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing (RFC 9112, 7.1) without extensions or trailers."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, extensions and trailers dropped; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n + 2 > len(body) or body[at + n : at + n + 2] != CRLF:
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in url)


def records_of(page_id: str, unique: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment_bytes: int) -> list[bytes]:
    name = f"<urn:x-page:{page_id}:{unique}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", f"sha1:{digest}")]
        return [_record([*head, ("Content-Type", "application/http; msgtype=response")], block)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(head, block)]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*head, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{page_id}:{unique}:{k}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        out.append(_record([*more, ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)], piece))
    return out


def write_archive(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", segment_bytes: int = 32 << 10, min_revisit_bytes: int = 0, records_per_file: int = 2_500
) -> None:
    """Write `pages` as gzipped WARC files under `path`."""
    base = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    # written out, since a revisit names its origin by the number of the origin's row
    kept = work_dir(pages.sparkSession)
    base = write_out(base.withColumn("unique", F.monotonically_increasing_id()), kept)
    # the row that revisits name: that with the largest id, of equal ones the last
    last = F.max(F.struct(F.col("id").alias("origin"), F.col("unique").alias("number"))).alias("last")
    groups = base.where(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(last, F.count("*").alias("n")).where("n > 1 and last.origin is not null")
    # written out: a small table is broadcast, and beside a large one the rows of a common payload can be split
    groups = materialize(groups.select("sha", "last.origin", "last.number"))
    base = base.join(groups, "sha", "left")
    revisit = F.coalesce(F.col("id") < F.col("origin"), F.col("origin").isNotNull() & F.col("id").isNull())
    base = base.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "unique", "url", "payload", "sha", F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("origin").cast("string"), F.lit(":"), F.col("number").cast("string"))).alias("origin"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for r in zip(*(batch.column(c) for c in ("id", "unique", "url", "payload", "sha", "origin")), strict=True):
                i, u, link, body, sha, origin = (x.as_py() for x in r)
                out += records_of(i, u, link, body, base64.b32encode(bytes.fromhex(sha)).decode(), origin, date, segment_bytes)
                held += len(body)
                if held > 2_000_000 or len(out) >= 1000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, held = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    # each value is a whole record; the writer's line separator is the pair of line ends that closes it
    records = base.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    drop_path(pages.sparkSession, kept)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of each record of a file, gzipped (one member or many) or plain.

    The block is None if the record is broken.
    """
    # decompressed as it is read, so that only one record is held beside the file
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    line, lost, head = b"\r\n", False, None
    try:
        while line:
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:  # once for each stretch of bytes that belong to no record
                    lost = True
                    yield {"warc-type": "broken"}, None
                line = f.readline()
                continue
            lost, head = False, {}
            while (line := f.readline()).strip():
                k, _, v = line.decode(errors="replace").partition(":")
                head[k.strip().lower()] = v.strip()
            size = head.get("content-length", "")
            block = f.read(int(size)) if size.isascii() and size.isdigit() else None
            whole = block is not None and len(block) == int(size)
            lost = not whole  # what follows up to the next version line is part of this record
            this, head = head, None
            yield this, block if whole else None
            line = f.readline()
    except (EOFError, OSError, zlib.error):  # the stream breaks off
        yield head or {"warc-type": "broken"}, None


def _payload(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload and its stated length of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        body = dechunk(body)
    stated = fields.get(b"content-length", b"")
    return body, int(stated) if stated.isdigit() else None


_ROW = "record_id string, record_type string, target_uri string, refers_to string, segment int, total long, origin string, digest string, n long, complete boolean, body binary"


def _finish(r: dict, block: bytes | None, with_payload: bool) -> dict:
    """Fill in what the block says; a block of None is one whose segments do not add up."""
    payload, stated = _payload(block) if block is not None else (None, None)
    if r["record_type"] == "revisit":
        return r | {"n": stated, "complete": block is not None, "body": None}
    ok = payload is not None
    return r | {"n": len(payload) if ok else None, "digest": sha1_base32(payload) if ok else None, "complete": ok, "body": payload if with_payload and ok else None}


def _table(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"segment": pa.int32(), "total": pa.int64(), "n": pa.int64(), "complete": pa.bool_(), "body": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in (x.split()[0] for x in _ROW.split(", "))})


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.isdigit() and len(x) < 10 else None


def _parse(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for head, block in parse_records(data.as_py()):
                number, total = (_number(head.get(k)) for k in ("warc-segment-number", "warc-segment-total-length"))
                own = head.get("warc-record-id", "").strip("<>") or None
                r = {
                    "record_id": own,
                    "record_type": head.get("warc-type", "broken"),
                    "target_uri": head.get("warc-target-uri"),
                    "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
                    "segment": number if block is not None else None,  # a broken segment leaves its block incomplete
                    "total": total,
                    "origin": head.get("warc-segment-origin-id", "").strip("<>") or own,
                    "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    "n": None,
                    "complete": None,
                    "body": block,
                }
                number = r["segment"]
                rows.append(r if number else _finish(r, block, with_payload))
                held += len(rows[-1]["body"] or b"") + 500
                if held > 2_000_000:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)


def join_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """Block of segments (number, total length, bytes) in any order, or None if they are not whole."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in segments)
    whole = [s[0] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1][1] == len(block)
    return block if whole else None


def _assemble(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            first = min(row["parts"], key=lambda p: p["segment"])
            r = {k: first[k] for k in ("record_id", "record_type", "target_uri", "refers_to", "digest")} | {"segment": None, "total": None, "origin": row["origin"]}
            yield _table([_finish(r, join_segments([(p["segment"], p["total"], p["body"]) for p in row["parts"]]), with_payload)])


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, complete (and payload)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    # fixed on shared storage, since whole and segmented records take different ways from here
    parsed = materialize(files.mapInArrow(lambda b: _parse(b, with_payload), _ROW))
    whole = parsed.where("segment is null")
    parts = parsed.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("record_id", "record_type", "target_uri", "refers_to", "segment", "total", "digest", "body")).alias("parts"))
    rows = whole.unionByName(parts.mapInArrow(lambda b: _assemble(b, with_payload), _ROW))
    return rows.select("record_id", "record_type", "target_uri", "refers_to", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "complete", *([F.col("body").alias("payload")] if with_payload else []))


def page_of(record_id: str) -> Column:
    """The page id inside a record identifier (a column's name) of `write_archive`."""
    return F.expr(f"try_cast(split({record_id}, ':')[2] as bigint)")
