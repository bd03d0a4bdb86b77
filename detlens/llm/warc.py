"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer makes one gzip member per record. Files have names of their own for every task
attempt; the manifest that Spark writes names those of the attempts that ended well, so a
lost executor leaves at most files that nobody reads.

The reader walks through a file record by record and checks gzip sums, version line, headers,
block length, record end and SHA-1 payload digest. After a failed check it searches for the
next gzip member or version line that begins a valid record, logs the bytes in between as a
quarantined gap, and reads on. It holds one gzip member in memory at a time.

Cases: null payloads are empty; a null URL or id has no header and reads back as null; control
characters in a URL are percent-encoded; repeated rows are written each, all of them as
response if theirs is the smallest id of their payload. An empty table makes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.session import materialize, shared_path

#: A file is closed once it has so many compressed bytes.
FILE_BYTES = 64 << 20
#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
_CHUNK = 1 << 18
_HEADER_BYTES = 1 << 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder given as URI or plain path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if re.match("file:/[^/]", path) else path)
    return pafs.LocalFileSystem(), path


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header only, and the full payload's length and digest."""
    sha = digest(payload)
    name = lambda page: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{sha}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": name(refers_to) if revisit else None,
        "WARC-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def firsts(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages as (page_id, payload, refers_to, revisit ...): the smallest id of equal payloads is the response.

    Digests are counted with map-side aggregation; only repeated ones are joined back, from a
    table, so that a digest with many rows can be split.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("_sha", F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)))
    repeated, n = C.counted(
        rows.filter(F.col("_sha").isNotNull()).groupBy("_sha")
        .agg(F.min(page_id).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", "_first"), "digests")
    joined = rows.join(C.maybe_broadcast(repeated, n, 128), "_sha", "left")
    revisit = F.col("_first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_first"))
    return joined.withColumn("_revisit", revisit)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as WARC files under ``folder``; the manifest (path, records, bytes)."""
    rows = firsts(pages.select(page_id, url, html), page_id, html, min_bytes).select(
        F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"), F.col("_first").cast("long").alias("first"), F.col("_revisit").alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for a, b, texts in C.slices(batch.column(2)):
                ids, urls, first, revisit = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1, 3, 4))
                for i in range(len(texts)):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip_member(record(ids[i], urls[i], texts.raw(i), first[i] if revisit[i] else None, revisit[i]))
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= file_bytes:
                        out.close()
                        done.append((f"{folder.rstrip('/')}/{name}", records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Damaged(ValueError):
    """A record failed a check; ``found`` are the valid records before the damage."""

    def __init__(self, why: str, found: list[dict] | None = None):
        super().__init__(why)
        self.found = found or []


class _Source:
    """Random access to a file through one buffered window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.window = file, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not (self.base <= offset and offset + n <= self.base + len(self.window)):
            self.file.seek(offset)
            self.base, self.window = offset, self.file.read(max(n, _CHUNK))
        return self.window[offset - self.base: offset - self.base + n]

    def find(self, offset: int) -> int:
        """The next place from ``offset`` that looks like a member or a version line, or the file's end."""
        while offset < self.size:
            part = self.at(offset, _CHUNK)
            found = [i for i in (part.find(MEMBER), part.find(VERSION)) if i >= 0]
            if found:
                return offset + min(found)
            if len(part) < _CHUNK:
                return self.size
            offset += len(part) - len(VERSION)
        return self.size


def _parse(data: bytes, offset: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``offset`` of ``data``."""
    if not _VERSION_LINE.match(data, offset):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", offset)
    if head_end < 0:
        raise Damaged("headers do not end")
    head = {}
    for line in data[offset:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("a header has no colon")
        head[name.strip().lower()] = value.strip()
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    end = head_end + 4 + length
    if length < 0 or data[end: end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    return head, data[head_end + 4: end], end + 4


def _checked(head: dict, block: bytes) -> dict:
    """The record's fields; its payload is held against its digest where it is stored."""
    kind = head.get("warc-type", "")
    http = head.get("content-type", "").startswith("application/http")
    payload = block[block.find(b"\r\n\r\n") + 4:] if http and b"\r\n\r\n" in block else block
    named = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind != "revisit":
        actual = digest(payload)
        if named and named != actual:
            raise Damaged("payload digest")
        named, size = actual, len(payload)
    else:
        payload, size = None, head.get("warc-payload-length")
    number = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None
    return {"record_type": kind, "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"),
            "page_id": number("warc-page-id"), "refers_to": number("warc-refers-to-page-id"),
            "payload_digest": named, "payload_bytes": None if size is None else int(size), "payload": payload}


def _inside(data: bytes, whole: bool) -> tuple[list[dict], str | None]:
    """(valid records, first error) of a member's bytes; after a failed check it goes on at the next version line.
    Of bytes that break off the last record isn't trusted."""
    found, error, k = [], None, 0
    while k < len(data):
        try:
            head, block, end = _parse(data, k)
            record = _checked(head, block)
        except Damaged as e:
            error = error or str(e)
            at = _VERSION_LINE.search(data, k + 1)
            k = at.start() if at else len(data)
            continue
        if whole or end < len(data):
            found.append(record)
        k = end
    return found, error


def _readable(z, part: bytes) -> bytes:
    """What can be decompressed of a part with an error in it."""
    out = []
    try:
        for i in range(0, len(part), 16):
            out.append(z.decompress(part[i: i + 16]))
    except zlib.error:
        pass
    return b"".join(out)


def _records_at(source: _Source, offset: int) -> tuple[list[dict], int, str | None]:
    """The valid records that begin at ``offset`` (a member may hold several), where they end, and what is wrong between them."""
    start = source.at(offset, len(VERSION))
    if start.startswith(MEMBER):
        z, parts, at = zlib.decompressobj(31), [], offset
        while not z.eof:
            part = source.at(at, min(_CHUNK, source.size - at)) if at < source.size else b""
            if not part:
                raise Damaged("the member is cut off", _inside(b"".join(parts), False)[0])
            before = z.copy()
            try:
                parts.append(z.decompress(part))
            except zlib.error as e:
                parts.append(_readable(before, part))
                raise Damaged(f"gzip: {e}", _inside(b"".join(parts), False)[0]) from None
            at += len(part)
        found, error = _inside(b"".join(parts), True)
        if error and not found:
            raise Damaged(error)
        return found, at - len(z.unused_data), error
    if not start.startswith(VERSION):
        raise Damaged("neither a member nor a version line")
    size = _HEADER_BYTES
    head_bytes = source.at(offset, min(size, source.size - offset))
    while (stop := head_bytes.find(b"\r\n\r\n")) < 0 and offset + size < source.size and _VERSION_LINE.match(head_bytes):
        size *= 4
        head_bytes = source.at(offset, min(size, source.size - offset))
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head_bytes[: stop + 2] if stop >= 0 else b"")
    need = (stop + 8 + int(length[1])) if length else len(head_bytes)
    if offset + need > source.size:
        raise Damaged("the record is cut off")
    head, block, end = _parse(source.at(offset, need), 0)
    return [_checked(head, block)], offset + end, None


def salvage(source: _Source) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(offset, length, error, record): records in order; a gap has an error and no record. Damage inside a
    member that also holds valid records is logged as a gap of the whole member, after them."""
    pos = 0
    while pos < source.size:
        if source.at(pos, 1) in (b"\r", b"\n"):  # blank lines between plain records
            pos += 1
            continue
        try:
            found, end, why = _records_at(source, pos)
        except Damaged as e:
            why, found, end = str(e), e.found, source.find(pos + 1)
            while end < source.size:
                try:
                    _records_at(source, end)
                    break
                except Damaged as other:
                    if other.found:
                        break
                    end = source.find(end + 1)
        for r in found:
            yield pos, end - pos, None, r
        if why:
            yield pos, end - pos, why, None
        pos = end


_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string()),
           ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64()),
           ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]


def read(paths: DataFrame, files: int, payloads: bool = True) -> DataFrame:
    """The records and the gaps (``error`` is not null) of the WARC files in column ``path``, a file per task."""
    fields = _FIELDS if payloads else _FIELDS[:-1]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_folder(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as f:
                    for offset, length, error, r in salvage(_Source(f, f.size())):
                        rows.append({"path": path, "offset": offset, "length": length, "error": error, **(r or {})})
                        held += len(r["payload"] or b"") if r and payloads else 200
                        if held >= C.SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return paths.select("path").repartition(max(1, files)).mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record and read the archives back."""
    manifest = write(C.table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    found = read(manifest, manifest.count(), payloads=False)
    return found.filter(F.col("error").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, upper(sha1(h)) AS x FROM p),
f AS (SELECT x, min(page_id) AS first, count(*) AS n FROM s GROUP BY 1),
b AS (
  SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> (5 * (3 - j))) & 31 AS BIGINT), 1), '' ORDER BY i, j) AS payload_digest
  FROM (SELECT x, i, CAST('0x' || substr(x, 1 + 5 * i, 5) AS BIGINT) AS v FROM (SELECT x, unnest(range(8)) AS i FROM f)), (SELECT unnest(range(4)) AS j)
  GROUP BY x)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s JOIN f USING (x) JOIN b USING (x)
"""
