"""WARC archives: a writer with revisit records and a salvage reader that resumes after damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, scratch, small, stored

#: Compressed bytes after which a new archive file is begun.
FILE_BYTES = 64 << 20
#: Largest member or record that the reader unpacks: no row of Spark holds more. A larger one is a gap.
MOST_BYTES = (1 << 31) - 1
#: Distinct repeated payloads up to which their list is broadcast.
MOST_REPEATED = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


class Damage(ValueError):
    """A member or record that fails a check."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record, response or (with ``refers_to``) revisit; its block is an HTTP answer, without body in a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else f"urn:page:{name}"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@dataclass
class Source:
    """Random access to a file by blocks, so that no file has to fit in memory."""

    file: pa.NativeFile
    block: int = 1 << 20

    def __post_init__(self) -> None:
        self.size = self.file.size()
        self._at, self._data = -1, b""

    def get(self, start: int, n: int) -> bytes:
        if not (0 <= self._at <= start and start + n <= self._at + len(self._data)):
            self._at, self._data = start, self.file.read_at(min(max(n, self.block), max(0, self.size - start)), start)
        return self._data[start - self._at : start - self._at + n]

    def find(self, what: re.Pattern, start: int, overlap: int = 16) -> int:
        """Offset of the next match at or after ``start``, or -1."""
        while start < self.size:
            data = self.get(start, min(self.block, self.size - start))
            if m := what.search(data):
                return start + m.start()
            if start + len(data) >= self.size:
                return -1
            start += max(1, len(data) - overlap)
        return -1


def unpack(source: Source, start: int) -> tuple[bytes, int]:
    """The gzip member at ``start`` with its checks, and where it ends."""
    z, out, at = zlib.decompressobj(31), [], start
    total = 0
    while not z.eof:
        if at >= source.size:
            raise Damage("the member is cut off")
        data = source.get(at, min(1 << 16, source.size - at))
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise Damage(f"gzip: {e}") from e
        total += len(out[-1])
        if total > MOST_BYTES:
            raise Damage("the member is too large")
        at += len(data)
    return b"".join(out), at - len(z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("a header line without name")
        try:
            found[name.strip().decode().lower()] = value.strip().decode()
        except UnicodeDecodeError as e:
            raise Damage("a header line that isn't UTF-8") from e
    return found


def parse(get, size: int, start: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at ``start``, checked, and where the record ends. ``get(start, n)`` gives bytes."""
    if not _VERSION.match(get(start, min(10, size - start))):
        raise Damage("no version line")
    n = 1 << 12
    while (end := (head := get(start, min(n, size - start))).find(b"\r\n\r\n")) < 0:
        if n >= size - start or n > 1 << 20:
            raise Damage("the header doesn't end")
        n *= 4
    fields = _fields(head[:end])
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damage("no content length")
    length, at = int(fields["content-length"]), start + end + 4
    if length > MOST_BYTES or at + length + 4 > size:
        raise Damage("the block is cut off or too large")
    block = get(at, length)
    if get(at + length, 4) != b"\r\n\r\n":
        raise Damage("no end of record after the block")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damage("the block's digest differs")
    return fields, block, at + length + 4


def salvage(file: pa.NativeFile) -> Iterator[tuple[int, dict[str, str], bytes] | tuple[int, int, str]]:
    """Records ``(offset, fields, block)`` of an archive, plain or of gzip members, and gaps ``(offset, end, reason)``.

    After a failed check the reader looks for the next member that unpacks to a record, or the next version
    line that begins a valid record, and goes on from there; the bytes between are a gap. Offsets in a
    member's gap are those of the whole member.
    """
    source = Source(file)
    at = 0
    packed = source.get(0, min(3, source.size)) == _MEMBER or (source.find(re.compile(re.escape(_MEMBER)), 0) >= 0 and source.find(_VERSION, 0) < 0)
    while at < source.size:
        try:
            if packed:
                data, end = unpack(source, at)
                if not _VERSION.match(data) and _VERSION.search(data) is None:
                    raise Damage("no record in the member")
                inner = 0
                while inner < len(data):
                    try:
                        fields, block, inner_end = parse(lambda s, n, d=data: d[s : s + n], len(data), inner)
                        yield at, fields, block
                        inner = inner_end
                    except Damage as e:
                        nxt = _next_record(lambda s, n, d=data: d[s : s + n], len(data), inner + 1, lambda s, d=data: m.start() if (m := _VERSION.search(d, s)) else -1)
                        yield at, end, f"in a member, bytes {inner} to {nxt}: {e}"
                        inner = nxt
                at = end
            else:
                fields, block, end = parse(source.get, source.size, at)
                yield at, fields, block
                at = end
        except Damage as e:
            nxt = _next_member(source, at + 1) if packed else _next_record(source.get, source.size, at + 1, lambda s: source.find(_VERSION, s))
            yield at, nxt, str(e)
            at = nxt


def _next_record(get, size: int, start: int, find) -> int:
    while 0 <= (at := find(start)) < size:
        try:
            parse(get, size, at)
            return at
        except Damage:
            start = at + 1
    return size


def _next_member(source: Source, start: int) -> int:
    magic = re.compile(re.escape(_MEMBER))
    while (at := source.find(magic, start)) >= 0:
        try:
            if _VERSION.search(unpack(source, at)[0]):
                return at
        except Damage:
            pass
        start = at + 1
    return source.size


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` as ``(page_id, url, payload, refers_to)``.

    Of pages with equal payloads of ``min_bytes`` or more, that with the smallest page_id is the response, the
    others refer to it. Null html is an empty payload. Rows that repeat the smallest page_id are responses too;
    payloads whose pages all lack a page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    same = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    same = stored(same.select("sha", "size", "least"), "repeated")
    joined = rows.join(small(same, same.count(), MOST_REPEATED), ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's filesystem and path for a URI of Spark's; Arrow knows S3 by its plain name only."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, payload, refers_to)`` as .warc.gz files, a gzip member for each record; returns ``(path, records)``, stored.

    Every task attempt writes files of its own name and reports them when they are whole, so that what a
    lost or repeated attempt leaves is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        n = records = size = 0
        out, paths, counts = None, [], []
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[at].as_py() for c in batch.columns)
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out, n, records, size = fs.open_output_stream(f"{root}/{name}", compression=None), n + 1, 0, 0
                    paths.append(f"{folder}/{name}")
                data = member(encode_record(page_id, url, payload, refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    counts.append(records)
                    out = None
        if out is not None:
            out.close()
            counts.append(records)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return stored(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "manifest")


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """All records and gaps of ``files(path)``; a row is a gap if its ``reason`` isn't null.

    Size and digest of a response are those of the payload as read, those of a revisit what its header
    states. Damage costs only the bytes in the gaps. Files that can't be opened are one gap.
    """

    def row(path: str, x: tuple) -> dict:
        if isinstance(x[1], int):
            return {"path": path, "offset": x[0], "end": x[1], "reason": x[2]}
        at, fields, block = x
        kind = fields.get("warc-type")
        out = {"path": path, "offset": at, "record_type": kind, "uri": fields.get("warc-target-uri"), "page_id": _number(fields.get("warc-record-id")), "refers_to": _number(fields.get("warc-refers-to"))}
        if kind == "revisit":
            length = fields.get("warc-payload-length", "")
            return out | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        return out | {"payload_bytes": len(body), "payload_digest": base32_sha1(body), "payload": body if payloads else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                try:
                    fs, name = filesystem(path)
                    for x in salvage(fs.open_input_file(name)):
                        held.append(row(path, x))
                        size += len(held[-1].get("payload") or b"") + 256
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                except OSError as e:
                    held.append({"path": path, "offset": 0, "end": 0, "reason": f"not read: {e}"})
                yield pa.RecordBatch.from_pylist(held, schema=_READ)

    schema = "path string, offset long, end long, reason string, page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return files.select("path").mapInArrow(run, schema)


def quarantine(archives: DataFrame) -> DataFrame:
    """The log of byte gaps of ``read_archives``: ``(path, offset, end, reason)``; what stands between is in no record."""
    return archives.where("reason is not null").select("path", "offset", "end", "reason")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of ``pages`` to the shared folder and reads it back: a row for every page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Raises if the archive has a gap.
    Null html is an empty payload; repeated rows are records of their own; other columns are left out.
    """
    spark = pages.sparkSession
    files = write_archives(deduplicated(pages, min_bytes), scratch(spark, "warc"))
    back = read_archives(files.repartition(max(1, files.count()), "path"))
    broken = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("damage in "), "path", F.lit(": "), "reason"))).otherwise(F.col("record_type"))
    return back.select("page_id", "payload_bytes", "payload_digest", broken.alias("record_type"), "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``round_trip`` of all pages; nulls, repeats and ties as there and in ``deduplicated``."""
    return round_trip(read(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS least FROM p GROUP BY h),
b AS (
  SELECT h, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM g
),
d AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS digest FROM b
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p JOIN g USING (h) JOIN d USING (h)
"""
