"""WARC records in ZIP-packaged archives: written per task, read back by ranges.

An archive is a ZIP file with stored members: `archive/data.warc.gz` (each record
a gzip member of its own) and `indexes/index.cdxj` (a sorted line per record: URL key,
time, and JSON with file name, offset and length). The reader parses the end record, the
ZIP64 records and the central directory, finds where the stored members begin (any
number of WARC members and indexes), and reads ranges of records, each inflated by its
length; nothing is extracted or read whole. Record ids derive from page_id and digest, so
a revisit names the id of its response and a second attempt writes the same.

Files are reached through pyarrow's file systems, by the scheme of the folder
(file, hdfs, s3, gs, ...), so every executor sees them.

Defined cases: null html is an empty payload; a null page_id or url is left out of
its record and read back as null; records with equal payloads of at least
`least` bytes refer to the smallest page_id (rows that tie on it are all
responses); smaller payloads are all responses; other columns are not read; an
empty table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import stored

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A task begins a new archive when one has so many bytes; records are read in ranges of so many.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: A task reads one range; of more than TASKS ranges so many bytes.
TASKS, TASK_BYTES = 1_000, 64 << 20
GZIP_LEVEL = 4
#: The tables carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
# fixed values of the formats
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_KEPT_IN_URL = "".join(map(chr, range(33, 127))).replace("%", "")


def record_id(page_id, digest: str) -> str:
    """Name of the record of a page and its payload: the same in every attempt, and known to those who refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; with `refers_to` a revisit, whose block has the headers of the response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: {record_id(page_id, digest)}")
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Target-URI: {quote(url, safe=_KEPT_IN_URL)}"] if url is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, lengths: list[int]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of the records in a run of gzip members of these lengths."""
    view, at = memoryview(data), 0
    for length in lengths:
        record = zlib.decompress(view[at : at + length], 31)
        at += length
        head, _, rest = record.partition(b"\r\n\r\n")
        warc = _headers(head)
        block = rest[: int(warc["content-length"])]
        head, _, payload = block.partition(b"\r\n\r\n")
        yield warc, _headers(head), payload


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host parts from the right, then path and query."""
    host, path = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)(.*)", url or "", re.S).groups()
    name = host.lower().partition(":")[0].removeprefix("www.")
    return re.sub(r"\s", "+", ",".join(reversed(name.split("."))) + ")" + (path.partition("#")[0] or "/").lower())


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


class ArchiveWriter:
    """Appends records to one archive as a stream."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        system, place = fs.FileSystem.from_uri(self.path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self._file = _Forward(system.open_output_stream(place))
        self._zip = zipfile.ZipFile(self._file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._member = self._zip.open(MEMBER, "w", force_zip64=True)
        self._index: list[str] = []
        self.bytes = 0

    def add(self, record: bytes, url: str | None, digest: str) -> None:
        packed = gzip.compress(record, GZIP_LEVEL, mtime=0)
        self._member.write(packed)
        entry = {"url": url or "", "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(len(packed)), "offset": str(self.bytes), "filename": MEMBER.rpartition("/")[2]}
        self._index.append(f"{url_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}")
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self._member.close()
        with self._zip.open(INDEX, "w", force_zip64=True) as index:
            index.write("".join(f"{line}\n" for line in sorted(self._index)).encode())
        self._zip.close()
        self._file.close()
        return self.path, len(self._index)


class _Forward(io.RawIOBase):
    """A stream that only goes forward, so the ZIP writer uses data descriptors."""

    def __init__(self, sink):
        self._sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._sink.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._sink.close()
        super().close()


def zip_members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (method, first byte, bytes) of each member, from the central directory; ZIP64 included."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    start = max(0, size - 22 - 65_535)
    tail = read(start, size - start)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    count, length, offset = struct.unpack("<10xHLL", tail[at : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset) or tail[max(0, at - 20) : at].startswith(_LOCATOR64):
        locator = read(start + at - 20, 20)
        if locator[:4] == _LOCATOR64:
            (place,) = struct.unpack("<8xQ4x", locator)
            end = read(place, 56)
            if end[:4] != _END64:
                raise ValueError("bad ZIP64 end of central directory")
            count, length, offset = struct.unpack("<32xQQQ", end)
    directory, at, out = read(offset, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("bad central directory entry")
        method, packed, plain, names, extras, comments, begin = struct.unpack("<10xH8xLLHHH8xL", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + names].decode("utf-8")
        extra, e = directory[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                # in this order, each only where its 32-bit field is full
                wide = list(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                begin = wide.pop(0) if begin == 0xFFFFFFFF else begin
            e += 4 + n
        local = read(begin, 30)
        if local[:4] != _LOCAL:
            raise ValueError("bad local header")
        out[name] = (method, begin + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        at += 46 + names + extras + comments
    return out


def record_ranges(path: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """(first byte, lengths of the records) of runs of whole records in an archive's stored WARC members, from their indexes."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        members = zip_members(file, file.size())
        archives = {name.rpartition("/")[2]: m for name, m in members.items() if re.search(r"\.warc(\.gz)?$", name)}
        indexes = [m for name, m in members.items() if re.search(r"\.cdxj$", name)]
        if any(method for method, _, _ in [*archives.values(), *indexes]):
            raise ValueError(f"{path}: WARC members and indexes have to be stored, not packed")
        spans: dict[str, set[tuple[int, int]]] = {name: set() for name in archives}
        for _, first, n in indexes:
            file.seek(first)
            for line in io.BytesIO(file.read(n)):
                if line.strip() and not line.startswith(b"!"):
                    entry = json.loads(line[line.index(b"{") :])
                    spans[entry["filename"].rpartition("/")[2]].add((int(entry["offset"]), int(entry["length"])))
        for name, found in spans.items():
            if archives[name][2] and not found:
                raise ValueError(f"{path}: {name} has no index")
            run_at, run, end = 0, [], 0
            for offset, length in sorted(found):
                if run and (offset != end or end + length - run_at > range_bytes):
                    yield archives[name][1] + run_at, run
                    run = []
                run_at = run_at if run else offset
                run.append(length)
                end = offset + length
            if run:
                yield archives[name][1] + run_at, run


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes all pages into archives under `folder`; (path, records) of the archives whose tasks succeeded."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    copies = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), "first")
    )
    # a table of known size: small ones are broadcast, else Spark splits the pages of a digest with many copies
    linked = rows.join(stored(copies), F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    linked = linked.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        archive = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                archive = archive or ArchiveWriter(folder)
                archive.add(record_bytes(page_id, url, payload, digest, refers_to), url, digest)
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return stored(linked.mapInArrow(written, "path string, records bigint"))


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                runs = list(record_ranges(path, range_bytes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))],
                    names=["path", "first", "lengths"],
                )

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    file.seek(first)
                    data = file.read(sum(lengths))
                rows = []
                for warc, http, payload in parse_records(data, lengths):
                    page = int(warc["page-id"]) if "page-id" in warc else None
                    url = unquote(warc["warc-target-uri"]) if "warc-target-uri" in warc else None
                    if warc["warc-type"] == "revisit":
                        refers = int(warc["refers-to-page-id"])
                        rows.append((page, url, "revisit", refers, int(http["content-length"]), warc["warc-payload-digest"].partition(":")[2], None))
                    else:
                        rows.append((page, url, "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # one archive to a task, then ranges to tasks by number: rows this small would all be read in one
    listed = archives.repartition(max(1, archives.count())).select("path")
    ranges = stored(listed.mapInArrow(located, "path string, first bigint, lengths array<bigint>"))
    n, total = ranges.agg(F.count("*"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    tasks = max(1, min(n, max(TASKS, -(-(total or 0) // TASK_BYTES))))
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return ranges.repartition(tasks).mapInArrow(read, schema)
