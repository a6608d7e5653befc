"""Web archives (WARC) inside ZIP packages: writing, and reading by ranges.

Every task writes packages into the shared folder: a stored member with one gzip stream per
WARC record, and a stored member with an index of the records.  A reader fetches the end of a
package, finds the central directory (of ZIP64 too), locates both members from it and the
local headers, and then fetches each record by its range; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, fresh_folder, tidy

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a new package begins; rows of one at most.
PACKAGE, PACKAGE_ROWS = 256 << 20, 200_000
#: Bytes fetched at a time while reading neighbouring records.
FETCH = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): which rows repeat the payload of a smaller page_id.

    Equality is that of SHA-1 and length.  Digests alone are grouped, with partial sums before
    the shuffle; the pages themselves only meet the list of revisits, by page and digest.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(F.encode(payload, "utf-8")).alias("d"), F.octet_length(payload).alias("n"))
    digests = rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).select("page_id", "d", "n")
    groups = digests.groupBy("d", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    revisits = digests.join(groups, ["d", "n"]).where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, gzipped by itself."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class Package:
    """A package under way."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.path, self.rows, self.size, self.index = path, 0, 0, []
        self.stream = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        data = record(page_id, url, payload, refers_to)
        self.member.write(data)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(data)}))
        self.size += len(data)
        self.rows += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.path, self.rows, self.size


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes every row of ``pages`` as a record into packages below ``folder``; (path, rows, size) of each, materialised.

    A task that runs again writes under another name, and only packages of tasks that ended
    well are listed.  Null html is an empty payload, a null url gives no target header.
    """
    files, path = filesystem(folder)
    files.create_dir(path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        task, done, package = TaskContext.get(), [], None
        for batch in batches:
            for page_id, url, html, refers_to in _rows(batch):
                if package is None:
                    package = Package(store, f"{root}/{task.partitionId()}-{task.taskAttemptId()}-{len(done)}.wacz")
                package.add(page_id, url, html.encode(), refers_to)
                if package.size >= PACKAGE or package.rows >= PACKAGE_ROWS:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        for p, rows, size in done:
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["path", "rows", "size"])

    return cut(planned(pages, least).mapInArrow(tidy(kernel), "path string, rows long, size long"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as tuples, one at a time as Python objects."""
    for at in range(batch.num_rows):
        yield tuple(c[at].as_py() for c in batch.columns)


def _extra64(extra: bytes, fields: list[int], wide: list[int]) -> list[int]:
    """Replaces those of the fields that are at their limit by the ZIP64 extra field's numbers."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values) if f == w else f for f, w in zip(fields, wide, strict=True)]
        at += 4 + size
    return fields


def members(source: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """(first byte, size) of each stored member, from the central directory."""
    total = source.size()
    tail_at = max(0, total - (1 << 16) - 22 - 76)
    tail = source.read_at(total - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        count, size, start = struct.unpack_from("<QQQ", source.read_at(56, at), 32)
    directory, out, at = source.read_at(size, start), {}, 0
    for _ in range(count):
        method, packed, plain, names, extras, comments, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        plain, packed, local = _extra64(extra, [plain, packed, local], [0xFFFFFFFF] * 3)
        if method == 0:
            n, e = struct.unpack("<HH", source.read_at(4, local + 26))
            out[name] = (local + 30 + n + e, packed)
        at += 46 + names + extras + comments
    return out


def parse(data: bytes) -> dict[str, object]:
    """Headers of a gzipped record, and its HTTP headers and payload."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"fields": fields, "length": length, "payload": payload}


def records(source: pa.NativeFile) -> Iterator[bytes]:
    """Every record of a package by its range in the index, neighbours fetched together."""
    at = members(source)
    start, _ = at[ARCHIVE]
    place, size = at[INDEX]
    held, held_at = b"", 0
    for line in source.read_at(size, place).splitlines():
        entry = json.loads(line)
        a, n = entry["offset"], entry["length"]
        if a < held_at or a + n > held_at + len(held):
            held, held_at = source.read_at(min(max(FETCH, n), at[ARCHIVE][1] - a), start + a), a
        yield held[a - held_at : a - held_at + n]


FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the packages (path, ...).

    Length and digest of a revisit are those of the full payload, from its headers; a
    response's digest is computed from the payload and must equal its header.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        number = lambda s: int(s) if s != "" else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for data in records(source):
                        r = parse(data)
                        f = r["fields"]
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Type"] == "response" and (base32_sha1(r["payload"]) != digest or len(r["payload"]) != r["length"]):
                            raise ValueError(f"{path}: a record's payload differs from its headers")
                        url = f.get("WARC-Target-URI")
                        url = url if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
                        refers = f.get("WARC-Refers-To")
                        rows.append((number(f["WARC-Record-ID"][10:-1]), url, r["length"], digest, f["WARC-Type"], number(refers[10:-1]) if refers else None))
                        if len(rows) == 5000:
                            yield _found(rows)
                            rows = []
                    if rows:
                        yield _found(rows)

    spread = packages.select("path").repartition(max(1, min(10_000, packages.count())), F.xxhash64("path"))
    return spread.mapInArrow(tidy(kernel), FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages into packages in the shared folder and reads every record back.

    Rows with a payload of at least ``least`` bytes that equals that of a smaller page_id are
    revisits of the smallest; all rows of that smallest id are responses.  Every row comes
    back once, repeated rows as often as they are; an empty table gives no package and no row.
    """
    folder = fresh_folder(spark, "warc")
    return read_packages(write_packages(pages, folder, least), folder)
