"""WARC records in ZIP archives: writing them, and range reads without extraction.

An archive is a ZIP file whose members are stored, not packed: a file of
records, each compressed by itself, and an index with the place of each
record. The reader looks for the end record, follows it (through the ZIP64
records where they are present) to the central directory, finds the stored
members, reads the index, and then reads single records by their byte ranges.

Payloads that occur more than once are written once; the other pages get a
revisit record that refers to it. Which page is kept is settled by a grouped
maximum and a join before anything is written.

Archives go to the shared folder by any file system that pyarrow can open. Each
has a name of its own, and only archives in the written manifest are read, so
that a task that runs twice does no harm.

Nulls, empty and odd input: a null html is empty; a null url is written empty;
control characters in a url are escaped; a null page_id stays null and is never
referred to unless all equal pages have none (then each is a response); rows
with equal page_id and equal payload are all responses if theirs is the largest
id. An empty table gives no archive. Further columns do not matter.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from airtrace.llm.common import require
from airtrace.session import materialise, shared_folder

# Fixed values of the formats.
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are always written.
REVISIT_BYTES = 1000
#: Record bytes of an archive.
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20


# ---------------------------------------------------------------- ZIP reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Fill values of all ones from the ZIP64 field of an entry, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(numbers) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def members(file, size: int) -> list[Member]:
    """The central directory of an open archive."""
    tail_at = max(0, size - 22 - 65_535)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == LOCATOR64:
        end64 = struct.unpack_from("<Q", tail, at - 12)[0]
        record = read_range(file, end64, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory = read_range(file, start, length)
    found, at = [], 0
    for _ in range(count):
        if directory[at:at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n:at + 46 + name_n + extra_n]
        plain, packed, header = _wide(extra, [plain, packed, header])
        found.append(Member(name, method, packed, header))
        at += 46 + name_n + extra_n + note_n
    return found


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"range {start}+{length} is beyond the end")
    return data


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin; its local header has lengths of its own."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is packed; only stored members can be read in place")
    local = read_range(file, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_n + extra_n


# ---------------------------------------------------------------- records


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed by itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """The fields of one compressed record; the payload's digest is checked."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    size = len(payload) if kind == "response" else int(_fields(http)["content-length"])
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind,
        "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


# ---------------------------------------------------------------- Spark


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add digest, record type and the page referred to; hot payloads are counted before the join."""
    require(pages, "page_id", "url", "html")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    large = rows.where(F.col("bytes") >= REVISIT_BYTES)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(kept, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return out.select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives and return the manifest: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        body, index, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.wacz"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                archive.writestr(RECORDS, body.getvalue())
                archive.writestr(INDEX, "\n".join(index))
            with store.open_output_stream(f"{root}/{name}") as target:
                target.write(out.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [out.tell()], "records": [n]})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("record_type", "page_id", "url", "html", "digest", "refers_to"))):
                kind, page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                url = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
                data = record(kind, page_id, url, html.encode(), digest, refers_to)
                index.append(json.dumps({"offset": body.tell(), "length": len(data)}))
                body.write(data)
                n += 1
                if body.tell() >= archive_bytes:
                    yield close()
                    body, index, n = io.BytesIO(), [], 0
        if n:
            yield close()

    return materialise(pages.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named in ``path``, read by byte ranges."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + (["payload"] if payloads else [])
    schema = FIELDS + (", payload binary" if payloads else "")
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def records(path: str) -> Iterator[dict]:
        store, name = open_store(path)
        size = store.get_file_info(name).size
        with store.open_input_file(name) as file:
            inside = {m.name: m for m in members(file, size)}
            listing = read_range(file, data_start(file, inside[INDEX]), inside[INDEX].size)
            start = data_start(file, inside[RECORDS])
            for line in listing.splitlines():
                place = json.loads(line)
                yield parse(read_range(file, start + place["offset"], place["length"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], type=types.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for row in records(path):
                    rows.append(row)
                    held += row["payload_bytes"] if payloads else 0
                    if len(rows) >= 10_000 or held >= RANGE_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    paths = manifest.select("path")
    return paths.repartition("path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder))
