"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` with one gzip member a record, ``indexes/index.cdxj``
with a line for each record and its range, and ``datapackage.json``. The reader parses the end record, its 64-bit form
and the central directory, finds where the stored members begin, and reads each record that an index names by its range;
nothing is extracted, and nothing but the ranges is read. Files without an index are walked record by record.

``archived`` packs pages into archives of bounded size, files of the shared folder; pages with equal payloads are one
response and revisits. ``ranged_records`` reads such files in tasks, by offset. Both open any file system that pyarrow
knows. The list of archives is what the tasks that ended well returned: an archive that a lost task left behind isn't read.

Nulls and edges: a null html is an empty payload, a null url an empty one. Of equal payloads of ``least_bytes`` or more the
smallest page_id is the response, and so are all rows that share it; a null page_id refers to that one, and where all are
null each is a response. Payloads are equal if their sizes, SHA-1 and 64-bit hashes are. A very long page is an archive of
its own. Repeated rows give repeated rows, an empty table none; other columns, whatever their names, are ignored. A file
that can't be read gives one row with the error; ranges are checked against the file, and a record of more than ``MOST`` bytes is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.arrow import memory_returned, slices
from querent.session import stored, stored_dir

# Fixed values of the formats.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Most bytes of a record, inflated; a longer one is an error.
MOST = 256 << 20
#: What a forged file may raise while its fields are used.
FAULTS = (ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError, struct.error, zlib.error, OSError)

#: Reads ``size`` bytes from ``offset`` on.
ReadAt = Callable[[int, int], bytes]


def within(read_at: ReadAt, size: int) -> ReadAt:
    """``read_at`` for ranges that lie in a file of ``size`` bytes."""

    def read(at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > size:
            raise ValueError("a range beyond the file")
        return read_at(at, n)

    return read


def inflated(data: bytes) -> bytes:
    """One gzip member."""
    unpacker = zlib.decompressobj(31)
    out = unpacker.decompress(data, MOST)
    if not unpacker.eof:
        raise ValueError(f"a record ends early or inflates to more than {MOST} bytes")
    return out


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def zipped(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` writes 64-bit fields where they aren't needed."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        wide = zip64 or len(data) >= FULL32 or at >= FULL32
        own = FULL32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, own, own, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, own, own, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra
    at, n = len(out), len(members)
    out += directory
    if zip64 or n >= FULL16 or at >= FULL32:
        end = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at) + LOCATOR64 + struct.pack("<IQI", 0, end, 1)
        out += END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), at, 0)
    return bytes(out)


class Zip:
    """The directory of a ZIP file, and ranges of its stored members."""

    def __init__(self, read_at: ReadAt, size: int):
        self.read_at = read_at = within(read_at, size)
        tail_at = max(0, size - 22 - FULL16)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0 or len(tail) - at < 22:
            raise ValueError("no end of a ZIP directory")
        _, _, _, count, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if FULL16 == count or FULL32 in (length, offset):
            locator = read_at(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == LOCATOR64:
                end = read_at(struct.unpack_from("<IQ", locator, 4)[1], 56)
                if end[:4] != END64:
                    raise ValueError("no 64-bit end of the ZIP directory")
                count, length, offset = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, Member] = {}
        data, at = read_at(offset, length), 0
        for _ in range(count):
            if data[at : at + 4] != ENTRY:
                raise ValueError("a ZIP directory entry is broken")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, names, extras, notes = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            raw, extra = data[at + 46 : at + 46 + names], data[at + 46 + names : at + 46 + names + extras]
            wide = [k for k, v in (("full", full), ("packed", packed), ("header", header)) if v == FULL32]
            values = {"full": full, "packed": packed, "header": header}
            place = 0
            while place + 4 <= len(extra):
                kind, size_ = struct.unpack_from("<HH", extra, place)
                if kind == 1:
                    values |= dict(zip(wide, struct.unpack_from(f"<{len(wide)}Q", extra, place + 4), strict=True))
                place += 4 + size_
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
            self.members[name] = Member(name, method, values["packed"], values["header"])
            at += 46 + names + extras + notes

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} isn't stored as it is")
        head = self.read_at(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + names + extras

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"the range is beyond {name}")
        return self.read_at(self.start(name) + offset, length)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str | None) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(kind: str, name: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit that keeps the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    kind: str
    name: str
    url: str
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def fields(block: bytes) -> dict[str, str]:
    """The fields of a header, by lower-case name; lines that begin with a space go on."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if ":" in line)}


def parsed(data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = fields(head)
    block = rest[: int(headers["content-length"])]
    if len(block) < int(headers["content-length"]):
        raise ValueError("a WARC record ends early")
    http: dict[str, str] = {}
    if headers.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = fields(top)
    return Record(headers.get("warc-type", ""), headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri", ""), headers, http, block)


def unzipped(archive: Zip, name: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stored member one after the other, read in steps."""
    at, size, rest = 0, archive.members[name].size, b""
    while rest or at < size:
        unpacker, out, held = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                if at >= size:
                    raise ValueError(f"{name} ends within a record")
                rest = archive.range(name, at, min(step, size - at))
                at += len(rest)
            out.append(unpacker.decompress(rest, MOST - held + 1))
            held += len(out[-1])
            if held > MOST:
                raise ValueError(f"a record inflates to more than {MOST} bytes")
            rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
        yield b"".join(out)


def walked(archive: Zip, name: str, head: int = 1 << 16) -> Iterator[bytes]:
    """The records of a stored member that isn't compressed, each read by its range once its header has told its length."""
    at, size = 0, archive.members[name].size
    while at < size:
        top, mark, _ = archive.range(name, at, min(head, size - at)).partition(b"\r\n\r\n")
        if not mark:
            raise ValueError(f"a record of {name} has no header")
        length = len(top) + 4 + int(fields(top)["content-length"])
        if not len(top) < length <= MOST:
            raise ValueError(f"a record of {length} bytes")
        yield archive.range(name, at, length)
        at += length + 4


def records(read_at: ReadAt, size: int) -> Iterator[Record]:
    """The records of a ZIP-packaged archive: those that its indexes name, or all where it has none."""
    archive = Zip(read_at, size)
    indexes = sorted(n for n in archive.members if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx")))
    for name in sorted(n for n in archive.members if n.startswith("archive/") and not n.endswith("/") and not indexes):
        if not name.endswith((".warc", ".warc.gz")):
            raise ValueError(f"{name} is of an unknown kind")
        for data in (unzipped if name.endswith(".gz") else walked)(archive, name):
            yield parsed(data)
    starts: dict[str, int] = {}
    for index in indexes:
        for line in archive.range(index, 0, archive.members[index].size).decode().splitlines():
            if "{" not in line:
                continue
            entry = json.loads(line[line.index("{") :])
            name = f"archive/{entry['filename']}"
            if name not in starts:
                starts[name] = archive.start(name)
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset < 0 or offset + length > archive.members[name].size:
                raise ValueError(f"the range is beyond {name}")
            data = archive.read_at(starts[name] + offset, length)
            yield parsed(inflated(data) if data[:2] == b"\x1f\x8b" else data)


def packed(found: list[tuple[str, str | None, bytes]]) -> bytes:
    """An archive of (name, url, gzipped record)."""
    data, lines = bytearray(), []
    for name, url, raw in found:
        entry = {"url": clean(url), "filename": "data.warc.gz", "offset": str(len(data)), "length": str(len(raw)), "id": name}
        lines.append(f"{clean(url) or '-'} 19700101000000 {json.dumps(entry)}")
        data += raw
    index = "\n".join(sorted(lines)) + "\n"
    members = [("archive/data.warc.gz", bytes(data)), ("indexes/index.cdxj", index.encode())]
    package = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n.rpartition("/")[2], "path": n, "hash": f"sha256:{hashlib.sha256(d).hexdigest()}", "bytes": len(d)} for n, d in members]}
    return zipped([*members, ("datapackage.json", json.dumps(package).encode())])


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(path: str, content: bytes) -> None:
    """Writes a file whole: it has its name only once all of it is there."""
    system, inner = opened(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def archived(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """(path, n_records): archives of about ``archive_bytes`` bytes in ``folder``, with a record for every page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.xxhash64(html).alias("hash"), F.octet_length(html).alias("size"))
    same = ["sha", "hash", "size"]
    first = rows.where(F.col("size") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").drop("n"), "payloads")
    rows = rows.join(first, same, "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches):
        held, size = [], 0

        def out():
            content = packed(held)
            path = f"{folder}/pages-{hashlib.sha256(content).hexdigest()[:24]}-{uuid.uuid4().hex[:8]}.wacz"
            put(path, content)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)])], ["path", "n_records"])

        for part in slices(batches):
            for row in part.to_pylist():
                name = f"urn:page:{'' if row['page_id'] is None else row['page_id']}"
                refers = None if row["refers_to"] is None else f"urn:page:{row['refers_to']}"
                raw = gzipped(record("revisit" if refers else "response", name, row["url"], row["html"].encode(), refers))
                held.append((name, row["url"], raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        memory_returned()

    return rows.mapInArrow(run, "path string, n_records long")


RECORDS = "path string, record_type string, record_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string, error string"


def row_of(path: str, r: Record) -> dict:
    """A response's size and digest are those of the payload that was read; a revisit's are those that it states."""
    whole = r.kind != "revisit"
    stated = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if whole and stated and stated != digest(r.payload):
        raise ValueError(f"the payload of {r.name} isn't what its digest says")
    return {"path": path, "record_type": r.kind, "record_id": r.name, "url": r.url, "payload": r.payload if whole else None, "payload_bytes": len(r.payload) if whole else int(r.http["content-length"]), "payload_digest": digest(r.payload) if whole else stated, "refers_to": r.headers.get("warc-refers-to", "").strip("<>") or None, "error": None}


def tabled(found: Iterator[tuple[str, Iterator[Record]]], least_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS for the records of each path, in batches of about ``least_bytes``; one with the error where a file can't be read."""
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    rows, size = [], 0
    for path, own in found:
        try:
            for r in own:
                rows.append(row_of(path, r))
                size += len(r.payload) + 500
                if size >= least_bytes:
                    yield batch(rows)
                    rows, size = [], 0
        except FAULTS as e:
            rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
    yield batch(rows)
    memory_returned()


def archive_records(files: DataFrame) -> DataFrame:
    """One row per record of small archives (path, content), as the binaryFile source gives them."""

    def run(batches):
        def each():
            for part in slices(batches):
                for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                    view = memoryview(content or b"")
                    yield path, records(lambda at, n, v=view: bytes(v[at : at + n]), len(view))

        return tabled(each())

    return files.select("path", "content").mapInArrow(run, RECORDS)


def path_records(path: str) -> Iterator[Record]:
    """The records of one archive in any file system that pyarrow opens, by ranges only."""
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        yield from records(lambda offset, size: file.read_at(size, offset), file.size())


def ranged_records(archives: DataFrame, most_tasks: int = 10_000) -> DataFrame:
    """One row per record of the archives at ``path``, read by ranges in up to ``most_tasks`` tasks."""

    def run(batches):
        return tabled((path, path_records(path)) for batch in batches for path in batch.column("path").to_pylist())

    tasks = max(1, min(archives.count(), most_tasks))
    return archives.select("path").repartition(tasks).mapInArrow(run, RECORDS)


def page_records(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from archives in the shared folder."""
    folder = f"{stored_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    found = ranged_records(stored(archived(pages, folder, least_bytes, archive_bytes), "archives"))
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind)
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error")))).otherwise(page("record_id"))
    return found.select(failed.cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: DuckDB SQL for ``page_records`` over table ``{pages}``: five hexadecimal digits of a digest are four letters.
SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM {pages}),
ranked AS (SELECT *, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first_id FROM own)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, (k // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first_id, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM coalesce(first_id, page_id) THEN first_id END AS refers_to
FROM ranked
"""
