"""WARC records in ZIP packages: a writer, and a reader that needs no extraction.

A package holds the stored (uncompressed) member archive/data.warc.gz, with one gzip member per
record, and indexes/index.cdxj with each record's offset and length in it. The reader parses the end
of the package, its ZIP64 records and central directory, finds where stored members begin, reads the
index and then reads ranges of records straight from the package. Packages are read and written
through pyarrow's file systems, so they can be in any store that it knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import cut, fresh_path, tasks_for

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ZIP directories


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def _zip64(extra: bytes, wanted: list[bool]) -> list[int]:
    """Values of the ZIP64 extra field for the fields that are all ones in the entry."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("ZIP64 sizes are missing")


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP package: name -> (local header offset, stored size, method).

    ``file`` is seekable. Raises ValueError where there is no directory, or one over several disks."""
    tail_at = max(0, size - 65_557)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)  # those bytes were inside the comment
    if end < 0:
        raise ValueError("no end of central directory")
    disk, _, _, count, length, start = struct.unpack_from("<HHHHLL", tail, end + 4)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
        at = struct.unpack_from("<Q", tail, locator + 8)[0]
        record = _range(file, at, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        disk, count, length, start = struct.unpack_from("<L", record, 16)[0], *struct.unpack_from("<QQQ", record, 32)
    if disk not in (0, 0xFFFF):
        raise ValueError("packages over several disks are not read")
    raw, at, out = _range(file, start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, full, n, x, c = struct.unpack_from("<LLHHH", raw, at + 20)
        offset = struct.unpack_from("<L", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        wanted = [v == 0xFFFFFFFF for v in (full, stored, offset)]
        if any(wanted):
            values = iter(_zip64(raw[at + 46 + n : at + 46 + n + x], wanted))
            full, stored, offset = (next(values) if w else v for w, v in zip(wanted, (full, stored, offset)))
        out[name] = (offset, stored, method)
        at += 46 + n + x + c
    return out


def member_range(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(start, length) of a stored member's bytes in the package."""
    offset, size, method = entry
    if method != 0:
        raise ValueError("the member is not stored")
    head = _range(file, offset, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    n, x = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n + x, size


# ---- records


def _id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page, url, payload: bytes, sha1_hex: str, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; field names in lower case."""

    def fields(block: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        return {k.lower(): v.strip() for k, _, v in pairs}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _gunzip(raw: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member that begins at ``at``, and its length; later members are not touched."""
    member, parts, end = zlib.decompressobj(31), [], at
    while not member.eof:
        if end >= len(raw):
            raise ValueError("a record is cut off")
        parts.append(member.decompress(raw[end : end + step]))
        end += step
    return b"".join(parts), min(end, len(raw)) - len(member.unused_data) - at


# ---- writing


def with_references(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of ``pages(page_id, url, html)``: of equal
    payloads of ``least`` bytes or more the row with the largest page_id is referred to by the others. Shorter ones, empty ones among
    them, have no part in the join, so what they share is no key of it."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload"))
    is_long = F.octet_length("payload") >= least
    groups = base.where(is_long).groupBy("payload_digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and leader is not null").drop("n")
    columns = ["page_id", "url", "payload", "payload_digest"]
    joined = base.where(is_long).join(groups, "payload_digest", "left").select(*columns, F.expr("if(leader <=> page_id, null, leader)").alias("refers_to"))
    return base.where(~is_long).select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(joined)


def write_packages(records: DataFrame, folder: str, max_records: int = 50_000, max_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write packages of the rows of :func:`with_references` under ``folder``; returns (package, records, bytes).

    Each task writes its own packages under fresh names, so a task that runs again never writes to a
    package that is listed; only listed packages count. The list is written to the shared folder."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            name = f"pages-{uuid.uuid4().hex}.wacz"
            lines, at = [], 0
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(DATA, "w", force_zip64=True) as member:
                    while row is not None and len(lines) < max_records and at < max_bytes:
                        raw = gzip.compress(record(*row, date), 1, mtime=0)
                        member.write(raw)
                        lines.append(json.dumps({"id": _id(row[0]), "offset": at, "length": len(raw)}))
                        at += len(raw)
                        row = next(rows, None)
                with package.open(INDEX, "w", force_zip64=True) as member:
                    member.write("".join(f"{x}\n" for x in lines).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64()), pa.array([at], pa.int64())], ["name", "records", "bytes"])

    listed = cut(records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "name string, records long, bytes long"), "warc-packages")
    return listed.select(F.concat(F.lit(folder + "/"), F.col("name")).alias("package"), "records", "bytes")


# ---- reading


def splits(packages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(package, start, length): byte ranges of whole records, about ``split_bytes`` each, from the index of
    every package of ``packages(package)``."""

    def run(batches):
        for b in batches:
            for package in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(package)
                with store.open_input_file(path) as file:
                    members = directory(file, file.size())
                    start, _ = member_range(file, members[DATA])
                    at, size = member_range(file, members[INDEX])
                    ranges, first, end = [], None, None
                    for line in _range(file, at, size).splitlines():
                        entry = json.loads(line)
                        if first is not None and end - first >= split_bytes:
                            ranges.append((package, start + first, end - first))
                            first = None
                        first = entry["offset"] if first is None else first
                        end = entry["offset"] + entry["length"]
                    if first is not None:
                        ranges.append((package, start + first, end - first))
                if ranges:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ranges)], ["package", "start", "length"])

    return packages.select("package").mapInArrow(run, "package string, start long, length long")


def read_records(packages: DataFrame, payloads: bool = False, split_bytes: int = 8 << 20) -> DataFrame:
    """One row per record: package, offset, record_type, page_id, uri, refers_to, payload_bytes and
    payload_digest (hex) of the full payload, payload (null unless ``payloads``, and for revisits).

    A response's size and digest are measured on what was read and must agree with its header; a
    revisit states those of the payload that it refers to (see :func:`dangling_revisits`). ValueError for a
    broken package. A range row is tiny and stands for megabytes, so tasks are counted by ranges, not by the
    size of their rows."""
    page = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v or "")) else None

    def run(batches):
        for b in batches:
            for package, start, length in zip(*(c.to_pylist() for c in b.columns)):
                store, path = fs.FileSystem.from_uri(package)
                with store.open_input_file(path) as file:
                    raw = _range(file, start, length)
                rows, at = [], 0
                while at < len(raw):
                    text, used = _gunzip(raw, at)
                    warc, http, payload = parse_record(text)
                    stated = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"{package}: digest differs at {start + at}")
                    size = len(payload) if warc["warc-type"] == "response" else int(http["content-length"])
                    rows.append((package, start + at, warc["warc-type"], page(warc["warc-record-id"]), warc.get("warc-target-uri"), page(warc.get("warc-refers-to")), size, stated, payload if payloads and warc["warc-type"] == "response" else None))
                    at += used
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["package", "offset", "record_type", "page_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
    ranges = cut(splits(packages, split_bytes), "warc-ranges")
    tasks = tasks_for(packages.sparkSession, ranges.count(), 16)
    return ranges.repartitionByRange(tasks, "package", "start").mapInArrow(
        run, "package string, offset long, record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def dangling_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) that revisits of ``records`` state of the response they refer to, where
    no response with these was read. A response that many revisit counts once."""
    told = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    read = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes")
    return told.join(read, ["page_id", "payload_digest", "payload_bytes"], "left_anti")


def package_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` into packages and read their records back.

    Null html is an empty payload, null url leaves out the field, a null page_id is written as such and
    comes back null. Rows that share page_id and payload are all responses if they are the largest.
    An empty table writes nothing and gives an empty result; further columns are ignored. A very long payload
    is one record and alone in its range; it is held in memory once. ValueError if a revisit's size or digest
    is not that of the response it names.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    records = cut(read_records(write_packages(with_references(pages), folder)).drop("payload"), "warc-records")
    if not dangling_revisits(records).isEmpty():
        raise ValueError(f"{folder}: a revisit refers to a response that differs or is not there")
    return records
