"""WARC archives in ZIP packages: written by tasks, found by their directories, read record by record in place.

A package holds stored (not deflated) members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdxj``, one line for each record. Reading never unpacks a package: the end of the file gives the central
directory (with its ZIP64 form where numbers are large), the directory gives the members, the index gives the place of
every record, and each record is read from its range.

Packages are written under a folder that every executor reaches, through the file system that the folder's address
names. A task that runs again writes new files; only files that a finished task reported are listed, so lost executors
leave nothing half-written in the result. Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with
the smallest id is a response, the others are revisits that name it.

Null payloads are empty. Rows without an id, and repeated rows of an id, are records of their own, each judged by its own
payload; ids that are null sort last, and a revisit never refers to itself. Payloads of any length are one record. An empty table gives no packages and
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.batches import bounded
from codefacts.session import ensure_checkpoint_dir, materialize

#: payloads of fewer bytes are always written out
REVISIT_FROM = 100
#: bytes of records after which a task begins another package
PACKAGE = 128 << 20
#: records that are read by one row of work
SLICE = 512
#: bytes of archives for each reading task
TASK = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_LOCAL, _CENTRAL, _END, _END64, _WHERE64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def file_system(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address such as file:/..., hdfs://..., s3a://... or a plain path."""
    if "://" not in address:
        address = address.replace("file:", "", 1)
        return fs.LocalFileSystem(), address
    if address.startswith("file://"):
        return fs.LocalFileSystem(), address.removeprefix("file://")
    return fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


# ---------------------------------------------------------------- packages


class Member(NamedTuple):
    """A stored member: its name, where its bytes begin, and how many there are."""

    name: str
    start: int
    size: int


class PackageWriter:
    """Writes stored members one after another; their sizes may be unknown until they end."""

    def __init__(self, out: io.RawIOBase, zip64: bool = False) -> None:
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        """Sizes and checksum follow the data, so nothing has to be held back."""
        start, raw, crc, size = self.at, name.encode(), 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # room for 64-bit sizes, and a sign that those after the data are
        self._write(struct.pack("<4s5H3I2H", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._write(part)
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.members:
            wide = self.zip64 or max(size, start) >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            small = (_FULL32, _FULL32) if wide else (size, size)
            self._write(
                struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, *small, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if wide else start) + raw + extra
            )
        size, end, n = self.at - begin, self.at, len(self.members)
        wide = self.zip64 or begin >= _FULL32 or n >= _FULL16
        if wide:
            self._write(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(struct.pack("<4sIQI", _WHERE64, 0, end, 1))
        counts = (_FULL16, _FULL16, _FULL32, _FULL32) if wide else (n, n, size, begin)
        self._write(struct.pack("<4s2H2H2IH", _END, 0, 0, *counts, 0))
        self.out.close()


def members(read, size: int) -> list[Member]:
    """The members that a package's directory lists; ``read(start, length)`` reads a range. Deflated members are refused."""
    tail_start = max(0, size - 22 - _FULL16)
    tail = read(tail_start, size - tail_start)
    at = len(tail) - 22
    while at >= 0:  # the end record may be followed by a comment of the length it names
        if tail[at : at + 4] == _END and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, begin = struct.unpack_from("<4H2I", tail, at + 4)
    if count == _FULL16 or length == _FULL32 or begin == _FULL32:
        where = read(tail_start + at - 20, 20)
        if where[:4] != _WHERE64:
            raise ValueError("no place of the ZIP64 directory")
        end64 = read(struct.unpack_from("<Q", where, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of directory")
        count, length, begin = struct.unpack_from("<3Q", end64, 32)
    directory, out, at = read(begin, length), [], 0
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, stored, full = struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<2I", directory, at + 20)
        names, extras, comments = struct.unpack_from("<3H", directory, at + 28)
        start = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode()
        extra, end = at + 46 + names, at + 46 + names + extras
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<2H", directory, extra)
            if kind == 1:  # only what does not fit is there, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                full = wide.pop(0) if full == _FULL32 else full
                stored = wide.pop(0) if stored == _FULL32 else stored
                start = wide.pop(0) if start == _FULL32 else start
            extra += 4 + n
        at = end + comments
        if method != 0 or full != stored:
            if not name.endswith("/"):
                raise ValueError(f"{name} is not stored")
            continue
        local = read(start, 30)
        if local[:4] != _LOCAL:
            raise ValueError("broken local header")
        names, extras = struct.unpack_from("<2H", local, 26)
        out.append(Member(name, start + 30 + names + extras, stored))
    return out


# ---------------------------------------------------------------- records


def record(kind: str, uri: str, number: str, payload: bytes, length: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, gzipped by itself. A revisit has no payload but tells its digest and length."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{number}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    body = payload if kind == "response" else b""
    lines += [f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and payload of one gzipped record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


# ---------------------------------------------------------------- Spark


def roles(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest and response: the page_id of the response that a row revisits, null for responses.

    Of a payload that repeats, rows with the smallest page_id are responses, however many; rows without an id revisit it.
    Where no row of it has an id, all are responses.
    """
    rows = materialize(pages.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest")))
    # counts and least ids are summed up before they are dealt out, so no payload is too frequent
    several = rows.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = rows.join(materialize(several.select("payload_digest", "first")), "payload_digest", "left")
    return first.select("page_id", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("response"))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes packages of all pages (page_id, url, html); one row for each finished package: address and records."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    revisits = roles(pages).filter("response is not null").select(F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest"), "response").distinct()
    # an id may come with several payloads, or be missing: the role belongs to both together
    digest = F.sha2(F.col("html").cast("binary"), 256)
    marked = pages.withColumn("digest", digest).join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        rows = (row for batch in batches for k in range(len(batch)) for row in [tuple(c[k].as_py() for c in batch.columns)])
        pending = next(rows, None)
        while pending is not None:
            address = f"{folder}/{uuid.uuid4().hex}.wacz"
            package = PackageWriter(store.open_output_stream(file_system(address)[1]))
            index, at = [], 0

            def parts() -> Iterator[bytes]:
                nonlocal pending, at
                while pending is not None and at < PACKAGE:
                    page, url, html, response = pending
                    payload = html.encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    kind = "response" if response is None else "revisit"
                    uri = url.replace("\r", " ").replace("\n", " ")
                    data = record(kind, uri, "none" if page is None else str(page), payload, len(payload), digest, None if response is None else str(response))
                    index.append(json.dumps({"offset": at, "length": len(data), "record": page, "type": kind}))
                    at += len(data)
                    yield data
                    pending = next(rows, None)

            package.member(ARCHIVE, parts())
            package.member(INDEX, iter(["\n".join(index).encode() + b"\n"]))
            package.close()
            yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([len(index)], pa.int64())], names=["address", "records"])

    return bounded(marked.select("page_id", "url", "html", "response")).mapInArrow(work, "address string, records long")


def _reader(address: str):
    store, path = file_system(address)
    source = store.open_input_file(path)

    def read(start: int, length: int) -> bytes:
        source.seek(start)
        data = source.read(length)
        if len(data) != length:
            raise ValueError("the package is cut off")
        return data

    return read, source.size()


def locate(packages: DataFrame) -> DataFrame:
    """The places of records in packages (address): lines of the indexes, in slices of up to ``SLICE`` records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column("address").to_pylist():
                read, size = _reader(address)
                found = {m.name: m for m in members(read, size)}
                archive, index = found[ARCHIVE], found[INDEX]
                lines = [json.loads(x) for x in read(index.start, index.size).decode().splitlines() if x]
                for k in range(0, len(lines), SLICE):
                    part = lines[k : k + SLICE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([address]), pa.array([[archive.start + x["offset"] for x in part]], pa.list_(pa.int64())), pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))],
                        names=["address", "offsets", "lengths"],
                    )

    return packages.select("address").mapInArrow(work, "address string, offsets array<long>, lengths array<long>")


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the packages: page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload.

    Digest and length of a response are taken from the payload that was read; those of a revisit from its header.
    ``payload`` is null for revisits, and for all records if ``payloads`` is false.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                read, _ = _reader(place["address"])
                rows, size = [], 0
                for offset, length in zip(place["offsets"], place["lengths"], strict=True):
                    fields, payload = parse_record(read(offset, length))
                    kind = fields["warc-type"]
                    number = lambda name, fields=fields: (lambda v: None if v in (None, "none") else int(v))(fields[name].strip("<>").rpartition(":")[2] if name in fields else None)
                    response = kind == "response"
                    told = fields["warc-payload-digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if response else told
                    if digest != told:
                        raise ValueError("a payload does not have the digest its record tells")
                    size += len(payload)
                    rows.append(
                        {
                            "page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"),
                            "payload_bytes": len(payload) if response else int(fields["x-payload-length"]), "payload_digest": digest,
                            "url": fields.get("warc-target-uri", ""), "payload": payload if response and payloads else None,
                        }
                    )
                    if size > 1 << 22 and payloads:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    # a row of places is small, the reading behind it is not: the number of tasks follows the bytes of the archives
    places = materialize(locate(packages))
    size = places.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda total, x: total + x))).first()[0] or 0
    spread = places.repartition(max(packages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    return spread.mapInArrow(work, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary")


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("url", pa.string()), ("payload", pa.binary()),
    ]
)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for packages in the shared folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/packages/{uuid.uuid4().hex}"
