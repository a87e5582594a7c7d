"""WARC records in ZIP archives: a writer, and a reader that works on byte ranges.

An archive holds two stored (not deflated) members, the WARC file with one gzip member
per record and an index of record places. The reader parses the central directory,
with its ZIP64 parts, from the end of the file, locates both members and reads single
records by range; nothing is extracted. Files are reached through pyarrow's file
systems, so a folder may be any that all executors can open by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.tables import read_table, stored
from tracewarden.session import new_folder

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/data.cdxj"
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
HTTP_TYPE = "application/http; msgtype=response"

# Fixed values of the ZIP format: signatures and layouts of its records.
END_SIGNATURE, END_LAYOUT = b"PK\x05\x06", "<4sHHHHIIH"
END64_PLACE_SIGNATURE, END64_PLACE_LAYOUT = b"PK\x06\x07", "<4sIQI"
END64_SIGNATURE, END64_LAYOUT = b"PK\x06\x06", "<4sQHHIIQQQQ"
ENTRY_SIGNATURE, ENTRY_LAYOUT = b"PK\x01\x02", "<4sHHHHHHIIIHHHHHII"
LOCAL_SIGNATURE, LOCAL_LAYOUT = b"PK\x03\x04", "<4sHHHHHIIIHH"
ZIP64_EXTRA = 1


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# --- Reading ------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A member of an archive: ``header`` is the place of its local header."""

    name: str
    stored: bool
    size: int
    packed_size: int
    header: int


def read_range(file: pa.NativeFile, start: int, size: int) -> bytes:
    data = file.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"archive ends within {size} bytes at {start}")
    return data


def directory(file: pa.NativeFile) -> list[Member]:
    """Members of an archive, from its central directory (ZIP64 where it has one)."""
    total = file.size()
    tail_size = min(total, 65_535 + struct.calcsize(END_LAYOUT) + struct.calcsize(END64_PLACE_LAYOUT))
    tail = read_range(file, total - tail_size, tail_size)
    at = tail.rfind(END_SIGNATURE)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, entries, size, start, _ = struct.unpack_from(END_LAYOUT, tail, at)
    place = at - struct.calcsize(END64_PLACE_LAYOUT)
    if place >= 0 and tail[place : place + 4] == END64_PLACE_SIGNATURE:
        _, _, end64, _ = struct.unpack_from(END64_PLACE_LAYOUT, tail, place)
        record = struct.unpack(END64_LAYOUT, read_range(file, end64, struct.calcsize(END64_LAYOUT)))
        if record[0] != END64_SIGNATURE:
            raise ValueError("no ZIP64 end of central directory where its locator points")
        entries, size, start = record[7], record[8], record[9]
    data, members, at = read_range(file, start, size), [], 0
    for _ in range(entries):
        entry = struct.unpack_from(ENTRY_LAYOUT, data, at)
        if entry[0] != ENTRY_SIGNATURE:
            raise ValueError("damaged central directory")
        name_size, extra_size, comment_size = entry[10:13]
        at += struct.calcsize(ENTRY_LAYOUT)
        name = data[at : at + name_size].decode("utf-8", "replace")
        extra = data[at + name_size : at + name_size + extra_size]
        at += name_size + extra_size + comment_size
        packed_size, full_size, header = wide_sizes(extra, entry[8], entry[9], entry[16])
        members.append(Member(name, entry[4] == 0, full_size, packed_size, header))
    return members


def wide_sizes(extra: bytes, packed_size: int, full_size: int, header: int) -> tuple[int, int, int]:
    """The three numbers, each from the ZIP64 extra field where its own field is full."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            wide = extra[at + 4 : at + 4 + size]
        at += 4 + size
    numbers, at = [], 0
    for value in (full_size, packed_size, header):  # their order in the extra field
        if value == 0xFFFFFFFF:
            (value,) = struct.unpack_from("<Q", wide, at)
            at += 8
        numbers.append(value)
    return numbers[1], numbers[0], numbers[2]


def data_start(file: pa.NativeFile, member: Member) -> int:
    """Place of a stored member's bytes; the local header has name and extra sizes of its own."""
    if not member.stored:
        raise ValueError(f"{member.name} is deflated; records of it cannot be read by range")
    header = struct.unpack(LOCAL_LAYOUT, read_range(file, member.header, struct.calcsize(LOCAL_LAYOUT)))
    if header[0] != LOCAL_SIGNATURE:
        raise ValueError("no local header where the central directory points")
    return member.header + struct.calcsize(LOCAL_LAYOUT) + header[9] + header[10]


def record_places(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(start, size) of every record of an archive, by its indexes, or by a scan where there is none."""
    members = directory(file)
    by_name = {m.name: m for m in members}
    indexed = set()
    for index in (m for m in members if m.name.endswith(".cdxj")):
        lines = read_range(file, data_start(file, index), index.size)
        for line in lines.splitlines():
            entry = json.loads(line[line.index(b"{") :])
            member = by_name[entry["filename"]]
            if member.name not in indexed:
                indexed.add(member.name)
                base = data_start(file, member)
            yield base + entry["offset"], entry["length"]
    for member in (m for m in members if m.name.endswith(".warc.gz") and m.name not in indexed):
        yield from scanned_places(file, data_start(file, member), member.size)


def scanned_places(file: pa.NativeFile, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of a stored member without an index, holding one at a time."""
    at, end = start, start + size
    while at < end:
        unpacker, read = zlib.decompressobj(31), at
        while not unpacker.eof:
            block = read_range(file, read, min(step, end - read))
            if not block:
                raise ValueError("the last record is cut off")
            unpacker.decompress(block)
            read += len(block)
        used = read - len(unpacker.unused_data) - at
        yield at, used
        at += used


def parsed_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one unpacked WARC record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8")
    return fields, rest[: int(fields["content-length"])]


def page_number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (column ``archive``: their URIs).

    Columns page_id, url, record_type, payload_bytes, payload_digest (bare base32 SHA-1),
    payload (null in revisits) and refers_to. A payload that does not have the digest of its
    header raises an error, as damaged archives do.
    """

    def located(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    splits, size = [[]], 0
                    for start, length in record_places(file):
                        if size > SPLIT_BYTES:
                            yield split_rows(uri, splits)
                            splits, size = [[]], 0
                        splits[-1].append((start, length))
                        size += length
                    yield split_rows(uri, splits)

    def split_rows(uri: str, splits: list) -> pa.RecordBatch:
        rows = [s for s in splits if s]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uri] * len(rows), pa.string()),
                pa.array([[p for p, _ in s] for s in rows], pa.list_(pa.int64())),
                pa.array([[n for _, n in s] for s in rows], pa.list_(pa.int64())),
            ],
            ["archive", "starts", "sizes"],
        )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = opened(row["archive"])
                with system.open_input_file(path) as file:
                    records = (record_row(zlib.decompress(read_range(file, a, n), 31)) for a, n in zip(row["starts"], row["sizes"]))
                    for rows in in_batches(records):
                        yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    splits = archives.select("archive").mapInArrow(located, "archive string, starts array<long>, sizes array<long>")
    return splits.repartition("archive", F.get("starts", F.lit(0))).mapInArrow(
        read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, payload binary, refers_to long",
    )


RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("refers_to", pa.int64()),
    ]
)


def in_batches(rows: Iterable[dict], most_bytes: int = BATCH_BYTES, most_rows: int = 1024) -> Iterator[list[dict]]:
    """Rows in lists of about ``most_bytes`` of payload: a split of pages that deflate well is many times its size."""
    batch, size = [], 0
    for row in rows:
        batch.append(row)
        size += len(row["payload"] or b"")
        if size >= most_bytes or len(batch) >= most_rows:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def record_row(record: bytes) -> dict:
    fields, block = parsed_record(record)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    else:
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": page_number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
        "refers_to": page_number(fields.get("warc-refers-to")),
    }


# --- Writing ------------------------------------------------------------------


def written_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One gzip member; ``first`` is the page that a revisit refers to, None for a response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = "" if page_id is None else str(page_id)
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": "1970-01-01T00:00:00Z",  # pages have no time of capture
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if first is None:
        block += payload
    else:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{first}>"
    fields |= {"Content-Type": HTTP_TYPE, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archive(uri: str, records: Iterator[bytes], most_bytes: int) -> tuple[int, int]:
    """Writes records until ``most_bytes`` are reached; returns how many, and the bytes of the WARC member."""
    system, path = opened(uri)
    places, at = [], 0
    with system.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as archive:
        with archive.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as member:
            for record in records:
                member.write(record)
                places.append((at, len(record)))
                at += len(record)
                if at >= most_bytes:
                    break
        with archive.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
            for offset, length in places:
                entry = {"filename": WARC_MEMBER, "offset": offset, "length": length}
                member.write(f"{json.dumps(entry)}\n".encode())
    return len(places), at


def write_archives(pages: DataFrame, folder: str, smallest_shared: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page and returns the archives (archive, records, warc_bytes).

    Of pages whose payloads are equal and have ``smallest_shared`` bytes or more, the one
    with the smallest id is written whole and the others refer to it; rows that repeat
    that id are written whole too. A null html is an empty payload. Pages without an
    id refer to others but are not referred to. Archives have names of their own per
    attempt, and only those of finished tasks are in the returned table.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= smallest_shared)
    firsts = shared.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisit = F.when((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first"))
    marked = rows.join(firsts.select("sha1", "first"), "sha1", "left").select("page_id", "url", "payload", "sha1", revisit.alias("first"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, payload, sha1, first = (batch.column(c)[k].as_py() for c in range(5))
                    yield written_record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), first)

        source = records()
        for head in source:
            uri = f"{folder}/pages-{uuid.uuid4().hex}.zip"

            def with_head(head: bytes = head) -> Iterator[bytes]:
                yield head
                yield from source

            count, size = write_archive(uri, with_head(), archive_bytes)
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [count], "warc_bytes": [size]})

    return stored(marked.mapInArrow(write, "archive string, records long, warc_bytes long"), "archives")


def make_folder(spark: SparkSession, uri: str) -> None:
    """Creates a folder in whatever file system Spark has for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    folder = new_folder(spark, "warc")
    make_folder(spark, folder)
    archives = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
