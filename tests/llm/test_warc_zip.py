"""WARC records in ZIP archives (3): round trips, and directories that others write."""

from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from tests.llm.helpers import with_clashes
from tracewarden.llm import warc_zip as W
from tracewarden.llm.tables import ship_library
from tracewarden.session import new_folder

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/é b\r\nX: y", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://c", None), (4, "", ""), (5, "http://d", "x" * 300_000), (6, "http://e", "\r\n\r\nWARC/1.1"),
    (None, "http://f", "<p>ä</p>"), (None, "http://g", "alone"), (7, "http://h", "twice"), (7, "http://h", "twice"), (8, "http://h", "twice"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, smallest=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= smallest:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        whole = first.get(html or "")
        revisit = whole is not None and i != whole
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", whole if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("smallest,archive_bytes", [(0, 1 << 30), (6, 1)])
def test_round_trip(spark, smallest, archive_bytes):
    ship_library(spark)
    folder = new_folder(spark, "warc")
    W.make_folder(spark, folder)
    pages = with_clashes(spark.createDataFrame(ROWS, PAGES)).selectExpr("*", "'y' AS sha1", "'y' AS first", "'y' AS payload").repartition(2)
    archives = W.write_archives(pages, folder, smallest, archive_bytes)
    found = W.read_archives(archives)
    rows = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=repr) == expected(ROWS, smallest)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert payloads[5] == b"x" * 300_000 and payloads[6] == b"\r\n\r\nWARC/1.1" and payloads[3] == b""
    for r in archives.collect():
        with zipfile.ZipFile(r["archive"].removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_no_pages_no_archives(spark):
    ship_library(spark)
    folder = new_folder(spark, "warc")
    W.make_folder(spark, folder)
    assert W.read_archives(W.write_archives(spark.createDataFrame([], PAGES), folder)).collect() == []


def record(i, html):
    return W.written_record(i, f"http://x/{i}", html.encode(), digest(html), None)


def test_archives_without_index_are_scanned_and_comments_skipped(tmp_path):
    records = [record(k, "page " * k * 50) for k in range(20)]
    path = tmp_path / "plain.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("readme.txt", "PK\x05\x06 not the end")
        z.writestr("archive/one.warc.gz", b"".join(records))
        z.comment = b"a comment " * 30
    with pa.OSFile(str(path)) as file:
        found = [file.read_at(n, a) for a, n in W.record_places(file)]
        assert found == records
        assert list(W.scanned_places(file, *next((W.data_start(file, m), m.size) for m in W.directory(file) if m.name.endswith("gz")), step=7)) == list(W.record_places(file))


def test_zip64_directory(tmp_path, monkeypatch):
    # Python writes ZIP64 parts once its limits are passed; lowering them makes a small file with all of them.
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for k in range(4):
            z.writestr(f"archive/{k}.warc.gz", record(k, "wide"))
    assert W.END64_SIGNATURE in path.read_bytes()
    with pa.OSFile(str(path)) as file:
        assert [m.name for m in W.directory(file)] == [f"archive/{k}.warc.gz" for k in range(4)]
        assert [W.record_row(W.zlib.decompress(file.read_at(n, a), 31))["page_id"] for a, n in W.record_places(file)] == [0, 1, 2, 3]


def test_damage_is_an_error(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", record(1, "x") * 3)
    path = tmp_path / "bad.zip"
    path.write_bytes(buffer.getvalue())
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError, match="deflated"):
        list(W.record_places(file))
    path.write_bytes(b"nothing here")
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError, match="central directory"):
        W.directory(file)
    damaged = W.zlib.decompress(record(1, "payload"), 31).replace(b"payload\r\n", b"pay1oad\r\n")
    with pytest.raises(ValueError, match="damaged"):
        W.record_row(damaged)


def test_payloads_are_handed_on_in_bounded_batches():
    from tracewarden.llm.warc_zip import in_batches

    rows = [{"payload": None if n % 5 == 0 else b"x" * 100} for n in range(50)]
    batches = list(in_batches(iter(rows), most_bytes=300, most_rows=10))
    assert [r for b in batches for r in b] == rows
    assert all(sum(len(r["payload"] or b"") for r in b) <= 300 and len(b) <= 10 for b in batches) and len(batches) > 10
