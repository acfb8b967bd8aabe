"""WARC archives in ZIP packages: exact round trips, ZIP64 directories, and broken files."""

import hashlib
import io
import zipfile

import pytest
from panelwright.llm.queries import ORACLES, QUERIES
from panelwright.llm.warc import DATA, INDEX, archive_records, read_archives, store_of, warc_record, write_archives, zip_members

LONG = "<p>é long page</p>" * 100
PAGES = "page_id long, url string, html string, payload string"


def reader(data):
    return lambda at, n: data[at : at + n]


def test_query_equals_its_sql(spark, sf):
    from oracle import check

    assert check(QUERIES["op9_warc"](spark, sf), sf, ORACLES["op9_warc"])


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", LONG, "x"), (2, None, LONG, "x"), (3, "http://a/\r\nEvil: 1", "short", None), (4, "http://b/", "short", None), (5, "u", None, None), (6, "u", "", None), (None, None, LONG, None), (2, None, LONG, "x")]
    got = sorted(read_archives(write_archives(spark.createDataFrame(rows, PAGES))).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.record_type for r in got] == ["revisit", "response", "response", "response", "response", "response", "response", "revisit"]
    assert [r.refers_to for r in got] == [2, None, None, None, None, None, None, 2]
    assert all(r.payload_bytes == len((h or "").encode()) for r, h in zip(got, [LONG, LONG, LONG, "short", "short", None, "", LONG]))
    assert all(r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    assert bytes(got[1].payload).decode() == LONG and got[3].url == "http://a/Evil: 1"
    assert read_archives(write_archives(spark.createDataFrame([], PAGES))).collect() == []


def test_archives_are_packages_with_an_index(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = write_archives(pages, archive_bytes=20_000).collect()
    assert sum(r.records for r in listed) == pages.count() and len(listed) > 1
    for r in listed:
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.namelist() == [DATA, INDEX] and z.testzip() is None
            assert len(z.read(INDEX).splitlines()) == r.records == sum(1 for _ in archive_records(r.path))


def packed(members, note=b"", **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **how) as z:
        z.comment = note
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def test_members_are_found_behind_a_note_and_a_prefix_of_end_marks():
    data = packed([("a.warc", b"abc PK\x05\x06 def", zipfile.ZIP_STORED), ("packed", b"x" * 99, zipfile.ZIP_DEFLATED), ("é/", b"", zipfile.ZIP_STORED)], note=b"PK\x05\x06 a note")
    found = zip_members(reader(data), len(data))
    assert list(found) == ["a.warc"]
    at, n = found["a.warc"]
    assert data[at : at + n] == b"abc PK\x05\x06 def"


def test_zip64_directory():
    import struct

    data = packed([("m", b"payload", zipfile.ZIP_STORED)])
    end = data.rfind(b"PK\x05\x06")
    entries, length, start = struct.unpack_from("<HII", data, end + 10)
    directory = bytearray(data[start : start + length])
    name_n = struct.unpack_from("<H", directory, 28)[0]
    struct.pack_into("<II", directory, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", directory, 42, 0xFFFFFFFF)
    struct.pack_into("<H", directory, 30, 28)
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    directory = bytes(directory[: 46 + name_n]) + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(directory), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = data[:start] + directory + end64 + locator + tail
    at, n = zip_members(reader(wide), len(wide))["m"]
    assert wide[at : at + n] == b"payload"


def test_broken_files_are_errors(tmp_path):
    with pytest.raises(ValueError, match="no end"):
        zip_members(reader(b"nothing"), 7)
    with pytest.raises(ValueError, match="WARC"):
        warc_record(b"HTTP/1.1 200 OK\r\n\r\n")
    data = packed([(DATA, b"xx", zipfile.ZIP_STORED), (INDEX, b"0 99 response sha1:0\n", zipfile.ZIP_STORED)])
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(ValueError, match="outside"):
        list(archive_records(f"file://{tmp_path}/a.zip"))


def test_copies_of_rows_without_an_id_and_single_pages(spark):
    rows = [(None, "a", LONG, None), (7, "b", LONG, None), (8, "c", LONG + "other", None), (None, "d", LONG + "more", None), (None, "e", LONG + "more", None)]
    got = {r.url: (r.record_type, r.refers_to) for r in read_archives(write_archives(spark.createDataFrame(rows, PAGES)), payloads=False).collect()}
    assert got == {"a": ("revisit", 7), "b": ("response", None), "c": ("response", None), "d": ("response", None), "e": ("response", None)}


def test_a_full_filter_changes_no_result(spark, sf, monkeypatch):
    from oracle import check
    from panelwright.llm import warc

    monkeypatch.setattr(warc, "FILTER_BITS", 7)
    assert check(QUERIES["op9_warc"](spark, sf), sf, ORACLES["op9_warc"])


def test_schemes(tmp_path):
    store, path = store_of(f"file://{tmp_path}/x")
    assert path == f"{tmp_path}/x" and store_of(f"{tmp_path}/x")[1] == path == store_of(f"file:{tmp_path}/x")[1]
    with pytest.raises(ValueError, match="dbx://"):
        store_of("dbx://bucket/x")


def test_neighbours_are_read_together(spark, sf, monkeypatch):
    from panelwright.llm import warc

    listed = write_archives(spark.read.parquet(f"{sf}/pages.parquet").coalesce(1)).first()
    whole = list(archive_records(listed.path))
    for size in (1, 50_000):
        monkeypatch.setattr(warc, "RANGE_BYTES", size)
        assert list(archive_records(listed.path)) == whole
