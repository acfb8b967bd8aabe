"""WARC records in ZIP-packaged archives: written by Spark tasks, read back by byte ranges without extraction.

An archive is a ZIP file with two stored members: archive/data.warc.gz, WARC records that are compressed one
by one, and indexes/index.cdx, a line for each record with its place in that member.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT_FROM = 1000
ARCHIVE_BYTES = 32 << 20
#: Bits of the filter that tells which payloads may have copies, 16 MB whatever the number of pages.
FILTER_BITS = 27
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20
#: Schemes that Spark's file systems and Arrow's name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
#: Fixed values of the ZIP format: signatures, and the size that marks a field as held by ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it. ValueError if Arrow has none for its scheme."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"archives can't be kept at {scheme}:// from here ({e}); give write_archives a folder that tasks can write to, as hdfs, s3, gs, abfs or a shared mount") from e


# Writing


def _bits(digest: Column) -> list[Column]:
    """The bits of a digest in the filter."""
    return [F.shiftrightunsigned(F.xxhash64(digest, F.lit(k)), 64 - FILTER_BITS) for k in range(3)]


def copies_filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests of shared(payload_digest), as 64-bit words: they are put together in Spark, and
    at most 2 ** FILTER_BITS bits come to the driver."""
    bit = shared.select(F.explode(F.array(*_bits(F.col("payload_digest")))).alias("bit"))
    word = bit.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set"))
    found, out = word.toPandas(), np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return out


def planned(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, payload_digest, leader): leader is the largest page_id with the same payload of
    at least revisit_from bytes, null for shorter and single ones. Null html is an empty payload.

    Digests alone are shuffled to find those with several rows. Rows whose digest a filter of those rules out
    stay where they are; only the others, with few by mistake, meet the leaders by a shuffle.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha1("payload"))
    counted = own.where(F.octet_length("payload") >= revisit_from).groupBy("payload_digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    leaders = written(counted.where("n > 1 and leader is not null").select("payload_digest", "leader"), "leaders")
    sent = pages.sparkSession.sparkContext.broadcast(copies_filter(leaders))

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        words, found = sent.value, np.ones(len(a), bool)
        for bit in (a.to_numpy(np.int64), b.to_numpy(np.int64), c.to_numpy(np.int64)):
            found &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
        return pd.Series(found)

    marked = own.withColumn("may_have_copies", held(*_bits(F.col("payload_digest"))))
    lone = marked.where("not may_have_copies").withColumn("leader", F.lit(None).cast("long"))
    some = marked.where("may_have_copies").join(leaders.hint("shuffle_hash"), "payload_digest", "left")
    columns = ["page_id", "url", "payload", "payload_digest"]
    leader = F.when(F.octet_length("payload") >= revisit_from, F.col("leader")).alias("leader")
    return lone.select(*columns, "leader").unionByName(some.select(*columns, leader))


def _record(page_id, url: str | None, payload: bytes, digest: str, leader: int | None) -> tuple[str, bytes]:
    revisit = leader is not None and leader != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{leader}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "revisit" if revisit else "response", "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, inner = store_of(self.path)
        self.out = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload, digest, leader) -> None:
        kind, record = _record(page_id, url, payload, digest, leader)
        packed = gzip.compress(record, 6, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{self.at} {len(packed)} {kind} sha1:{digest}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            index.write("".join(self.lines).encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **how) -> DataFrame:
    """(path, records) of the archives that hold a record for each row of pages(page_id, url, html).

    Every task writes archives of about archive_bytes under names of its own to the folder (one of its own
    under the shared folder, unless given, as a URI); the list of them is kept as a table. A task that is lost
    or repeated leaves files that no list names, and the list names whole files only.
    """
    folder = (folder or f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}").rstrip("/")
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)

    def run(batches):
        now, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, leader in zip(*(batch.column(c).to_pylist() for c in range(5))):
                now = now or _Archive(folder)
                now.add(page_id, url, payload, digest, leader)
                if now.at >= archive_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records"])

    rows = planned(pages, **how).select("page_id", "url", "payload", "payload_digest", "leader")
    return written(rows.mapInArrow(run, "path string, records long"), "archives-list")


# Reading


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """(offset, length) of the bytes of each stored member, from the central directory at a file's end.

    read(offset, length) gives bytes. ZIP64 records are used where the 16 and 32-bit fields are full. Members
    that are compressed, encrypted or folders have no range and are left out. ValueError if there is no
    directory.
    """
    tail_at = max(0, size - (22 + FULL16))
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == entries or FULL32 in (length, start):
        at = tail_at + end - 20
        locator = read(at, 20) if at >= 0 else b""
        if locator[:4] == LOCATOR64:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = read(where, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        at += 46 + name_n + extra_n + note_n
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide, k = extra[4 : 4 + n], 0
                if whole == FULL32:
                    whole, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if packed == FULL32:
                    packed, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                if offset == FULL32:
                    offset = struct.unpack_from("<Q", wide, k)[0]
            extra = extra[4 + n :]
        if method or flags & 1 or name.endswith("/"):
            continue
        local = read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        local_name, local_extra = struct.unpack_from("<HH", local, 26)
        found[name] = (offset + 30 + local_name + local_extra, packed)
    return found


def warc_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def archive_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that an archive's index lists, read by their ranges, neighbours together."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as file:
        members = zip_members(lambda at, n: file.read_at(n, at), file.size())
        data_at, data_n = members[DATA]
        index_at, index_n = members[INDEX]
        places = [tuple(map(int, line.split(" ", 2)[:2])) for line in file.read_at(index_n, index_at).decode().splitlines()]
        at = 0
        while at < len(places):
            begin, end, first = places[at][0], sum(places[at]), at
            while at < len(places) and places[at][0] == (end if at > first else begin) and (at == first or end - begin < RANGE_BYTES):
                end, at = sum(places[at]), at + 1
            if end > data_n:
                raise ValueError(f"{path}: a record lies outside its member")
            held = file.read_at(end - begin, data_at + begin)
            for offset, length in places[first:at]:
                yield warc_record(zlib.decompress(held[offset - begin : offset - begin + length], 47))


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record of the
    archives(path ...), dealt out by path. A response's bytes and digest are counted from its payload, and a
    digest that differs from its header's is an error; a revisit has those of its headers and no payload."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in archive_records(path):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    payload, n = None, int(headers["warc-payload-length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    row = (_page(headers["warc-record-id"]), headers["warc-target-uri"], n, digest, kind, _page(headers.get("warc-refers-to")))
                    rows.append((*row, payload) if payloads else row)
                    held += len(payload or b"") if payloads else 100
                    if held > 16 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    tasks = 16 * archives.sparkSession.sparkContext.defaultParallelism  # an archive a task, while they are few
    dealt = archives.select("path").repartition(max(1, min(tasks, archives.count())))
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """What read_archives finds in the archives that write_archives makes of pages.

    Rows with equal payloads of at least REVISIT_FROM bytes are revisits of the one with the largest page_id;
    rows that repeat that page_id are responses as well. A row with a null page_id revisits the others, or is a
    response if there are none with an id; null urls are read as empty; extra columns are ignored; an empty
    table gives no rows.
    """
    return read_archives(write_archives(pages), payloads=False)
