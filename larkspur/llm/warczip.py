"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts a member.

An archive is a ZIP file of two stored members: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (one line a record: its key and a JSON object with offset and length). The reader parses the end
records and the central directory (ZIP64 as well), finds the stored members, reads the index and then only the byte
ranges of the records. Archives live in the shared folder and are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import forget, new_folder, small_batches, stored

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20
MIN_REVISIT = 100
#: Archives are read by as many tasks as there are archives, up to this number.
MOST_TASKS = 100_000
STORED = 0

# Fixed values of the ZIP format: signatures, and the fields' layouts after them.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_HEAD, CENTRAL_HEAD = struct.Struct("<HHHHHLLLHH"), struct.Struct("<HHHHHHLLLHHHHHLL")
END_HEAD, END64_HEAD, LOCATOR64_HEAD = struct.Struct("<HHHHLLH"), struct.Struct("<QHHLLQQQQ"), struct.Struct("<LQL")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class NotAnArchive(ValueError):
    """The bytes are no ZIP file that holds what is asked for."""


# --- writing


def warc_record(kind: str, target: str, record_id: str, digest: str, size: int, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit (payload None) names the record it refers to."""
    body = payload or b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class ZipWriter:
    """Writes stored members one after the other to a stream that need not seek; always adds the ZIP64 records."""

    def __init__(self, stream):
        self.stream, self.at, self.central = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: Iterable[bytes]) -> None:
        """A stored member whose size and checksum follow it (data descriptor)."""
        raw, start, size, crc = name.encode(), self.at, 0, 0
        self._put(LOCAL + LOCAL_HEAD.pack(45, 0x0808, STORED, 0, 33, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        for chunk in chunks:
            size, crc = size + len(chunk), zlib.crc32(chunk, crc)
            self._put(chunk)
        self._put(b"PK\x07\x08" + struct.pack("<LQQ", crc, size, size))
        extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
        self.central.append(CENTRAL + CENTRAL_HEAD.pack(45, 45, 0x0808, STORED, 0, 33, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)

    def finish(self) -> None:
        start, n = self.at, len(self.central)
        for entry in self.central:
            self._put(entry)
        size, end64 = self.at - start, self.at
        self._put(END64 + END64_HEAD.pack(44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64 + LOCATOR64_HEAD.pack(0, end64, 1))
        self._put(END + END_HEAD.pack(0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class ArchiveWriter:
    """One archive: records go out as they come, the index (a line a record) at the end."""

    def __init__(self, path: str):
        system, self.path = open_fs(path)
        system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(self.path)
        self.zip, self.size, self.index = ZipWriter(self.stream), 0, []

    def write(self, records: Iterable[tuple[str, bytes]]) -> int:
        """Write records (key, record) until the archive is full; how many went in."""
        n = 0

        def chunks() -> Iterator[bytes]:
            nonlocal n
            for key, record in records:
                packed = gzip.compress(record, 6, mtime=0)
                self.index.append(f"{key} {json.dumps({'offset': self.size, 'length': len(packed)})}\n")
                self.size += len(packed)
                n += 1
                yield packed
                if self.size >= ARCHIVE_BYTES:
                    return

        self.zip.member(WARC_MEMBER, chunks())
        self.zip.member(INDEX_MEMBER, (line.encode() for line in self.index))
        self.zip.finish()
        self.stream.close()
        return n


# --- reading


def read_range(f, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise NotAnArchive(f"{size} bytes at {start} asked for, {len(data)} there")
    return data


def end_record(f, length: int) -> tuple[int, int, int]:
    """(entries, size and start of the central directory), from the end record or its ZIP64 form."""
    tail_size = min(length, 22 + FULL16)
    tail = read_range(f, length - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise NotAnArchive("no end record")
    _, _, _, entries, size, start, _ = END_HEAD.unpack_from(tail, at + 4)
    if FULL16 == entries or FULL32 in (size, start):
        place = length - tail_size + at - 20
        locator = read_range(f, place, 20) if place >= 0 else b""
        if locator[:4] == LOCATOR64:
            _, where, _ = LOCATOR64_HEAD.unpack_from(locator, 4)
            head = read_range(f, where, 56)
            if head[:4] != END64:
                raise NotAnArchive("no ZIP64 end record")
            _, _, _, _, _, _, entries, size, start = END64_HEAD.unpack_from(head, 4)
    if start + size > length:
        raise NotAnArchive("the central directory is not in the file")
    return entries, size, start


def members(f, length: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, checksum, stored size, local header's place), from the central directory."""
    entries, size, start = end_record(f, length)
    directory, at, found = read_range(f, start, size), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != CENTRAL:
            raise NotAnArchive("bad central entry")
        (_, _, flags, method, _, _, crc, packed, plain, name_size, extra_size, note_size, _, _, _, local) = CENTRAL_HEAD.unpack_from(directory, at + 4)
        at += 46
        name = directory[at : at + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = directory[at + name_size : at + name_size + extra_size], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, i)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            i += 4 + n
        found[name] = (method, crc, packed, local)
        at += name_size + extra_size + note_size
    return found


def stored_member(f, found: dict, name: str) -> tuple[int, int]:
    """(start, size) of a stored member's bytes in the archive."""
    if name not in found:
        raise NotAnArchive(f"no member {name}")
    method, _, size, local = found[name]
    if method != STORED:
        raise NotAnArchive(f"{name} is not stored")
    head = read_range(f, local, 30)
    if head[:4] != LOCAL:
        raise NotAnArchive(f"no local header of {name}")
    *_, name_size, extra_size = LOCAL_HEAD.unpack_from(head, 4)
    return local + 30 + name_size + extra_size, size


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise NotAnArchive("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records(path: str) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(key, headers, block) of all records that an archive's index lists, each by its own byte range."""
    system, place = open_fs(path)
    with system.open_input_file(place) as f:
        length = f.size()
        found = members(f, length)
        index_at, index_size = stored_member(f, found, INDEX_MEMBER)
        warc_at, warc_size = stored_member(f, found, WARC_MEMBER)
        for line in read_range(f, index_at, index_size).decode().splitlines():
            key, _, entry = line.partition(" ")
            entry = json.loads(entry)
            if entry["offset"] + entry["length"] > warc_size:
                raise NotAnArchive("an index entry points outside the archive")
            yield key, *parse_record(gzip.decompress(read_range(f, warc_at + entry["offset"], entry["length"])))


# --- DataFrames


def record_urn(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def urn_page(urn: str | None) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if text == "none" else int(text)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """page_id, digest and refers_to of the rows whose payload (of ``min_bytes`` at least) a smaller page_id holds as well;
    and the stored table that this reads."""
    narrow = stored(pages.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha2("html", 256).alias("digest")), "page-digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    return narrow.join(first, "digest").where("page_id <> first_id").groupBy("page_id", "digest").agg(F.min("first_id").alias("refers_to")), narrow


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into archives in ``folder``; the archives' paths, kept as a table.

    A retried task writes new files under new names; only the committed attempt's paths are in the table.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    again, digests = revisits(pages)
    found = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    digest = F.sha2("html", 256)
    rows = pages.withColumn("digest", digest).join(found, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for r in batch.slice(at, 256).to_pylist():
                        payload, again = r["html"].encode(), r["refers_to"]
                        url = r["url"].replace("\r", " ").replace("\n", " ")
                        yield str(r["page_id"]), warc_record("response" if again is None else "revisit", url, record_urn(r["page_id"]), r["digest"], len(payload), payload if again is None else None, None if again is None else record_urn(again))

        source, paths = each(), []
        for first in source:
            writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
            writer.write(x for part in ((first,), source) for x in part)
            paths.append(writer.path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    small_batches(rows.sparkSession)
    archives = stored(rows.mapInArrow(run, "path string"), "archives")
    forget(digests)
    return archives


RECORDS = T.StructType().add("page_id", "long").add("record_type", "string").add("target", "string").add("payload_bytes", "long").add("payload_digest", "string").add("refers_to", "long").add("payload", "binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives at ``path``; a response's payload is checked against its digest as it is read."""
    schema = RECORDS if with_payload else T.StructType(RECORDS.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(schema)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for _, head, block in records(path):
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    response = head["warc-type"] == "response"
                    if response and hashlib.sha256(block).hexdigest() != digest:
                        raise NotAnArchive(f"{head['warc-record-id']}: the payload does not match its digest")
                    row = (urn_page(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], len(block) if response else int(head["x-payload-length"]), digest, urn_page(head.get("warc-refers-to")), block if response else None)
                    rows.append(row[: len(kinds)])
                    size += len(block)
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # a number of its own, as adaptive execution would join the few bytes of all paths into one task
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.repartition(tasks, "path").mapInArrow(run, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read all records back, without payloads.

    Null html is an empty payload, a null url empty. Of equal payloads of ``MIN_REVISIT`` bytes or more the row with the
    smallest page_id is the response; rows repeated with that id are responses too. Rows without a page_id are
    responses and never referred to. Payloads of any length are one record each, written and read one at a time. An
    empty table gives no rows; other columns are ignored.
    """
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc")), with_payload=False)
