import hashlib
import io
import zipfile
from collections import defaultdict

import pytest
from pyarrow import fs

from larkspur.llm import runtime, warczip

SCHEMA = "page_id long, url string, html string, digest string, path string"
BIG = "<p>" + "é same payload " * 20


def rows():
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, BIG, "<p>other", BIG, BIG + "!", "long " * 100_000, "WARC/1.0\r\n\r\nPK\x05\x06" * 3, "é" * 50, "é" * 50]
    out = [(90 - i, f"http://h/{i}" if i % 5 else None, t, "d", "p") for i, t in enumerate(html)]
    return [*out, out[6], (91, "http://a\r\nb", BIG, "d", "p"), (None, "http://n", BIG, "d", "p"), (None, None, "z", "d", "p")]


def brute(rows):
    held = defaultdict(list)
    for i, _, t, *_ in rows:
        if i is not None:
            held[t or ""].append(i)
    out = []
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        again = i is not None and len(raw) >= 100 and min(held[t or ""]) < i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(held[t]) if again else None))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = warczip.archived_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())
    full = warczip.read_archives(warczip.write_archives(pages, runtime.new_folder(spark, "warc")))
    texts = {r.page_id: r.payload.decode() for r in full.where("record_type = 'response' and page_id is not null").collect()}
    assert texts == {i: t or "" for i, _, t, *_ in rows() if i in texts} and texts[80] == "long " * 100_000
    assert warczip.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_read_by_as_many_tasks(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(40)], "page_id long, url string, html string").repartition(7)
    archives = warczip.write_archives(pages, runtime.new_folder(spark, "warc"))
    assert archives.count() > 1
    assert warczip.read_archives(archives).rdd.getNumPartitions() == archives.count()


def test_several_archives_from_one_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warczip, "ARCHIVE_BYTES", 300)
    writer = None
    source = iter([(str(i), warczip.warc_record("response", "u", warczip.record_urn(i), "d", 3, b"abc")) for i in range(10)])
    paths = []
    for first in source:
        writer = warczip.ArchiveWriter(f"{tmp_path}/a/{len(paths)}.wacz")
        writer.write(x for part in ((first,), source) for x in part)
        paths.append(writer.path)
    assert len(paths) > 1
    assert [k for p in paths for k, _, _ in warczip.records(p)] == [str(i) for i in range(10)]


def test_archives_are_valid_zip64(tmp_path):
    path = f"{tmp_path}/x.wacz"
    warczip.ArchiveWriter(path).write([("7", warczip.warc_record("response", "u", "<urn:page:7>", "d", 2, b"hi"))])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [warczip.WARC_MEMBER, warczip.INDEX_MEMBER]
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert [(k, b) for k, _, b in warczip.records(path)] == [("7", b"hi")]


def test_reads_archives_of_another_writer(tmp_path):
    import gzip
    import json

    record = gzip.compress(warczip.warc_record("response", "u", "<urn:page:1>", "d", 2, b"ok"))
    for zip64, note in ((False, b""), (True, b""), (False, b"a note PK\x05\x06 in it")):
        path = tmp_path / f"{zip64}{len(note)}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            for name, data in (("readme", b"x" * 10), (warczip.WARC_MEMBER, record), (warczip.INDEX_MEMBER, f"1 {json.dumps({'offset': 0, 'length': len(record)})}\n".encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as m:
                    m.write(data)
            z.comment = note
        assert [(k, b) for k, _, b in warczip.records(str(path))] == [("1", b"ok")]


def test_more_entries_than_a_plain_end_record_can_count():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"f{i}", b"")
    found = warczip.members(out, len(out.getvalue()))
    assert len(found) == 66_000


@pytest.mark.parametrize("data", [b"", b"PK", b"x" * 100, b"PK\x05\x06" + b"\xff" * 18])
def test_what_is_no_archive_is_refused(tmp_path, data):
    path = tmp_path / "bad"
    path.write_bytes(data)
    with pytest.raises(warczip.NotAnArchive):
        list(warczip.records(str(path)))
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(warczip.NotAnArchive):
        warczip.members(f, len(data))
