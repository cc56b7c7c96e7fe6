import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow import fs

from ledgerlight.llm import warc as W
from ledgerlight.llm.common import run_folder

BIG = "<p>" + "x" * 1200
HTML = {1: "small", 2: "small", 3: BIG, 4: BIG, 5: BIG, 6: None, 7: "", 8: "é" * 500, 9: "é" * 500, 10: "\r\n\r\nWARC/1.1\r\n" * 99,
        11: "y" * 300000, 12: "z" * 999, 13: "z" * 999}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i} ü\r\nX: y" if i % 3 else None, h) for i, h in HTML.items()] + [(5, "again", BIG), (None, "n", BIG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as digest", "1 as holder")


def test_round_trip(pages):
    rows = W.warc_round_trip(pages).collect()
    assert len(rows) == len(HTML) + 2
    for r in rows:
        payload = (BIG if r.page_id is None else HTML[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        holder = {3: 5, 4: 5, 5: None, None: 5, 8: 9, 9: None}.get(r.page_id)
        assert r.refers_to == holder
        assert r.record_type == ("revisit" if holder else "response")


def test_empty_and_all_null(spark, pages):
    assert W.warc_round_trip(pages.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    row = W.warc_round_trip(nothing).first()
    assert (row.page_id, row.payload_bytes, row.record_type) == (None, 0, "response")


def test_archives_have_a_member_per_record_and_a_sidecar(spark, pages):
    folder = run_folder(spark, "warc-test")
    whole = W.write_archives(W.plan_records(pages).coalesce(2), f"{folder}/whole")
    index = W.normalise(whole, f"{folder}/members")
    rows = index.orderBy("archive", "offset").collect()
    assert sum(r.records for r in whole.collect()) == len(rows) == len(HTML) + 2
    for source in whole.collect():  # one member over all records
        data = W._open_file(source.archive).read()
        one = zlib.decompressobj(W.GZIP)
        one.decompress(data)
        assert one.eof and not one.unused_data
    for archive in {r.archive for r in rows}:
        mine = [r for r in rows if r.archive == archive]
        data = W._open_file(archive).read()
        assert sum(r.length for r in mine) == len(data)
        records = [gzip.decompress(data[r.offset:r.offset + r.length]) for r in mine]
        assert b"".join(records) == gzip.decompress(data)
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(W.END) for x in records)
        system, path = fs.FileSystem.from_uri(archive + ".idx")
        lines = system.open_input_file(path).read().decode().splitlines()
        assert [line.split("\t") for line in lines] == [
            [str(r.offset), str(r.length), r.record_id, r.record_type] for r in mine]


def test_streams_in_small_pieces(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 7)
    payloads = [bytes([65 + i]) * (i * 37) for i in range(20)]
    records = [W.format_record(i, None, p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data = gzip.compress(b"".join(records[:12])) + gzip.compress(b"".join(records[12:]))
    assert [r for _, r in W.split_records(W.inflate(io.BytesIO(data)))] == records


def test_damage_is_an_error():
    record = W.format_record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(W.split_records(iter([record[:-9]])))
