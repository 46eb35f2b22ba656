import base64
import hashlib
import struct

import pytest
import zstandard

from adlens.llm import warc
from adlens.llm.ship import send_package
from adlens.session import scratch_path

ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", None), (4, None, ""),
        (5, "http://a/\r\nx%", "<p>é ok</p>"), (6, "http://a/6", "<b>" + "long " * 50_000 + "</b>"), (None, "http://n", "<p>same</p>")]


@pytest.fixture
def pages(spark):
    send_package(spark)
    return lambda rows: spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        top = max(same) if same and len(data) >= least else page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "response" if page_id == top else "revisit", None if page_id == top else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip_equals_brute_force(pages, least):
    got = [tuple(r) for r in warc.archive_round_trip(pages(ROWS), least).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)


def test_payloads_and_urls_come_back(spark, pages):
    folder = scratch_path(spark, "warc-test")
    records = warc.read_archives(warc.write_archives(pages(ROWS), folder), folder).collect()
    stored = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response"}
    assert stored == {2: b"<p>same</p>", 4: b"", 5: "<p>é ok</p>".encode(), 6: ROWS[5][2].encode()}
    assert {r.page_id: r.url for r in records} == {i: u for i, u, _ in ROWS}
    assert all(r.payload is None for r in records if r.record_type == "revisit")


def test_identical_rows_of_the_response_are_responses(pages):
    rows = [(1, "u", "x"), (2, "v", "x"), (2, "v", "x")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages(rows)).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


def test_only_the_targets_of_revisits_are_landed(pages, monkeypatch):
    landed, land = {}, warc.land

    def counted(df, label):
        out = land(df, label)
        landed[label] = out.count()
        return out
    monkeypatch.setattr(warc, "land", counted)
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(40)] + [(i, f"http://h/{i}", "<p>same</p>") for i in range(40, 43)]
    got = [tuple(r) for r in warc.archive_round_trip(pages(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    last = [n for label, n in landed.items() if label not in ("winners", "revisits", "archives", "records")]
    assert landed["records"] == 43 and sum(last) == 1


def test_empty_table(pages):
    assert warc.archive_round_trip(pages([])).collect() == []


def test_dictionary_leads_and_every_record_is_a_frame(tmp_path):
    path = tmp_path / "x.warc.zst"
    data = [warc.record(i, f"http://h/{i}", f"<html><body>page {i} of the site</body></html>".encode() * 3, "D", None) for i in range(300)]
    with open(path, "wb") as out:
        writer = warc.ArchiveWriter(out)
        for d in data:
            writer.add(d)
        writer.close()
    raw = path.read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(raw[8:8 + size])
    at, frames = 8 + size, []
    while at < len(raw):
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        frames.append(one.decompress(raw[at:]))
        at = len(raw) - len(one.unused_data)
    assert frames == data
    assert len(raw) - size < sum(map(len, data)) / 4


def test_samples_are_the_dictionary_where_there_is_nothing_to_train_on():
    assert warc.build_dictionary([b"abc"]) == b"abc"
