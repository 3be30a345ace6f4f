"""The salvage reader on damaged archives, and the writer's edge cases."""

import gzip
import io

import pytest

from eventlens.llm import warc
from eventlens.llm.common import shared_path


def archive(n=6, compress=True):
    records = [warc.record(i, f"http://h/{i}", (f"page {i} " * 50).encode(), None) for i in range(n)]
    parts = [gzip.compress(r, mtime=0) if compress else r for r in records]
    return parts


def read(data):
    return [(kind, start, end, warc._row("p", kind, start, end, headers, block)) for kind, start, end, headers, block in warc.salvage(io.BytesIO(data))]


def pages(found):
    return [row["page_id"] for kind, *_, row in found if row["kind"] == "record"]


def test_sound_archives_have_no_gaps():
    for compress in (True, False):
        found = read(b"".join(archive(compress=compress)))
        assert pages(found) == list(range(6)) and all(kind == "record" for kind, *_ in found)


def test_damaged_record_is_a_gap_and_later_ones_are_recovered():
    for compress in (True, False):
        parts = archive(compress=compress)
        hurt = bytearray(parts[2])
        hurt[len(hurt) // 2] ^= 0xFF
        parts[2] = bytes(hurt)
        found = read(b"".join(parts))
        assert pages(found) == [0, 1, 3, 4, 5]
        gaps = [(start, end) for kind, start, end, _ in found if kind == "gap"]
        begin = len(parts[0] + parts[1])
        assert gaps == [(begin, begin + len(parts[2]))]


def test_garbage_cut_ends_and_every_byte_accounted_for():
    for compress in (True, False):
        parts = archive(compress=compress)
        data = b"junk\x1f\x8b\x08more" + parts[0] + b"WARC/1.9\r\n" + parts[1] + parts[2][: len(parts[2]) // 2]
        found = read(data)
        assert pages(found) == [0, 1]
        assert [start for _, start, _, _ in found] == [0] + [end for _, _, end, _ in found][:-1]
        assert found[-1][2] == len(data)
    assert read(b"") == [] and read(b"x")[0][:3] == ("gap", 0, 1)


def test_damage_anywhere_loses_only_the_record_hit():
    parts = archive(4)
    whole = b"".join(parts)
    for at in range(len(parts[0]), len(parts[0] + parts[1]), 7):
        hurt = bytearray(whole)
        hurt[at] ^= 0x55
        assert set(pages(read(bytes(hurt)))) >= {0, 2, 3}


def test_large_records_span_pieces():
    big = warc.record(1, "u", bytes(range(256)) * 20_000, None)
    for data in (big + big, gzip.compress(big) + gzip.compress(big)):
        assert pages(read(data)) == [1, 1]


def test_edge_rows_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a b\r\nX: y", long, 1), (2, None, long, 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", "x", 1), (5, "u", "x", 1), (5, "u", "x", 1), (None, "u", long, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(table.drop("refers_to"), folder, archive_bytes=1)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect()}
    assert got == {
        (1, 1200, "revisit", 2),
        (2, 1200, "response", None),
        (3, 0, "response", None),
        (4, 0, "response", None),
        (None, 1, "response", None),
        (None, 1200, "response", None),
        (5, 1, "response", None),
    }
    empty = warc.write_archives(table.drop("refers_to").limit(0), folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_headers_of_any_length(spark):
    urls = ["http://h/" + "a" * 70_000, "http://h/" + "é" * 400_000, "http://h/short"]
    records = [warc.record(i, url, b"page", None) for i, url in enumerate(urls)]
    for data in (b"".join(records), b"".join(gzip.compress(r) for r in records)):
        assert pages(read(data)) == [0, 1, 2]
    hurt = records[0].replace(b"\r\n\r\n", b"\r\n", 1)
    assert pages(read(hurt + records[1] + records[2])) == [1, 2]
    table = spark.createDataFrame([(i, url, "page") for i, url in enumerate(urls)], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(table, folder)
    found = warc.read_archives(manifest, folder).collect()
    assert [r.kind for r in found] == ["record"] * manifest.agg({"records": "sum"}).first()[0] == ["record"] * 3


def test_a_lost_record_is_no_silent_loss(spark):
    found = spark.createDataFrame([("record",), ("gap",)], "kind string")
    manifest = spark.createDataFrame([("p", 2, 9)], "path string, records long, bytes long")
    with pytest.raises(ValueError, match="2 records were written, 1 could be read"):
        warc.all_records(found, manifest)
    assert warc.all_records(found, manifest.selectExpr("path", "1L AS records", "bytes")).count() == 1


def test_archives_are_read_in_a_task_each(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('page ', id), 400) AS html")
    manifest = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}", archive_bytes=300)
    archives = manifest.count()
    assert archives > 8
    read = warc.read_archives(manifest, f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() == archives
    assert warc.all_records(read, manifest).count() == 40
