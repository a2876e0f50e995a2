import gzip
import io
import zlib

import pytest

from relgrove.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, schema=PAGES, **options):
    return warc.round_trip(spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema), **options).collect()


def stored(spark, tmp_path, rows, schema=PAGES):
    """As a table, since row numbers count on one."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages"))
    return spark.read.parquet(str(tmp_path / "pages"))


def test_records(spark, tmp_path):
    rows = [(1, "http://a/ü b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 100_000), (None, "u", "<p>x</p>"), (6, "u", "six"), (6, "u", "six"), (7, "u\r\nX: y", "a\r\n\r\nb")]
    got = warc.round_trip(stored(spark, tmp_path, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert len(got) == len(rows)
    assert (by[1][0]["record_type"], by[1][0]["refers_to"]) == ("response", None)
    assert (by[2][0]["record_type"], by[2][0]["refers_to"]) == ("revisit", 1) and by[None][0]["refers_to"] == 1
    assert by[3][0]["record_type"] == "response" and by[4][0]["refers_to"] == 3 and by[4][0]["payload_bytes"] == 0
    assert by[5][0]["payload_bytes"] == 200_000
    assert sorted((r["record_type"], r["refers_to"]) for r in by[6]) == [("response", None), ("revisit", 6)]
    assert by[7][0]["payload_digest"] == warc.sha1_base32(b"a\r\n\r\nb") and by[1][0]["payload_digest"] == by[2][0]["payload_digest"]


def test_payloads_threshold_and_columns(spark, tmp_path):
    rows = [(k, "u", t, 1, "x") for k, t in enumerate(["same", "same", "much longer and the same", "much longer and the same"])]
    pages = stored(spark, tmp_path, rows, PAGES + ", rid int, ref_page string")
    manifest = warc.write(pages, warc.new_folder(spark), revisit_from=10)
    got = {r["page_id"]: r for r in warc.read(manifest, payloads=True).collect()}
    assert [got[k]["record_type"] for k in range(4)] == ["response", "response", "response", "revisit"]
    assert bytes(got[2]["payload"]).decode() == rows[2][2] and got[3]["payload"] is None
    for r in manifest.collect():
        data = gzip.open(r["path"].removeprefix("file://")).read()  # any reader of gzip can read it
        assert data.count(b"WARC/1.1\r\n") == r["records"]


def test_empty(spark):
    assert round_trip(spark, []) == []


def test_damage():
    one = warc.member(warc.record(1, 0, "u", b"payload"))
    two = warc.member(warc.record(2, 1, "u", b"other", (1, 0)))
    read = lambda data: [warc.page_of(*warc.parse(m)) for m in warc.members(io.BytesIO(data))]
    assert [r["record_type"] for r in read(one + two)] == ["response", "revisit"]
    raw = zlib.decompress(one, 31)
    for bad in (one[:-9], one + two[:20], warc.member(raw.replace(b"payload\r\n", b"paYload\r\n")), warc.member(raw[:-1]), warc.member(raw.replace(b"Content-Length: 8", b"Content-Length: 9")), warc.member(b"HELLO\r\n\r\n"), b"not gzip"):
        with pytest.raises(warc.DamagedRecord):
            read(bad)
