import base64
import gzip
import hashlib
import random

import pytest

from redactlake.llm import warc as W

ROWS = [(1, "http://a/x", "<p>one</p>"), (2, "http://b/y z", "same"), (9, None, "same"), (4, "http://c/\n", "same"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\nünï\r\n\r\n")]


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, 3) for r in ROWS], "page_id long, url string, html string, payload int")


def archived(pages, folder, **kw):
    records = W.mark_revisits(W.convert(W.to_arc(pages, "page_id", "url", "html")), **kw)
    W.write_warc(records, folder)
    return {r.record_key: r for r in W.read_warc(pages.sparkSession, folder).collect()}


def test_pages_come_back(pages, folder):
    got = archived(pages, folder)
    assert len(got) == len(ROWS)
    for key, _, html in ROWS:
        body = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(body), sha1(body))
        assert got[key].payload == (body if got[key].record_type == "response" else None)
    kinds = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    assert kinds == {1: ("response", None), 2: ("revisit", 9), 4: ("revisit", 9), 9: ("response", None), 5: ("revisit", 6), 6: ("response", None), 7: ("response", None)}
    assert got[2].refers_to_id == got[9].record_id and got[9].url is None and got[2].url == "http://b/y%20z"


def test_small_payloads_are_no_revisits(pages, folder):
    assert {r.record_type for k, r in archived(pages, folder, least_bytes=1).items() if k in (5, 6)} == {"response"}


def test_repeated_rows_null_keys_and_empty_tables(spark, folder):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "v", "y")], "page_id long, url string, html string")
    records = W.mark_revisits(W.convert(W.to_arc(df, "page_id", "url", "html")))
    W.write_warc(records, folder)
    rows = W.read_warc(spark, folder).collect()
    assert sorted((r.record_key is None, r.record_type, r.refers_to) for r in rows if r.payload_digest == sha1(b"x")) == [
        (False, "response", None), (False, "revisit", 1), (True, "revisit", 1)]
    assert [r.record_type for r in rows if r.payload_digest == sha1(b"y")] == ["response"]
    W.write_warc(W.mark_revisits(W.convert(W.to_arc(df.filter("false"), "page_id", "url", "html"))), folder + "-2")
    assert W.read_warc(spark, folder + "-2").collect() == []


def test_rows_that_arrive_in_another_order_when_computed_again(spark, folder):
    rows = [(i, "u", f"text {i % 5}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)

    def arrive(batches):
        for batch in batches:
            places = list(range(batch.num_rows))
            random.SystemRandom().shuffle(places)
            yield batch.take(places)

    got = archived(pages.mapInArrow(arrive, pages.schema), folder)
    assert sorted(got) == list(range(60))
    for key, _, html in rows:
        best = 55 + key % 5
        kind = ("response", None, None) if key == best else ("revisit", best, got[best].record_id)
        assert (got[key].record_type, got[key].refers_to, got[key].refers_to_id) == kind
        assert got[key].payload == (html.encode() if key == best else None)


def test_keys_of_64_bits(spark, folder):
    keys = [(1 << 63) - 1, -(1 << 63), 10**18, -(10**18), 0]
    got = archived(spark.createDataFrame([(k, "u", "x") for k in keys], "page_id long, url string, html string"), folder)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        k: ("revisit", keys[0]) if k != keys[0] else ("response", None) for k in keys}
    for text, key in [(b"9223372036854775808", None), (b"x1", None), (b"", None), (b"-9", -9)]:
        assert W.archive_key(b"HTTP/1.1 200 OK\r\nX-Archive-Key: " + text + b"\r\n\r\n") == key


def test_both_versions_and_plain_files(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\nhello"
    one = W.version_block(1) + b"\nhttp://a/b c 1.2.3.4 20010203040506 text/html %d\n%s\n" % (len(body), body)
    two = W.version_block(2) + b"\ndns:a 1.2.3.4 200102030405 text/dns 200 - - 0 f.arc 5\nA 1.2\n"
    (tmp_path / "1.arc").write_bytes(one)
    (tmp_path / "2.arc.gz").write_bytes(gzip.compress(two))
    rows = sorted(W.convert(W.read_arc(spark, str(tmp_path))).collect(), key=lambda r: r.arc_version)
    assert [(r.arc_version, r.url, r.warc_date, bytes(r.payload)) for r in rows] == [
        (1, "http://a/b c", "2001-02-03T04:05:06Z", b"hello"),
        (2, "dns:a", "2001-02-03T04:05:00Z", b"A 1.2"),
    ]


@pytest.mark.parametrize("bad", [b"x", W.version_block(1) + b"\nu i d m 99\nshort", b"u i d m 1\nx\n", W.version_block(2) + b"\nu i 1\nx\n"])
def test_broken_archives_are_errors(bad):
    with pytest.raises(ValueError, match="ARC"):
        list(W.parse_arc(bad))


def test_files_stay_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 1000)
    chunks = list(W._chunks([b"x" * 300] * 100, b"\r\n\r\n", b"head"))
    assert max(map(len, chunks)) < 1400
    assert [c.startswith(b"head") for c in chunks] == [n % W.CHUNKS_PER_FILE == 0 for n in range(len(chunks))]
