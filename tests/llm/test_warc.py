import pytest

from gridspark.llm import warc

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_round_trip_and_revisits(spark):
    rows = [
        (1, "http://a/x y", "same"), (2, "http://b", "same"), (3, None, TRICKY), (4, "http://ä", "é\n" * 5000), (5, "http://c", None),
        (6, "http://d", ""), (7, "http://e", "same"), (7, "http://e", "same"), (8, "http://f", "\r\n"), (None, "http://g", "same"), (None, "x", "lone"),
    ]
    pages = spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.deduplicated_archives(pages, archive_bytes=4000).collect()
    assert len(got) == len(rows)
    want = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        if r.page_id is not None:
            assert r.payload_bytes == len(want[r.page_id]) and r.payload_digest == warc.base32_sha1(want[r.page_id])
            assert r.record_type != "response" or bytes(r.payload) == want[r.page_id]
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None)
    assert kinds == [
        (1, "revisit", 7), (2, "revisit", 7), (3, "response", None), (4, "response", None), (5, "revisit", 6), (6, "response", None),
        (7, "response", None), (7, "response", None), (8, "response", None),
    ]
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 7)]


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.deduplicated_archives(pages, least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark):
    assert warc.deduplicated_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.parse(warc.build(1, "u", b"abc", None, False) + b"xx"))
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1\r\n\r\n"))


def test_archives_keep_their_size(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " * 40) for k in range(3000)] + [(9000, "http://big", "b" * 20_000_000), (9001, None, "b" * 20_000_000)]
    pages = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "page_id long, url string, html string")
    got = warc.deduplicated_archives(pages, path=f"{tmp_path}/a", archive_bytes=100_000).drop("payload").collect()
    assert len(got) == 3002 and {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {9000: 9001}
    sizes = sorted(f.stat().st_size for f in tmp_path.glob("a/part-*"))
    assert 20_000_000 < sizes[-1] < 20_010_000 and sizes[-2] < 101_000 and len(sizes) > 10


def test_records_of_an_archive():
    data = warc.END.join([warc.opening(b"x"), warc.build(1, "http://a", b"abc", 5, True, "http://b"), b""])
    (info, fields), (revisit, _) = warc.parse(data)
    assert info["WARC-Type"] == "warcinfo" and b"software" in fields
    assert revisit["WARC-Refers-To-Target-URI"] == "http://b" and revisit["WARC-Refers-To-Date"] == warc.DATE
