import hashlib

from textlake.llm import warc_convert as W

V1 = (b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
      b"\nhttp://x.org/a b 1.2.3.4 19970203040506 text/html 45\nHTTP/1.0 200 OK\r\nContent-Length: 7\r\n\r\n<a>\n</a>\n"
      b"\ndns:x.org 1.2.3.4 19970203 text/dns 5\n1.2.3\n"
      b"garbage line\n"
      b"http://cut.org/ 1.2.3.4 19970203040506 text/plain 99\nshort")
V2_HEAD = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
V2 = (b"filedesc://b.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 b.arc %d\n" % len(V2_HEAD) + V2_HEAD +
      b"\nhttp://y.org/ 1.2.3.4 199702030405 text/html 200 abc - 209 b.arc 3\nhey\n")


def test_version_1_headers_and_lengths():
    recs = list(W.parse_arc(V1))
    assert [r["url"] for r in recs] == ["filedesc://a.arc", "http://x.org/a b", "dns:x.org", "http://cut.org/"]
    assert recs[1]["body"].startswith(b"HTTP/1.0") and len(recs[1]["body"]) == 45
    assert recs[2]["body"] == b"1.2.3" and [r["truncated"] for r in recs] == [False, False, False, True]
    out = [W.convert_record(r, "a.arc") for r in recs]
    assert [r["type"] for r in out] == ["warcinfo", "response", "resource", "resource"]
    assert out[1]["date"] == "1997-02-03T04:05:06Z" and out[2]["date"] == "1997-02-03T00:00:00Z"
    assert out[1]["payload"] == recs[1]["body"].split(b"\r\n\r\n", 1)[1]
    assert out[1]["sha1"] == hashlib.sha1(out[1]["payload"]).hexdigest()
    assert len({r["record_id"] for r in out}) == 4
    assert out == [W.convert_record(r, "a.arc") for r in W.parse_arc(V1)]  # identifiers are stable


def test_version_2_headers():
    recs = list(W.parse_arc(V2))
    assert [r["url"] for r in recs] == ["filedesc://b.arc", "http://y.org/"]
    assert recs[1]["result-code"] == "200" and recs[1]["body"] == b"hey" and recs[1]["archive-date"] == "199702030405"
    assert W.iso_date("199702030405") == "1997-02-03T04:05:00Z" and W.iso_date("nonsense") == "1970-01-01T00:00:00Z"


def brute(pages, least=1000):
    raw = [(k, (h or "").encode()) for k, _, h in pages]
    last = {}
    for k, b in raw:
        if len(b) >= least:
            last[b] = max(last.get(b, k), k)
    return sorted((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, k) != k else "response",
                   last[b] if last.get(b, k) != k else None) for k, b in raw)


def test_round_trip(spark):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n" + "\n"
    pages = [(1, "http://a.org/x y\nz", big), (2, None, big), (3, "http://b/é", "x" * 999), (4, "", "x" * 999), (5, "u", None), (6, "u", ""),
             (7, "u", "\r\n\r\n"), (8, "u", "HTTP/1.1 200 OK\r\n\r\n" + "y" * 1000), (9, "u", "HTTP/1.1 200 OK\r\n\r\n" + "y" * 1000),
             (10, "u", "z" * 300000), (-3, "u", big), (12, "u", "\n" + "q" * 1000 + "\n\n"), (13, "u", "1 0 x\nhttp://n 1 1 1 5\n" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", __import__("pyspark").sql.functions.lit(1))
    for version in (1, 2):
        out = W.archive_pages(df, version=version)
        got = [tuple(r) for r in out.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=lambda r: r[0]) == sorted(brute(pages), key=lambda r: r[0])
        assert out.where("NOT digest_ok").count() == 0


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(1, "u", "a" * 2000)] * 3 + [(None, "u", "a" * 2000)]
    out = W.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 4 and sum(r["record_type"] == "response" for r in out) == 1
    assert all(r["refers_to"] == 1 for r in out if r["record_type"] == "revisit")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.archive_pages(none).count() == 0


def test_spark_written_files_are_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "1.1.1.1", "20000101000000", b"hello")], "key long, url string, ip string, date string, payload binary")
    W.write_arc(df.coalesce(1), str(tmp_path / "arc"))
    recs = W.convert_arc(spark, str(tmp_path / "arc"))
    assert [(r["type"], bytes(r["payload"])[:5]) for r in recs.orderBy("type").collect()] == [("response", b"hello"), ("warcinfo", b"1 0 t")]
