import gzip

from tallymap.llm import warc


def _made(spark, block, extra=()):
    headers = warc.Fields([
        ("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-IP-Address", "10.0.0.1"), ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"),
        ("WARC-Block-Digest", "sha1:SOURCE"), *extra,
    ])
    files = spark.createDataFrame([(bytearray(warc.write_record(headers, block)),)], "content binary")
    rows = warc.derive(warc.parse_records(files)).collect()
    return {r.record_type: bytes(r.block).decode() for r in rows}


def test_source_headers_are_kept(spark):
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9"
    made = _made(spark, block, [("X-Own", "mine")])
    assert made["conversion"] == "café"
    lines = made["metadata"].split("\r\n")
    for line in ("source-WARC-IP-Address: 10.0.0.1", "source-WARC-Concurrent-To: <urn:uuid:2>", "source-WARC-Concurrent-To: <urn:uuid:3>",
                 "source-WARC-Block-Digest: sha1:SOURCE", "source-X-Own: mine", "http-set-cookie: a=1", "http-set-cookie: b=2"):
        assert line in lines


def test_bodies_are_decoded(spark):
    packed = gzip.compress("<p>größer".encode("utf-16-le"))
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=utf-16le\r\n\r\n"
    assert _made(spark, head + chunks)["conversion"] == "größer"
    made = _made(spark, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x8b\x03\x80abc")
    assert made["conversion"] == "" and "decoding-error: unknown coding br" in made["metadata"]
