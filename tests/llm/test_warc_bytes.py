import encodings.aliases
import gzip

import pytest

from tallymap.llm import warc

HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\n\r\n"
BODY = b"<title>\\ud800 x</title><p>+2AA-abc \xed\xa0\x80 \xff\xfe&#xD800;&#55296; \\N{x}"


def record(block, name="Content-Length"):
    lines = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a/", f"{name}: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("charset", sorted(set(encodings.aliases.aliases.values())) + ["unicode_escape", "utf-7", "idna", "undefined", "x\0", ""])
def test_no_charset_ends_a_job(charset):
    headers = warc.Fields([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")])
    for body in (BODY, b"", bytes(range(256))):
        made = warc.derivatives(headers, HEAD % charset.encode() + body)
        assert [h["WARC-Type"] for h, _ in made] == ["metadata", "conversion"]
        for h, content in made:
            content.decode("utf-8")
            assert h["WARC-Block-Digest"] == warc.digest(content)


def test_charsets_that_browsers_do_not_read_are_utf8():
    assert warc._markup("é".encode(), "text/html; charset=utf-7") == ("é", "utf-8")
    assert warc._markup("é".encode("cp1251", "replace"), "charset=windows-1251")[1] == "cp1251"
    assert warc._markup(b"\xe9", "charset=latin1") == ("é", "cp1252")


def test_header_names_in_any_case(spark):
    files = spark.createDataFrame([(bytearray(record(b"abc", "content-length") + record(b"de", "CONTENT-LENGTH")),)], "content binary")
    assert [bytes(r.block) for r in warc.parse_records(files).collect()] == [b"abc", b"de"]
    for bad in (record(b"abc", "X-Length"), record(b"abc").replace(b"Length: 3", b"Length: \xb2"), record(b"abc").replace(b": 3", b": 99")):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))


def test_packed_files(spark, tmp_path):
    blocks = [HEAD % b"utf-8" + b"<p>page %d " % i + b"x" * (i * 997) for i in range(40)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in blocks))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(map(record, blocks))))
    (tmp_path / "three.warc").write_bytes(b"".join(map(record, blocks)))
    (tmp_path / "none.warc.gz").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = warc.parse_records(files)
    assert sorted(bytes(r.block) for r in found.select("block").collect()) == sorted(blocks * 3)
    assert warc.derive(found).where("record_type = 'conversion'").count() == 120
    whole = gzip.compress(record(blocks[1]))
    with pytest.raises(ValueError, match="cut"):
        list(warc.read_records(whole[:-12]))


def test_large_files_are_handed_on_in_parts(spark, monkeypatch):
    data = b"".join(record(b"%d" % i * 50) for i in range(3000))
    files = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(),)], "content binary")
    assert warc.parse_records(files).count() == 3000


def test_odd_pages(spark):
    pages = [(1, "http://a/", "<p>" + "very long " * 200_000), (1, "http://a/", ""), (None, None, None), (2, "http://b/", "<p>x"), (2, "http://b/", "<p>x")]
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, block string, headers string")
    rows = warc.derivative_report(frame).collect()
    assert len(rows) == 2 * len(pages)
    assert max(r.content_length for r in rows) > 1_900_000
    assert sorted(r.content for r in rows if r.record_type == "conversion" and r.target_uri == "http://b/") == ["x", "x"]
    assert warc.derivative_report(frame.limit(0)).count() == 0
