"""The converter on archives as others write them: versions 1 and 2, blanks, dns records, cuts and garbage."""

import io

import pytest

from skillweave.llm import warc
from skillweave.session import scratch_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
PAGE = HTTP + b"<html>" + b"the same page " * 100 + b"</html>"


def record(line: bytes, content: bytes) -> bytes:
    return line + b" %d\n" % len(content) + content + b"\n"


def arc(version: int, *parts: bytes) -> bytes:
    block = b"%d 0 Some Archive\n%s\n" % (version, " ".join(warc.ARC_FIELDS[version]).encode())
    more = b"" if version == 1 else b" 200 - - 0 x.arc"
    return b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain%s %d\n" % (more, len(block)) + block + b"\n" + b"".join(parts)


V1 = arc(1, record(b"http://a/ 1.2.3.4 19990101000000 text/html; charset=utf-8", PAGE),
         record(b"http://b/with blank 1.2.3.4 19980101 text/html", PAGE),
         record(b"dns:a.org 10.0.0.1 19990101000000 text/dns", b"19990101\na.org. 1 IN A 1.2.3.4\n"),
         b"garbage that is no record line\nmore of it\n",
         record(b"http://c/ - 1997 -", HTTP + b"short"),
         record(b"ftp://d/x 1.2.3.4 19990101000000 application/octet-stream", b"PK" * 800),
         record(b"ftp://e/x 1.2.3.4 19990101000000 application/octet-stream", b"PK" * 800))
V2 = arc(2, record(b"http://f/ 1.2.3.4 20000101000000 text/html; charset=x 200 abc - 99 x.arc", PAGE),
         b"http://g/ 2001:db8::1 20000101000000 text/html 200 - - 17 x.arc 900\n" + HTTP + b"cut here")


@pytest.fixture
def archives(spark):
    import gzip
    path = scratch_path(spark, "genuine")
    files = {"part-1.arc": V1, "part-2.arc.gz": gzip.compress(V2), "part-3.arc": b"<html>no archive</html>", "part-4.arc": b"",
             "part-5.arc": arc(1).replace(b"1 0 Some", b"9 0 Some")}
    for name, data in files.items():
        from skillweave.session import hadoop_path
        fs, p = hadoop_path(spark, f"{path}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()
    return path


def test_genuine_archives_are_converted(spark, archives):
    got = {r.target_uri: r for r in warc.read_records(spark, warc.convert(spark, archives, scratch_path(spark, "w"))).collect()
           if r.record_type != "warcinfo"}
    # the earliest of the equal pages is the response, no message names a key
    assert {u: r.record_type for u, r in got.items()} == {
        "http://a/": "revisit", "http://b/with blank": "response", "http://f/": "revisit", "dns:a.org": "resource",
        "http://c/": "response", "ftp://d/x": "resource", "ftp://e/x": "resource", "http://g/": "response"}
    assert got["http://a/"].warc_date == "1999-01-01T00:00:00Z" and got["http://c/"].warc_date == "1997-01-01T00:00:00Z"
    assert got["ftp://d/x"].payload_bytes == 1600 and got["http://a/"].payload_digest == got["http://b/with blank"].payload_digest


def test_what_is_malformed_is_a_reject_with_its_bytes(spark, archives):
    got = sorted((r.file.rsplit("/", 1)[1], r.reason, bytes(r.data)) for r in warc.rejects(spark, archives).collect())
    assert got[0] == ("part-1.arc", "bad record line", b"garbage that is no record line\nmore of it\n")
    assert [(f, x) for f, x, _ in got[1:]] == [("part-3.arc", "no version block"), ("part-5.arc", "unknown ARC version")]


def test_warc_headers_of_each_type(spark, archives):
    import gzip
    records = {}
    for r in warc.archives(spark, warc.convert(spark, archives, scratch_path(spark, "w"))).collect():
        for fields, block in warc.read_warc(gzip.GzipFile(fileobj=io.BytesIO(bytes(r["content"])))):
            records[fields.get("warc-target-uri", fields.get("warc-filename"))] = fields, block
    info, text = records["x.arc"]
    assert info["warc-type"] == "warcinfo" and b"converted-from: ARC version" in text and b"publisher: Some Archive" in text
    assert records["dns:a.org"][0]["content-type"] == "text/dns"
    revisit, head = records["http://a/"]
    response = records["http://b/with blank"][0]
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-date"] == "1998-01-01T00:00:00Z"
    assert head == HTTP and revisit["warc-payload-digest"] == response["warc-payload-digest"]
    assert records["http://g/"][0]["warc-truncated"] == "length"


@pytest.mark.parametrize("line, url, date, mime", [
    (b"http://a/ 1.2.3.4 19990101000000 text/html; charset=utf-8 3", "http://a/", "19990101000000", "text/html; charset=utf-8"),
    (b"http://a b/c 1.2.3.4 1999 - 3", "http://a b/c", "1999", "-"), (b"dns:x :: 19990101 text/dns 3", "dns:x", "19990101", "text/dns")])
def test_record_lines_are_anchored_on_address_and_date(line, url, date, mime):
    (got,) = warc.read_arc(io.BytesIO(arc(1) + line + b"\nabc\n"))
    assert (got["URL"], got["Archive-date"], got["Content-type"], got["content"]) == (url, date, mime, b"abc")
