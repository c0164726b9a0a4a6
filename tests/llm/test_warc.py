import base64
import gzip
import hashlib
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, warc

SF = "/root/testdata/sf0.001"
PAGE = b'<html><head><title>A &amp; B</title><style>x</style></head><body><p>One&nbsp;two</p><script>no</script><a href="/x?a=1&amp;b">link</a><br>three</body>'
BLOCK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Y: z\r\n\r\n" + PAGE


def test_derived_records():
    headers = {"WARC-Type": "response", "WARC-Payload-Digest": "sha1:SRC", "WARC-IP-Address": "1.2.3.4"}
    (meta, conversion) = warc.derive("<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", headers, BLOCK)
    assert (meta[0], conversion[0]) == ("metadata", "conversion") and meta[1] != conversion[1]
    for _, name, made, body in (meta, conversion):
        assert made["WARC-Record-ID"] == name and made["WARC-Refers-To"] == "<urn:uuid:1>" and made["WARC-Target-URI"] == "http://a/"
        assert made["WARC-Source-Payload-Digest"] == "sha1:SRC" and made["X-Source-WARC-IP-Address"] == "1.2.3.4"
        assert made["WARC-Block-Digest"] == warc.digest(body) and made["Content-Length"] == str(len(body))
    assert conversion[3].decode() == "One two\nlink\nthree"
    fields = meta[3].decode().split("\r\n")
    assert "title: A & B" in fields and "outlink: /x?a=1&b" in fields and "http-header-x-y: z" in fields
    assert list(warc.derive("<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", headers, BLOCK)) == [meta, conversion]


def test_other_payloads():
    binary = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    assert [r[0] for r in warc.derive("a", None, None, {}, binary)] == ["metadata"]
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>é".encode("latin-1")
    assert [r[3].decode() for r in warc.derive("a", None, None, {}, latin)][1] == "é"
    assert [r[3] for r in warc.derive("a", None, None, {}, b"")][1] == b""


def test_file_round_trip(spark, tmp_path):
    responses = warc.page_responses(spark.read.parquet(f"{SF}/pages.parquet"), "url", "html", F.lit("2020-01-01T00:00:00Z"), F.col("page_id"))
    made = warc.derivatives(responses)
    folder = f"file://{tmp_path}/out"
    warc.write_warc(made.repartition(3), folder)
    assert len(list((tmp_path / "out").glob("part-*.warc.gz"))) == 3 and not list((tmp_path / "out").glob(".*"))
    back = warc.read_warc(spark, folder)
    key = lambda r: (r.record_id, r.record_type, r.target_uri, bytes(r.block), r.headers["WARC-Refers-To"])
    assert sorted(map(key, back.collect())) == sorted(map(key, made.collect()))
    original = {r.record_id for r in responses.collect()}
    assert {r.headers["WARC-Refers-To"] for r in back.collect()} == original


def test_cut_file_keeps_whole_records():
    data = warc.serialized({"WARC-Type": "response", "Content-Length": "3"}, b"abc") + warc.serialized({"WARC-Type": "response", "Content-Length": "3"}, b"def")
    assert [b for _, b in warc.records(data)] == [b"abc", b"def"]
    assert [b for _, b in warc.records(gzip.compress(data))] == [b"abc", b"def"]
    assert [b for _, b in warc.records(data[:-5])] == [b"abc"]


def test_query_against_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_warc(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.source_payload_digest == warc.digest(page.html.encode())
        if r.record_type == "conversion":
            assert r.block_digest == warc.digest(warc.plain_text(page.html).encode())
    assert len({r.record_id for r in rows}) == len(rows) and len({r.refers_to for r in rows}) == len(pages)


def test_edges(spark):
    rows = spark.createDataFrame([("response", None, None, None, None, None), ("request", "x", "y", "z", None, bytearray(b"q"))], warc.RECORD)
    assert sorted(r.record_type for r in warc.derivatives(rows).collect()) == ["conversion", "metadata"]
    assert warc.derivatives(rows.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert warc.derivatives(warc.page_responses(pages, "url", "html", F.lit("d"), F.col("page_id"))).count() == 2


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "no-such", "hex", "utf-16", "zlib_codec"])
def test_any_charset_is_read(charset):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>a..b \u00e9</p>".encode()
    assert [r[0] for r in warc.derive("a", None, None, {}, block)] == ["metadata", "conversion"]


def test_cut_gzip_and_bad_lengths():
    one, two = (warc.serialized({"WARC-Type": "response", "Content-Length": "3"}, b) for b in (b"abc", b"def"))
    zipped = gzip.compress(one) + gzip.compress(two)
    assert [b for _, b in warc.records(zipped)] == [b"abc", b"def"]
    for n in range(1, len(gzip.compress(two)) + 1):
        assert [b for _, b in warc.records(zipped[: len(zipped) - n])][:1] == [b"abc"]
    assert [b for _, b in warc.records(gzip.compress(one) + b"\x1f\x8bdamaged")] == [b"abc"]
    for length in ("x", "-3", "", "3.5", "\u0663"):
        bad = warc.serialized({"WARC-Type": "response", "Content-Length": length or "none"}, b"abc")
        assert [b for _, b in warc.records(bad + two)] == [b"abc", b"def"]
        assert [b for _, b in warc.records(bad)] == [b"abc"]
    assert list(warc.records(b"")) == list(warc.records(b"WARC/1.1\r\nx")) == []


def test_members_are_streamed(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 7)
    made = [({"WARC-Type": "response", "Content-Length": str(n)}, bytes(range(n % 256)) * (n // max(1, n % 256)) + b"x" * (n - (n % 256) * (n // max(1, n % 256)))) for n in (0, 1, 255, 1000, 5000)]
    plain = b"".join(warc.serialized(h, b) for h, b in made)
    zipped = b"".join(gzip.compress(warc.serialized(h, b)) for h, b in made)
    assert [b for _, b in warc.records(plain)] == [b for _, b in warc.records(zipped)] == [b for _, b in made]


class _Plain(HTMLParser):
    """Visible text by the standard library's parser, a line for each block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [""], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if tag in ("p", "div", "li", "ul", "nav", "h1", "br", "article", "footer", "body"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.handle_starttag(tag if tag not in ("script", "style", "head") else "", [])

    def handle_data(self, data):
        if not self.skip:
            self.out[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(o.split()) for o in self.out) if x)


def test_query_against_an_independent_version(spark):
    """Ids, links, digests, lengths and blocks worked out anew, from the pages alone."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {(r.page_id, r.record_type): r for r in queries.op8_warc(spark, SF).collect()}
    assert set(rows) == {(p, k) for p in pages for k in ("metadata", "conversion")}
    for (page_id, kind), r in rows.items():
        page = pages[page_id]
        payload = page.html.encode()
        sha1 = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.source_payload_digest == sha1 and r.target_uri == page.url
        if kind == "conversion":
            block = _Plain(page.html).text().encode()
            assert (r.content_length, r.block_crc32) == (len(block), zlib.crc32(block))
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    for page_id in pages:
        a, b = rows[page_id, "metadata"], rows[page_id, "conversion"]
        assert a.refers_to == b.refers_to and len({a.record_id, b.record_id, a.refers_to}) == 3


def test_long_repeated_and_clashing(spark):
    block = bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"<p>long text</p>" * 100_000)
    rows = spark.createDataFrame([("response", "<a>", "u", "d", {"k": "v"}, block, 7, "x")] * 2, warc.RECORD + ", key int, content string")
    made = warc.derivatives(rows, "key").collect()
    assert len(made) == 4 and len({r.record_id for r in made}) == 2 and {r.key for r in made} == {7}
    assert {len(r.block) for r in made if r.record_type == "conversion"} == {10 * 100_000 - 1}
