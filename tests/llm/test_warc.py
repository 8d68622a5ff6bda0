import gzip
import json
from pathlib import Path

from mediaguard.llm import warc

PAGE = ('<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- no <b>this</b> --><p>One <b>two</b><br>three<a href="/x?a=1&amp;b=2">link</a></p><div>ü &lt;tag&gt;</div></body></html>')


def test_visible():
    title, text, links = warc.visible(PAGE)
    assert title == "A & B"
    assert text == "One two\nthreelink\nü <tag>"
    assert links == ["/x?a=1&b=2"]
    assert warc.visible("") == ("", "", [])
    assert warc.visible("a<!-- open")[1] == "a"
    assert warc.visible("a<script>open")[1] == "a"
    assert warc.visible("<" * 20000)[1] == "<" * 20000


def test_links_and_digests(spark):
    rows = [(1, "http://a.example/b/", PAGE), (2, None, None), (1, "http://a.example/b/", PAGE), (3, "http://c", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record")
    source = {r.page_id: bytes(r.record) for r in warc.responses(pages).collect()}
    derived = warc.derive(warc.responses(pages)).collect()
    assert len(derived) == 8
    for r in derived:
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    headers, block = warc.parse(source[1])
    own = {r.warc_type: r for r in derived if r.target_uri == "http://a.example/b/"}
    named = dict(headers)
    assert named["WARC-Block-Digest"] == warc.digest(block)
    assert {r.refers_to for r in own.values()} == {named["WARC-Record-ID"]}
    assert own["metadata"].concurrent_to == own["conversion"].record_id and own["conversion"].concurrent_to == own["metadata"].record_id
    meta = json.loads(own["metadata"].block)
    assert [tuple(h) for h in meta["warc"]] == headers
    assert meta["payload"]["digest"] == named["WARC-Payload-Digest"] == own["conversion"].source_digest
    assert meta["html"]["links"] == [{"url": "/x?a=1&b=2", "resolved": "http://a.example/x?a=1&b=2"}]
    assert [r.target_uri for r in derived].count(None) == 2


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://b/", "<p>x\r\n\r\ny</p>")], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages))
    warc.write(derived, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "out").glob("*.gz"))
    found = []
    while data:
        headers, block = warc.parse(data)
        size = data.index(b"\r\n\r\n") + 4 + len(block) + 4
        assert data[size - 4:size] == b"\r\n\r\n"
        found.append((dict(headers)["WARC-Record-ID"], block.decode()))
        data = data[size:]
    assert sorted(found) == sorted((r.record_id, r.block) for r in derived.collect())


def test_no_derivatives(spark):
    rows = [(b"junk",), (None,), (warc.record([("WARC-Type", "warcinfo")], b"x"),)]
    assert warc.derive(spark.createDataFrame(rows, "record binary")).count() == 0
