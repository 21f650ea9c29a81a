import gzip
import hashlib
import os
import random
import time
import zlib
from html.parser import HTMLParser

import pytest

from covlattice.llm import warc

DATA = "/root/testdata/sf0.001"

PAGES = [
    (1, "http://a.com/", "<html lang='de'><head><title>A &amp; B</title><style>p{}</style></head><body><p>one<b>two</b></p><br>three &lt;x&gt;<a href=\"/l?a=1&amp;b=2\">link</a></body></html>"),
    (2, None, None),
    (3, "", ""),
    (4, "http://b.com", "no tags at all\n\n  but   lines"),
    (5, "http://c.com", "<script>var t='</p>';</script>kept<!-- <p>gone --><!-- never closed"),
    (6, "http://d.com", "&#233;&eacute;&#x4e2d;&nbsp;x <SCRIPT>a</SCRIPT > y" + "<p>z" * 5000),
    (6, "http://d.com", "&#233;&eacute;&#x4e2d;&nbsp;x <SCRIPT>a</SCRIPT > y" + "<p>z" * 5000),
    (None, "http://e.com", "中文 😀\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def text(page):
    return warc.read_page(page)[0]


def fields(page):
    return warc.warc_fields(*warc.read_page(page)[1:])


def test_plain_text():
    assert text(PAGES[0][2]) == "onetwo\nthree <x>link"
    assert text(PAGES[3][2]) == "no tags at all\nbut lines"
    assert text(PAGES[4][2]) == "kept"
    assert text(PAGES[5][2]).split("\n")[:2] == ["éé中 x y", "z"]
    assert fields(PAGES[0][2]) == "title: A & B\r\nlanguage: de\r\noutlink: /l?a=1&b=2\r\n"
    assert fields("<html lang=en><title>t</title><!-- <a href=x> --><a href='y&#10;z: w'><a name=n href = q/r>") == (
        "title: t\r\nlanguage: en\r\noutlink: y z: w\r\noutlink: q/r\r\n"
    )
    assert fields("<title>never closed <a href=x>") == "" and text("a<title>never closed") == "a"
    assert text("x &#" + "9" * 9000 + "; y") == "x \ufffd y"


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<html ", "<a href=", "<a href='", '<a href="x', "<a b=\"'", "<!--", "<!", "</script ", "<script>", "<title>", "</", "<a\n", "&#", "&amp", "<p", "x=", "= ",
     "<a x=\"'", "<a x='\"", "<a x=\"<a y='", "<a x=\"\" <", "<a x=\"<\" ", "='\"", "&#0", "&#x0000"],
)
def test_hostile_pages_take_time_in_proportion(piece):
    """A megabyte of openings that are never closed; once as tags of their own, once inside one tag."""
    began = time.process_time()
    warc.read_page(piece * (1_000_000 // len(piece)))
    warc.read_page("<a " + piece.replace("<", "") * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - began < 5


class Reader(HTMLParser):
    """Text, title, language and links by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.pieces, self.title, self.language, self.links, self.hidden = [], None, None, [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc._BREAKS:
            self.pieces.append("\n")
        if tag in ("script", "style", "noscript", "template", "title"):
            self.hidden.append(tag)
        got = dict(reversed(attrs))
        if tag == "a" and got.get("href") is not None and not self.hidden:
            self.links.append(" ".join(got["href"].split()))
        if tag == "html" and self.language is None:
            self.language = got.get("lang")

    def handle_endtag(self, tag):
        if tag in warc._BREAKS:
            self.pieces.append("\n")
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def handle_data(self, data):
        if self.hidden[-1:] == ["title"] and self.title is None:
            self.title = " ".join(data.split())
        elif not self.hidden:
            self.pieces.append(data)

    @property
    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.pieces).split("\n"))
        return "\n".join(x for x in lines if x)


def test_quotes_and_padded_entities():
    assert warc.read_page('<a href="x>y">t</a>') == ("t", None, None, ["x>y"])
    assert warc.read_page('<a title="a > b" href="/z">u</a>') == ("u", None, None, ["/z"])
    assert warc.read_page("<p title='<b>'>v</p><a href = '>'>w</a title='>'>x") == ("v\nwx", None, None, [">"])
    assert text("&#00000065;&#x00000041;&#0000000000000000000065 &#x0;&#00;&#99999999;&#x110000;") == "AAA \ufffd\ufffd\ufffd\ufffd"
    assert text("&#" + "0" * 9000 + "65;") == "A"
    # a value that no quote ends, and a tag that nothing ends
    assert warc.read_page('<a href="x>y</a> <a title="p > q" href=/z>t')[0].endswith("t")
    assert warc.read_page("<a href='x>y</a> z") == ("y z", None, None, ["'x"]) or text("<a href='x>y</a> z") == "y z"
    assert text('a <b and <i x="<">c</i>') == "a <b and c"


@pytest.mark.parametrize("seed", range(6))
def test_random_pages_are_read_as_the_standard_parser_reads_them(seed):
    """Well-formed tags with every kind of value, and entities of every kind."""
    r = random.Random(seed)
    values = ["x>y", "a > b", "/z?a=1&amp;b=2", "<b>", "'", '"', "", "&#0065;", "ä", "=", "a b", "&gt;"]
    texts = ["word ", "&#00000065;", "&#x00041;", "&lt;b&gt;", "&#128512;", " = ", "'", '"', "\n", "&amp;#65;", "&#xD800;", "&#0;", "é", "1 > 0 "]

    def attribute():
        name, v = r.choice(["href", "title", "class", "lang", "x"]), r.choice(values)
        if '"' not in v and r.random() < 0.6:
            return f'{name}{r.choice(["=", " = "])}"{v}"'
        return f"{name}='{v}'" if "'" not in v else f"{name}=plain"

    page = "".join(
        r.choice(texts) if r.random() < 0.5 else f"<{r.choice(['a', 'p', 'b', 'br', 'div', 'html'])} {' '.join(attribute() for _ in range(r.randrange(4)))}>"
        for _ in range(600)
    )
    read = Reader(page)
    got, title, language, links = warc.read_page(page)
    assert (got, title, links) == (read.text, read.title, read.links)


def test_payloads_are_decoded_as_the_headers_say():
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html{}\r\n{}"
    assert warc.page_of(head.format("; charset=ISO-8859-1", ""), "é€".encode("cp1252")) == "é€"
    assert warc.page_of(head.format('; Charset="Shift_JIS"', ""), "日本".encode("shift_jis")) == "日本"
    assert warc.page_of(head.format("", ""), "<meta charset='windows-1251'>я".encode("cp1251")).endswith("я")
    assert warc.page_of(head.format("", ""), "я".encode()) == "я" and warc.page_of(None, "я".encode()) == "я"
    for label in ("no-such", "base64", "undefined"):
        assert warc.page_of(head.format(f"; charset={label}", ""), b"abc\xff") == "abc\ufffd"
    packed = gzip.compress("é text".encode() * 50_000)
    assert warc.page_of(head.format("", "Content-Encoding: gzip\r\n"), packed) == "é text" * 50_000
    assert warc.page_of(head.format("", "Content-Encoding: gzip\r\n"), packed[:-9])[:6] == "é text"
    assert warc.page_of(head.format("", "Content-Encoding: gzip\r\n"), b"plain") == "plain"
    for raw in (zlib.compress(b"deflated"), zlib.compress(b"deflated")[2:-4]):
        assert warc.page_of(head.format("", "Content-Encoding: deflate\r\n"), raw) == "deflated"
    chunked = b"4\r\nWiki\r\n6;x=y\r\npedia \r\n3\r\nin \r\n0\r\n\r\n"
    assert warc.page_of(head.format("", "Transfer-Encoding: chunked\r\n"), chunked) == "Wikipedia in "
    assert warc.page_of(head.format("", "Transfer-Encoding: chunked\r\n"), b"not so") == "not so"
    assert warc.page_of(head.format("", ""), b"") == ""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_gives_what_the_standard_parser_gives(spark):
    from covlattice.llm.queries import op5_warc

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    made = op5_warc(spark, DATA).collect()
    assert len(made) == 2 * len(pages)
    for r in made:
        page = pages[r.page_id]
        read = Reader(page.html or "")
        want = read.text if r.record_type == "conversion" else warc.warc_fields(read.title, read.language, read.links)
        assert r.block == want
        assert r.target_uri == page.url and r.payload_digest == warc.digest((page.html or "").encode())
        assert r.block_digest == warc.digest(want.encode()) and r.content_length == len(want.encode())


def test_records_are_linked(pages):
    responses = warc.responses_from_pages(pages)
    source = {r.record_id: r for r in responses.collect()}
    made = warc.derive(responses, keep="page_id").collect()
    assert len(made) == 2 * len(PAGES)
    by_id = {r.record_id: r for r in made}
    for r in made:
        response = source[r.refers_to]
        assert (r.target_uri, r.date, r.source_headers, r.page_id) == (response.target_uri, response.date, response.headers, response.page_id)
        assert r.payload_digest == warc.digest(bytes(response.payload)) and r.block_digest == warc.digest(bytes(r.block))
        assert r.content_length == len(r.block)
        if r.record_type == "metadata":
            assert by_id[r.concurrent_to].record_type == "conversion" and by_id[r.concurrent_to].refers_to == r.refers_to
    assert len({r.record_id for r in made}) == 2 * (len(PAGES) - 1)  # one page is there twice


def test_files_round_trip(spark, pages, tmp_path):
    responses = warc.responses_from_pages(pages)
    listed = warc.write_warc(warc.response_records(responses).repartition(2), f"file://{tmp_path}/a")
    assert sum(r.records for r in listed.collect()) == len(PAGES)
    back = warc.responses_from_records(warc.read_warc(spark, f"file://{tmp_path}/a"))
    want = responses.drop("page_id")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    made = warc.derive(want)
    warc.write_warc(made, f"file://{tmp_path}/b")
    again = warc.read_warc(spark, f"file://{tmp_path}/b")
    assert made.exceptAll(again).count() == 0 and again.exceptAll(made).count() == 0


def test_native_digest(spark):
    row = spark.createDataFrame([(b"abc",)], "b binary").select(warc.base32(__import__("pyspark").sql.functions.sha1("b")).alias("d")).first()
    assert "sha1:" + row.d == warc.digest(b"abc")
    assert hashlib.sha1(b"abc").hexdigest().startswith("a9993e")


def test_empty_table(spark):
    assert warc.derivative_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
