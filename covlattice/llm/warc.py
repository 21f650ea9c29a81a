"""WARC derivatives: responses to linked metadata and plain-text conversion records.

Every response gives two records.  Both name it in ``WARC-Refers-To`` and carry
its target URI, its date, its HTTP header block and its payload digest; each has
an identifier of its own, made from the response's, so that a repeated run or a
retried task makes the same records.  The metadata record names the conversion
in ``WARC-Concurrent-To``.

Records are rows; :func:`write_warc` and :func:`read_warc` turn rows into
``.warc.gz`` files (a gzip member for each record) and back.

Defined results: a null payload is an empty one and gives an empty conversion; a
null URI is the empty URI; equal responses give equal records, as many as there
are responses; an empty table gives no records; other columns are not kept.  A
page of any length and content is read in time in proportion to its length.  A
tag ends at the first ``>`` outside of its quoted values; where none comes before
a ``<`` outside of them, at the first ``>`` before any ``<``; else it is text.

A payload is decoded as its header block says: chunks are put together, gzip and
deflate unpacked, and the charset is that of the headers, else of a ``meta`` tag
near the start, else UTF-8.  What can't be decoded is kept as far as it goes; the
payload digest is that of the bytes as they came.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date of responses made from a table without one.
UNDATED = "1970-01-01T00:00:00Z"
#: Bytes of records in a file, about.
FILE_BYTES = 256 << 20

RECORD = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "source_headers string, payload_digest string, block_digest string, content_type string, content_length long, "
    "block binary"
)
_SCHEMA = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in RECORD.split(", "))]
)

#: Comments, the start of tags, and other marks.
_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*+)|[!?/][^<>]*+>)")
#: The rest of a tag up to its ``>``, quoted values stepped over; and the same without regard to quotes.
_QUOTED = re.compile(r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_PLAIN = re.compile(r"[^<>]*+")
#: Elements whose content is not text.
_HIDDEN = frozenset("script style noscript template title".split())
_CLOSING = {name: re.compile(rf"</{name}(?![^\s/<>])[^<>]*+>", re.I) for name in _HIDDEN}
#: Tags that end a line of text.
_BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p "
    "pre section table tr ul".split()
)
#: An attribute; every try takes its name, so that a tag is gone through once.
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']\S*+)))?")


#: Zeros before a number, and numbers of no character; the library's decoder would raise on very long ones.
_PADDED = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")


def _decoded(text: str) -> str:
    """``text`` with its entities decoded."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _PADDED.sub(r"\1", text))
    return html.unescape(text)


def _line(text: str) -> str:
    """Decoded text on one line."""
    return " ".join(_decoded(text).split())


def _attribute(tag: str, name: str) -> str | None:
    """Value of the first attribute of that name."""
    for found in _ATTRIBUTE.finditer(tag):
        if found[1].lower() == name and found.lastindex > 1:
            return found[found.lastindex]
    return None


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Text, title, language and links of an HTML page, in one pass from its start to its end.

    The text has one line for each block, white space collapsed and entities
    decoded.  Comments, scripts, styles, templates and the title go; one that is
    not closed ends with the page.  Links and language are those of tags outside
    of them.  The time is in proportion to the page, whatever it holds.
    """
    pieces, at, title, language, links = [], 0, None, None, []
    plain = 0  # up to here a tag's search was in vain: tags that start before are read without regard to quotes
    while mark := _MARK.search(page, at):
        pieces.append(page[at : mark.start()])
        at = mark.end()
        if mark[1]:
            end = page.find("-->", mark.start() + 2)
            at = len(page) if end < 0 else end + 3
            continue
        if not mark[3]:
            continue
        inside = _QUOTED.match(page, at) if mark.start() >= plain else None
        if inside and page[inside.end() : inside.end() + 1] != ">":
            plain, inside = inside.end(), None
        if not inside:
            inside = _PLAIN.match(page, at)
            if page[inside.end() : inside.end() + 1] != ">":
                pieces.append(mark[0])
                continue
        at = inside.end() + 1
        name = mark[3].lower()
        if name in _BREAKS:
            pieces.append("\n")
        if mark[2]:
            continue
        if name in _HIDDEN:
            end = _CLOSING[name].search(page, at)
            if end and title is None and name == "title":
                title = _line(page[at : end.start()])
            at = end.end() if end else len(page)
        elif name == "a" and (link := _attribute(inside[0], "href")) is not None:
            links.append(_line(link))
        elif name == "html" and language is None and (lang := _attribute(inside[0], "lang")):
            language = _line(lang)
    pieces.append(page[at:])
    lines = (" ".join(line.split()) for line in _decoded("".join(pieces)).split("\n"))
    return "\n".join(line for line in lines if line), title, language, links


def warc_fields(title: str | None, language: str | None, links: list[str]) -> str:
    """The metadata as warc-fields lines."""
    fields = [("title", title), ("language", language), *(("outlink", x) for x in links)]
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)


#: Labels of charsets that stand for a wider one on the web (fixed values).
_WIDER = {"ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "gb2312": "gb18030", "gbk": "gb18030"}
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?+([^\s\"';>/]++)", re.I)
#: Bytes in which a ``meta`` tag may name the charset.
META_BYTES = 1024


def _unchunked(payload: bytes) -> bytes:
    """The chunks of a chunked payload put together, up to the first that is none."""
    parts, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or not int(size, 16):
            break
        parts.append(payload[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(parts) if parts or at else payload


def _unpacked(payload: bytes, coding: str) -> bytes:
    """What gzip or deflate data hold, as far as they go; other data as they are."""
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        unpack, out = zlib.decompressobj(bits), []
        try:
            for k in range(0, len(payload), 1 << 16):
                out.append(unpack.decompress(payload[k : k + (1 << 16)]))
            out.append(unpack.flush())
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return payload


def page_of(headers: str | None, payload: bytes) -> str:
    """The text of a payload, by the content type, content coding and transfer coding of its header block."""
    fields = {}
    for line in (headers or "").split("\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        payload = _unpacked(payload, coding.strip())
    named = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(payload[:META_BYTES].decode("latin-1"))
    label = named[1].lower() if named else "utf-8"
    try:
        return payload.decode(_WIDER.get(label, label), "replace")
    except (LookupError, ValueError):  # no charset of texts
        return payload.decode("utf-8", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def responses_from_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", date: str = UNDATED
) -> DataFrame:
    """page_id and a response record (record_id, target_uri, date, headers, payload) for every page."""
    uri = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    payload = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("")), uri, F.lit(date)).cast("binary"))
    identifier = F.concat(
        F.lit("<urn:uuid:"),
        F.array_join(F.array(*[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), "-"),
        F.lit(">"),
    )
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n"),
    )
    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        identifier.alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("headers"),
        payload.cast("binary").alias("payload"),
    )


def derive(responses: DataFrame, keep: str | None = None) -> DataFrame:
    """Metadata and conversion record (``RECORD``) of every response; ``keep``: a column passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names = ("record_id", "target_uri", "date", "headers", "payload")
            for source, uri, date, headers, payload in zip(*(batch.column(c).to_pylist() for c in names)):
                payload = payload or b""
                page = page_of(headers, payload)
                source_digest = digest(payload)
                ids = {k: record_id(f"{source} {k}") for k in ("metadata", "conversion")}
                text, *found = read_page(page)
                for kind, mime, block in (
                    ("metadata", "application/warc-fields", warc_fields(*found).encode()),
                    ("conversion", "text/plain; charset=utf-8", text.encode()),
                ):
                    linked = ids["conversion"] if kind == "metadata" else None
                    rows.append(
                        (kind, ids[kind], source, linked, uri or "", date, headers, source_digest, digest(block), mime, len(block), block)
                    )
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], f.type) for f in _SCHEMA]
            if keep:
                twice = pa.array([k for i in range(len(batch)) for k in (i, i)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(keep).take(twice), *columns], names=[keep, *_SCHEMA.names])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=_SCHEMA.names)

    kept = f"`{keep}` {responses.schema[keep].dataType.simpleString()}, " if keep else ""
    return responses.mapInArrow(run, kept + RECORD)


def response_records(responses: DataFrame) -> DataFrame:
    """The responses themselves as rows of ``RECORD``: header block, empty line, payload."""
    block = F.concat(F.concat("headers", F.lit("\r\n")).cast("binary"), "payload")
    sha1 = lambda c: F.concat(F.lit("sha1:"), base32(F.sha1(c)))
    return responses.select(
        F.lit("response").alias("record_type"),
        "record_id",
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("concurrent_to"),
        "target_uri",
        "date",
        F.lit(None).cast("string").alias("source_headers"),
        sha1(F.col("payload")).alias("payload_digest"),
        sha1(block).alias("block_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )


def base32(digits: "F.Column") -> "F.Column":
    """Base 32 of 40 hexadecimal digits: five of them are four characters."""
    fives = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 40, 5)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Header name of each column, in the order in which they are written.
_HEADERS = [
    ("WARC-Type", "record_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Concurrent-To", "concurrent_to"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "date"),
    ("WARC-Source-Headers", "source_headers"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
]


def to_bytes(record: dict) -> bytes:
    """A WARC record; line breaks inside a value go on as indented lines."""
    lines = ["WARC/1.1"]
    for name, column in _HEADERS:
        if record[column] is not None:
            value = str(record[column]).rstrip("\r\n").replace("\r\n", "\r\n ")
            lines.append(f"{name}: {value}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + record["block"] + b"\r\n\r\n"


def from_stream(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an uncompressed WARC stream."""
    columns = {name.lower(): column for name, column in _HEADERS}
    while line := stream.readline():
        if line.strip() == b"":
            continue
        record = dict.fromkeys(_SCHEMA.names)
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and last:
                record[last] += "\r\n" + line[1:].decode().rstrip("\r\n")
                continue
            name, _, value = line.decode().partition(":")
            last = columns.get(name.strip().lower())
            if last:
                record[last] = value.strip()
        record["content_length"] = int(record["content_length"])
        record["block"] = stream.read(record["content_length"])
        if record["source_headers"]:
            record["source_headers"] += "\r\n"
        yield record


def write_warc(records: DataFrame, uri: str) -> DataFrame:
    """Write rows of ``RECORD`` as ``.warc.gz`` files below ``uri``; gives (file, records) of each.

    A file is written under a name of its own and renamed when whole, so a
    retried task replaces its own file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(folder)
        part, number, count, size, sink = TaskContext.get().partitionId(), 0, 0, 0, None
        done: list[tuple[str, int]] = []

        def close() -> None:
            sink.close()
            name = f"{folder}/part-{part:05d}-{number:03d}.warc.gz"
            fs.move(f"{name}.{attempt}", name)
            done.append((name, count))

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink = fs.open_output_stream(f"{folder}/part-{part:05d}-{number:03d}.warc.gz.{attempt}", compression=None)
                data = gzip.compress(to_bytes(row), 6, mtime=0)
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
                    number, count, size, sink = number + 1, 0, 0, None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"]
        )

    from covlattice.llm.common import cut_lineage

    return cut_lineage(records.select(*_SCHEMA.names).mapInArrow(run, "file string, records long"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORD`` from the ``.warc.gz`` files below ``path``; read through Spark, a file in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in from_stream(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    rows.append(record)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("content").mapInArrow(run, RECORD)


def responses_from_records(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, date, headers, payload) of the response records among rows of ``RECORD``."""
    found = records.where("record_type = 'response'")
    at = F.expr("instr(decode(block, 'ISO-8859-1'), '\\r\\n\\r\\n')")
    return found.select(
        "record_id",
        "target_uri",
        "date",
        F.expr("decode(substring(block, 1, instr(decode(block, 'ISO-8859-1'), '\\r\\n\\r\\n') + 1), 'UTF-8')").alias("headers"),
        F.substring("block", at + 4, F.octet_length("block")).alias("payload"),
    )


def derivative_report(pages: DataFrame) -> DataFrame:
    """page_id and all fields of both derived records of every page, the block as text."""
    made = derive(responses_from_pages(pages), keep="page_id")
    return made.withColumn("block", F.decode("block", "UTF-8"))
