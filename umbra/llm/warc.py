"""WARC derivative builder: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import whole_ids
from umbra.llm.markup import attributes, raw_ends, walk

VERSION = "WARC/1.1"
#: Source headers that derived records take over unchanged where the response has them.
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type", "WARC-Truncated")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed namespace for URLs of RFC 4122

# Elements of HTML by what becomes of them in plain text.
_HIDDEN = frozenset("script style noscript template title".split())
_IN_HEAD = frozenset("base basefont bgsound link meta".split()) | _HIDDEN
_BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr td th table section article header footer nav aside main blockquote pre form br hr dl dt dd body html".split())
_RAW_END = raw_ends(_HIDDEN)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC writers give it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    """A name-based id: the same record always gets the same one."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_lines(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names and values in order; a line that starts with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of every record in uncompressed WARC bytes.

    A truncated last record keeps what is there; so does a record whose
    Content-Length is no whole number: its block is the rest of the data. One
    without Content-Length has an empty block.
    """
    found, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        headers = _header_lines(data[at:end].split(b"\r\n")[1:])
        said = next((v for k, v in headers if k.lower() == "content-length"), "") or "0"
        at = end + 4
        length = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else len(data) - at
        found.append((headers, data[at : at + length]))
        at += length
    return found


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Visible text (a line per block, blanks folded), title, and links in order without repeats.

    A head ends at its end tag, at <body or at whatever can't stand in it.
    Scripts, styles, comments and titles are no text, and links in them no links.
    """
    parts, title, links, in_head = [], None, {}, False
    for text, tag, closes, about, inner in walk(page, _RAW_END):
        in_head = in_head and (not text or text.isspace())
        if not in_head:
            parts.append(text)
        if tag == "title" and not closes and title is None:
            title = "".join(x for x, *_ in walk(inner, {}))
        if tag == "a" and not closes:
            if href := next((v for k, v in attributes(about) if k == "href"), ""):
                links.setdefault(html.unescape(href).strip())
        if tag == "head" and not closes:
            in_head = True
        elif in_head and tag and tag not in _IN_HEAD:
            in_head = False
        if not in_head:
            parts.append("\n" if tag in _BREAKS else " " if not tag or tag in _HIDDEN else "")
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), " ".join(html.unescape(title or "").split()), [x for x in links if x]


def plain_text(page: str) -> str:
    return read_page(page)[0]


def _body(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, HTTP headers and payload of a response's block."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.split(b"\r\n")
    return lines[0].decode("latin-1"), _header_lines(lines[1:]), payload if mark else b""


def _decoded(payload: bytes, content_type: str) -> tuple[str, str]:
    m = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("ascii", "replace"))
    charset = m[1].lower() if m else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def derive(record: bytes) -> list[dict]:
    """Metadata and conversion records of each response record in ``record``; other types give none."""
    out = []
    for headers, block in parse(record):
        named = {k.lower(): v for k, v in headers}
        if named.get("warc-type", "").lower() != "response":
            continue
        status, http, payload = _body(block)
        http_named = {k.lower(): v for k, v in http}
        page, charset = _decoded(payload, http_named.get("content-type", ""))
        source = named.get("warc-record-id") or record_id("response", digest(block))
        block_digest = named.get("warc-block-digest") or digest(block)
        payload_digest = named.get("warc-payload-digest") or digest(payload)
        carried = [(k, named[k.lower()]) for k in CARRIED if k.lower() in named]
        ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
        text, title, links = read_page(page)
        fields = [
            ("via", named.get("warc-target-uri", "")),
            ("http-status", (status.split(" ", 2) + ["", ""])[1]),
            *((f"http-{k.lower()}", v) for k, v in http),
            ("charset-detected", charset),
            ("title", title),
            ("source-block-digest", block_digest),
            ("source-payload-digest", payload_digest),
            ("conversion", ids["conversion"]),
            *(("outlink", link) for link in links),
        ]
        blocks = {"metadata": "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace"), "conversion": text.encode("utf-8", "replace")}
        kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
        for kind, data in blocks.items():
            mine = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), *carried]
            if kind == "conversion":
                mine.append(("WARC-Concurrent-To", ids["metadata"]))
            mine += [("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", kinds[kind])]
            out.append({"warc_type": kind, "record_id": ids[kind], "refers_to": source, "target_uri": named.get("warc-target-uri"), "warc_date": named.get("warc-date"), "source_block_digest": block_digest, "source_payload_digest": payload_digest, "block_digest": digest(data), "content_length": len(data), "record": serialise(mine, data)})
    return out


_DERIVED = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, source_block_digest string, source_payload_digest string, block_digest string, content_length long"


def _derive(batches: Iterator[pa.RecordBatch], with_record: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DERIVED.split(", ")][1:] + ["record"] * with_record
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            rows = [(i, d) for i, record in zip(part.column(0).to_pylist(), part.column(1), strict=True) for d in derive(record.as_py() or b"")]
            kinds = {"content_length": pa.int64(), "record": pa.binary()}
            columns = [pa.array([i for i, _ in rows], pa.int64()), *(pa.array([d[k] for _, d in rows], kinds.get(k, pa.string())) for k in names)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", *names])


def response_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): each page as the bytes of a WARC response record.

    Null url or html count as empty; blanks in a url are dropped so that they can't
    break the header. Repeated pages and null ids each give a record; pages of any
    length are taken whole; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out = []
                for page_id, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (page or "").encode()
                    uri = "".join((url or "").split())
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, uri)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
                    out.append(serialise(headers, block))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])

    rows = pages.select(whole_ids(pages, id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, record binary")


def build_derivatives(records: DataFrame, with_record: bool = True) -> DataFrame:
    """Two rows for each response in ``records`` (page_id, record): its metadata and its conversion.

    Refers-to ids, target URI, date and the other CARRIED headers come from the
    source unchanged, and so do its digests (computed where it lacks them);
    ``record`` is the derived record's bytes, ready to be written one after
    another. Records of other types and null records give no rows, a response
    without HTTP head or text gives an empty conversion. Repeated records give
    the same ids again. A row is worked on by itself, so memory is bounded by
    the largest record; other columns are not read; an empty table gives no rows.
    """
    return records.select("page_id", "record").mapInArrow(lambda b: _derive(b, with_record), _DERIVED + ", record binary" * with_record)
