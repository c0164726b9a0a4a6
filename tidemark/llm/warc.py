"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Every response gives one `metadata` record (application/warc-fields: what the source's
headers and page say, with its links) and, where its payload is text, one `conversion`
record (text/plain). Both name the response by WARC-Refers-To, keep its target URI, date
and payload digest, and carry its own WARC and HTTP headers on. Record ids are derived
from the source's id, so that a repeated task writes the same records.

A null block counts as empty; a block without an HTTP header is all payload. Bytes that
the charset cannot decode become replacement characters. Records of other types pass by.
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
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm._common import map_rows

RECORD = "record_type string, record_id string, target_uri string, date string, headers map<string,string>, block binary"
#: Namespace of the derived ids.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
TEXT_TYPES = ("text/", "application/xhtml", "application/xml", "application/json")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Bytes of a file that are read, and unzipped, at once.
_PIECE = 1 << 20
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in lower case) and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines) if c}, payload


def decoded(payload: bytes, content_type: str) -> str:
    found = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):  # no such charset, or one that can't replace what it can't read
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """All visible text of a page, a line for each block."""
    page = _BREAK.sub("\n", _SKIP.sub(" ", page).replace("\r", " ").replace("\n", " "))
    lines = (" ".join(x.split()) for x in html.unescape(_TAG.sub("", page)).split("\n"))
    return "\n".join(x for x in lines if x)


def derive(record_id: str, target_uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> Iterator[tuple[str, str, dict[str, str], bytes]]:
    """Type, id, headers and block of the records that a response gives."""
    status, http, payload = split_http(block)
    kind = http.get("content-type", "")
    source = {
        "WARC-Target-URI": target_uri or "",
        "WARC-Date": date or "",
        "WARC-Refers-To": record_id,
        "WARC-Refers-To-Target-URI": target_uri or "",
        "WARC-Refers-To-Date": date or "",
        "WARC-Source-Payload-Digest": headers.get("WARC-Payload-Digest") or digest(payload),
        "WARC-Source-Block-Digest": headers.get("WARC-Block-Digest") or digest(block),
    }
    kept = {f"X-Source-{k}": v for k, v in headers.items() if f"WARC-Source-{k.removeprefix('WARC-')}" not in source}
    is_text = not status or kind.lower().startswith(TEXT_TYPES)
    page = decoded(payload, kind) if is_text else ""
    fields = [("http-status", status), *[(f"http-header-{k}", v) for k, v in http.items()], ("payload-length", str(len(payload)))]
    if title := _TITLE.search(page):
        fields.append(("title", " ".join(html.unescape(title[1]).split())))
    fields += [("outlink", html.unescape(next(g for g in m.groups() if g is not None)).strip()) for m in _LINK.finditer(page)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    made = [("metadata", "application/warc-fields", meta)]
    if is_text:
        made.append(("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")))
    for record_type, content_type, body in made:
        name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record_type} {record_id}')}>"
        own = {"WARC-Type": record_type, "WARC-Record-ID": name, **source, "WARC-Block-Digest": digest(body), "Content-Type": content_type, "Content-Length": str(len(body)), **kept}
        yield record_type, name, own, body


def serialized(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a WARC 1.1 file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v)
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def _unzipped(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one, a piece at a time, up to where it is cut or damaged."""
    data = stream.read(_PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(_PIECE)
        return
    member = zlib.decompressobj(31)
    while data:
        try:
            out = member.decompress(data, _PIECE)
        except zlib.error:
            return
        if out:
            yield out
        if member.eof:
            data = member.unused_data.lstrip(b"\0") or stream.read(_PIECE)
            member = zlib.decompressobj(31)
        else:
            data = member.unconsumed_tail or stream.read(_PIECE)


def records(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a WARC file's records, gzipped or not, one in memory at a time.

    What is cut or damaged at the file's end is left out. A record whose length is
    missing or no number ends where the next one begins.
    """
    pieces = _unzipped(io.BytesIO(source) if isinstance(source, bytes) else source)
    held = bytearray()

    def more() -> bool:
        if (piece := next(pieces, None)) is None:
            return False
        held.extend(piece)
        return True

    def find(what: bytes, at: int = 0) -> int:
        """Where `what` begins, reading on until it is there; -1 if it isn't."""
        while (found := held.find(what, at)) < 0:
            at = max(at, len(held) - len(what) + 1)
            if not more():
                return -1
        return found

    while (begin := find(b"WARC/")) >= 0:
        del held[:begin]
        if (end := find(b"\r\n\r\n")) < 0:
            return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, c, v in (x.partition(":") for x in lines) if c}
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if length.isascii() and length.isdigit():
            stop = end + 4 + int(length)
            while len(held) < stop and more():
                pass
            if len(held) < stop:
                return
        elif (stop := find(b"\r\n\r\nWARC/", end)) < 0:
            stop = max(end + 4, len(held) - 4 if held.endswith(b"\r\n\r\n") else len(held))
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as rows of RECORD; a file is read by one task, a record at a time.

    Files in a store that Arrow knows are opened as streams, whatever their size; others
    come through Spark, which holds the (gzipped) bytes of one and takes files of up to 2 GB.
    """
    import pyarrow.fs as fs

    files = spark.read.format("binaryFile").load(path)
    try:
        streams = fs.FileSystem.from_uri(spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)).toString()) is not None
    except Exception:  # a scheme that Arrow doesn't know, or a store that it can't reach
        streams = False
    column = "path" if streams else "content"
    target = to_arrow_schema(StructType.fromDDL(RECORD))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if streams:
                    store, name = fs.FileSystem.from_uri(value.as_py())
                    source = store.open_input_stream(name, compression=None)
                else:
                    source = value.as_py()
                for headers, block in records(source):
                    row = [headers.get("WARC-Type"), headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), list(headers.items()), block]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

    return files.select(column).mapInArrow(parse, RECORD)


def page_responses(pages: DataFrame, url: str, page: str, date: Column, identity: Column) -> DataFrame:
    """Rows of RECORD for fetched pages; a null page has an empty payload."""
    payload = F.coalesce(F.col(page), F.lit("")).cast("binary")
    hashed = F.sha1(F.concat_ws(" ", F.lit("response"), identity.cast("string"), F.col(url)).cast("binary"))
    part = lambda a, n: F.substring(hashed, a, n)
    name = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    headers = F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("Content-Type"), F.lit("application/http; msgtype=response"))
    return pages.select(identity.alias("key"), F.lit("response").alias("record_type"), name.alias("record_id"), F.col(url).alias("target_uri"), date.alias("date"), headers.alias("headers"), F.concat(head.cast("binary"), payload).alias("block"))


def derivatives(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of RECORD for the metadata and conversion records of all responses.

    `key`, if given, is a column whose value each derived record keeps; other columns are
    not kept. A response without an id is named by the digest of its block, target and date.
    Repeated responses each give their own records, which are equal; a block of any length
    is read whole; an empty table gives none.
    """
    names = ["record_id", "target_uri", "date", "headers", "block"]
    rows = responses.where(F.col("record_type") == "response").withColumn("headers", F.map_entries("headers"))

    def run(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ([key] if key else []) + ["record_type", "record_id", "target_uri", "date", "headers", "block"]}
        for i, (name, target, date, headers, block) in enumerate(zip(*(columns[n] for n in names))):
            block = block or b""
            name = name or f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{digest(block)} {target} {date}')}>"
            headers = {e["key"]: e["value"] or "" for e in headers or []}
            for kind, own, made, body in derive(name, target, date, headers, block):
                for k, v in zip(out, ([columns[key][i]] if key else []) + [kind, own, target, date, list(made.items()), body]):
                    out[k].append(v)
        return out

    schema = (f"`{key}` {responses.schema[key].dataType.simpleString()}, " if key else "") + RECORD
    return map_rows(rows, ([key] if key else []) + names, run, schema, rows=64)


def write_warc(rows: DataFrame, folder: str) -> None:
    """Write rows of RECORD as gzipped WARC files, one for each partition, into a shared folder.

    A file is written under a name of its attempt and renamed when complete, so a
    repeated task leaves no half or double file.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = f"{base}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip.compress(serialized(dict(row["headers"]), row["block"] or b""), mtime=0))
        store.move(part, f"{base}/part-{context.partitionId():05d}.warc.gz")
        yield from ()

    rows.select("headers", "block").mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()
