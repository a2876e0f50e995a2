"""WARC archives of web pages: writer and sequential reader (operator 4).

Writer: each task writes one archive to a folder that all executors share, a
gzip member for each record. The archive's name holds the task attempt, and
only archives of attempts whose rows reached the manifest are read, so lost or
repeated tasks leave files that nobody reads. Of pages with equal payloads, one
is a ``response``, the others are ``revisit`` records without payload that
refer to it; which one it is, is decided from digests and lengths, so payloads
move only if the list of revisits is too long for a broadcast.

Reader: streams an archive in blocks of 64 KiB through incremental zlib, starts
a new member where one ends, frames each record by its Content-Length and
checks block and payload digests. It holds one record at a time. Damaged
records raise ``DamagedRecord``.

Defined results: null html is the empty payload. Repeated rows (same page_id)
are records of their own; of these, too, one is the response. A null page_id
ranks after all others and reads back as null. An empty table gives no archive
and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrove.llm.common import checkpointed, own_folder, row_number_of_scan, text_of

_CRLF = b"\r\n"
_BLOCK = 1 << 16
#: A fixed date keeps archives reproducible.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    """A record that breaks the format or whose digest differs."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id, rid: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{rid}>"


def record(page_id, rid: int, url: str | None, payload: bytes, refers_to: tuple | None = None) -> bytes:
    """An uncompressed record; refers_to: (page_id, rid) of the response that a revisit repeats."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = sha1_base32(payload)
    if refers_to is None:
        block += payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id, rid)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[3:3] = [("WARC-Refers-To", _name(*refers_to)), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + _CRLF + block + _CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member of a binary stream, one at a time."""
    z, parts, rest = None, [], b""
    while data := rest or stream.read(_BLOCK):
        z, rest = z or zlib.decompressobj(31), b""
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            raise DamagedRecord(f"gzip: {e}") from e
        if z.eof:
            yield b"".join(parts)
            rest, z, parts = z.unused_data, None, []
    if z is not None:
        raise DamagedRecord("the archive ends within a gzip member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the one record in a member; checks the frame and the block's digest."""
    head, found, rest = data.partition(_CRLF * 2)
    lines = head.split(_CRLF)
    if not found or not lines[0].startswith(b"WARC/1."):
        raise DamagedRecord("no WARC header")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise DamagedRecord(f"header line {line[:80]!r}")
        headers[k.strip().lower().decode()] = v.strip().decode()
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise DamagedRecord("Content-Length") from e
    if len(rest) != n + 4 or rest[n:] != _CRLF * 2:
        raise DamagedRecord(f"a block of {n} bytes was announced, {len(rest) - 4} are there")
    block = rest[:n]
    if headers.get("warc-block-digest", "") != f"sha1:{sha1_base32(block)}":
        raise DamagedRecord("block digest")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; a response's payload must have the digest and the length in its headers."""
    http, _, payload = block.partition(_CRLF * 2)
    size = next((int(x.split(b":")[1]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:")), -1)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers.get("warc-type", "")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise DamagedRecord(f"payload of {headers.get('warc-record-id')}")
    number = lambda name: (lambda x: int(x) if x else None)(name.strip("<>").split(":")[2])
    return {
        "page_id": number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def plan(pages: DataFrame, page_id: str = "page_id", html: str = "html", revisit_from: int = 0) -> DataFrame:
    """(rid, ref_page, ref_rid) of the rows that become revisits: payloads of ``revisit_from`` bytes or more that an earlier page has."""
    body = text_of(html)
    thin = pages.select(row_number_of_scan().alias("rid"), F.col(page_id).alias("page"), F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest"))
    thin = checkpointed(thin.where(F.col("n") >= revisit_from))
    first = F.min(F.struct(F.col("page").isNull().alias("no_id"), "page", "rid")).alias("first")
    groups = thin.groupBy("digest", "n").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = checkpointed(groups)  # so that the join below may split the rows of a hot payload
    return thin.join(groups, ["digest", "n"]).where(F.col("rid") != F.col("first.rid")).select("rid", F.col("first.page").alias("ref_page"), F.col("first.rid").alias("ref_rid"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, level: int = 6) -> DataFrame:
    """Writes the archives below ``folder`` (a URI that all executors reach); returns the manifest (path, records, bytes)."""
    root = _as_uri(folder)

    def run(batches):
        task = TaskContext.get()
        path, out, records, size = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0, 0
        for b in batches:
            cols = [b.column(k) for k in range(6)]
            for k in range(b.num_rows):
                rid, page, address, text, ref, ref_rid = (c[k].as_py() for c in cols)
                if out is None:
                    fs, place = _open(root)
                    fs.create_dir(place, recursive=True)
                    out = fs.open_output_stream(f"{place}/{path.rpartition('/')[2]}", compression=None)  # members are compressed already
                data = member(record(page, rid, address, (text or "").encode("utf-8", "surrogatepass"), None if ref_rid is None else (ref, ref_rid)), level)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])

    rows = pages.select(row_number_of_scan().alias("rid"), F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    rows = rows.join(plan(pages, page_id, html, revisit_from), "rid", "left").select("rid", "page", "url", "html", F.col("ref_page").cast("long"), "ref_rid")
    return checkpointed(rows.mapInArrow(run, "path string, records long, bytes long"))


_PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives (column path), with its payload if asked for (responses only)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = _open(path)
                held, size = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for data in members(stream):
                        row = page_of(*parse(data))
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size >= 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path").mapInArrow(run, _PAGE + ", payload binary" * payloads)


def new_folder(spark: SparkSession) -> str:
    return own_folder(spark, "warc")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages and reads the archives back."""
    manifest = write(pages, new_folder(pages.sparkSession), **options)
    n = max(1, manifest.count())  # an archive per task: its reader is sequential
    return read(manifest.select("path").repartition(n, "path"))
