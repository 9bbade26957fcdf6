"""WARC archives: a writer with revisit records, and a sequential reader.

Archives are files of gzip members, one per record, in a folder that all machines
reach; tasks write and read them through Arrow's file systems. A task's archive has a
name of its own, and the list of archives holds those of tasks that succeeded, so a
task that is lost and run again leaves nothing behind that is read.

The reader holds one block of compressed bytes at a time. It inflates member by
member, frames each record by its Content-Length, and checks block and payload digests
while the bytes go by.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, stored

READ_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 26
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
"""The profile of revisit records. A fixed value of the format."""
VERSION = b"WARC/1.1"


class WarcError(ValueError):
    """An archive that breaks off, is framed wrongly, or fails a digest."""


def sha1(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def http_block(payload: bytes, with_payload: bool) -> bytes:
    """An HTTP response; the block of a revisit ends with its header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (payload if with_payload else b"")


def one_line(value: str) -> str:
    """A header value: control characters would end or break it, so they are percent-encoded, as in URLs."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value).strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = http_block(payload, refers_to is None)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Target-URI": one_line(url or ""),
        "WARC-Date": "1970-01-01T00:00:00Z",  # the table has no date
        "WARC-Payload-Digest": f"sha1:{sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-X-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-X-Refers-To-Page-ID": str(refers_to)}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def _members(source) -> Iterator[Iterator[bytes]]:
    """For each gzip member its inflated bytes, piece by piece; a member is to be used up before the next."""
    rest = b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        inflater = zlib.decompressobj(31)

        def pieces(inflater=inflater) -> Iterator[bytes]:
            nonlocal rest
            full = False  # whether there may be more to come of the bytes given so far
            while not inflater.eof:
                if not rest and not full:
                    rest = source.read(READ_BYTES)
                    if not rest:
                        raise WarcError("the archive ends within a record")
                try:
                    piece = inflater.decompress(rest, READ_BYTES)
                except zlib.error as error:
                    raise WarcError(f"not a gzip member: {error}") from error
                rest, full = inflater.unused_data if inflater.eof else inflater.unconsumed_tail, len(piece) == READ_BYTES
                if piece:
                    yield piece

        yield pieces()


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no header line: {line[:60]!r}")
        last = name.strip().lower().decode("utf-8", "replace")
        found[last] = value.strip().decode("utf-8", "replace")
    return found


def _read_record(pieces: Iterator[bytes]) -> Record:
    held = b""
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a record without the end of its header")
        held += piece
    first, *lines = held[:end].split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise WarcError(f"no record begins here: {first[:60]!r}")
    headers = _headers(lines)
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as error:
        raise WarcError("a record without a length") from error
    parts, have = [held[end + 4 :]], len(held) - end - 4
    for piece in pieces:
        parts.append(piece)
        have += len(piece)
    whole = b"".join(parts)
    if whole[length:] != b"\r\n\r\n":
        raise WarcError(f"a record of {have} bytes where {length} and two line ends belong")
    block = whole[:length]
    _check(headers.get("warc-block-digest"), block, "block")
    if not headers.get("content-type", "").startswith("application/http"):
        return Record(headers, {}, block)
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("an HTTP response without the end of its header")
    http = _headers(head.split(b"\r\n")[1:])
    if headers.get("warc-type") == "response":
        _check(headers.get("warc-payload-digest"), payload, "payload")
        if "content-length" in http and int(http["content-length"]) != len(payload):
            raise WarcError("a payload of another length than its header says")
    return Record(headers, http, payload)


def _check(digest: str | None, data: bytes, what: str) -> None:
    if digest is None:
        return
    kind, _, value = digest.partition(":")
    if kind.lower() == "sha1" and value.lower() != sha1(data):
        raise WarcError(f"the {what} digest does not agree")


def read_records(source) -> Iterator[Record]:
    """The records of an archive, an open file of bytes, in turn."""
    for member in _members(source):
        yield _read_record(member)


def file_system(path: str):
    """Arrow's file system for a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write_pass(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = file_system(folder)
        archive, name, size, records = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        try:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    if archive is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        archive, size, records = system.open_output_stream(f"{inside}/{name}", compression=None), 0, 0
                    member = record(page_id, url, (html or "").encode(), refers_to)
                    archive.write(member)
                    size, records = size + len(member), records + 1
                    if size >= most:
                        archive.close()
                        done.append((f"{folder}/{name}", records, size))
                        archive = None
        finally:
            if archive is not None:
                archive.close()
        if archive is not None:
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))],
            ["path", "records", "bytes"],
        )

    return run


def with_targets(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The pages with ``refers_to``: of equal payloads, the largest page_id for all others.

    Digests are summed first, and only those that several pages share come back to the
    pages. A page without id refers to one with an id, never the other way round.
    """
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")]
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(*columns, html.alias("html"), F.when(F.octet_length(html) >= least, F.sha1(html)).alias("digest"))
    same = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    same = stored(same.where("n > 1").select(F.col("digest").alias("digest_"), "target"), "same-payloads")
    joined = pages.join(same, F.col("digest") == F.col("digest_"), "left")
    own = F.coalesce(F.col("page_id") == F.col("target"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per page (``page_id long, url string, html string``) and list the archives.

    Of payloads of at least ``least`` bytes that are equal, the page with the largest
    id gives a response, the others revisits of it. Null html is an empty payload.
    Rows that repeat the largest id are all responses. Rows without id refer to a page
    with one if there is any, else they are responses. An archive is closed once it
    has ``archive_bytes``. Returns ``path, records, bytes``, stored.
    """
    system, inside = file_system(folder)
    system.create_dir(inside, recursive=True)
    written = with_targets(pages, least).mapInArrow(_write_pass(folder, archive_bytes), "path string, records long, bytes long")
    return stored(written, "archives")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def _read_pass(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, inside = file_system(path)
                rows, held, met = [], 0, 0
                with system.open_input_stream(inside, compression=None) as source:
                    for found in read_records(source):
                        head = found.headers
                        number = lambda key, head=head: int(head[key]) if head.get(key) else None
                        payload = found.payload.decode() if with_payload and found.kind == "response" else None
                        digest = head["warc-payload-digest"].partition(":")[2]
                        rows.append((number("warc-x-page-id"), head["warc-target-uri"], found.kind, int(found.http_headers["content-length"]),
                                     digest, number("warc-x-refers-to-page-id"), payload))
                        met, held = met + 1, held + 200 + len(payload or "")
                        if held > 1 << 22:
                            yield out(rows)
                            rows, held = [], 0
                yield out(rows)
                if met != records:
                    raise WarcError(f"{path} has {met} records where {records} were written")

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives listed (``path``, ``records``), read from start to end by one task each.

    Returns ``page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload``; length and digest are those of the full payload, ``payload`` is null
    for revisits and where it is not asked for. Fails on a record that is cut off,
    framed wrongly or has another digest than its bytes.
    """
    spark: SparkSession = archives.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path", "records").repartition(parts, "path").mapInArrow(_read_pass(with_payload), READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives and read these back, without the payloads.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are ignored. A record per
    row, repeated ones too. Null html is an empty payload. A page without id is written
    and may revisit another, but none revisits it while one of the same payload has an
    id. An empty table gives no rows.
    """
    archives = write_archives(pages, folder or new_folder(pages.sparkSession, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What reading back gives, by plain grouping.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), t AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS target
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to
FROM t
"""
