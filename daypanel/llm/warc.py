"""WARC archives: pages written as gzip members, and a reader that splits files by byte range."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats' magic, version and profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A member of no bytes; its last byte is 0, as is that of any record below 16 MB.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
READ = 1 << 16

RECORDS = (
    "record_type string, record_id string, refers_to string, uri string, page_id long, refers_to_page long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages (page_id, url, payload) with `digest`, `bytes` and `first`, the page that a revisit refers to.

    Of equal payloads of at least `least` bytes the largest page_id is the
    response and has a null `first`, as all smaller payloads have. A null
    page_id is never referred to: it revisits the others, and without others
    each such page is a response. Rows that repeat the largest page_id are all
    responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {
            "digest": F.sha1("payload"),
            "bytes": F.octet_length("payload").cast("long"),
            # Smaller payloads stand alone; their keys spread them.
            "equal": F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).otherwise(
                F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.sha1("url"), F.lit("")))
            ),
        }
    )
    # Map-side maximum of short rows: a group of any size moves as one row per task.
    largest = known.filter(F.col("bytes") >= least).groupBy("equal").agg(
        F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")
    )
    shared = largest.filter("n > 1").select("equal", "largest")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return known.join(shared, "equal", "left").select("page_id", "url", "payload", "digest", "bytes", first.alias("first"))


def _record_id(page: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}").urn


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One gzip member whose last byte is 0."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = packer.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()
    return data if data[-1] == 0 else data + EMPTY_MEMBER


def _records(date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = []
            for row in batch.to_pylist():
                page, digest, size, first = row["page_id"], row["digest"], row["bytes"], row["first"]
                # Any URL is kept exactly: what can't stand in a header line is percent-encoded.
                uri = None if row["url"] is None else quote(row["url"], safe="%/:?#[]@!$&'()*+,;=-._~")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                head = [
                    ("WARC-Type", "response" if first is None else "revisit"),
                    ("WARC-Record-ID", f"<{_record_id(page, digest)}>"),
                    ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("Content-Type", "application/http;msgtype=response"),
                ]
                head += [] if uri is None else [("WARC-Target-URI", uri)]
                head += [] if page is None else [("Page-ID", str(page))]
                if first is not None:
                    head += [("WARC-Refers-To", f"<{_record_id(first, digest)}>"), ("Refers-To-Page-ID", str(first))]
                    head += [("WARC-Profile", PROFILE)]
                block = http.encode() + (row["payload"] if first is None else b"")
                # The writer below puts the last byte back, as what ends a row.
                members.append(_member(head, block, level)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    return write


def write_archives(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 6, least: int = 1000
) -> str:
    """Write a WARC record per page under `path`, gzipped record by record, and return `path`.

    Each task writes one archive with Spark's own file writer, so a lost task
    leaves nothing behind. That writer ends every row with a fixed byte; as the
    last byte of a gzip member below 16 MB is 0, and a longer one gets an empty
    member behind it, the zero byte is that end and the files are plain gzip.
    Null html is an empty payload; a null url has no target; an empty table
    writes archives without records; other columns are ignored.
    """
    rows = with_revisits(pages, least).mapInArrow(_records(date, level), "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option(
        "lineSep", "\u0000"
    ).text(path)
    return path


def _opened(path: str):
    """A file for random access, in any store that pyarrow knows by the path's scheme."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(unquote(inner))


def _member_at(file, at: int, size: int, whole: bool = True) -> tuple[bytes, int] | None:
    """The bytes of the gzip member at `at` and where it ends; None if there is none.

    Without `whole`, only as much is decoded as tells whether a WARC record (or
    an empty member) begins there.
    """
    reader, out, pos = zlib.decompressobj(31), [], at
    try:
        while not reader.eof:
            data = file.read_at(min(READ, size - pos), pos) if pos < size else b""
            if not data:
                return None
            pos += len(data)
            out.append(reader.decompress(data))
            if not whole and sum(map(len, out)) >= len(VERSION):
                return b"".join(out), -1
    except zlib.error:
        return None
    return b"".join(out), pos - len(reader.unused_data)


def _begins(file, at: int, size: int) -> bool:
    """Whether a record starts at `at`: its header decodes, and behind it another member or the end stands."""
    head = _member_at(file, at, size, whole=False)
    if head is None or head[0] and not head[0].startswith(VERSION):
        return False
    if (full := _member_at(file, at, size)) is None:
        return False
    return full[1] == size or file.read_at(len(MAGIC), full[1]) == MAGIC


def _first_record(file, start: int, end: int, size: int) -> int | None:
    """The first member that starts in [start, end)."""
    if start == 0:
        return 0 if size else None
    while start < end:
        # Two bytes more than the range: magic that begins inside may end outside.
        data = file.read_at(min(READ, end - start) + len(MAGIC) - 1, start)
        at = data.find(MAGIC)
        while at >= 0:
            if start + at < end and _begins(file, start + at, size):
                return start + at
            at = data.find(MAGIC, at + 1)
        start += READ
    return None


def _parsed(data: bytes) -> dict | None:
    """A record's fields; None for an empty member."""
    if not data:
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION):
        raise ValueError("a gzip member that is no WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    uri = fields.get("WARC-Target-URI")
    refers, page, first = fields.get("WARC-Refers-To"), fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "record_type": fields["WARC-Type"],
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "refers_to": refers and refers.strip("<>"),
        "uri": uri,
        "page_id": page and int(page),
        "refers_to_page": first and int(first),
        "payload_digest": digest,
        "payload_bytes": int(sizes["Content-Length"]),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _scan(batch_bytes: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def frame(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            for name in ("page_id", "refers_to_page", "payload_bytes"):
                out[name] = pd.array([None if r[name] is None else r[name] for r in rows], dtype="Int64")
            return out

        for ranges in batches:
            for path, size, start, end in ranges[["path", "size", "start", "end"]].itertuples(index=False):
                rows, held = [], 0
                with _opened(path) as file:
                    at = _first_record(file, start, end, size)
                    while at is not None and at < min(end, size):
                        member = _member_at(file, at, size)
                        if member is None:
                            raise ValueError(f"{path} is broken at byte {at}")
                        data, at = member
                        if (record := _parsed(data)) is not None:
                            rows.append(record)
                            held += len(data)
                        if held >= batch_bytes:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return read


def read_archives(spark: SparkSession, path: str, split_bytes: int = 8 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all archives under `path`, as `RECORDS`.

    Every file is cut into ranges of `split_bytes`, each read by itself. A task
    looks for gzip magic in its range, accepts a place if a record header
    decodes there and the member is followed by another or by the end of the
    file, and then reads on from member to member: it owns the records that
    start inside its range, wherever they end. A task holds one record and
    `batch_bytes` of rows. Damaged members and digests that don't match fail the
    read. A folder without records gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    ranges = files.filter("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes))).alias("start")
    )
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    # A range's row is short but its work is not: dealt by a hash to as many tasks as there are ranges, some of which get
    # several and others none, and not coalesced.
    dealt = ranges.repartition(max(1, min(ranges.count(), 1 << 15)), "path", "start")
    return dealt.mapInPandas(_scan(batch_bytes), RECORDS)
