"""WARC archives: one record a page, long ones in segments, read back by reassembling the segments.

Archives are blobs of whole records in a table in the shared folder (a Python task can't open files in every store that
Spark reads).  Reading groups continuation records by their origin's identifier, orders them by segment number,
checks the total length and decodes chunked transfer framing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import bounded, materialize

#: Bytes of a record's block beyond which it goes on in continuation records.
SEGMENT = 32 << 10
#: Bytes of a chunk of transfer framing.
CHUNK = 4 << 10
#: Bytes of an archive blob, whole records, one at least.
ARCHIVE = 4 << 20
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"


def chunked_body(payload: bytes, chunk: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + chunk]), payload[i : i + chunk]) for i in range(0, len(payload), chunk)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body (extensions are skipped, trailers ignored); ValueError if it is cut off."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[line + 2 : line + 2 + size]
        if len(part) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(part)
        at = line + 4 + size


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head.encode(), len(block), block)


def records_of(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """The page's records: a response and its continuations, or a revisit without the payload."""
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:none"
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": DATE, "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id, "X-Refers-To-Page-Id": refers_to,
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked_body(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    out = [record(fields | {"WARC-Segment-Number": 1}, block[:segment])]
    pieces = range(segment, len(block), segment)
    for k, i in enumerate(pieces):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.UUID(name), str(k + 2))}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": fields["WARC-Record-ID"], "WARC-Segment-Number": k + 2}
        out.append(record(more | ({"WARC-Segment-Total-Length": len(block)} if k == len(pieces) - 1 else {}), block[i : i + segment]))
    return out


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if not first.startswith("WARC/") or len(block) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"damaged record at byte {at}")
        yield fields, block
        at = end + 8 + size


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole record, its digest verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    page, refers = (None if (v := fields.get(k)) is None else int(v) for k in ("x-page-id", "x-refers-to-page-id"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return page, int(http["content-length"]), digest, "revisit", refers
    payload = unchunk(body) if http.get("transfer-encoding") == "chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {page} differs from its digest")
    return page, len(payload), digest, "response", None


RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PIECE = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT, archive_bytes: int = ARCHIVE) -> DataFrame:
    """A materialized table (archive binary) with a record for each row of pages.

    Of rows with equal payloads of least bytes or more, those with the largest page_id are responses and the others
    revisit it; a null page_id comes before all others.  A null html is an empty payload.  Records' identifiers are of this
    writing alone, so archives of several writings can be read together.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    copies = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(F.spark_partition_id().alias("part"), "page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    writing = uuid.uuid4()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = 0, [], 0
        for batch in batches:
            for part, page_id, url, text, digest, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = records_of(str(uuid.uuid5(writing, f"{part}-{n}")), page_id, url, text.encode(), digest, refers_to, again, segment)
                n += 1
                held += new
                size += sum(map(len, new))
                if size >= archive_bytes:
                    yield to_batch([(b"".join(held),)], pa.schema([("archive", pa.binary())]))
                    held, size = [], 0
        if held:
            yield to_batch([(b"".join(held),)], pa.schema([("archive", pa.binary())]))

    return materialize(rows.mapInArrow(write, "archive binary"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives.

    Whole records are parsed where they are read; only pieces of segmented ones are shuffled, by their origin.
    ValueError on damaged records, missing segments, a wrong total length or digest."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                yield to_batch([page_of(f, b) for f, b in parse_records(archive.as_py()) if "warc-segment-number" not in f], RESULT)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for f, b in parse_records(archive.as_py()):
                    if number := f.get("warc-segment-number"):
                        head = "\n".join(f"{k}:{v}" for k, v in f.items()) if number == "1" else None
                        rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(number), None if (t := f.get("warc-segment-total-length")) is None else int(t), head, b))
                yield to_batch(rows, PIECE)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {origin} are missing or their length is wrong")
                rows.append(page_of(dict(x.split(":", 1) for x in parts[0]["head"].split("\n")), block))
            yield to_batch(rows, RESULT)

    result = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    split = archives.mapInArrow(pieces, "origin string, number int, total long, head string, block binary")
    one = split.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "head", "block"))).alias("parts"))  # a record's own segments
    return archives.mapInArrow(whole, result).unionByName(one.mapInArrow(assemble, result))


def archive_pages(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write pages to archives and read them back."""
    return read_archives(write_archives(pages, least, segment))
