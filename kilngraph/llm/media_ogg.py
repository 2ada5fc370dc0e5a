"""Media columns in Ogg: payloads as packets of multiplexed logical streams, written and read back inside map tasks.

Reading verifies every page's checksum, reassembles packets from lacing values (also across pages), demultiplexes the
logical streams and derives each packet's time from granule positions.  Row by row, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import as_bytes, bounded

#: Bytes of a packet; a sample is one byte.
PACKET = 576
RATE = 8000
STREAMS = 2
#: Lacing values a page holds at most (the format allows 255; here packets of three values do go on over pages).
SEGMENTS = 250
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sBBHIQ")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, BEGINS, ENDS = 1, 2, 4

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_crc(page: bytes) -> int:
    """The format's CRC (polynomial 0x04C11DB7, most significant bit first, from 0) by zlib's, which is its mirror image."""
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def pages_of(serial: int, packets: list[bytes], granules: list[int], segments: int = SEGMENTS) -> list[bytes]:
    """A logical stream's pages: the first packet alone on the first page; later packets may go on over pages.

    A page's granule position is that of the last packet that ends on it, or -1."""
    out, lacing, body, granule, flags = [], bytearray(), [], -1, BEGINS

    def flush(more: int) -> None:
        nonlocal lacing, body, granule, flags
        head = HEAD.pack(b"OggS", 0, flags | more, granule, serial, len(out), 0, len(lacing))
        page = b"".join([head, bytes(lacing), *body])
        out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        left = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while left:
            if len(lacing) == segments:
                flush(0)
                flags = CONTINUED if done else 0
            part, left = left[: segments - len(lacing)], left[segments - len(lacing) :]
            size = sum(part)
            lacing += part
            body.append(packet[done : done + size])
            done += size
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(ENDS if k == len(packets) - 1 else 0)
    return out


def write_ogg(payload: bytes, streams: int = STREAMS, segments: int = SEGMENTS) -> bytes:
    """The payload's packets of 576 bytes dealt in turn to the logical streams, whose pages are interleaved.

    Serial numbers follow from the payload, so equal payloads have equal files."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    seed = zlib.crc32(payload)
    logical = []
    for k in range(streams):
        own = packets[k::streams]
        ident = IDENT.pack(b"RAWPCM8\0", k, streams, PACKET, RATE, len(payload))
        logical.append(pages_of((seed + k) & 0xFFFFFFFF, [ident, *own], [0, *(PACKET * (i + 1) for i in range(len(own)))], segments))
    out = [pages[0] for pages in logical]  # the beginnings come first
    for i in range(1, max(map(len, logical))):
        out += [pages[i] for pages in logical if i < len(pages)]
    return b"".join(out)


def read_ogg(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload and what the container says; ValueError on a wrong checksum, a gap in the pages or a lost packet."""
    at = pages = packets = last = 0
    streams: dict[int, dict] = {}
    while at < len(media):
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(lacing)
        page = media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]
        if magic != b"OggS" or version or len(page) != end - at or page_crc(page) != crc:
            raise ValueError(f"damaged page at byte {at}")
        s = streams.setdefault(serial, {"next": 0, "packets": [], "open": b"", "ends": []})
        if number != s["next"] or bool(flags & BEGINS) != (number == 0) or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"page {number} of stream {serial} out of order")
        s["next"] += 1
        done, start = 0, body
        for value in lacing:
            done += value
            if value < 255:
                s["packets"].append(s["open"] + media[start : body + done])
                s["open"], start = b"", body + done
        if start < end or (lacing and lacing[-1] == 255):
            s["open"] += media[start:end]
        if granule >= 0:
            s["ends"].append((granule, len(s["packets"])))
        s["ended"] = bool(flags & ENDS)
        at, pages = end, pages + 1
    parts: list[tuple[int, bytes]] = []
    size = 0
    for s in streams.values():
        magic, k, of, packet, rate, size = IDENT.unpack(s["packets"][0])
        if magic != b"RAWPCM8\0" or not s["ended"] or s["open"]:
            raise ValueError("a logical stream is cut off")
        # the time at which a packet ends: from its page's granule position back, a packet's samples each
        for (granule, n), (_, before) in zip(s["ends"][1:], s["ends"][:-1], strict=True):
            for i in range(before, n):
                own = (granule - (n - 1 - i) * packet) // packet - 1
                parts.append((own * of + k, s["packets"][i]))
        packets += len(s["packets"]) - 1
        last = max(last, s["ends"][-1][0] * 1000 // rate)
    payload = b"".join(p for _, p in sorted(parts, key=lambda x: x[0]))
    if len(payload) != size or [i for i, _ in sorted(parts, key=lambda x: x[0])] != list(range(len(parts))):
        raise ValueError("packets are missing")
    return payload, {"streams": len(streams), "pages": pages, "packets": packets, "last_ms": last}


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % PACKET or PACKET * (not raw))


def feature(payload: bytes, about: dict[str, int]) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    step = np.abs(np.diff(samples))
    return ";".join([*(f"{k}={v}" for k, v in about.items()), f"mean={samples.mean():.4f}", f"rms={np.sqrt((samples * samples).mean()):.4f}", f"step={step.mean():.4f}"])


def ogg_features(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Store each text as Ogg, read it back and describe it: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.

    A null text is empty: 576 bytes of padding.  Each row of docs gives a row; equal texts give equal values.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in as_bytes(batch.column("text")):
                media = write_ogg(pad(raw), segments=segments)
                payload, about = read_ogg(media)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, about)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, SCHEMA)


def media_column(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """docs with a binary column media: each text as an Ogg file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = pa.array([write_ogg(pad(raw), segments=segments) for raw in as_bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "media"), media], [*(n for n in batch.schema.names if n != "media"), "media"])

    kept = bounded(docs).drop("media")
    return kept.mapInArrow(store, kept.withColumn("media", F.lit(b"").cast("binary")).schema)
