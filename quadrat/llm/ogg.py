"""Operator 7: media columns as Ogg.

``write_ogg`` stores 8-bit samples losslessly: a logical stream of PCM packets and, interleaved with it, a stream of
comments. ``read_ogg`` verifies each page's checksum and order, demultiplexes the pages by serial number, reassembles
packets from lacing values (a value of 255 carries on, over page borders too) and derives timestamps from granule
positions. A page that is damaged ends the read with ``OggError``.

One pass, no shuffle; a task holds one batch of texts.

Defined cases: a null text is empty; a payload is padded with bytes 0 to a positive multiple of 64; equal texts give
equal values; a null id is kept; an empty table gives no rows. Extra columns are not read.
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

from quadrat.llm.common import rows_of, tune

RATE = 8000
BLOCK = 64
#: Samples in a data packet; with 255-byte segments, a page holds at most 255 * 255 bytes.
PACKET = 4096
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_IDENT = struct.Struct("<8sBBHIQ")
_MAGIC, _NOTE = b"\x80PCM-U8 ", b"\x81NOTES  "


class OggError(ValueError):
    """The bytes aren't a sound Ogg file."""


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, start 0) through zlib's reflected one."""
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (granule, bytes). The first packet has a page of its own."""
    segments: list[tuple[bytes, int, bool]] = []  # bytes, granule if a packet ends here else -1, whether it starts one
    pages: list[tuple[int, bytes]] = []
    at = 0

    def flush(last: bool) -> None:
        nonlocal segments, at
        flags = (0 if segments[0][2] else CONTINUED) | (FIRST if at == 0 else 0) | (LAST if last else 0)
        granule = max((g for _, g, _ in segments), default=-1)
        lacing = bytes(len(s) for s, _, _ in segments)
        pages.append((granule, _page(flags, granule, serial, at, lacing, b"".join(s for s, _, _ in segments))))
        segments, at = [], at + 1

    for n, (packet, granule) in enumerate(packets):
        cuts = range(0, len(packet) + 1, 255)  # a packet of a multiple of 255 bytes ends with an empty segment
        for i in cuts:
            part = packet[i : i + 255]
            segments.append((part, granule if len(part) < 255 else -1, i == 0))
            if len(segments) == 255 and not (n == len(packets) - 1 and len(part) < 255):
                flush(False)
        if n == 0 and segments:
            flush(len(packets) == 1)
    if segments:
        flush(True)
    return pages


def write_ogg(samples: bytes, rate: int = RATE) -> bytes:
    """A physical Ogg stream with the samples (8-bit, mono) and a comment stream beside them."""
    serial = zlib.crc32(samples)
    audio = [(_IDENT.pack(_MAGIC, 1, 8, 0, rate, len(samples)), 0)]
    audio += [(samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in range(0, len(samples), PACKET)]
    notes = [(_NOTE, 0), (f"SAMPLES={len(samples)}".encode(), len(samples))]
    first, second = _stream_pages(audio, serial), _stream_pages(notes, serial ^ 0xFFFFFFFF)
    return b"".join([first[0][1], second[0][1], *(p for _, p in first[1:2]), *(p for _, p in second[1:]), *(p for _, p in first[2:])])


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing values, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut off in a page's header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page starts at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut off in a page")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, data[at + 27 + n : end]
        at = end


def read_ogg(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Logical streams by serial number, each the list of (packet, granule position of the page where it ends; -1 if
    another packet ends after it there)."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    state: dict[int, list] = {}  # serial: next page number, open packet's parts or None, whether it has ended
    for flags, granule, serial, number, lacing, body in read_pages(data):
        if flags & FIRST:
            if serial in state:
                raise OggError("a stream begins twice")
            state[serial], streams[serial] = [0, None, False], []
        if serial not in state or state[serial][2]:
            raise OggError("a page outside its stream")
        own = state[serial]
        if number != own[0] or bool(flags & CONTINUED) != (own[1] is not None):
            raise OggError("a page is missing")
        own[0] += 1
        at, ended = 0, []
        parts = own[1]
        for size in lacing:
            parts = [] if parts is None else parts
            parts.append(body[at : at + size])
            at += size
            if size < 255:
                ended.append(b"".join(parts))
                parts = None
        own[1] = parts
        if ended and granule < 0:
            raise OggError("a page on which a packet ends has no granule position")
        streams[serial] += [(p, granule if i == len(ended) - 1 else -1) for i, p in enumerate(ended)]
        own[2] = bool(flags & LAST)
        if own[2] and parts is not None:
            raise OggError("a stream ends inside a packet")
    if any(not ended for _, _, ended in state.values()):
        raise OggError("a stream has no last page")
    return streams


def decode(data: bytes) -> tuple[bytes, int, list[float]]:
    """The samples, their rate, and the times in seconds at which pages of the sample stream end."""
    for packets in read_ogg(data).values():
        if packets and packets[0][0][:8] == _MAGIC:
            _, _, _, _, rate, n = _IDENT.unpack(packets[0][0])
            samples = b"".join(p for p, _ in packets[1:])
            granules = [g for _, g in packets[1:] if g >= 0]
            if len(samples) != n or granules[-1:] != [n]:
                raise OggError("granule positions don't match the samples")
            return samples, rate, [g / rate for g in granules]
    raise OggError("no sample stream")


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text and the bytes before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % BLOCK if data else BLOCK), len(data)


def features(samples: bytes, rate: int, times: list[float]) -> str:
    """Pages, duration, mean, root mean square, peak and crossings of the samples around their middle of 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return (
        f"pages={len(times)};seconds={times[-1] if times else 0:.6f};mean={x.mean():.6f};"
        f"rms={np.sqrt(np.square(x).mean()):.6f};peak={int(np.abs(x).max())};crossings={crossings}"
    )


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def media_columns(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` of every document: stored as Ogg, read back, measured."""
    tune(docs.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for ids, texts in rows_of(batches, "doc_id", "text"):
            rows = []
            for doc, text in zip(ids, texts):
                payload, n = padded(text)
                media = write_ogg(payload)
                back, rate, times = decode(media)
                rows.append(
                    (
                        doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media),
                        hashlib.sha256(media).hexdigest(), features(back, rate, times),
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(convert, SCHEMA)
