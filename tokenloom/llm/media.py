"""Operator 3: media columns in Ogg containers.

A payload becomes one Ogg file of two logical streams: PCM audio (one unsigned 8-bit sample a
byte, 8,000 a second) and a small tag stream with the unpadded length. Reading finds the pages,
verifies each page's checksum, demultiplexes by serial number, reassembles packets from the lacing
values (packets may continue over pages) and derives timestamps from granule positions.

A null text counts as empty. Equal texts give equal values. Damaged media raise OggError; nothing
is skipped. Each document is handled alone, so memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME = 8000, 192
AUDIO, TAGS = 0x41554431, 0x54414731
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """The bytes are no intact Ogg file."""


def checksum(page: bytes) -> int:
    """CRC-32 of Ogg (polynomial 0x04C11DB7, high bit first, from 0), by way of the reflected one."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream, of packets with the granule position that each completes."""
    pages: list[bytes] = []
    lacing, body, done, flags, fresh = bytearray(), [], -1, FIRST, True

    def flush(last: bool, continues: bool) -> None:
        nonlocal lacing, body, done, flags
        pages.append(page(flags | (LAST if last else 0), done, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, done, flags = bytearray(), [], -1, CONTINUED if continues else 0

    for k, (data, granule) in enumerate(packets):
        at, left = 0, len(data)
        while True:
            if len(lacing) == 255:
                flush(False, at > 0)
            room = 255 - len(lacing)
            full = min(left // 255, room)
            lacing += b"\xff" * full
            body.append(data[at : at + full * 255])
            at, left = at + full * 255, left - full * 255
            if left < 255 and len(lacing) < 255:
                lacing.append(left)
                body.append(data[at:])
                done = granule
                break
        if k == 0 or k == len(packets) - 1:  # the header packet has a page of its own
            flush(k == len(packets) - 1, False)
    return pages


def mux(payload: bytes, n_bytes: int) -> bytes:
    """payload as an Ogg file; a data packet holds 64 frames of 192 samples."""
    step = 64 * FRAME
    audio = [(struct.pack("<8sHHII", b"PCM8    ", 1, 1, RATE, FRAME), 0)]
    audio += [(payload[i : i + step], min(i + step, len(payload))) for i in range(0, len(payload), step)]
    tags = [(b"TAGS\x01", 0), (struct.pack("<Q", n_bytes), len(payload))]
    a, t = _stream(AUDIO, audio), _stream(TAGS, tags)
    return b"".join([a[0], t[0], *a[1:], *t[1:]])


@dataclass
class Logical:
    """A logical stream as read: whole packets, and for each the granule position of its page."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)

    def seconds(self) -> float:
        return max(self.granules, default=0) / RATE


def demux(media: bytes) -> dict[int, Logical]:
    """Logical streams by serial number. Raises OggError where a page is damaged or missing."""
    streams: dict[int, Logical] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("cut off in a page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise OggError("a stream without its first page")
            s = streams[serial] = Logical()
        if number != s.pages or s.ended or bool(flags & CONTINUED) != bool(s._open):
            raise OggError(f"page {number} of stream {serial} is out of place")
        s.pages += 1
        pos, size = start, 0
        for v in lacing:
            size += v
            if v < 255:
                s.packets.append(b"".join([*s._open, view[pos : pos + size]]))
                s.granules.append(granule)
                s._open = []
                pos, size = pos + size, 0
        if size:
            s._open.append(bytes(view[pos : pos + size]))
        s.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s._open for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def features(samples: np.ndarray, seconds: float) -> str:
    """Duration in ms, mean and RMS in hundredths, zero crossings, loudest frame, and the energy
    of the differences at steps of 1, 2, 4 and 8 samples; integers, so the same anywhere."""
    x = samples.astype(np.int64) - 128
    n = len(x)
    frames = np.square(x).reshape(-1, FRAME).sum(1)
    cross = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    bands = [int(np.square(x[s:] - x[:-s]).sum()) // n for s in (1, 2, 4, 8)]
    rms = int(np.sqrt(float(int(frames.sum()) * 10000 // n)))
    return ",".join(map(str, [round(seconds * 1000), int(x.sum()) * 100 // n, rms, cross, int(frames.argmax()), int(frames.max()) // FRAME, *bands]))


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % FRAME or (0 if text else FRAME))


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, media binary."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = []
            for v in b.column(1):
                raw = (v.as_py() or "").encode()
                media.append(mux(payload_of(raw), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, media binary")


def read_media(table: DataFrame) -> DataFrame:
    """(doc_id, media) -> checks and features of what is stored."""
    kind = table.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages", "seconds"]

    def one(media: bytes) -> tuple:
        streams = demux(media)
        audio = streams[AUDIO]
        payload = b"".join(audio.packets[1:])
        (n,) = struct.unpack("<Q", streams[TAGS].packets[1])
        sec = audio.seconds()
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
            features(np.frombuffer(payload, np.uint8), sec), sum(s.pages for s in streams.values()), sec,
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        for b in batches:
            found = [one(v.as_py()) for v in b.column(1)]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return table.select("doc_id", "media").mapInArrow(
        rows, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long, seconds double"
    )
