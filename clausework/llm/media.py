"""Media columns: Ogg streams.

A payload of 8-bit samples becomes packets of one frame each in a logical stream; a second logical stream carries an
index of the first. Both are laid into pages (lacing values, granule positions, checksums) and multiplexed. The reader
verifies each page's checksum, demultiplexes by serial number, reassembles packets from lacing values across pages, and
derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the container: capture pattern, header layout, flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
FRAME, RATE = 576, 8000
HEAD = b"CWPCM8\x00\x01" + struct.pack("<II", RATE, FRAME)

_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from 0: zlib's reflected CRC over bit-reversed bytes, bits reversed again."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg_crc(head + body)) + head[26:] + body


def lacing_of(n: int) -> bytes:
    """Lacing values of a packet of n bytes: 255s, then a rest under 255."""
    return b"\xff" * (n // 255) + bytes((n % 255,))


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; granules: the position after each packet. The first packet has a page of its own; packets may run over pages."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST
    for k, p in enumerate(packets):
        laces, at = lacing_of(len(p)), 0
        while laces:
            room = 255 - len(lacing)
            now, laces = laces[:room], laces[room:]
            size = sum(now)
            lacing += now
            body += p[at : at + size]
            at += size
            if not laces:
                granule = granules[k]
            if len(lacing) == 255 or not laces and (k == 0 or k == len(packets) - 1):
                last = LAST if k == len(packets) - 1 and not laces else 0
                out.append(page(serial, len(out), granule, flags | last, bytes(lacing), bytes(body)))
                lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED if laces else 0
    return out


def encode(payload: bytes) -> bytes:
    """Two multiplexed logical streams: samples (serial: the payload's CRC-32) and, every 64 frames, an index packet (serial: its complement)."""
    serial = zlib.crc32(payload)
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    n = len(frames)
    sound = pages_of(serial, [HEAD, *frames], [0, *(FRAME * (k + 1) for k in range(n))])
    marks = list(range(0, n, 64))
    index = pages_of(serial ^ 0xFFFFFFFF, [b"CWINDEX\x00", *(struct.pack("<QI", k * FRAME, zlib.crc32(frames[k])) for k in marks)], [0, *(k * FRAME for k in marks)])
    out = [sound[0], index[0]]
    a, b = sound[1:], index[1:]
    out += [x for pair in zip(a, b, strict=False) for x in pair] + a[len(b) :] + b[len(a) :]
    return b"".join(out)


class MediaError(ValueError):
    pass


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    times: list[tuple[int, float]] = field(default_factory=list)  # packets done, seconds, at the end of each page that ends one
    pages: int = 0
    part: bytes = b""
    ended: bool = False


def decode(data: bytes) -> dict[int, Stream]:
    """All logical streams by serial number. Raises MediaError for a bad capture, checksum, page number or unfinished packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise MediaError(f"no page at {at}")
        _, _, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise MediaError(f"checksum of the page at {at}")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(s.part):
            raise MediaError(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        x, began = at + 27 + n, at + 27 + n
        for lace in lacing:
            x += lace
            if lace < 255:
                s.packets.append(s.part + data[began:x])
                s.part, began = b"", x
        s.part += data[began:x]
        if granule >= 0:
            s.times.append((len(s.packets), granule / RATE))
        s.ended |= bool(flags & LAST)
        at = end
    if any(s.part or not s.ended for s in streams.values()):
        raise MediaError("a stream is not finished")
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, float]:
    """The samples of the sound stream and its length in seconds; the index stream must agree with it."""
    sound = next(s for s in streams.values() if s.packets[0] == HEAD)
    frames = sound.packets[1:]
    for s in streams.values():
        if s is not sound:
            for p in s.packets[1:]:
                at, crc = struct.unpack("<QI", p)
                if zlib.crc32(frames[at // FRAME]) != crc:
                    raise MediaError("the index does not fit")
    return b"".join(frames), sound.times[-1][1]


def pad(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of the frame."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def features(payload: bytes, seconds: float) -> str:
    """Seconds, mean, root mean square and zero crossings of the samples around 128."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    v = np.arange(256) - 128
    sign = x >= 128
    return f"{seconds:.6f};{float(counts @ v) / len(x):.6f};{(float(counts @ (v * v)) / len(x)) ** 0.5:.6f};{int(np.count_nonzero(sign[1:] != sign[:-1]))}"


_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as an Ogg file. Null text: empty; null ids and repeated rows stay."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                raw = [(t or "").encode() for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(raw)), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def measured(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back packet by packet."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                p, seconds = payload_of(decode(m))
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(p, seconds)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measured(stored(docs))
