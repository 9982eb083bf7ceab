"""Ogg media columns: pages with verified checksums, packets reassembled from lacing values, logical streams taken apart,
timestamps from granule positions. Bytes in, columns out; every row is handled alone, so nothing is shuffled.

Defined results: null bytes have no pages; bytes that are no page are skipped up to the next capture pattern and counted;
a page with a wrong checksum, a cut page or a gap in a stream's numbering spoils the packet it belongs to, never its
neighbours, and is counted as well.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
#: Every byte with its bits in reverse.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Identification packet of the streams that store_bytes writes: magic, version, rate, bytes in a packet, place among the streams, streams.
_IDENT = struct.Struct("<7sBIIBB")
_MAGIC = b"SFPCMU8"


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 (0x04c11db7, high bit first, from 0, not inverted) of a page whose checksum field is zero.

    zlib's has the same polynomial, low bit first and inverted: bytes and result are mirrored, and both inversions undone.
    """
    low_first = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes
    good: bool


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet; -1 where no page says it.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    spoiled: int = 0


def write_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + page_crc(head + body).to_bytes(4, "little") + head[26:] + body


def read_pages(data: bytes) -> tuple[list[Page], int]:
    """The pages and how many bytes belong to none."""
    pages, at, skipped = [], 0, 0
    while at < len(data):
        found = data.find(b"OggS", at)
        if found < 0:
            return pages, skipped + len(data) - at
        skipped += found - at
        at = found
        if len(data) - at < _HEAD.size:
            return pages, skipped + len(data) - at
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        start = at + _HEAD.size
        lacing = data[start : start + n]
        end = start + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            skipped, at = skipped + 4, at + 4
            continue
        good = page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        if not good and data.find(b"OggS", at + 4, end) >= 0:  # its lengths may be what is wrong
            skipped, at = skipped + 4, at + 4
            continue
        pages.append(Page(flags, granule, serial, number, lacing, data[start + n : end], good))
        at = end
    return pages, skipped


def demultiplex(pages: list[Page]) -> list[Stream]:
    """The logical streams, in the order of their first pages, with whole packets alone."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes] | None] = {}  # parts of a packet that goes on; None: its start is lost
    due: dict[int, int] = {}
    for p in pages:
        s = streams.setdefault(p.serial, Stream(p.serial))
        if not p.good:
            s.spoiled += 1
            continue
        s.pages += 1
        parts = open_.pop(p.serial, [])
        if due.get(p.serial, p.number) != p.number or (parts == []) == bool(p.flags & CONTINUED):
            s.spoiled += 1
            parts = None if p.flags & CONTINUED else []
        due[p.serial] = p.number + 1
        at, ended_here = 0, 0
        for n in p.lacing:
            if parts is not None:
                parts.append(p.body[at : at + n])
            at += n
            if n < 255:
                if parts is not None:
                    s.packets.append(b"".join(parts))
                    s.granules.append(-1)
                    ended_here += 1
                parts = []
        if ended_here:
            s.granules[-1] = p.granule
        if p.lacing[-1:] == b"\xff":
            open_[p.serial] = parts
        s.ended |= bool(p.flags & LAST)
    for serial in open_:
        streams[serial].spoiled += 1
    return list(streams.values())


def lacing_of(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def store_bytes(samples: bytes, rate: int = 8000, streams: int = 2, packet: int = 1024, segments: int = 24) -> bytes:
    """8-bit samples as Ogg: packets dealt to the streams in turn, pages of at most `segments` lacing values, a packet going on
    in the next page where it doesn't fit. A page's granule position is the number of the stream's samples up to its last whole packet."""
    packets = [samples[i : i + packet] for i in range(0, len(samples), packet)]
    streams = max(1, min(streams, len(packets)))
    heads, bodies = [], []
    for k in range(streams):
        serial = k + 1
        ident = _IDENT.pack(_MAGIC, 1, rate, packet, k, streams)
        heads.append(write_page(FIRST, 0, serial, 0, lacing_of(len(ident)), ident))
        own = packets[k::streams]
        lacing, body = b"".join(lacing_of(len(p)) for p in own), b"".join(own)
        made, number, at, done = [], 1, 0, 0
        whole, so_far = [], 0  # samples up to the last packet that ends by each lacing value
        for i, n in enumerate(lacing):
            so_far += n
            done = so_far if n < 255 else done
            whole.append(done)
        for i in range(0, len(lacing), segments):
            part = lacing[i : i + segments]
            size = sum(part)
            ends = any(n < 255 for n in part)
            flags = CONTINUED * (i > 0 and lacing[i - 1] == 255) | LAST * (i + segments >= len(lacing))
            made.append(write_page(flags, whole[i + len(part) - 1] if ends else -1, serial, number, part, body[at : at + size]))
            number, at = number + 1, at + size
        bodies.append(made)
    turns = [p for turn in range(max(map(len, bodies))) for made in bodies for p in made[turn : turn + 1]]
    return b"".join(heads + turns)


def identified(stream: Stream) -> tuple | None:
    """The fields of a stream's identification packet, if store_bytes wrote it: others may begin like it, or be cut short."""
    first = stream.packets[0] if stream.packets else b""
    return _IDENT.unpack(first) if len(first) == _IDENT.size and first.startswith(_MAGIC) else None


def restore_bytes(data: bytes) -> tuple[bytes, list[Stream], int]:
    """The samples that store_bytes stored, the streams and the count of what was wrong."""
    pages, skipped = read_pages(data)
    streams = demultiplex(pages)
    own = sorted(((ident[4], s.serial, s) for s in streams if (ident := identified(s))), key=lambda x: x[:2])
    turns = max((len(s.packets) for *_, s in own), default=1) - 1
    samples = b"".join(s.packets[1 + t] for t in range(turns) for *_, s in own if 1 + t < len(s.packets))
    return samples, streams, skipped + sum(s.spoiled for s in streams)


def timestamps(stream: Stream, rate: int) -> list[float | None]:
    """Seconds at the end of each packet; None where no page says it, or at an unknown rate (0)."""
    return [g / rate if g >= 0 and rate else None for g in stream.granules]


def padded(data: bytes, to: int = 64) -> bytes:
    return data + b"\0" * (-len(data) % to or (to if not data else 0))


def sample_features(samples: bytes) -> tuple[float, float, int, int]:
    """Mean and root mean square about silence (128), peak, crossings of silence."""
    if not samples:
        return 0.0, 0.0, 0, 0
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    return float(x.mean()), float(np.sqrt(np.mean(x.astype(np.int32) ** 2))), int(np.abs(x).max()), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))


def store(payload: str | Column, **how) -> Column:
    """binary: each row's text or bytes, padded to a multiple of 64, as an Ogg file."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([store_bytes(padded(v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v or b""), **how) for v in x])

    return of(payload)


def granule_rate(stream: Stream) -> int:
    """Granules a second, from the head that a stream's first packet is; 0 where it is none of those known."""
    if ident := identified(stream):
        return ident[2]
    head = stream.packets[0] if stream.packets else b""
    if head.startswith(b"\x01vorbis") and len(head) >= 16:
        return int.from_bytes(head[12:16], "little")
    if head.startswith(b"OpusHead"):
        return 48_000  # whatever was recorded
    if head.startswith(b"\x7fFLAC") and len(head) >= 30:
        return int.from_bytes(head[27:30], "big") >> 4
    if head.startswith(b"Speex   ") and len(head) >= 40:
        return int.from_bytes(head[36:40], "little")
    return 0


_SUMMARY = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, streams int, pages int, packets int, faults int, seconds double"


def summary_of(media: bytes | None) -> tuple:
    media = media or b""
    samples, streams, faults = restore_bytes(media)
    seconds = sum(max((t for t in timestamps(s, granule_rate(s)) if t is not None), default=0.0) for s in streams)
    mean, rms, peak, crossed = sample_features(samples)
    pages, packets = sum(s.pages for s in streams), sum(len(s.packets) for s in streams)
    feature = f"streams={len(streams)};pages={pages};packets={packets};seconds={seconds:.6f};mean={mean:.4f};rms={rms:.4f};peak={peak};crossings={crossed}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(streams), pages, packets, faults, seconds


def summary(media: str | Column) -> Column:
    """struct of what an Ogg file that store wrote holds, read back from its bytes."""

    @F.pandas_udf(_SUMMARY)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([summary_of(v) for v in x], columns=[c.split()[0] for c in _SUMMARY.split(", ")])

    return of(media)


def packets_of(media: bytes | None) -> list[dict]:
    streams = demultiplex(read_pages(media or b"")[0])
    return [{"serial": s.serial, "packet": k, "granule": g, "seconds": t, "data": p} for s in streams for k, (p, g, t) in enumerate(zip(s.packets, s.granules, timestamps(s, granule_rate(s))))]


def packets(media: str | Column) -> Column:
    """array<struct<serial, packet, granule, seconds, data>> of any Ogg file; seconds by the rate that a
    stream's first packet says (store's own, Vorbis, Opus, FLAC, Speex), else null."""

    @F.pandas_udf("array<struct<serial:bigint,packet:int,granule:bigint,seconds:double,data:binary>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([packets_of(v) for v in x])

    return of(media)
