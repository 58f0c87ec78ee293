"""Media columns in the Ogg container: pages, packets, logical streams, timestamps.

A page holds up to 255 lacing values; a value of 255 goes on, a smaller one
ends a packet, so packets run over pages. Each page carries its stream's
serial number, a sequence number, the granule position after the last packet
that ends in it, and a checksum over all its bytes. Pages of several streams
may alternate; reading takes them apart by serial number. A stream's time is
its granule position over its sample rate.

The checksum is CRC-32 with polynomial 0x04C11DB7, not reflected, from 0. With
bits reversed it is what zlib computes, so it runs at zlib's speed.

Samples are stored as unsigned 8-bit PCM of one channel, in a stream whose
first packet is the header of the OggPCM mapping; a second logical stream
("text") says how many bytes the unpadded text has.

Defined results
- null or empty text: no bytes of text, 64 zero bytes of payload
- a text of any length gives as many pages as it needs; equal texts give equal bytes
- a page with a wrong checksum is passed over and counted; reading goes on at
  the next capture pattern; null or foreign bytes have no stream
- ids aren't read, so null or repeated ids do no harm; a column that has an output's name is replaced
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prismill.llm.bpe import mapped

CAPTURE = b"OggS"
BLOCK = 64
RATE = 8000
PACKET = 4096

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """Of a page whose checksum field is zero."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream from packets with the granule position after each.

    The first packet has a page of its own, as the format asks of headers.
    """
    out: list[bytes] = []
    lacing, body, granule, ended, carried = bytearray(), [], -1, False, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, carried, ended
        kind = carried * 1 | (not out) * 2 | last * 4
        head = bytearray(_HEADER.pack(CAPTURE, 0, kind, granule if ended else -1, serial, len(out), 0, len(lacing)) + lacing)
        page = head + b"".join(body)
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        out.append(bytes(page))
        lacing, body, ended = bytearray(), [], False

    for k, (data, position) in enumerate(packets):
        values, at = len(data) // 255 + 1, 0
        while values:
            if len(lacing) == 255:
                flush(False)
                carried = at > 0
            take = min(values, 255 - len(lacing))
            values -= take
            size = take * 255 if values else len(data) - at
            lacing += b"\xff" * (take - 1) + bytes([255 if values else size - (take - 1) * 255])
            body.append(data[at : at + size])
            at += size
        granule, ended = position, True
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
            carried = False
    return out


@dataclass
class Stream:
    """A logical stream as read: its packets, and the granule position where a page gave one after a packet."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    positions: dict[int, int] = field(default_factory=dict)
    pages: int = 0
    gaps: int = 0
    next_page: int = 0
    part: list[bytes] | None = None

    @property
    def codec(self) -> str:
        head = self.packets[0] if self.packets else b""
        return "pcm" if head.startswith(b"PCM     ") else "text" if head.startswith(b"text/") else "unknown"

    @property
    def rate(self) -> int:
        return struct.unpack(">I", self.packets[0][16:20])[0] if self.codec == "pcm" else 1

    def times(self) -> list[tuple[int, float]]:
        """Packet number and seconds at its end, where known."""
        return [(k, g / self.rate) for k, g in sorted(self.positions.items())]

    @property
    def seconds(self) -> float:
        return max(self.positions.values(), default=0) / self.rate


def demultiplex(data: bytes | None) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages had a wrong checksum."""
    streams: dict[int, Stream] = {}
    data, at, bad = data or b"", 0, 0
    while (at := data.find(CAPTURE, at)) >= 0 and at + 27 <= len(data):
        _, version, kind, granule, serial, number, crc, segments = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        page = bytearray(data[at:end])
        page[22:26] = bytes(4)
        if version or end > len(data) or checksum(bytes(page)) != crc:
            bad += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s.next_page:
            s.gaps += 1
            s.part = None
        if not kind & 1:
            s.part = []
        s.next_page, s.pages = number + 1, s.pages + 1
        pos, ended = at + 27 + segments, False
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                if s.part is not None:
                    s.packets.append(b"".join(s.part) + data[pos : pos + run])
                    ended = True
                s.part, pos, run = [], pos + run, 0
        if run and s.part is not None:
            s.part.append(data[pos : pos + run])
        if ended and granule >= 0:
            s.positions[len(s.packets) - 1] = granule
        at = end
    return streams, bad


def interleave(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the rest in turn."""
    heads, rest = [s[0] for s in streams], [s[1:] for s in streams]
    turns = [p for k in range(max(map(len, rest))) for s in rest if k < len(s) for p in s[k : k + 1]]
    return b"".join(heads + turns)


def store(text: str | None) -> bytes:
    """A text as an Ogg file of 8-bit samples, padded with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    payload = data + bytes(BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)
    serial = zlib.crc32(payload)
    head = struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    cuts = range(0, len(payload), PACKET)
    sound = [(head, 0), *((payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts)]
    note = [(b"text/plain; charset=utf-8", 0), (str(len(data)).encode(), len(payload) // RATE)]
    return interleave([pages(sound, serial), pages(note, serial ^ 0xFFFFFFFF)])


@dataclass
class Media:
    """What was read from stored bytes."""

    payload: bytes
    n_bytes: int | None
    streams: int
    packets: int
    pages: int
    bad_pages: int
    seconds: float


def load(data: bytes | None) -> Media:
    """The samples of the first PCM stream, put together from its packets."""
    streams, bad = demultiplex(data)
    sound = next((s for s in streams.values() if s.codec == "pcm"), None)
    note = next((s for s in streams.values() if s.codec == "text" and len(s.packets) > 1), None)
    payload = b"".join(sound.packets[1:]) if sound else b""
    return Media(payload, int(note.packets[1]) if note else None, len(streams), sum(len(s.packets) for s in streams.values()), sum(s.pages for s in streams.values()), bad, sound.seconds if sound else 0.0)


def feature(m: Media) -> str:
    """Mean, loudness and crossings of the middle of the samples, with the container's counts."""
    x = np.frombuffer(m.payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x)))) if len(x) else 0
    mean, loud = (float(x.mean()), float(np.sqrt((x.astype(np.float64) ** 2).mean()))) if len(x) else (0.0, 0.0)
    return f"u8;{m.seconds:.4f}s;mean={mean:.3f};rms={loud:.3f};zc={crossings};streams={m.streams};packets={m.packets};pages={m.pages}"


def stored(df: DataFrame, column: str = "text", to: str = "media") -> DataFrame:
    """Replace a text column by a column of Ogg bytes."""
    return mapped(df, column, {to: T.BinaryType()}, lambda text: (store(text),), keep=False)


FIELDS = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}


def described(df: DataFrame, column: str = "media") -> DataFrame:
    """Replace a column of Ogg bytes by what they hold: sizes, digests and a feature string."""

    def one(data: bytes | None) -> tuple:
        m, data = load(data), data or b""
        sha = hashlib.sha256
        return m.n_bytes, len(m.payload), sha(m.payload).hexdigest(), zlib.crc32(m.payload[-BLOCK:]), len(data), sha(data).hexdigest(), feature(m)

    return mapped(df, column, FIELDS, one, keep=False)
