"""Ogg media columns: bytes stored as 8-bit samples in two multiplexed logical streams, and read back.

The samples are cut into packets that go to the two streams in turn. Packets are laced into pages, a page may end inside
a packet, and the pages of both streams interleave. Reading verifies each page's checksum, follows each stream's page
numbers, puts packets together from lacing values, derives every packet's time from granule positions (which count a
stream's own samples), and merges the streams by time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8000
UNIT = 192
PACKET = 10 * UNIT
SEGMENTS = 24  # lacing values of a page; at most 255
SERIALS = (1, 2)
HEAD = b"NLPCM8\x00\x01" + struct.pack("<IB", RATE, 1)
CONTINUED, FIRST, LAST = 1, 2, 4
FLUSH = 16 << 20
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, highest bit first, start 0: the usual CRC of the bit-reversed bytes, reversed."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream(serial: int, packets: list[bytes]) -> list[bytes]:
    pages = [_page(FIRST, 0, serial, 0, bytes([len(HEAD)]), HEAD)]
    lacing, body, granule, done, inside = bytearray(), [], 0, -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, done, inside
        flags = (CONTINUED if inside else 0) | (LAST if last else 0)
        pages.append(_page(flags, done, serial, len(pages), bytes(lacing), b"".join(body)))
        inside = bool(lacing) and lacing[-1] == 255
        lacing, body, done = bytearray(), [], -1

    for packet in packets:
        for at in range(0, len(packet) + 1, 255):
            piece = packet[at:at + 255]
            if len(lacing) == SEGMENTS:
                close(False)
            lacing.append(len(piece))
            body.append(piece)
            if len(piece) < 255:
                granule += len(packet)
                done = granule
                break
    if done < 0 and not lacing:
        done = granule
    close(True)
    return pages


def write(payload: bytes) -> bytes:
    """The Ogg file of a payload; its length is a multiple of 192."""
    packets = [payload[at:at + PACKET] for at in range(0, len(payload), PACKET)]
    streams = [_stream(serial, packets[i::2]) for i, serial in enumerate(SERIALS)]
    out = []
    for turn in range(max(map(len, streams))):
        out += [pages[turn] for pages in streams if turn < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as read: packets as (start sample, bytes), and what was wrong."""

    packets: list[tuple[int, bytes]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    head: bytes | None = None
    _open: list[bytes] = field(default_factory=list)
    _waiting: list[bytes] = field(default_factory=list)
    _next: int = 0
    faults: int = 0

    def page(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        if number != self._next:
            self.faults += 1
            self._open, self._waiting = [], []
        if not flags & CONTINUED and self._open:
            self.faults += 1
            self._open = []
        skip = bool(flags & CONTINUED) and not self._open  # the start of this packet was lost
        self._next, self.pages, at = number + 1, self.pages + 1, 0
        for value in lacing:
            self._open.append(bytes(body[at:at + value]))
            at += value
            if value < 255:
                whole, self._open = b"".join(self._open), []
                if skip:
                    skip = False
                elif self.head is None:
                    self.head = whole
                else:
                    self._waiting.append(whole)
        if granule >= 0:
            start = granule - sum(map(len, self._waiting))
            for whole in self._waiting:
                self.packets.append((start, whole))
                start += len(whole)
            self._waiting = []
        self.ended |= bool(flags & LAST)


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages whose checksum or shape was wrong (they are left out)."""
    streams: dict[int, Stream] = {}
    view, at, bad = memoryview(data), 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if len(data) < at + 27 or len(data) < at + 27 + data[at + 26]:
            return streams, bad + 1
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27:at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        if version or len(data) < end or checksum(data[at:at + 22] + b"\0\0\0\0" + data[at + 26:end]) != crc:
            bad += 1
            at += 4
            continue
        streams.setdefault(serial, Stream()).page(flags, granule, number, lacing, view[start:end])
        at = end
    return streams, bad


def samples(streams: dict[int, Stream]) -> bytes:
    """All packets in order of their time, streams of equal time in order of their serial number."""
    timed = sorted((start, serial, i) for serial, s in streams.items() for i, (start, _) in enumerate(s.packets))
    return b"".join(streams[serial].packets[i][1] for _, serial, i in timed)


def describe(streams: dict[int, Stream], bad: int, payload: bytes) -> str:
    """Structure and signal features; levels in thousandths, around the middle level 128."""
    wave = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    ends = [max((start + len(p) for start, p in s.packets), default=0) for s in streams.values()]
    level = int(round(1000 * float(np.sqrt(np.mean(wave * wave))))) if len(wave) else 0
    mean = int(round(1000 * float(np.mean(wave)))) if len(wave) else 0
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return (f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
            f"ms={1000 * max(ends, default=0) // RATE};bad={bad + sum(s.faults for s in streams.values())};mean={mean};rms={level};crossings={crossings}")


def _flushed(batches: Iterator[pa.RecordBatch], each, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for row in zip(*[c.to_pylist() if c.type not in (pa.binary(), pa.string()) else c for c in batch.columns]):
            out.append(each(*row))
            size += len(out[-1][-1])
            if size >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def to_ogg(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 text of every row (null: empty), padded with spaces, as an Ogg file.

    Repeated rows stay repeated; other columns are not read.
    """
    def each(doc_id, text) -> tuple:
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        return doc_id, len(data), write(padded(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            yield from _flushed(iter([batch]), each, schema)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def from_ogg(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with ``feature`` and the ``payload`` read back; null media gives nulls.

    Pages with a wrong checksum are left out and counted as ``bad`` in the feature.
    """
    def each(doc_id, n_bytes, data) -> tuple:
        data = data.as_py()
        if data is None:
            return doc_id, n_bytes, data, None, b""
        streams, bad = read(data)
        payload = samples(streams)
        return doc_id, n_bytes, data, describe(streams, bad, payload), payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary()), ("feature", pa.string()), ("payload", pa.binary())])
            yield from _flushed(iter([batch]), each, schema)

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("payload", T.BinaryType())]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, T.StructType([media.schema["doc_id"], *fields]))


def media_digest(docs: DataFrame) -> DataFrame:
    """Sizes and digests of every text's media column and of the payload read back from it."""
    return from_ogg(to_ogg(docs)).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")
