"""Media columns as MPEG transport streams (ISO/IEC 13818-1): one program with one elementary stream.

mux() writes program tables, packetised elementary packets with timestamps, and
188-byte transport packets; demux() parses them again, checks the continuity
counters, reassembles the packets and keeps timestamps and random-access
points. Both work on whole arrays of packets.

Cases: a null payload is empty, and an empty payload has one access unit of
padding in media_table(). demux() refuses streams without sync bytes, program
tables or with a wrong table checksum, and programs that move to another stream.
A packet that comes twice in a row, as streams may have it, counts and its payload
is taken once. Lost packets are counted, and so are elementary packets that lack
or exceed their stated length. Payloads of any length are whole; a batch of rows
ends at about BATCH_BYTES of them, or after one. Repeated rows get equal answers,
an empty table gives no rows, and only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nestra.llm.common import saved

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
#: Stream type and id of private data in elementary packets.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
#: Payloads fill whole frames of so many bytes; an access unit has so many frames at most.
FRAME, UNIT_FRAMES = 576, 10
PAD = 255
#: 90 kHz ticks between access units; each so many units, one is a random-access point.
TICKS, RANDOM_EACH = 3600, 8
PES_HEADER = 14
#: Bytes of media that a batch of rows holds, or one row where that is larger.
BATCH_BYTES = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table_id: int, key: int, body: bytes, counter: int) -> bytes:
    """A transport packet with one whole section of a program table."""
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 255, key >> 8, key & 255, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT_BODY = bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
_PMT_BODY = bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
_TABLES = [_section_packet(PAT_PID, 0x00, 1, _PAT_BODY, i) + _section_packet(PMT_PID, 0x02, 1, _PMT_BODY, i) for i in range(16)]


def _units(units: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Transport packets, as (unit, packet, byte), of access units of one size; `first` is the number of the first unit."""
    n, size = units.shape
    number = np.arange(first, first + n, dtype=np.int64)
    pts = number * TICKS
    pes = np.empty((n, PES_HEADER + size), np.uint8)
    length = PES_HEADER - 6 + size
    pes[:, :9] = [0, 0, 1, PRIVATE_ID, length >> 8, length & 255, 0x84, 0x80, 5]
    for at, value in enumerate((0x21 | pts >> 29 & 0x0E, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)):
        pes[:, 9 + at] = value & 255
    pes[:, PES_HEADER:] = units
    total = pes.shape[1]
    # The first packet has a field of 8 bytes with the clock; the last one is stuffed to its size.
    middle, rest = divmod(max(0, total - 176), 184)
    n_packets = 1 + middle + bool(rest)
    out = np.full((n, n_packets, PACKET), 255, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = STREAM_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = STREAM_PID & 255
    out[:, :, 3] = 0x10 | (counter + np.arange(n * n_packets).reshape(n, n_packets)) & 15
    out[:, 0, 3] |= 0x20
    held = min(176, total)
    out[:, 0, 4] = 183 - held  # 7, or more as stuffing for a short unit
    out[:, 0, 5] = 0x10 | np.where(number % RANDOM_EACH == 0, 0x40, 0)
    for at, value in enumerate((pts >> 25, pts >> 17, pts >> 9, pts >> 1, (pts & 1) << 7 | 0x7E, pts * 0)):
        out[:, 0, 6 + at] = value & 255
    out[:, 0, PACKET - held :] = pes[:, :held]
    if middle:
        out[:, 1 : 1 + middle, 4:] = pes[:, 176 : 176 + middle * 184].reshape(n, middle, 184)
    if rest:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = 183 - rest
        if rest < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = pes[:, total - rest :]
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload; the program tables come again at each random-access point."""
    data = np.frombuffer(payload, np.uint8)
    unit = FRAME * UNIT_FRAMES
    whole = len(data) // unit
    blocks, counter = [], 0
    for first in range(0, whole, RANDOM_EACH):
        part = _units(data[first * unit : min(whole, first + RANDOM_EACH) * unit].reshape(-1, unit), first, counter)
        counter += part.shape[0] * part.shape[1]
        blocks += [_TABLES[first // RANDOM_EACH & 15], part.tobytes()]
    if len(data) % unit:
        if whole % RANDOM_EACH == 0:
            blocks.append(_TABLES[whole // RANDOM_EACH & 15])
        blocks.append(_units(data[whole * unit :].reshape(1, -1), whole, counter).tobytes())
    return b"".join(blocks)


@dataclass
class Demuxed:
    payload: bytes
    pts: np.ndarray
    random_access: np.ndarray
    packets: int
    discontinuities: int
    doubled: int = 0
    damaged: int = 0


def _section(raw: bytes, table_id: int) -> bytes:
    at = 1 + raw[0]
    length = (raw[at + 1] & 15) << 8 | raw[at + 2] if at + 2 < len(raw) else 0
    section = raw[at : at + 3 + length]
    if length < 9 or raw[at] != table_id or crc32_mpeg(section) != 0:
        raise ValueError("a program table is damaged")
    return section[8:-4]


def _tables(packets: np.ndarray, table_id: int) -> bytes:
    """The body of a table that comes again and again; every copy is checked."""
    bodies = {_section(p, table_id) for p in {row.tobytes() for row in packets[:, 4:]}}
    if len(bodies) != 1:
        raise ValueError("the program changes")
    return bodies.pop()


def demux(media: bytes) -> Demuxed:
    """The first elementary stream of the first program."""
    if len(media) % PACKET or not media:
        raise ValueError("not whole transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync bytes are missing")
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 != 0
    pat = np.flatnonzero((pid == PAT_PID) & starts)
    if not len(pat):
        raise ValueError("no program association table")
    body = _tables(packets[pat], 0x00)
    pmt_pid = (body[2] & 31) << 8 | body[3]
    pmt = np.flatnonzero((pid == pmt_pid) & starts)
    if not len(pmt):
        raise ValueError("no program map table")
    body = _tables(packets[pmt], 0x02)
    skip = 4 + ((body[2] & 15) << 8 | body[3])
    stream_pid = (body[skip + 1] & 31) << 8 | body[skip + 2]
    own = packets[pid == stream_pid]
    counters = own[:, 3] & 15
    with_payload = own[:, 3] >> 4 & 1 == 1
    again = np.zeros(len(own), bool)
    again[1:] = (counters[1:] == counters[:-1]) & with_payload[1:] & with_payload[:-1]
    # A copy may differ in its clock only, so its payload is what counts.
    begin = np.where(own[:, 3] >> 4 & 2 != 0, 5 + own[:, 4].astype(np.int64), 4)
    for i in np.flatnonzero(again):
        again[i] = begin[i] == begin[i - 1] and (own[i, begin[i] :] == own[i - 1, begin[i] :]).all()
    if again.any():
        own = own[~again]
    control = own[:, 3] >> 4 & 3
    counters = own[:, 3] & 15
    with_payload = control & 1 == 1
    lost = int(((counters[1:] - counters[:-1] - with_payload[1:]) & 15 != 0).sum())
    field = control & 2 != 0
    begins = np.where(field, 5 + own[:, 4].astype(np.int64), 4)
    begins[~with_payload] = PACKET
    stream = own[np.arange(PACKET) >= begins[:, None]]
    unit_starts = own[:, 1] & 0x40 != 0
    at = np.concatenate([[0], np.cumsum(PACKET - begins)])[:-1][unit_starts]
    if not len(at) or (stream[at] != 0).any() or (stream[at + 1] != 0).any() or (stream[at + 2] != 1).any():
        raise ValueError("an elementary packet has no start code")
    header = 9 + stream[at + 8].astype(np.int64)
    stated = stream[at + 4].astype(np.int64) << 8 | stream[at + 5]
    damaged = int(((stated > 0) & (stated + 6 != np.diff(np.r_[at, len(stream)]))).sum())
    p = [stream[at + 9 + i].astype(np.int64) for i in range(5)]
    pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
    random = field[unit_starts] & (own[unit_starts, 4] > 0) & (own[unit_starts, 5] & 0x40 != 0)
    keep = np.ones(len(stream), bool)
    for i in range(int(header.max())):
        keep[at[header > i] + i] = False
    return Demuxed(stream[keep].tobytes(), pts, pts[random], len(packets), lost, int(again.sum()), damaged)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, bytes([PAD]))


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of (doc_id, text): the transport streams, stored in the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, media, held = 0, [], [], 0
            for i, text in enumerate(batch.column(1)):
                n, payload = padded(text.as_py())
                sizes.append(n)
                media.append(mux(payload))
                held += len(media[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    ids = batch.column(0).slice(at, len(media)).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, sizes, media, held = i + 1, [], [], 0

    return saved(docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary"), "media")


DECODED = "doc_id long, n_bytes long, payload binary, pts array<long>, random_access array<long>, packets long, discontinuities long, doubled long, damaged long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"


def read_media(media: DataFrame, with_payload: bool = True) -> DataFrame:
    """What the streams of (doc_id, n_bytes, media) hold: payload, timestamps, random-access points, counts and digests."""
    fields = [x.rsplit(" ", 1) for x in DECODED.split(", ")]
    fields = [f for f in fields if with_payload or f[0] != "payload"]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, (doc_id, n_bytes, stored) in enumerate(zip(*(batch.column(c) for c in range(3)), strict=True)):
                raw = stored.as_py()
                d = demux(raw)
                payload = [d.payload] if with_payload else []
                rows.append((doc_id.as_py(), n_bytes.as_py(), *payload, d.pts.tolist(), d.random_access.tolist(), d.packets, d.discontinuities, d.doubled, d.damaged, len(raw), hashlib.sha256(raw).hexdigest(), len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-32:])))
                held += len(d.payload) if with_payload else 8 * len(d.pts) + 200
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])
                    rows, held = [], 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, ", ".join(" ".join(f) for f in fields))
