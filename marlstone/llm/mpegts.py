"""Media columns: payloads in MPEG transport streams.

``mux`` stores bytes as one private elementary stream of a program: PAT and PMT
sections, PES packets with presentation time stamps, random-access flags and
clock references, cut into 188-byte packets.  ``demux`` reads any transport
stream: it finds the packet grid, parses program tables (checking their CRC),
checks the continuity counters of every stream, puts elementary packets
together again and lists their time stamps with the random-access points.
Packets are handled as a numpy array of rows, not one by one.

Defined results: null and empty texts are stored as 64 zero bytes, so every row
has a stream; a stream without a packet grid has no programs; an empty table
gives an empty result; equal texts give equal streams.  Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, prepare, record_batch, slices, staged, table

PACKET = 188
SYNC = 0x47
PMT_PID, ES_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
PAD = 64
#: Bytes of payload in one elementary packet; every GROUP-th can be entered at.
UNIT, GROUP = 8192, 4
CLOCK, TICK = 90_000, 3_600
FIRST_PTS = 90_000


@lru_cache(maxsize=4096)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: most significant bit first, nothing inverted at the end."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = _section(
    2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])
)


def _head(pid: int, start: bool, counter: int, adaptation: bool) -> bytes:
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | counter & 15])


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (_head(pid, True, counter, False) + b"\0" + section).ljust(PACKET, b"\xff")


def _stamp(prefix: int, value: int) -> bytes:
    return bytes(
        [prefix << 4 | value >> 29 & 0x0E | 1, value >> 22 & 255, value >> 14 & 0xFE | 1, value >> 7 & 255, value << 1 & 0xFE | 1]
    )


def _adaptation(flags: int, fields: bytes, total: int) -> bytes:
    """An adaptation field of ``total`` bytes with its length byte."""
    if total == 1:
        return b"\0"
    return (bytes([total - 1, flags]) + fields).ljust(total, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        part, pts = payload[at : at + UNIT], FIRST_PTS + number * TICK
        entry = number % GROUP == 0
        if entry:
            out += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        length = len(part) + 8
        pes = b"\0\0\x01\xbd" + length.to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + part
        pcr = (pts - TICK) << 15 | 0x3F << 9
        fields, flags, fixed = (pcr.to_bytes(6, "big"), 0x50, 8) if entry else (b"", 0, 0)
        room = PACKET - 4 - fixed
        size = max(fixed, PACKET - 4 - len(pes)) if len(pes) < room else fixed
        first = pes[: PACKET - 4 - size]
        out.append(_head(ES_PID, True, counter, size > 0) + (_adaptation(flags, fields, size) if size else b"") + first)
        counter += 1
        full, rest = divmod(len(pes) - len(first), PACKET - 4)
        if full:
            rows = np.empty((full, PACKET), dtype=np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            rows[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
            rows[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), len(first)).reshape(full, PACKET - 4)
            out.append(rows.tobytes())
            counter += full
        if rest:
            out.append(_head(ES_PID, False, counter, True) + _adaptation(0, b"", PACKET - 4 - rest) + pes[-rest:])
            counter += 1
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: stamps, its first transport packet, its data."""

    pts: int | None
    dts: int | None
    packet: int
    random_access: bool
    data: bytes


@dataclass
class Stream:
    kind: int
    program: int
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    damaged: int = 0


@dataclass
class Transport:
    packets: int = 0
    lost_bytes: int = 0
    crc_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)


def _grid(data: bytes) -> tuple[np.ndarray, int]:
    """Packets on the grid of sync bytes, and bytes that lie outside it."""
    n = len(data) // PACKET
    rows = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    if len(data) == n * PACKET and (rows[:, 0] == SYNC).all():
        return rows, 0
    raw, kept, at = np.frombuffer(data, np.uint8), [], 0
    while at + PACKET <= len(raw):
        ahead = raw[at :: PACKET][: (len(raw) - at) // PACKET]
        wrong = np.nonzero(ahead != SYNC)[0]
        good = int(wrong[0]) if len(wrong) else len(ahead)
        if good >= 2 or (good and at + (good + 1) * PACKET > len(raw)):
            kept.append(raw[at : at + good * PACKET].reshape(good, PACKET))
            at += good * PACKET
        else:  # look for the next two sync bytes one packet apart
            later = np.nonzero((raw[at + 1 : len(raw) - PACKET] == SYNC) & (raw[at + 1 + PACKET :] == SYNC))[0]
            if not len(later):
                break
            at += 1 + int(later[0])
    rows = np.concatenate(kept) if kept else np.empty((0, PACKET), np.uint8)
    return rows, len(data) - rows.size


def _sections(bodies: list[bytes], starts: list[bool]) -> Iterator[bytes]:
    """Table sections from the payloads of one pid's packets."""
    held = b""
    going = False
    for body, start in zip(bodies, starts, strict=True):
        if start and body:
            pointer = body[0]
            held = (held + body[1 : 1 + pointer], body[1 + pointer :])[1] if not going else held + body[1 : 1 + pointer]
            if going:
                yield from _complete(held)
                held = body[1 + pointer :]
            going = True
        elif going:
            held += body
    yield from _complete(held)


def _complete(held: bytes) -> Iterator[bytes]:
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return
        yield held[:size]
        held = held[size:]


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Transport:
    """Programs and streams of a transport stream."""
    rows, lost = _grid(data)
    out = Transport(len(rows), lost)
    if not len(rows):
        return out
    head = rows[:, :6].astype(np.int32)
    pid = (head[:, 1] & 0x1F) << 8 | head[:, 2]
    start = head[:, 1] & 0x40 > 0
    control, counter = head[:, 3] >> 4 & 3, head[:, 3] & 15
    adapts = (control & 2) > 0
    begin = np.where(adapts, 5 + head[:, 4], 4)
    flags = np.where(adapts & (head[:, 4] > 0), head[:, 5], 0)
    usable = ((control & 1) > 0) & (head[:, 1] & 0x80 == 0) & (head[:, 3] >> 6 == 0) & (begin <= PACKET)

    def tables(of: int) -> Iterator[bytes]:
        at = np.nonzero((pid == of) & usable)[0]
        for s in _sections([rows[i, begin[i] :].tobytes() for i in at], [bool(start[i]) for i in at]):
            if crc_mpeg(s[:-4]) == int.from_bytes(s[-4:], "big"):
                yield s
            else:
                out.crc_errors += 1

    for s in tables(0):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                if number := s[k] << 8 | s[k + 1]:
                    out.programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    for number, at in out.programs.items():
        for s in tables(at):
            k = 12 + ((s[10] & 0x0F) << 8 | s[11]) if s[0] == 2 else len(s)
            while k + 5 <= len(s) - 4:
                out.streams.setdefault((s[k + 1] & 0x1F) << 8 | s[k + 2], Stream(s[k], number))
                k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    for of, stream in out.streams.items():
        _read_stream(stream, rows, np.nonzero((pid == of) & usable)[0], start, counter, begin, flags)
    return out


def _read_stream(stream: Stream, rows, at, start, counter, begin, flags) -> None:
    stream.packets = len(at)
    if not len(at):
        return
    step = (counter[at[1:]] - counter[at[:-1]]) & 15
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (step == 0) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(axis=1)
    broken = np.zeros(len(at), dtype=bool)
    broken[1:] = (step != 1) & ~again[1:] & (flags[at[1:]] & 0x80 == 0)
    stream.duplicates, stream.continuity_errors = int(again.sum()), int(broken.sum())
    at, broken = at[~again], broken[~again]
    body = rows[at][np.arange(PACKET)[None, :] >= begin[at][:, None]].tobytes()
    ends = np.cumsum(PACKET - begin[at])
    firsts = np.nonzero(start[at])[0]
    bounds = np.append(ends[firsts] - (PACKET - begin[at[firsts]]), ends[-1]).tolist()
    errors = np.add.reduceat(broken[firsts[0] :], firsts - firsts[0]).tolist() if len(firsts) else []
    for n, i in enumerate(firsts.tolist()):
        pes = body[bounds[n] : bounds[n + 1]]
        if len(pes) < 9 or pes[:3] != b"\0\0\x01":
            stream.damaged += 1
            continue
        size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        pts = _unstamp(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
        dts = _unstamp(pes[14:19]) if pes[7] & 0x40 and len(pes) >= 19 else None
        unit = pes[skip : 6 + size] if size else pes[skip:]
        if errors[n] or size and len(pes) < 6 + size:
            stream.damaged += 1
        stream.units.append(Unit(pts, dts, int(at[i]), bool(flags[at[i]] & 0x40), unit))


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of PAD."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b"\0")


MEDIA = "doc_id long, n_bytes long, media binary"
POINTS = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, timeline array<struct<pts: long, packet: long, random_access: boolean>>"
)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in slices(batches, "text", 4 << 20):
        texts = as_bytes(batch.column("text"))
        yield record_batch(
            {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": [mux(padded(t)) for t in texts]}, schema
        )


def described(media: bytes) -> dict:
    """What the stored bytes hold, as they are read back."""
    found = demux(media)
    of, stream = next(iter(found.streams.items()), (None, Stream(0, 0)))
    payload = b"".join(u.data for u in stream.units)
    stamps = [u.pts for u in stream.units if u.pts is not None]
    text = (
        f"programs={len(found.programs)};pid={of};type={stream.kind};packets={found.packets};units={len(stream.units)};"
        f"entries={sum(u.random_access for u in stream.units)};pts={stamps[0] if stamps else '-'}..{stamps[-1] if stamps else '-'};"
        f"continuity_errors={stream.continuity_errors};crc_errors={found.crc_errors};lost={found.lost_bytes}"
    )
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-PAD:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": text,
        "timeline": [{"pts": u.pts, "packet": u.packet, "random_access": u.random_access} for u in stream.units],
    }


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timeline")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), POINTS)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *zip(names, kinds, strict=True)])
    for batch in slices(batches, "media", 4 << 20):
        rows = [described(m) for m in as_bytes(batch.column("media"))]
        columns = {n: [r[n] for r in rows] for n in names}
        yield record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **columns}, schema)


def stored(docs: DataFrame) -> DataFrame:
    """A table of transport streams (doc_id, n_bytes, media) in the shared folder."""
    prepare(docs.sparkSession)
    return staged(docs.select("doc_id", "text").mapInArrow(_encode, MEDIA), "media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents")).mapInArrow(_decode, FEATURES)
