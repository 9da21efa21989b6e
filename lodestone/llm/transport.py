"""Bytes in MPEG transport streams: a multiplexer, and a demultiplexer that takes any such stream apart.

A payload is cut into access units; each is an elementary packet (PES) with a
90 kHz timestamp, carried by packets of 188 bytes of one PID. Program tables
(PAT, PMT with their CRC) and a clock reference stand before every random-access
point. The demultiplexer works on all packets of a batch at once: it finds
the program's PID in the tables, checks continuity counters, joins the
elementary packets and lists their timestamps and random-access points.
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

from .common import bounded, flat, pieces, store

PACKET, BODY = 188, 184
BLOCK = 576  # payloads are padded with PAD to a positive multiple of it
PAD = 255
UNIT = 4 * BLOCK  # bytes of an access unit
TICKS = 3600  # between units, of a 90 kHz clock
EVERY = 16  # units from one random-access point to the next
TABLES_PID, STREAM_PID, PROGRAM = 0x1000, 0x100, 1
HEADER = 14  # of an elementary packet with one timestamp
CHUNK_BYTES = 2 << 20


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | TABLES_PID)))
PMT = _table_packet(TABLES_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, 0x06, 0xE000 | STREAM_PID, 0xF000)))


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes up to a positive multiple of BLOCK, filled with PAD."""
    size = np.diff(offsets)
    full = np.maximum(1, -(-size // BLOCK)) * BLOCK
    at = np.concatenate([[0], np.cumsum(full)])
    out = np.full(at[-1], PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], size)] = data
    return out, at


def multiplex(payload: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A transport stream for each payload, and where each begins."""
    size = np.diff(offsets)
    units = -(-size // UNIT)
    index = _ramp(units)  # of a unit in its payload
    owner = np.repeat(np.arange(len(size)), units)
    length = np.minimum(UNIT, size[owner] - index * UNIT)
    access = index % EVERY == 0
    packets = -(-(HEADER + length + 8 * access) // BODY)
    # elementary packets, one after another
    pes_at = np.concatenate([[0], np.cumsum(length + HEADER)])
    pes = np.empty(pes_at[-1], np.uint8)
    pes[np.arange(len(payload)) + HEADER * (np.repeat(np.arange(len(length)), length) + 1)] = payload
    pts = index * TICKS
    rest = length + HEADER - 6
    fields = [0, 0, 1, 0xBD, rest >> 8, rest, 0x80, 0x80, 5, 0x21 | (pts >> 29) & 0xE, pts >> 22, (pts >> 14) | 1, pts >> 7, (pts << 1) | 1]
    for k, value in enumerate(fields):
        pes[pes_at[:-1] + k] = np.asarray(value) & 0xFF
    # packets: two of tables before each random-access point
    rows = packets + 2 * access
    first = np.cumsum(rows) - rows + 2 * access
    out = np.full((int(rows.sum()), PACKET), PAD, np.uint8)
    at = np.repeat(first, packets) + _ramp(packets)
    unit = np.repeat(np.arange(len(units) and len(length)), packets)
    k = _ramp(packets)
    clock = access[unit] & (k == 0)
    room = BODY - 8 * clock
    before = np.where(k == 0, 0, k * BODY - 8 * access[unit])
    carried = np.minimum(room, length[unit] + HEADER - before)
    stuffing = BODY - carried  # bytes of the adaptation field, its length byte among them
    media = np.concatenate([[0], np.cumsum(packets)])
    begin_unit = np.cumsum(units) - units
    counter = np.arange(len(at)) - media[begin_unit[owner[unit]]]
    out[at, 0] = 0x47
    out[at, 1] = (STREAM_PID >> 8) | 0x40 * (k == 0)
    out[at, 2] = STREAM_PID & 0xFF
    out[at, 3] = 0x10 | 0x20 * (stuffing > 0) | counter & 15
    has = at[stuffing > 0]
    out[has, 4] = (stuffing[stuffing > 0] - 1).astype(np.uint8)
    flagged = at[stuffing > 1]
    out[flagged, 5] = np.where(clock[stuffing > 1], 0x50, 0)
    c, ticks = at[clock], pts[unit[clock]]
    for n, value in enumerate((ticks >> 25, ticks >> 17, ticks >> 9, ticks >> 1, ((ticks & 1) << 7) | 0x7E, 0 * ticks)):
        out[c, 6 + n] = value & 0xFF
    target = np.repeat(at * PACKET + PACKET - carried - (np.cumsum(carried) - carried), carried) + np.arange(len(pes))
    out.ravel()[target] = pes
    tables = first[access]
    turn = (index[access] // EVERY) & 15
    for row, packet in ((tables - 2, PAT), (tables - 1, PMT)):
        out[row] = packet
        out[row, 3] = 0x10 | turn
    per_text = np.add.reduceat(rows, begin_unit) if len(rows) else rows
    return out.ravel(), np.concatenate([[0], np.cumsum(per_text)]) * PACKET


_tables: dict[bytes, int] = {}


def _pid_in(section: bytes, table: int) -> int:
    """The first program's (PAT) or stream's (PMT) PID of a section whose CRC is right."""
    key = bytes([table]) + section
    if key not in _tables:
        if len(_tables) > 1000:
            _tables.clear()
        start = section[0] + 1
        end = start + 3 + (struct.unpack_from(">H", section, start + 1)[0] & 0xFFF)
        body = section[start:end]
        if body[0] != table or crc32_mpeg(body[:-4]) != struct.unpack(">I", body[-4:])[0]:
            raise ValueError("damaged program table")
        at = 8 if table == 0 else 12 + (struct.unpack_from(">H", body, 10)[0] & 0xFFF)
        _tables[key] = struct.unpack_from(">H", body, at + 2 if table == 0 else at + 1)[0] & 0x1FFF
    return _tables[key]


class Streams:
    """Transport streams of many rows taken apart; ``offsets`` tell where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        p = data.reshape(-1, PACKET)
        if (p[:, 0] != 0x47).any() or (offsets % PACKET).any():
            raise ValueError("not whole transport packets")
        self.packets = np.diff(offsets) // PACKET
        owner = np.repeat(np.arange(len(self.packets)), self.packets)
        pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
        start = (p[:, 1] & 0x40) > 0
        control = p[:, 3] >> 4 & 3
        begin = 4 + np.where(control & 2, 1 + p[:, 4].astype(np.int64), 0)
        stream = np.full(len(self.packets), -1)
        for k, row in enumerate((offsets[:-1] // PACKET).tolist()):  # tables differ by stream in general; equal ones are parsed once
            if self.packets[k] < 2:
                continue
            head = pid[row : row + self.packets[k]]
            pat = row + int(np.argmax((head == 0) & start[row : row + len(head)]))
            tables = _pid_in(p[pat, begin[pat] :].tobytes(), 0)
            pmt = row + int(np.argmax((head == tables) & start[row : row + len(head)]))
            stream[k] = _pid_in(p[pmt, begin[pmt] :].tobytes(), 2)
        self.pid = stream
        es = np.flatnonzero((pid == stream[owner]) & (control & 1 > 0))
        whose = owner[es]
        count = p[es, 3] & 15
        jump = (count[1:].astype(np.int64) - count[:-1]) & 15
        broken = (jump != 1) & (whose[1:] == whose[:-1])
        self.breaks = np.bincount(whose[1:][broken], minlength=len(self.packets))
        a = begin[es]
        unit = es[start[es]]
        u = begin[unit]
        flatp = p.ravel()
        base = unit * PACKET + u
        if len(unit) and ((flatp[base] != 0) | (flatp[base + 1] != 0) | (flatp[base + 2] != 1)).any():
            raise ValueError("damaged elementary packet")
        b = [flatp[base + k].astype(np.int64) for k in range(9, HEADER)]
        self.pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
        a = a + np.where(start[es], 9 + flatp[np.minimum(es * PACKET + a + 8, len(flatp) - 1)].astype(np.int64), 0)
        self.access = (control[unit] & 2 > 0) & (p[unit, 4] > 0) & (p[unit, 5] & 0x40 > 0)
        self.unit_owner, self.unit_at = owner[unit], unit * PACKET - offsets[owner[unit]]
        size = PACKET - a
        self.payload = flatp[np.repeat(es * PACKET + a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, size, len(self.packets)).astype(np.int64))])


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for i, j in pieces(offsets, CHUNK_BYTES):
            out, at = multiplex(*padded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            media = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), media.cast(pa.binary())], ["doc_id", "n_bytes", "media"])


def _rows(media: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Per stream: its payload's and its own digests, program and counts, and timestamp, place and kind of each elementary packet."""
    s = Streams(media, at)
    raw, stored = memoryview(np.ascontiguousarray(s.payload)), memoryview(np.ascontiguousarray(media))
    first = np.searchsorted(s.unit_owner, np.arange(len(at)))
    rows = []
    for k in range(len(at) - 1):
        body, whole, own = raw[s.offsets[k] : s.offsets[k + 1]], stored[at[k] : at[k + 1]], slice(first[k], first[k + 1])
        rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), int(s.pid[k]), int(s.packets[k]), int(s.breaks[k]), s.pts[own], s.unit_at[own], s.access[own], None))
    return rows


def _taken_apart(media: np.ndarray, at: np.ndarray) -> list[tuple]:
    """As :func:`_rows`, where a damaged stream costs its own row only."""
    try:
        return _rows(media, at)
    except (ValueError, IndexError, struct.error) as e:
        if len(at) > 2:
            return [row for k in range(len(at) - 1) for row in _taken_apart(media[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]))]
        none = np.zeros(0, np.int64)
        return [(None, None, None, len(media), hashlib.sha256(media.tobytes()).hexdigest(), None, None, None, none, none, none.astype(bool), str(e) or type(e).__name__)]


def _demux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(2))
        for i, j in pieces(offsets, CHUNK_BYTES):
            *plain, pts, places, access, damage = zip(*_taken_apart(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            many = np.concatenate([[0], np.cumsum([len(x) for x in pts])])
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pts, places, access)], ["pts", "at", "random_access"])
            columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *map(pa.array, plain), pa.array(damage, pa.string()), pa.ListArray.from_arrays(pa.array(many, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_null(c.type) and n not in TEXTS else c.cast(pa.string()) if pa.types.is_null(c.type) else c for n, c in zip(NAMES, columns)], NAMES)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pid", "packets", "breaks", "damage", "units"]
TEXTS = ("payload_sha256", "media_sha256", "damage")
SCHEMA = ", ".join(f"{n} {'string' if n in TEXTS else 'array<struct<pts: bigint, at: bigint, random_access: boolean>>' if n == 'units' else 'long'}" for n in NAMES)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (a transport stream), written to the shared folder and read again.

    Null and empty texts are one padded block. Repeated rows, null ids and
    empty tables are like any other; further columns are ignored.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return store(docs.mapInArrow(_mux, "doc_id long, n_bytes long, media binary"), "media")


def write_units(media: DataFrame) -> DataFrame:
    """Take every stored stream apart and store what was found, with each elementary packet's timestamp, place and whether it is a random-access point; read again.

    A stream that is no whole sequence of packets, or has damaged tables or
    packets, has no payload and no units, and ``damage`` says why.
    """
    bounded(media.sparkSession)
    return store(media.select("doc_id", "n_bytes", "media").mapInArrow(_demux, SCHEMA), "units")


def features(units: DataFrame) -> DataFrame:
    """Digest of every stream, its feature from the stored timestamps and random-access points; ``units`` comes last."""
    n = F.size("units")
    feature = F.concat_ws(
        ";",
        *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in (("pid", F.col("pid")), ("packets", F.col("packets")), ("units", n), ("access", F.size(F.filter("units", lambda u: u["random_access"]))), ("breaks", F.col("breaks")))],
        F.concat(F.lit("pts="), F.get("units", F.lit(0))["pts"].cast("string"), F.lit("-"), F.get("units", n - 1)["pts"].cast("string")),
    )
    damaged = F.concat(F.lit("damaged: "), "damage")
    return units.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.coalesce(damaged, feature).alias("feature"), "units")
