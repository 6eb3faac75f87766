"""Media columns as MPEG transport streams.

A payload is stored as the elementary stream of one program: units of UNIT bytes, each in a packetised
elementary packet of its own with a presentation timestamp, cut into transport packets of 188 bytes. Program
tables (PAT and PMT, with their CRC) open the stream and come again every TABLES units, where decoding can
start: those units are marked as random access points and the clock reference is stored there. Continuity
counters count on for each PID; stuffing sits in adaptation fields, so every payload byte is kept as it is.

``streams`` reads transport streams: it joins the sections of PAT and PMT over their packets, follows them to
every elementary PID of every program, checks sync bytes, transport errors, table CRCs and continuity counters,
joins the packets of each unit and lists timestamps, random access points and the units that are not whole. ``demux``
gives the first of the elementary streams.

Defined cases: a null text counts as empty; a payload is filled up with bytes 255 to a positive multiple of
576; repeated rows and equal texts give equal values; an empty table gives an empty one; other columns are
ignored; a stream that names no elementary PID has an empty payload. Nothing stops the reading: a lost or damaged
packet is counted, and so are tables with a wrong CRC; a packet that is sent again is counted and left out. A unit is
listed as broken where a packet of it is lost, where its start code is missing or where its length isn't the one
that it states.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, id_text, map_slices

PACKET, SYNC, UNIT, TABLES = 188, 0x47, 576, 32
PAT_PID, PMT_PID, MEDIA_PID, PRIVATE_STREAM = 0x0000, 0x0100, 0x0101, 0x06
CLOCK, FRAMES_PER_SECOND = 90_000, 25
TICKS = CLOCK // FRAMES_PER_SECOND
FILL = 255


def _crc_table() -> np.ndarray:
    """CRC-32 of program tables: polynomial 04C11DB7, highest bit first."""
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = ((table << np.uint64(1)) ^ np.where(table & np.uint64(1 << 31), np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    return table


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, extension >> 8, extension & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of 33-bit presentation timestamps, a row each."""
    t = ticks.astype(np.uint64) & np.uint64((1 << 33) - 1)
    parts = [0x21 | (t >> np.uint64(30) & np.uint64(7)) << np.uint64(1), t >> np.uint64(22) & np.uint64(255), 1 | (t >> np.uint64(15) & np.uint64(127)) << np.uint64(1), t >> np.uint64(7) & np.uint64(255), 1 | (t & np.uint64(127)) << np.uint64(1)]
    return np.stack(parts, 1).astype(np.uint8)


def _unstamp(rows: np.ndarray) -> np.ndarray:
    r = rows.astype(np.int64)
    return (r[:, 0] >> 1 & 7) << 30 | r[:, 1] << 22 | (r[:, 2] >> 1) << 15 | r[:, 3] << 7 | r[:, 4] >> 1


#: A unit with its header of 14 bytes fills three packets and a part of a fourth; the first also holds the
#: adaptation field: its length, its flags and, at random access points, six bytes of clock reference.
HEAD = 14
ADAPT = 8
FIRST = PACKET - 4 - ADAPT - HEAD
REST = [PACKET - 4, PACKET - 4]
LAST = UNIT - FIRST - sum(REST)


def _template() -> np.ndarray:
    out = np.full((4, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x10
    out[0, 1] |= 0x40
    out[0, 3] = out[3, 3] = 0x30
    out[0, 4], out[0, 5] = ADAPT - 1, 0x00
    length = UNIT + HEAD - 6
    out[0, 4 + ADAPT : 4 + ADAPT + HEAD] = [0, 0, 1, 0xBD, length >> 8, length & 255, 0x80, 0x80, 5, 0, 0, 0, 0, 0]
    stuffing = PACKET - 4 - LAST
    out[3, 4], out[3, 5] = stuffing - 1, 0x00
    return out


_UNIT_PACKETS = _template()


def padded(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``, a positive multiple of UNIT bytes."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    media = np.tile(_UNIT_PACKETS, (n, 1, 1))
    at = 4 + ADAPT + HEAD
    media[:, 0, at:] = units[:, :FIRST]
    media[:, 1, 4:] = units[:, FIRST : FIRST + REST[0]]
    media[:, 2, 4:] = units[:, FIRST + REST[0] : FIRST + sum(REST)]
    media[:, 3, PACKET - LAST :] = units[:, FIRST + sum(REST) :]
    media[:, :, 3] |= (np.arange(4 * n).reshape(n, 4) % 16).astype(np.uint8)
    ticks = np.arange(n, dtype=np.int64) * TICKS
    media[:, 0, at - 5 : at] = _stamp(ticks)
    entry = np.arange(n) % TABLES == 0
    base = ticks[entry]
    media[entry, 0, 5] = 0x50  # random access, clock reference
    reference = np.stack([base >> 25, base >> 17, base >> 9, base >> 1, (base & 1) << 7 | 0x7E, np.zeros_like(base)], 1)
    media[entry, 0, 6:12] = (reference & 255).astype(np.uint8)
    out = []
    for k, start in enumerate(range(0, n, TABLES)):
        for table in (_PAT, _PMT):
            packet = table.copy()
            packet[3] |= k % 16
            out.append(packet.tobytes())
        out.append(media[start : start + TABLES].tobytes())
    return b"".join(out)


@dataclass
class Demuxed:
    """One elementary stream; packets, table_errors and damaged are those of the whole transport stream."""

    program: int = 0
    pid: int = 0
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    unit_lengths: list[int] = field(default_factory=list)
    broken: list[int] = field(default_factory=list)
    packets: int = 0
    table_errors: int = 0
    discontinuities: int = 0
    damaged: int = 0


class Packets:
    """The good packets of a stream and the fields of their headers."""

    def __init__(self, stream: bytes):
        rows = np.frombuffer(stream, np.uint8, len(stream) // PACKET * PACKET).reshape(-1, PACKET)
        good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
        self.damaged = int((~good).sum()) + bool(len(stream) % PACKET)
        self.rows = rows = rows[good]
        self.pid = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
        self.start, control, self.counter = rows[:, 1] & 0x40 != 0, rows[:, 3] >> 4 & 3, (rows[:, 3] & 15).astype(np.int64)
        self.adapt = np.where(control >= 2, rows[:, 4].astype(np.int64) + 1, 0)
        self.offset = np.minimum(PACKET, 4 + self.adapt)
        self.has_payload = control & 1 == 1
        self.wrong = 0

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(packets of the PID with a payload, which of them follow a gap, how many were sent again and left out)."""
        own = np.flatnonzero((self.pid == pid) & self.has_payload)
        step = np.diff(self.counter[own], prepend=self.counter[own[:1]] - 1) % 16
        same = np.flatnonzero(step == 0)
        again = same[(self.rows[own[same]] == self.rows[own[same - 1]]).all(1)]
        keep = np.ones(len(own), bool)
        keep[again] = False
        return own[keep], step[keep] != 1, len(again)

    def sections(self, pid: int, table_id: int) -> list[bytes]:
        """The distinct sections of a table whose CRC is right; others are counted in ``wrong``."""
        found: dict[bytes, bool] = {}
        own, gap, _ = self.of(pid)
        held = b""
        for i, lost in zip(own.tolist(), gap.tolist(), strict=True):
            data = self.rows[i, self.offset[i] :].tobytes()
            if lost:
                held = b""
            if not self.start[i]:
                held = self._take(held + data, table_id, found) if held else b""
                continue
            pointer = data[0] if data else 0
            if held:
                self._take(held + data[1 : 1 + pointer], table_id, found)
            held = self._take(data[1 + pointer :], table_id, found)
        return [section for section, right in found.items() if right]

    def _take(self, data: bytes, table_id: int, found: dict[bytes, bool]) -> bytes:
        """Takes whole sections from the start of ``data`` and returns what is left of an unfinished one."""
        while len(data) >= 3 and data[0] != FILL:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                return data
            if data[0] == table_id:
                section = data[:size]
                if section not in found:
                    found[section] = size > 11 and section_crc(section) == 0
                self.wrong += not found[section]
            data = data[size:]
        return data if data and data[0] != FILL else b""


def streams(stream: bytes) -> list[Demuxed]:
    """Every elementary stream, in the order of the tables."""
    packets = Packets(stream)
    programs: dict[int, int] = {}
    for pat in packets.sections(PAT_PID, 0):
        for i in range(8, len(pat) - 7, 4):
            number = int.from_bytes(pat[i : i + 2], "big")
            if number:  # 0 names the network's table
                programs.setdefault(number, int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF)
    gaps = int(packets.of(PAT_PID)[1].sum()) + packets.of(PAT_PID)[2]
    named: dict[tuple[int, int], None] = {}
    for number, table in programs.items():
        _, lost, again = packets.of(table)
        gaps += int(lost.sum()) + again
        for pmt in packets.sections(table, 2):
            if int.from_bytes(pmt[3:5], "big") != number:
                continue
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            while at + 5 <= len(pmt) - 4:
                named.setdefault((number, int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
                at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    found = [_elementary(packets, number, pid) for number, pid in named]
    for x in found:
        x.packets, x.table_errors, x.damaged, x.discontinuities = len(packets.rows), packets.wrong, packets.damaged, x.discontinuities + gaps
    return found or [Demuxed(packets=len(packets.rows), table_errors=packets.wrong, damaged=packets.damaged, discontinuities=gaps)]


def _elementary(packets: Packets, program: int, pid: int) -> Demuxed:
    own, lost, again = packets.of(pid)
    out = Demuxed(program, pid, discontinuities=int(lost.sum()) + again)
    begins = packets.start[own]
    if not begins.any():
        return out
    own, begins, lost = own[np.argmax(begins) :], begins[np.argmax(begins) :], lost[np.argmax(begins) :]
    rows, at, heads = packets.rows[own], packets.offset[own].copy(), np.flatnonzero(begins)
    first = rows[heads]
    header = np.take_along_axis(first, np.minimum(PACKET - 1, at[heads][:, None] + np.arange(HEAD)), 1).astype(np.int64)
    whole = (at[heads] + 9 <= PACKET) & (header[:, 0] == 0) & (header[:, 1] == 0) & (header[:, 2] == 1)
    at[heads] += np.where(whole, 9 + header[:, 8], 0)
    whole &= at[heads] <= PACKET
    stamped = whole & (header[:, 7] & 0x80 != 0) & (header[:, 8] >= 5)
    marked = (packets.adapt[own[heads]] > 1) & (first[:, 5] & 0x40 != 0)
    mask = np.arange(PACKET) >= at[:, None]
    sizes = np.add.reduceat(mask.sum(1), heads)
    stated = header[:, 4] << 8 | header[:, 5]  # 0 where it is left open
    # a gap that a unit's start shows belongs to the unit before as well
    gap = np.maximum.reduceat(lost & ~begins, heads)
    gap[:-1] |= lost[heads[1:]]
    broken = ~whole | gap | (stated != 0) & (sizes != stated - 3 - header[:, 8])
    out.payload, out.timestamps, out.random_access = rows[mask].tobytes(), _unstamp(header[:, 9:14])[stamped].tolist(), np.flatnonzero(marked).tolist()
    out.unit_lengths, out.broken = sizes.tolist(), np.flatnonzero(broken).tolist()
    return out


def demux(stream: bytes) -> Demuxed:
    """The first elementary stream."""
    return streams(stream)[0]


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8 bytes, filled up, as a transport stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [t.encode() for t in batch.column("text").to_pylist()]
        return batch_of(doc_id=(batch.column("doc_id"), None), n_bytes=(list(map(len, data)), pa.int64()), media=([mux(padded(d)) for d in data], pa.binary()))

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary", "text")


def demuxed(df: DataFrame, media_col: str = "media") -> DataFrame:
    """(doc_id, program, pid, payload, timestamps, random_access, broken, packets, table_errors, discontinuities,
    damaged): a row for each elementary stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, x) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) for x in streams(m or b"")]
        values = lambda name: [getattr(x, name) for _, x in found]
        return batch_of(
            doc_id=([i for i, _ in found], pa.int64()), program=(values("program"), pa.int32()), pid=(values("pid"), pa.int32()), payload=(values("payload"), pa.binary()), timestamps=(values("timestamps"), pa.list_(pa.int64())),
            **{name: (values(name), pa.list_(pa.int32())) for name in ("random_access", "broken")}, **{name: (values(name), pa.int32()) for name in ("packets", "table_errors", "discontinuities", "damaged")},
        )

    schema = "doc_id long, program int, pid int, payload binary, timestamps array<long>, random_access array<int>, broken array<int>, packets int, table_errors int, discontinuities int, damaged int"
    return map_slices(df.select("doc_id", df[media_col].alias("media")), run, schema, "media")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What op8 returns of the stored streams and of what ``demux`` reads back from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column("media").to_pylist():
            x = demux(media)
            out["payload_bytes"].append(len(x.payload))
            out["payload_sha256"].append(hashlib.sha256(x.payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(x.payload[-32:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"program={x.program} pid={x.pid} packets={x.packets} units={len(x.unit_lengths)} pts={'..'.join(map(str, x.timestamps[:1] + x.timestamps[-1:])) or 'none'} random_access={len(x.random_access)} errors={x.table_errors + x.discontinuities + x.damaged}")
        kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
        return batch_of(doc_id=(batch.column("doc_id"), None), n_bytes=(batch.column("n_bytes"), None), **{k: (v, kinds.get(k, pa.string())) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_slices(with_media(df, id_col, text_col), run, schema, "media")
