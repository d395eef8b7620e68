"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``to_transport`` multiplexes a payload into 188-byte packets: a program association table, a program map table, and
one elementary stream of private data whose access units start with an adaptation field that holds the random-access
flag and a clock reference, and a packet header with a presentation timestamp. ``from_transport`` reads only those
bytes: it checks sync bytes, table checksums and continuity counters, follows the tables to the stream, reassembles
its packets, and returns the payload with the timestamp and packet number of each random-access point.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
#: Payload is padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Bytes of payload in an access unit, and 90 kHz ticks between two of them.
ACCESS = 32768
TICKS = 3600
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _TABLE[c >> 24 ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(base: int) -> bytes:
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def to_transport(payload: bytes) -> bytes:
    out = [_TABLES]
    counter = 0
    for k, at in enumerate(range(0, len(payload), ACCESS)):
        unit = payload[at : at + ACCESS]
        pts = k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        field = b"\x50" + _clock(pts)  # random access and clock reference
        room = PACKET - 4 - 1 - len(field)
        if len(pes) < room:
            field += b"\xff" * (room - len(pes))
        first, rest = pes[: PACKET - 5 - len(field)], pes[PACKET - 5 - len(field) :]
        out.append(b"\x47" + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([0x30 | counter & 15, len(field)]) + field + first)
        counter += 1
        full, left = divmod(len(rest), PACKET - 4)
        packets = np.empty((full, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
        packets[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
        out.append(packets.tobytes())
        counter += full
        if left:
            stuffing = PACKET - 5 - left
            field = b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b""
            out.append(b"\x47" + ES_PID.to_bytes(2, "big") + bytes([0x30 | counter & 15, stuffing]) + field + rest[full * (PACKET - 4) :])
            counter += 1
    return b"".join(out)


def _sections(packets: np.ndarray, table_id: int) -> bytes:
    raw = packets[0, 5 + int(packets[0, 4]) :].tobytes()
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    if raw[0] != table_id or crc32_mpeg(raw[:size]):
        raise ValueError(f"bad program table {raw[0]:#x}")
    return raw[8 : size - 4]


def from_transport(media: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The payload, and (presentation timestamp, packet number) of each random-access point."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs = _sections(packets[pid == 0], 0x00)
    pmt = int.from_bytes(programs[2:4], "big") & 0x1FFF
    streams = _sections(packets[pid == pmt], 0x02)
    loop = streams[4 + (int.from_bytes(streams[2:4], "big") & 0xFFF) :]
    es = int.from_bytes(loop[1:3], "big") & 0x1FFF
    numbers = np.flatnonzero(pid == es)
    own = packets[numbers]
    control = own[:, 3] >> 4 & 3
    counters = own[control & 1 == 1, 3] & 15
    if (np.diff(counters.astype(np.int32)) % 16 != 1).any():
        raise ValueError("lost packets: a continuity counter jumps")
    begin = np.where(control & 2, 5 + own[:, 4].astype(np.int32), 4)
    body = own[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    sizes = PACKET - begin
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    random = (control & 2 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    units, points = [], []
    for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
        pes = body[ends[a] - sizes[a] : ends[b - 1]]
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("bad start of an elementary packet")
        size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if len(pes) != size + 6:
            raise ValueError("an elementary packet isn't whole")
        s = pes[9:14]
        pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        if random[a]:
            points.append((pts, int(numbers[a])))
        units.append(pes[head:])
    return b"".join(units), points


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary())]
            media = [to_transport(padded(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary): each whole text as a transport stream.

    A null text counts as empty; an empty one has a payload of 64 zero bytes. Null and repeated ids pass through, a
    row each; an empty table gives an empty one. Other columns are ignored. Streams leave a batch of at most 64 texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for x in batch.column(2):
            media = x.as_buffer().to_pybytes()
            payload, points = from_transport(media)
            sizes = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = sizes[sizes > 0] / len(payload)
            feature = f"packets={len(media) // PACKET};points={len(points)};last_pts={points[-1][0]};bits={-(share * np.log2(share)).sum():.3f}"
            for values, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), hashlib.sha256(media).hexdigest(), feature, [{"pts": p, "packet": n} for p, n in points]), strict=True):
                values.append(value)
        sizes = pa.array([len(x.as_buffer()) for x in batch.column(2)], pa.int64())
        arrays = [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), sizes, pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points"])


def read_back(media: DataFrame) -> DataFrame:
    """What the streams of ``store`` hold: sizes, digests, a feature string and the random-access points."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<pts:long,packet:long>>"
    return media.mapInArrow(_read, fields)
