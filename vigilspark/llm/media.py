"""Media columns: MPEG transport streams.

A payload is stored as one program of 188-byte packets: program tables (PAT and PMT with their checksums) before each
random-access point, and elementary packets with presentation timestamps. Reading parses the tables, checks the
continuity counters, reassembles the elementary packets of every stream that the tables list, and gives timestamps with
the random-access points. A packet may come twice in a row, and a counter may jump where the stream says so (the
discontinuity flag), as the format allows.

Defined cases: a null text is an empty payload; the payload is padded with bytes 0 to a positive multiple of 64; equal
payloads give equal streams; a damaged, empty or incomplete stream raises ValueError naming the packet; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common

# Fixed values of the transport-stream format (ISO/IEC 13818-1).
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_STREAM, PRIVATE_PES = 0xBD, 0x06
CLOCK = 90_000

UNIT = 4096  # payload bytes of one elementary packet
TICKS = 3600  # clock ticks between elementary packets (25 a second)
GROUP = 8  # elementary packets between random-access points
BLOCK = 64

MEDIA = "doc_id bigint, n_bytes bigint, media binary"
PARSED = "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, payload binary, pts array<bigint>, random_access array<boolean>, packets bigint"


@lru_cache(maxsize=256)
def psi_crc(section: bytes) -> int:
    """The CRC-32 of program tables: polynomial 04C11DB7, most significant bit first, start all ones."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + psi_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> tuple[bytes, bytes]:
    """The packet without its counter: what comes before and after the byte that holds it."""
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255]), b"\x00" + section.ljust(PACKET - 5, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))
_DATA = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | c]) for c in range(16)]


def _pts(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 255, 0x01 | (t >> 14) & 0xFE, t >> 7 & 255, 0x01 | (t << 1) & 0xFE])


def _pcr(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return (t >> 1).to_bytes(4, "big") + bytes([(t & 1) << 7 | 0x7E, 0])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one private elementary stream."""
    out: list[bytes] = []
    counter = tables = 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        ticks = n * TICKS
        access = n % GROUP == 0
        if access:
            for before, after in (_PAT, _PMT):
                out += (before, bytes([0x10 | tables & 15]), after)
            tables += 1
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + unit
        field_ = (b"\x50" + _pcr(ticks)) if access else b""
        pos, first = 0, True
        while pos < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            take = min(room, len(pes) - pos)
            if take == PACKET - 4 and not first:
                out += (_DATA[counter], pes[pos : pos + take])
            else:
                adapted = bool(field_) or take < PACKET - 4
                head = bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 255, (0x30 if adapted else 0x10) | counter])
                if adapted:
                    size = PACKET - 5 - take
                    head += bytes([size]) + ((field_ or b"\x00").ljust(size, b"\xff") if size else b"")
                out += (head, pes[pos : pos + take])
            counter = (counter + 1) & 15
            pos += take
            first, field_ = False, b""
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream as read back."""

    units: list[bytes] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(self.units)


def _checked(section: bytes, table: int, at: int) -> bytes:
    """The body of a program table in one packet."""
    size = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    if size < 12 or size > len(section) or section[0] != table or psi_crc(section[: size - 4]) != int.from_bytes(section[size - 4 : size], "big"):
        raise ValueError(f"packet {at}: damaged program table")
    return section[8 : size - 4]


def _unit(parts: list[bytes], into: Stream, access: bool, at: int) -> None:
    pes = b"".join(parts)
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
        raise ValueError(f"packet {at}: no elementary packet starts here")
    size = int.from_bytes(pes[4:6], "big") + 6
    if len(pes) != size:
        raise ValueError(f"packet {at}: an elementary packet of {size} bytes has {len(pes)}")
    head = 9 + pes[8]
    if head > size or pes[7] & 0x80 and head < 14:
        raise ValueError(f"packet {at}: the header of an elementary packet is cut off")
    p = pes[9:14]
    into.pts.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else -1)
    into.random_access.append(access)
    into.units.append(pes[head:])


def _packets(media: bytes) -> Iterator[tuple[int, int, bool, bool, bytes]]:
    """(number, identifier, starts a unit, random access, payload) of each packet that has a payload, once."""
    counters: dict[int, tuple[int, bytes]] = {}
    for n, at in enumerate(range(0, len(media), PACKET)):
        sync, hi, lo, flags = media[at : at + 4]
        if sync != SYNC or hi & 0x80:
            raise ValueError(f"packet {n}: lost synchronisation")
        pid, start, access, jump = (hi & 0x1F) << 8 | lo, at + 4, False, False
        if flags & 0x20:
            size = media[start]
            if size > PACKET - 5:
                raise ValueError(f"packet {n}: an adaptation field of {size} bytes")
            access, jump = (bool(media[start + 1] & 0x40), bool(media[start + 1] & 0x80)) if size else (False, False)
            start += 1 + size
        if not flags & 0x10:
            continue
        body = media[start : at + PACKET]
        was = counters.get(pid)
        if was is not None and not jump and flags & 15 != (was[0] + 1) & 15:
            if flags & 15 == was[0] and body == was[1]:
                counters[pid] = (was[0], b"")  # the one repetition that is allowed
                continue
            raise ValueError(f"packet {n}: continuity counter {flags & 15} after {was[0]} on {pid:#x}")
        counters[pid] = (flags & 15, body)
        yield n, pid, bool(hi & 0x40), access, body


def demux(media: bytes) -> dict[int, Stream]:
    """The elementary streams by packet identifier."""
    if not media or len(media) % PACKET:
        raise ValueError(f"packet {len(media) // PACKET}: not a whole number of packets")
    maps: set[int] = set()
    streams: dict[int, Stream] = {}
    open_: dict[int, tuple[list[bytes], bool, int]] = {}
    for n, pid, first, access, body in _packets(media):
        if pid in streams:
            if first:
                if pid in open_:
                    _unit(open_[pid][0], streams[pid], *open_[pid][1:])
                open_[pid] = ([body], access, n)
            elif pid in open_:
                open_[pid][0].append(body)
            else:
                raise ValueError(f"packet {n}: the start of an elementary packet is missing")
        elif pid == PAT_PID or pid in maps:
            if not body or 1 + body[0] >= len(body):
                raise ValueError(f"packet {n}: damaged program table")
            rows = _checked(body[1 + body[0] :], 0 if pid == PAT_PID else 2, n)
            if pid == PAT_PID:
                maps |= {int.from_bytes(rows[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(rows), 4) if rows[i : i + 2] != b"\x00\x00"}
                continue
            i = 4 + (int.from_bytes(rows[2:4], "big") & 0xFFF)
            while i + 5 <= len(rows):
                streams.setdefault(int.from_bytes(rows[i + 1 : i + 3], "big") & 0x1FFF, Stream())
                i += 5 + (int.from_bytes(rows[i + 3 : i + 5], "big") & 0xFFF)
    for pid, held in open_.items():
        _unit(held[0], streams[pid], *held[1:])
    if not any(s.units for s in streams.values()):
        raise ValueError(f"packet {len(media) // PACKET}: the program tables list no stream with a packet")
    return streams


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def transport_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded and stored as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            for i, j in common.row_chunks(offs):
                texts = [data[offs[k] : offs[k + 1]].tobytes() for k in range(i, j)]
                media = pa.array([mux(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[bytes, Stream]]:
    for media in batch.column(2):
        raw = media.as_py()
        yield raw, next(s for s in demux(raw).values() if s.units)


def parse_streams(media: DataFrame) -> DataFrame:
    """Reads stored streams back: payload, timestamps and random-access points (see PARSED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = list(_parsed(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(r) for r, _ in found], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r, _ in found]), pa.array([s.payload for _, s in found], pa.binary()), pa.array([s.pts for _, s in found], pa.list_(pa.int64())), pa.array([s.random_access for _, s in found], pa.list_(pa.bool_())), pa.array([len(r) // PACKET for r, _ in found], pa.int64())],
                    names=[c.split()[0] for c in PARSED.split(", ")],
                )

    return common.pick(media, "doc_id", "n_bytes", "media").mapInArrow(run, PARSED)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pts array<bigint>, random_access array<bigint>"


def stored_streams(docs: DataFrame) -> DataFrame:
    """The media table of `docs`, written in the shared folder and read back."""
    media = transport_streams(docs)
    path = f"{common.shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


def stream_digests(media: DataFrame) -> DataFrame:
    """Parses stored streams in the tasks and returns digests, a feature, all timestamps, and the timestamps of the
    random-access points of each (see DIGEST)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for doc, n, (raw, s) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _parsed(batch), strict=True):
                p = s.payload
                samples = np.frombuffer(p, np.uint8)
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), f"units={len(s.units)};access={sum(s.random_access)};pts={s.pts[0]}-{s.pts[-1]};sum={int(samples.sum(dtype=np.int64))};high={int((samples > 127).sum())}", s.pts, [t for t, a in zip(s.pts, s.random_access, strict=True) if a]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.list_(pa.int64()) if k > 7 else pa.int64()) for k, c in enumerate(cols)], names=names)

    return common.pick(media, "doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
