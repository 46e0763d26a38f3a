"""Media columns: MPEG audio streams, written frame by frame and read back by resynchronising on frame headers.

The payload is a text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576. Every 576 bytes become the
ancillary data of one MPEG-1 layer III mono frame with an empty granule (digital silence to any decoder): header,
CRC-16, side information and the unit. A first frame carries the Xing table (frame and byte counts, 100 seek points),
an ID3v2 tag the number of bytes before filling. Frame sizes follow from bit rate, sampling rate and padding alone.

Nulls: a null text counts as empty, and a row with a null key gets a stream like any other. Equal texts and repeated rows
give equal streams. Any text length is allowed; streams are made one at a time, so memory follows the longest text of a
block. An empty table gives an empty result; only the key and the text of a table are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

UNIT = 576
#: Fixed values of the format: kbit/s by index for MPEG-1 and MPEG-2 layer III, Hz by version and index.
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Frames alternate between these bit rates (index, at 48 kHz 672 and 768 bytes), which makes the stream a variable-rate one.
RATE_INDEXES = (12, 13)
CRC_POLYNOMIAL = 0x8005


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLYNOMIAL, table << 1) & 0xFFFF
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, as frame headers and side information are protected (start 0xFFFF)."""
    value = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        value = ((value << 8) & 0xFFFF) ^ CRC[(value >> 8) ^ column]
    return value


def _header(rate_index: int) -> bytes:
    """MPEG-1 layer III, protected, 48 kHz, no padding bit, mono."""
    return bytes([0xFF, 0xFA, rate_index << 4 | 1 << 2, 3 << 6])


def _frame_bytes(rate_index: int) -> int:
    return 144 * RATES_1[rate_index] * 1000 // 48000


SIDE = bytes(17)
_HEADS = [(h := _header(i)) + struct.pack(">H", int(crc16(np.frombuffer(h[2:] + SIDE, np.uint8)[None])[0])) + SIDE for i in RATE_INDEXES]
_SIZES = [_frame_bytes(i) for i in RATE_INDEXES]


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    units = max(1, -(-len(raw) // UNIT))
    return raw.ljust(units * UNIT, b"\xff"), len(raw)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def write(data: bytes, n_bytes: int) -> bytes:
    """A stream with the payload data, a multiple of 576 bytes of which n_bytes count."""
    units = len(data) // UNIT
    value = b"\x00n_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _synchsafe(len(value)) + b"\0\0" + value
    tag = b"ID3\4\0\0" + _synchsafe(len(frame)) + frame
    sizes = np.array(_SIZES)[np.arange(units) % 2]
    starts = np.concatenate([[0], np.cumsum(sizes)]) + _SIZES[0]  # the table's own frame comes first
    total = int(starts[-1])
    seek = (starts[np.arange(100) * units // 100] * 256 // total).astype(np.uint8).tobytes()
    info = b"Xing" + struct.pack(">III", 7, units, total) + seek
    body = np.zeros(total, np.uint8)
    first = _HEADS[0] + info
    body[: len(first)] = np.frombuffer(first, np.uint8)
    cells = np.frombuffer(data, np.uint8).reshape(units, UNIT)
    for parity, (head, size) in enumerate(zip(_HEADS, _SIZES)):
        own = starts[parity:-1:2]
        if len(own):
            block = np.zeros((len(own), size), np.uint8)
            block[:, : len(head)] = np.frombuffer(head, np.uint8)
            block[:, len(head) : len(head) + UNIT] = cells[parity::2]
            body[own[:, None] + np.arange(size)] = block
    return tag + body.tobytes()


def header_at(data: bytes, at: int) -> tuple[int, int, int, int, int, bool] | None:
    """(frame bytes, samples, Hz, side information bytes, head bytes before it, protected) of a layer III header, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, protected = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3, not data[at + 1] & 1
    rate, hertz, padding, mode = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1, data[at + 3] >> 6
    if version == 1 or layer != 1 or rate in (0, 15) or hertz == 3:
        return None
    hz = HERTZ[version][hertz]
    kbit = (RATES_1 if version == 3 else RATES_2)[rate]
    size = (144 if version == 3 else 72) * kbit * 1000 // hz + padding
    side = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[version == 3, mode == 3]
    return size, 1152 if version == 3 else 576, hz, side, 6 if protected else 4, protected


def read(data: bytes) -> dict:
    """Frames, tags and table of a stream; bytes that belong to no frame are skipped until two headers follow each other.

    128 bytes at the end that begin with TAG are an ID3v1 tag, unless they lie in the audio that the table's byte count gives.
    Gives n_bytes (from the tag, or None), offsets and sizes of the audio frames, their payload units, sample count,
    Hz, xing (frames, bytes, table) or None, junk bytes skipped, and the number of frames with a wrong checksum.
    """
    at, n_bytes, xing, junk = 0, None, None, 0
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((x & 127) << s for x, s in zip(data[6:10], (21, 14, 7, 0)))
        p, end = 10, min(len(data), 10 + size)
        while p + 10 <= end and data[p : p + 4].strip(b"\0"):
            own = sum((x & 127) << s for x, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
            if data[p : p + 4] == b"TXXX":
                name, _, value = data[p + 11 : p + 10 + own].partition(b"\0")
                if name == b"n_bytes" and value.isdigit():
                    n_bytes = int(value)
            p += 10 + own
        at = end
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    offsets: list[int] = []
    kinds: list[tuple] = []
    while at < end:
        kind = header_at(data, at)
        if kind and at + kind[0] <= end and (at + kind[0] == end or header_at(data, at + kind[0]) or offsets):
            info = at + kind[4] + kind[3]
            if not offsets and xing is None and data[info : info + 4] in (b"Xing", b"Info"):
                flags = struct.unpack_from(">I", data, info + 4)[0]
                numbers = struct.unpack_from(f">{(flags & 1) + (flags >> 1 & 1)}I", data, info + 8)
                table = info + 8 + 4 * len(numbers)
                if flags & 2 and end < at + numbers[-1] <= len(data):
                    end = len(data)
                xing = (*numbers, data[table : table + 100] if flags & 4 else b"")
            else:
                offsets.append(at)
                kinds.append(kind)
            at += kind[0]
        else:
            at, junk = at + 1, junk + 1
            following = data.find(b"\xff", at, end)
            following = end if following < 0 else following
            junk, at = junk + following - at, following
    units, wrong = [], 0
    places = np.array(offsets, np.int64)
    raw = np.frombuffer(data, np.uint8)
    groups: dict[tuple, list[int]] = {}
    for i, kind in enumerate(kinds):
        groups.setdefault(kind, []).append(i)
    cells = [b""] * len(offsets)
    for (size, _, _, side, head, protected), members in groups.items():
        own = places[members]
        if protected:
            covered = raw[own[:, None] + np.r_[2:4, 6 : 6 + side]]
            stored = raw[own + 4].astype(np.uint32) << 8 | raw[own + 5]
            wrong += int((crc16(covered) != stored).sum())
        start, stop = head + side, min(size, head + side + UNIT)
        for i, row in zip(members, raw[own[:, None] + np.arange(start, stop)]):
            cells[i] = row.tobytes()
    units = b"".join(cells)
    return {
        "n_bytes": n_bytes, "offsets": places, "sizes": [k[0] for k in kinds], "payload": units, "xing": xing, "junk": junk, "bad_checksums": wrong,
        "samples": sum(k[1] for k in kinds), "hz": kinds[0][2] if kinds else 0,
    }


def features(stream: dict) -> str:
    """Exact duration (samples over Hz) and seek offsets: count, first, last and a digest of all."""
    places = stream["offsets"]
    seek = hashlib.sha256(places.astype("<i8").tobytes()).hexdigest()[:16]
    ends = f"{places[0]}..{places[-1]}" if len(places) else ""
    return f"samples={stream['samples']};hz={stream['hz']};frames={len(places)};seek={ends}:{seek};crc_errors={stream['bad_checksums']};junk={stream['junk']}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, key: str = "doc_id", text: str = "text", with_stream: bool = False) -> DataFrame:
    """Per document the stored stream's digest columns; with_stream adds media binary, frame_offsets and duration_s."""
    common.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            rows = []
            for doc, own in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                data = write(*payload(own))
                got = read(data)
                back = got["payload"]
                row = [doc, got["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(got)]
                rows.append(row + ([data, got["offsets"].tolist(), got["samples"] / got["hz"] if got["hz"] else 0.0] if with_stream else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.float64()][: 11 if with_stream else 8]
    schema = SCHEMA + ", media binary, frame_offsets array<long>, duration_s double" * with_stream
    names = [x.split()[0] for x in schema.split(", ")]
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)
