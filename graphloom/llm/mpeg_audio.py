"""MPEG audio in a binary column: frame headers, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

`parse` reads any stream of MPEG 1, 2 and 2.5 frames of layers I, II and III: it skips an ID3v2 tag at the front and an
ID3v1 tag at the end, resynchronises on a header that a second header or the end of the stream follows at the frame's
length, reads the Xing, Info or VBRI table of the first frame with its seek entries and the encoder's delay and padding,
and checks the CRC-16 of protected frames of every layer.  A free-format stream's frame length is the distance of its
first two headers.  The duration is exact: samples, without delay and padding, and sample rate are integers.

`wrap` is the lossless container: silent layer III frames (48 kHz, one channel, CRC) whose ancillary bytes carry the
payload, at the least bitrate that holds what is left, so the last frames make the stream variable-bitrate; an Info
frame holds the frame count, the byte count and the 100-entry seek table.  A frame's ancillary part is found from its
header alone, so reading the payload back needs nothing but the stream.

Defined cases: a null text is empty; its payload is 64 zero bytes; bytes that no frame covers are counted as skipped; a
stream without frames has duration 0; a table that promises more than its frame holds gives what is there; texts of any
length are stored whole; repeated rows stay and equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C

UNIT = 64
#: Bytes within which a free-format frame ends.
MOST_FREE = 8192
# Fixed values of the MPEG audio formats (ISO 11172-3 and 13818-3): kbit/s by index, Hz by index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {10: (44100, 48000, 32000), 20: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {3: 10, 2: 20, 0: 25}


@dataclass(frozen=True)
class Header:
    version: int  # 10, 20 or 25
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int  # 0 in free format
    samples: int
    pad: int  # bytes of padding, which size holds
    bound: int  # subbands with an allocation for each channel, of layers I and II

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 10 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at this byte, or None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = VERSIONS.get(b >> 3 & 3), 4 - (b >> 1 & 3)
    bits, hz = c >> 4, c >> 2 & 3
    if version is None or layer == 4 or bits == 15 or hz == 3 or d & 3 == 2:
        return None
    kbits, rate = KBITS[1 if version == 10 else 2, layer][bits], RATES[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 10 else 576
    pad = (c >> 1 & 1) * (4 if layer == 1 else 1)
    size = 12_000 * kbits // rate * 4 + pad if layer == 1 else samples * 125 * kbits // rate + pad
    return Header(version, layer, not b & 1, kbits, rate, d >> 6 == 3, size if bits else 0, samples, pad, 4 * (d >> 4 & 3) + 4 if d >> 6 == 1 else 32)


def _free_size(data: bytes, at: int, h: Header) -> int:
    """Bytes of a free-format frame without padding: up to the next header of its kind that a third follows as far on; 0 if there is none."""
    alike = lambda x: x and not x.size and (x.version, x.layer, x.rate) == (h.version, h.layer, h.rate)
    to = at
    while 0 <= (to := data.find(data[at : at + 1], to + 1, at + MOST_FREE)):
        if to - at > 24 and alike(second := header(data, to)):
            size = to - at - h.pad
            third = to + size + second.pad
            if third == len(data) or alike(header(data, third)):
                return size
    return 0


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation, of layer II."""
    if h.version != 10:
        runs = ((4, 4), (7, 3), (19, 2))
    elif h.kbits and (each := h.kbits if h.mono else h.kbits // 2) < 56:
        runs = ((2, 4), (10 if h.rate == 32000 else 6, 3))
    else:
        runs = ((11, 4), (12, 3), (7 if h.rate != 48000 and (not h.kbits or each >= 96) else 4, 2))
    return [bits for n, bits in runs for _ in range(n)]


def _guarded(h: Header, data: bytes, at: int) -> int:
    """How many bits behind the checksum it covers; at: the byte behind it."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        bound = 32 if h.mono else h.bound
        return 4 * (channels * bound + 32 - bound)
    tables, used, place = _allocation(h), 0, 8 * at
    for band, bits in enumerate(tables):
        for _ in range(channels if band < h.bound else 1):
            if place + bits > 8 * len(data):
                return place - 8 * at + 2 * used
            word = int.from_bytes(data[place // 8 : place // 8 + 2].ljust(2, b"\0"), "big")
            used += (channels if band >= h.bound else 1) * bool(word >> 16 - bits - place % 8 & (1 << bits) - 1)
            place += bits
    return place - 8 * at + 2 * used


_CRC = []
for _i in range(256):
    _r = _i << 8
    for _ in range(8):
        _r = (_r << 1 ^ (0x8005 if _r & 0x8000 else 0)) & 0xFFFF
    _CRC.append(_r)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for x in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ x]
    return crc


def crc16_bits(data: bytes, bits: int, crc: int) -> int:
    """Of the first bits of data."""
    crc = crc16(data[: bits // 8], crc)
    for i in range(bits - bits % 8, bits):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ (data[i // 8] >> 7 - i % 8 & 1) else 0)
    return crc


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    layers: set[int] = field(default_factory=set)
    bitrates: set[int] = field(default_factory=set)
    skipped: int = 0
    checked: int = 0
    bad_crc: int = 0
    tag_bytes: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    table: str | None = None
    table_at: int = 0
    seek: list[int] = field(default_factory=list)  # byte offsets, from the table's frame on, of equal steps in time
    delay: int = 0
    padding: int = 0
    title: str | None = None
    offsets: list[int] = field(default_factory=list)
    data: list[tuple[int, int]] = field(default_factory=list)  # of the ancillary part, for layer III

    @property
    def microseconds(self) -> int:
        return max(0, self.samples - self.delay - self.padding) * 1_000_000 // self.rate if self.rate else 0


def _tag_size(data: bytes) -> int:
    """Bytes of the ID3v2 tag at the front."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    size = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + (10 if data[5] & 16 else 0)
    return size if size <= len(data) else 0


def _title(tag: bytes) -> str | None:
    at = 10
    while at + 10 <= len(tag) and tag[at : at + 4].strip(b"\0"):
        parts = tag[at + 4 : at + 8]
        size = parts[0] << 21 | parts[1] << 14 | parts[2] << 7 | parts[3] if tag[3] == 4 else int.from_bytes(parts, "big")
        if tag[at : at + 4] == b"TIT2" and size:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(tag[at + 10], "latin-1")
            return tag[at + 11 : at + 10 + size].decode(code, "replace").rstrip("\0")
        at += 10 + size
    return None


def _read_table(out: Stream, data: bytes, at: int, first: int, end: int) -> bool:
    """Whether the frame at this byte, whose ancillary part begins at first, holds a Xing, Info or VBRI table; reads it."""
    number = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    if data[first : first + 4] in (b"Xing", b"Info"):
        flags, i = number(first + 4), first + 8
        out.table, out.table_frames, out.table_bytes = data[first : first + 4].decode(), -1, -1
        if flags & 1:
            out.table_frames, i = number(i), i + 4
        if flags & 2:
            out.table_bytes, i = number(i), i + 4
        if flags & 4:
            out.seek, i = [x * max(out.table_bytes, 0) // 256 for x in data[i : i + 100]], i + 100
        i += 4 * (flags >> 3 & 1)
        if i + 24 <= end and data[i : i + 4] in (b"LAME", b"Lavf", b"Lavc"):
            out.delay, out.padding = number(i + 21, 3) >> 12, number(i + 21, 3) & 0xFFF
        return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= end:
        out.table, out.delay = "VBRI", number(at + 42, 2)
        out.table_bytes, out.table_frames = number(at + 46), number(at + 50)
        entries, scale, width = number(at + 54, 2), number(at + 56, 2), number(at + 58, 2)
        sizes = [number(at + 62 + i * width, width) * scale for i in range(entries) if at + 62 + (i + 1) * width <= end]
        out.seek = [sum(sizes[:i]) for i in range(len(sizes))]
        return True
    return False


def parse(data: bytes) -> Stream:
    out = Stream()
    at = out.tag_bytes = _tag_size(data)
    if at:
        out.title = _title(data[:at])
    start, end = at, len(data)
    # an ID3v1 tag, unless the chain of frames runs through to the end of the data over it
    tag = end - 128 if data[-128:-125] == b"TAG" and end - 128 >= at else end
    synced, free = False, 0
    while at < end:
        if at == tag:
            out.tag_bytes += end - tag
            break
        h = header(data, at)
        if h and not h.size:
            free = free or _free_size(data, at, h)
            h = replace(h, size=free + h.pad) if free else None
        follows = at + h.size if h else 0
        over = at < tag < follows and not (follows == end and (synced or at == start))
        if not h or follows > end or over or not synced and follows not in (tag, end) and header(data, follows) is None:
            # lost: on to the next byte that may begin a header, or to the tag
            step = data.find(b"\xff", at + 1, tag if at < tag else end)
            step = (tag if at < tag else end) if step < 0 else step
            out.skipped += step - at
            at, synced = step, False
            continue
        synced = True
        first = at + 4
        if h.protected:
            out.checked += 1
            out.bad_crc += crc16_bits(data[at + 6 : follows], min(_guarded(h, data, at + 6), 8 * (follows - at - 6)), crc16(data[at + 2 : at + 4])) != int.from_bytes(data[at + 4 : at + 6], "big")
        first += 2 * h.protected
        if h.layer == 3:
            first += h.side
        if not out.frames and out.table is None and h.layer == 3 and _read_table(out, data, at, first, follows):
            out.table_at = at
        else:
            out.frames += 1
            out.samples += h.samples
            out.rate = out.rate or h.rate
            out.layers.add(h.layer)
            out.bitrates.add(h.kbits)
            out.offsets.append(at)
            if h.layer == 3:
                out.data.append((first, follows))
        at = follows
    return out


def _frames() -> dict[int, bytes]:
    """Payload bytes -> all bytes before them in a silent 48 kHz one-channel frame, at the least bitrate; largest first."""
    out: dict[int, bytes] = {}
    for i, kbits in enumerate(KBITS[1, 3][1:], 1):
        head, side = bytes((0xFF, 0xFA, i << 4 | 1 << 2, 0xC0)), bytes(17)
        begin = head + crc16(head[2:] + side).to_bytes(2, "big") + side
        room, pad = divmod(3 * kbits - len(begin), UNIT)
        out.setdefault(room * UNIT, begin + bytes(pad))
    return dict(sorted(out.items(), reverse=True))


_FRAMES = _frames()
_TABLE_ROOM = 128


def wrap(payload: bytes) -> bytes:
    """payload, of a multiple of 64 bytes, as an MPEG stream."""
    frames, at = [], 0
    while at < len(payload):
        room = next(n for n in _FRAMES if n <= len(payload) - at)
        frames.append(_FRAMES[room] + payload[at : at + room])
        at += room
    begin = _FRAMES[_TABLE_ROOM]
    ends = [len(begin) + _TABLE_ROOM]
    for f in frames:
        ends.append(ends[-1] + len(f))
    seek = bytes(min(255, ends[i * len(frames) // 100] * 256 // ends[-1]) for i in range(100))
    first = begin[:23] + b"Xing" + struct.pack(">III", 7, len(frames), ends[-1]) + seek
    return b"".join((first.ljust(ends[0], b"\0"), *frames))


def unwrap(data: bytes, stream: Stream) -> bytes:
    """The payload: the last multiple of 64 bytes of each frame's ancillary part."""
    return b"".join(data[b - (b - a) // UNIT * UNIT : b] for a, b in stream.data)


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT) if raw else bytes(UNIT)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_us long, seek_offsets array<long>"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG stream."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            raws = list(C.raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([wrap(payload_of(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return C.pick(docs, "doc_id", "text").mapInArrow(task, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Of a table (doc_id, n_bytes, media): what the stored streams hold."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = []
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2)), strict=True):
                s = parse(data)
                payload = unwrap(data, s)
                says = f"mpeg-l{'/'.join(map(str, sorted(s.layers)))};{s.rate};frames={s.frames};us={s.microseconds};kbits={','.join(map(str, sorted(s.bitrates)))};table={s.table}:{s.table_frames}:{s.table_bytes}:{len(s.seek)};cut={s.delay}+{s.padding};crc={s.checked - s.bad_crc}/{s.checked};skipped={s.skipped};seek={zlib.crc32(struct.pack(f'<{len(s.offsets)}Q', *s.offsets)):08x}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), says, s.frames, s.microseconds, s.offsets))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores docs (doc_id, text) as a table with a media column and returns the features of the stored streams."""
    return features(C.stored(to_media(docs), "media"))
