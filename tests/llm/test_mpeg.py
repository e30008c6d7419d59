"""MPEG streams built bit by bit, and every column of the query against a plain computation."""

import hashlib
import random
import struct
import zlib

import pytest

from graphloom.llm import mpeg_audio as A


def bits_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ b
        crc = crc << 1 & 0xFFFF
        if top:
            crc ^= 0x8005
    return crc


def bits_of(data):
    return [x >> 7 - i & 1 for x in data for i in range(8)]


def frame(layer, bitrate, hz, mode, ext=0, version=3, rng=None, allocation=None):
    """A protected frame: random body after the given allocation bits, its checksum over the bits that count."""
    head = bytes((0xFF, 0xE0 | version << 3 | 4 - layer << 1, bitrate << 4 | hz << 2, mode << 6 | ext << 4))
    h = A.header(head, 0)
    body = allocation(h) if allocation else []
    count = len(body)
    body += [rng.randrange(2) for _ in range(8 * (h.size - 6) - len(body))]
    crc = bits_crc(bits_of(head[2:]) + body[:count])
    data = bytes(int("".join(map(str, body[i : i + 8])), 2) for i in range(0, len(body), 8))
    return head + crc.to_bytes(2, "big") + data


def layer_two(tables, rng):
    """Allocation and scale-factor selection bits by the standard's tables: bits of each subband."""

    def make(h):
        out, used = [], 0
        for band, bits in enumerate(tables):
            for _ in range((1 if h.mono else 2) if band < h.bound else 1):
                value = rng.choice([0, rng.randrange(1, 1 << bits)])
                out += [value >> bits - 1 - i & 1 for i in range(bits)]
                used += bool(value) * (1 if h.mono or band < h.bound else 2)
        return out + [rng.randrange(2) for _ in range(2 * used)]

    return make


CASES = [
    # bitrate, rate and mode indices, extension, version, subbands' bits
    (8, 0, 3, 0, 3, [4] * 11 + [3] * 12 + [2] * 7),
    (8, 1, 3, 0, 3, [4] * 11 + [3] * 12 + [2] * 4),
    (8, 0, 0, 0, 3, [4] * 11 + [3] * 12 + [2] * 4),
    (12, 0, 1, 1, 3, [4] * 11 + [3] * 12 + [2] * 7),
    (2, 0, 3, 0, 3, [4] * 2 + [3] * 6),
    (2, 2, 3, 0, 3, [4] * 2 + [3] * 10),
    (10, 0, 0, 0, 2, [4] * 4 + [3] * 7 + [2] * 19),
]


@pytest.mark.parametrize("case", CASES)
def test_layer_two_checksums(case):
    bitrate, hz, mode, ext, version, tables = case
    rng = random.Random(1)
    frames = [frame(2, bitrate, hz, mode, ext, version, rng, layer_two(tables, rng)) for _ in range(4)]
    s = A.parse(b"".join(frames))
    assert (s.frames, s.checked, s.bad_crc, s.layers) == (4, 4, 0, {2})
    bad = bytearray(b"".join(frames))
    bad[6] ^= 0x10
    assert A.parse(bytes(bad)).bad_crc == 1


@pytest.mark.parametrize(("mode", "ext", "n"), [(3, 0, 128), (0, 0, 256), (1, 1, 4 * (16 + 24)), (1, 3, 4 * (32 + 16))])
def test_layer_one_checksums(mode, ext, n):
    rng = random.Random(2)
    frames = [frame(1, 6, 0, mode, ext, 3, rng, lambda h: [rng.randrange(2) for _ in range(n)]) for _ in range(3)]
    s = A.parse(b"".join(frames))
    assert (s.frames, s.checked, s.bad_crc, s.samples) == (3, 3, 0, 3 * 384)
    bad = bytearray(frames[0] + frames[1] + frames[2])
    bad[6 + n // 8 - 1] ^= 1
    assert A.parse(bytes(bad)).bad_crc == 1


def silent(n, **head):
    """n layer III frames of 128 kbit/s at 44.1 kHz, stereo, without checksum."""
    return [bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0") for _ in range(n)]


def test_xing_table_with_delay_and_padding():
    frames = silent(50)
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1105).to_bytes(3, "big")
    first = (bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + b"Xing" + struct.pack(">III", 15, 50, 51 * 417) + toc + bytes(4) + lame).ljust(417, b"\0")
    s = A.parse(first + b"".join(frames))
    assert (s.table, s.table_frames, s.table_bytes, s.delay, s.padding, s.frames) == ("Xing", 50, 51 * 417, 576, 1105, 50)
    assert s.microseconds == (50 * 1152 - 576 - 1105) * 1_000_000 // 44100
    assert s.seek == [x * 51 * 417 // 256 for x in toc]


def test_vbri_table():
    frames = silent(40)
    sizes = [417 * 4] * 10
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 1000, 75, 41 * 417, 40, 10, 1, 2, 4) + b"".join(x.to_bytes(2, "big") for x in sizes)
    s = A.parse((bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + table).ljust(417, b"\0") + b"".join(frames))
    assert (s.table, s.table_frames, s.table_bytes, s.delay, s.frames) == ("VBRI", 40, 41 * 417, 1000, 40)
    assert s.seek == [417 * 4 * i for i in range(10)] and s.samples == 40 * 1152


def test_free_format():
    make = lambda pad: bytes((0xFF, 0xFB, 0x00 | pad << 1, 0x00)).ljust(500 + pad, b"\1")
    s = A.parse(b"junk" + b"".join(make(i % 2) for i in range(7)))
    assert (s.frames, s.skipped, s.samples) == (7, 4, 7 * 1152)
    assert s.offsets == [4 + 500 * i + i // 2 for i in range(7)]
    assert A.parse(make(0)).frames == 0


def test_every_column(spark):
    texts = [None, "", "a", "x" * 64, "é" * 100, "word " * 30_000, "a", "TAG" + "A" * 125, "\xff\xfb\x90" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in A.media_features(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        media = A.wrap(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        # frames counted by hand: each header follows the one before at its length
        at, frames, room = 0, [], 0
        while at < len(media):
            frames.append(at)
            kbits = A.KBITS[1, 3][media[at + 2] >> 4]
            room += (3 * kbits - 23) // 64 * 64 if at else 0
            at += 3 * kbits
        assert at == len(media) and room == len(payload)
        assert (r.frames, r.duration_us, r.seek_offsets) == (len(frames) - 1, (len(frames) - 1) * 24_000, frames[1:])
        assert f"frames={r.frames};us={r.duration_us}" in r.feature and f"table=Xing:{r.frames}:{len(media)}:100" in r.feature and f"crc={len(frames)}/{len(frames)}" in r.feature
    assert tuple(rows[2])[1:] == tuple(rows[6])[1:]
