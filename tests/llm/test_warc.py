"""Archives whole, cut, damaged, padded, foreign and nested, at every split size."""

import gzip
import hashlib
import random

import pytest

from graphloom.llm import _common as C
from graphloom.llm import warc

RNG = random.Random(2)
NOISE = lambda n: bytes(RNG.getrandbits(8) for _ in range(n))
MAKE = lambda i, p: warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None)
PAYLOADS = [NOISE(RNG.randrange(3000)) for _ in range(20)]
PAYLOADS[4] = NOISE(400) + MAKE(77, b"inner") + NOISE(5000) + MAKE(78, b"inner too") + NOISE(900)
MEMBERS = [MAKE(i, p) for i, p in enumerate(PAYLOADS)]
WHOLE = b"".join(MEMBERS)
STARTS = [sum(map(len, MEMBERS[:i])) for i in range(21)]


def look(spark, data, step):
    """Records by place, and the bytes of the gaps."""
    uri = C.shared_folder(spark, "test") + "/x.warc.gz"
    C.put_file(uri, data)
    records, gaps = warc.read(spark.createDataFrame([(uri, len(data))], "path string, bytes long"), step)
    skipped = set()
    for g in gaps.collect():
        skipped |= set(range(g.start, g.stop))
    return sorted(records.collect(), key=lambda r: (r.start, r.nth)), skipped


@pytest.mark.parametrize("step", [397, 1000, 5000, len(WHOLE)])
def test_whole_and_nested(spark, step):
    rows, skipped = look(spark, WHOLE, step)
    assert [(r.page_id, r.payload_digest, r.intact) for r in rows] == [(i, hashlib.sha1(p).hexdigest(), True) for i, p in enumerate(PAYLOADS)]
    assert [bytes(r.payload) for r in rows] == PAYLOADS and not skipped


@pytest.mark.parametrize("step", [1000, 5000, len(WHOLE)])
def test_damage_costs_its_own_record_only(spark, step):
    flipped = bytearray(WHOLE)
    flipped[STARTS[10] + len(MEMBERS[10]) // 2] ^= 16
    cases = {
        "cut": (WHOLE[:-100], set(range(19)), set(range(STARTS[19], len(WHOLE) - 100))),
        "flipped": (bytes(flipped), set(range(20)) - {10}, set(range(STARTS[10], STARTS[11]))),
        "padded": (WHOLE + bytes(16), set(range(20)), set(range(len(WHOLE), len(WHOLE) + 16))),
        "junk between": (WHOLE[: STARTS[7]] + b"\x1f\x8b\x08 junk" + WHOLE[STARTS[7] :], set(range(20)), set(range(STARTS[7], STARTS[7] + 8))),
        "front lost": (WHOLE[STARTS[3] + 50 :], set(range(4, 20)), set(range(len(MEMBERS[3]) - 50))),
    }
    for data, want, gap in cases.values():
        rows, skipped = look(spark, data, step)
        assert {r.page_id for r in rows} == want and skipped == gap


def test_other_kinds_of_records(spark):
    plain = lambda kind, block, *fields: "\r\n".join(("WARC/1.0", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}")).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    two = plain("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request") + plain("metadata", b"a: b", "WARC-Record-ID:", "  <urn:x>")
    parts = [
        gzip.compress(plain("warcinfo", b"software: x")),
        gzip.compress(plain("response", http, "Content-Type: application/http; msgtype=response")),
        gzip.compress(two),
        gzip.compress(plain("resource", b"data", "WARC-Payload-Digest: sha256:abc")),
        gzip.compress(plain("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"other").hexdigest())),
        gzip.compress(plain("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"body").hexdigest().upper())),
        gzip.compress(b"not a record"),
    ]
    rows, skipped = look(spark, b"".join(parts), 60)
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert [(r.record_type, r.payload_bytes, r.payload_digest, r.intact, r.nth) for r in rows] == [
        ("warcinfo", 11, sha(b"software: x"), None, 0),
        ("response", 4, sha(b"body"), None, 0),
        ("request", 0, sha(b""), None, 0),
        ("metadata", 4, sha(b"a: b"), None, 1),
        ("resource", 4, sha(b"data"), None, 0),
        ("response", 4, sha(b"body"), False, 0),
        ("revisit", None, sha(b"body"), None, 0),
    ]
    assert rows[3].record_id == "<urn:x>" and len(skipped) == len(parts[-1])


def test_round_trip_of_pages(spark):
    """Records of every page against the rule written out; long pages, hot payloads, many ranges."""
    hot, long = "<p>" + "x" * 1200, "long " * 400_000
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else f"<p>{i % 7}" if i % 2 else f"page {i % 11} " * 200) for i in range(300)] + [(1000, "u", long), (1001, None, long)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 20_000).collect()}
    assert len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        best[html] = max(i, best.get(html, i))
    for i, _, html in rows:
        revisit = len(html) >= 1000 and best[html] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None)


def test_manifest(spark):
    folder = C.shared_folder(spark, "test")
    C.put_file(f"{folder}/a/x.warc.gz", WHOLE)
    files = warc.manifest(spark, folder)
    assert [r.bytes for r in files.collect()] == [len(WHOLE)]
    assert warc.read(files, 3000, payloads=False)[0].count() == 20
