"""WARC archives: one gzip member per record, read back by byte ranges, whole or damaged.

Writing: records with equal payloads of at least MIN_REVISIT bytes are one response, that with the largest page_id, and
revisits that refer to it and carry the HTTP head only.  A task writes files of about FILE_BYTES, each led by a warcinfo
record, and a manifest of them goes to the shared folder.

Reading: every file is cut into ranges of split_bytes, a range a row.  A range looks for gzip magic from its start and
takes every member that decodes whole (its checksum and size hold) and whose content is one or more WARC records of
their declared length; it owns those that start inside it, wherever they end.  After bytes that are no such member the
search goes on at the next magic, so a cut, damaged or padded member costs itself alone.  What lies between members is
given out as gaps.

A range that starts inside a long record may meet an archive stored within its payload.  So each member that runs past
its range covers the ranges behind it up to its end, and members and gaps that start under a cover don't count: a join
of the small rows on (file, range).  Any split size gives the same records.

Defined cases: null html is empty; null page_id is written without the field, is never the largest, and comes back null
(if all copies lack it, all are responses); rows that repeat the largest page_id are responses all; null url has no
WARC-Target-URI; an empty table gives no file and an empty result; a record of any size is held whole by the task that
owns it; a record without a payload digest gets that of its payload (a revisit without one has none); records of other
kinds (warcinfo, request, metadata, ..) have their block as payload; a digest of another kind than SHA-1, or one that
isn't the payload's, gives intact null or false and the payload's own digest; an archive inside a damaged record counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MIN_REVISIT = 1000
FILE_BYTES = 32 << 20
SPLIT_BYTES = 8 << 20
STEP = 1 << 20
MAGIC = b"\x1f\x8b\x08"
BATCH_BYTES = 8 << 20
_GAP = re.compile(rb"\r?\n\r?\n")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task reads about this many ranges once there are more than MANY_TASKS of them.
RANGES_A_TASK, MANY_TASKS = 32, 4096
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, intact boolean, payload binary"
FOUND = "path string, start long, stop long, nth int, " + SCHEMA


def _urn(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def warcinfo(name: str) -> bytes:
    block = b"software: graphloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_OID, name).urn}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns their manifest (path, bytes)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = C.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    # counted from the columns that decide; only payloads that repeat are joined, hot ones without a shuffle on their key
    groups = C.stored(rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-groups")
    decided = C.join_spread(rows, groups, ["digest"], "n", pages.count(), "page_id", "url").select("page_id", "url", "html", "digest", F.expr("if(size >= %d and response is not null and not (page_id <=> response), response, null)" % MIN_REVISIT).alias("refers_to"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, members, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{nth:06d}.warc.gz"
            data = b"".join((warcinfo(name), *members))
            C.put_file(f"{folder}/{name}", data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], ["path", "bytes"])

        for batch in batches:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, payload, digest, refer in zip(ids, urls, C.raw_texts(batch.column(2)), digests, refers, strict=True):
                members.append(record(page_id, url, payload, digest, refer))
                held += len(members[-1])
                if held >= FILE_BYTES:
                    yield close()
                    nth, members, held = nth + 1, [], 0
        if members:
            yield close()

    return C.stored(decided.mapInArrow(task, "path string, bytes long"), "warc-manifest", groups)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives under a path; the files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("path", F.col("length").alias("bytes"))


class _File:
    """Bytes of a file from a position on, read by steps."""

    def __init__(self, uri: str, at: int) -> None:
        fs, name = C.open_fs(uri)
        self.file = fs.open_input_file(name)
        self.size, self.base, self.held = self.file.size(), at, bytearray()

    def upto(self, end: int) -> bool:
        """Holds the bytes up to end; False if the file is shorter."""
        while (at := self.base + len(self.held)) < min(end, self.size):
            self.held += self.file.read_at(max(STEP, end - at), at)
        return end <= self.size

    def find(self, at: int, end: int) -> int:
        """Where gzip magic starts in [at, end), or -1."""
        while at < end:
            stop = min(at + STEP, end)
            self.upto(stop + 2)
            i = self.held.find(MAGIC, at - self.base, stop + 2 - self.base)
            if i >= 0:
                return i + self.base
            at = stop
        return -1

    def member(self, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int] | None:
        """The records of the whole gzip member at this byte, and the byte after it; None if there is no such member."""
        unpack, out, more = zlib.decompressobj(31), [], at
        got = 0
        try:
            while not unpack.eof:
                if more >= self.size:
                    return None
                self.upto(more + 65_536)
                piece = bytes(self.held[more - self.base : more - self.base + 65_536])
                more += len(piece)
                out.append(unpack.decompress(piece))
                if got < 5 <= got + len(out[-1]) and not b"".join(out).startswith(b"WARC/"):
                    return None
                got += len(out[-1])
        except zlib.error:
            return None
        found = parse(b"".join(out))
        return (found, more - len(unpack.unused_data)) if found else None


def _fields(head: bytes) -> dict[str, str]:
    """The named fields after the first line, the first of each name; lines that begin with white space go on."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]
    out: dict[str, str] = {}
    for k, _, v in (x.partition(":") for x in lines):
        out.setdefault(k.strip().lower(), v.strip())
    return out


def parse(content: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """The whole records (fields, block) that lead a member's content, at least one; or None."""
    out, at = [], 0
    while content.startswith(b"WARC/", at) and (gap := _GAP.search(content, at)):
        fields = _fields(content[at : gap.start()])
        size = fields.get("content-length", "")
        if not size.isdecimal() or len(content) < gap.end() + int(size):
            break
        end = gap.end() + int(size)
        out.append((fields, content[gap.end() : end]))
        at = end
        while content[at : at + 1] in (b"\r", b"\n"):
            at += 1
    return out or None


def members(uri: str, start: int, end: int) -> Iterator[tuple[int, int, list[tuple[dict[str, str], bytes]]]]:
    """(first byte, byte after the last, records) of the members that start in [start, end), and of the gaps between them, which have no records."""
    file = _File(uri, start)
    end = min(end, file.size)
    at = free = start
    while (at := file.find(at, end)) >= 0:
        if not (got := file.member(at)):
            at += 1
            continue
        if at > free:
            yield free, at, []
        yield at, got[1], got[0]
        at = free = got[1]
    if free < end:
        yield free, end, []


def _named_digest(value: str) -> str | None:
    """The SHA-1 of a digest field in hex; None if it is none."""
    kind, _, text = value.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    text = text.strip()
    try:
        return text.lower() if len(text) == 40 and int(text, 16) >= 0 else base64.b32decode(text.upper()).hex()
    except ValueError:
        return None


def describe(fields: dict[str, str], block: bytes) -> tuple:
    """A row of SCHEMA."""
    kind, payload, declared = fields.get("warc-type", "").lower(), block, None
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http") and (gap := _GAP.search(block)):
        payload = block[gap.end() :]
        length = _fields(block[: gap.start()]).get("content-length", "")
        declared = int(length) if length.isdecimal() else None
    named, own = _named_digest(fields.get("warc-payload-digest", "")), hashlib.sha1(payload).hexdigest()
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d{1,18}", fields.get(k, "")) else None
    about = number("refers-to-page-id"), fields.get("warc-target-uri"), fields.get("warc-record-id")
    if kind == "revisit":  # the payload is elsewhere
        return number("page-id"), declared, named, kind, *about, None, None
    intact = None if named is None else named == own and declared in (None, len(payload))
    return number("page-id"), len(payload), own, kind, *about, intact, payload


def scan(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Rows of FOUND for files (path, bytes): a row per record, and one without record_type per gap."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary())

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, found in members(uri, start, end):
                    for i, one in enumerate(found):
                        row = describe(*one)
                        rows.append((uri, a, b, i, *row[:-1], row[-1] if payloads else None))
                        size += len(one[1]) if payloads else 100
                    if not found:
                        rows.append((uri, a, b, 0, *[None] * 9))
                    if size >= BATCH_BYTES or len(rows) >= 2000:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", at.alias("start")).withColumn("stop", F.col("start") + split_bytes)
    tasks = max(1, min(n, max(MANY_TASKS, n // RANGES_A_TASK)))
    return ranges.repartition(tasks).mapInArrow(task, FOUND)


def uncovered(found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """found without what lies inside a member that starts in an earlier range; gaps lose what is covered of them."""
    of = lambda c: F.floor(c / split_bytes).cast("long")
    long = found.where("record_type is not null").where(of(F.col("stop") - 1) > of(F.col("start")))
    behind = F.sequence(of(F.col("start")) + 1, of(F.col("stop") - 1))
    covers = long.select("path", F.explode(behind).alias("range"), "stop").groupBy("path", "range").agg(F.max("stop").alias("cover"))
    rows = found.withColumn("range", of(F.col("start"))).join(covers, ["path", "range"], "left").withColumn("cover", F.coalesce("cover", F.lit(0)))
    gap = F.col("record_type").isNull()
    rows = rows.where((~gap & (F.col("start") >= F.col("cover"))) | (gap & (F.col("stop") > F.col("cover"))))
    return rows.withColumn("start", F.when(gap, F.greatest("start", "cover")).otherwise(F.col("start"))).drop("range", "cover")


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the archives files (path, bytes): SCHEMA with path, start, stop, nth; and (path, start, stop)."""
    found = C.stored(scan(files, split_bytes, payloads), "warc-found")
    rows = uncovered(found, split_bytes)
    return rows.where("record_type is not null"), rows.where("record_type is null").select("path", "start", "stop")


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Archives pages (page_id, url, html) in the shared folder and reads them back, one row per record of a page."""
    records, _ = read(write(pages, C.shared_folder(pages.sparkSession, "warc")), split_bytes, payloads=False)
    return records.where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")
