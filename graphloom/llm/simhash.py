"""SimHash near-duplicates: 64-bit fingerprints, a positional byte index, count filtering, components.

Fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4 positional
bytes.  A plain inverted index has 8 x 256 lists, each a 256th of all rows, so lists are read by three positions at a
time instead: 20 triples of positions suffice for every set of 4 shared positions to contain one (Turan's number for
triples among 8).  Two fingerprints that meet under a triple are a candidate pair; the shared positional bytes of the
pair are tallied, pairs under the guaranteed minimum of 4 go, and the rest are verified by their differing bits.

Lists that hold more than HOT fingerprints are read by further positions of the same guarantee: under a triple, four
shared positions need one of the other five, so a hot list is dealt out by (triple, fourth position, byte).  Lists that
are still hot are dealt out as pairs of blocks.  No list is ever gathered whole in one task, no pair is dropped.

A list gives at most one link per fingerprint: the links inside a list are folded into a forest whose edges lead to the
smallest fingerprint of the tree.  That keeps connectivity, so components are those of all links.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; equal
fingerprints are one component; a null doc_id is never the smallest unless all of a component are null; repeated rows
stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHINGLE = 4
SEED = 42
BITS = 4
SHARED = 8 - BITS
HOT = 16_384
BLOCK = 4_096


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions of which each 4 positions contain one: three rings, each triple inside a ring or two of one ring and one of the next."""
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        in_ring = [sum(ring[p] == r for p in t) for r in range(3)]
        if 3 in in_ring or any(in_ring[r] == 2 and in_ring[(r + 1) % 3] == 1 for r in range(3)):
            out.append(t)
    return out


TRIPLES = _triples()


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Bit set if it is set in over half of the shingles' XXH64."""
    text = raw.lower().split()
    if not text:
        return 0
    if len(text) <= size:
        return xxhash.xxh64_intdigest(b" ".join(text), SEED)
    digest = xxhash.xxh64_intdigest
    n = len(text) - size + 1
    flat = b" ".join(text)
    lengths = np.fromiter(map(len, text), np.int64, len(text))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, *keys: str) -> DataFrame:
    """(doc_id, fp, keys): fp as a signed long; keys are further long columns."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(raw, size) for raw in C.raw_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keys])

    return C.pick(docs, "doc_id", "text", *keys).mapInArrow(task, ", ".join(f"{n} long" for n in ("doc_id", "fp", *keys)))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _lists(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 20 lists: list = triple << 24 | its three bytes."""
    fp = F.col("fp")
    keys = [F.lit(k << 24) + F.shiftleft(_byte(fp, a), 16) + F.shiftleft(_byte(fp, b), 8) + _byte(fp, c) for k, (a, b, c) in enumerate(TRIPLES)]
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links inside lists; rows sorted by key. A list's rows are compared at every distance, all lists at once."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows after this one in its list
    root = np.arange(n)
    rows, d = np.flatnonzero(left >= 1), 1
    low7 = np.uint64(0x7F7F7F7F7F7F7F7F)
    while len(rows):
        a, b = rows, rows + d
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        x = fps[a] ^ fps[b]
        shared = np.bitwise_count(~(((x & low7) + low7) | x | low7))  # bytes that are zero in x
        few = shared >= SHARED
        a, b, x = a[few], b[few], x[few]
        linked = np.bitwise_count(x) <= BITS
        if linked.any():
            for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                if i != j:
                    root[max(i, j)] = min(i, j)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        d += 1
        rows = rows[left[rows] >= d]
    below = np.flatnonzero(root != np.arange(n))
    return fps[root[below]], fps[below]


def _in_lists(listed: DataFrame) -> DataFrame:
    """(a, b): links of rows (list, fp) that come sorted and with each list in one partition."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _links(keys, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy()))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            if whole >= 20_000:
                yield found(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield found(keys, fps)

    return listed.sortWithinPartitions("list", "fp").mapInArrow(task, "a long, b long")


def _deal_blocks(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of lists that stay hot, once for each pair of blocks that holds them; n blocks make n * (n + 1) / 2 pairs."""
    rows = hot.join(sizes, "list").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges between distinct fingerprints (fp) whose components are those of all links of at most BITS bits."""
    listed = _lists(fps)
    sizes = C.stored(listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "simhash-hot")
    if sizes.isEmpty():
        return C.stored(_in_lists(listed.repartition("list")).distinct(), "simhash-links")
    cold = _in_lists(listed.join(sizes, "list", "left_anti").repartition("list"))
    hot_rows = listed.join(sizes.select("list"), "list", "left_semi")
    others = [[p for p in range(8) if p not in t] for t in TRIPLES]
    fourth = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, ps in enumerate(others) for p in ps))
    finer = hot_rows.withColumn("q", F.explode(F.filter(fourth, lambda x: x["k"] == F.shiftright("list", 24))))
    byte = F.expr("shiftrightunsigned(fp, cast(8 * q.p as int)) & 255")
    finer = finer.select((F.col("list") * 2048 + F.col("q.p") * 256 + byte).alias("list"), "fp")
    more = C.stored(finer.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "simhash-hot")
    second = _in_lists(finer.join(more, "list", "left_anti").repartition("list"))
    third = _in_lists(_deal_blocks(finer.join(more.select("list"), "list", "left_semi"), more).repartition("list"))
    return C.stored(cold.unionByName(second).unionByName(third).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates large and small stars: neighbours that are larger move to the smallest neighbour, then the smaller ones;
    the edges end as stars around the roots, after a number of rounds logarithmic in the longest path.
    """
    edges = edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour v of u goes to u's smallest
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo != hi").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_least, "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo != hi").union(joined.select(F.col("m").alias("lo"), "hi")).distinct()
        edges, last = C.stored(small, "components"), edges
        C.discard(last)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            out = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
            out._stored_at = edges._stored_at
            return out
        before = now


def simhash_components(docs: DataFrame, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """Per document of docs (doc_id, text): fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    of_docs = C.stored(fingerprints(docs, size), "simhash")
    fps = C.stored(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs")), "simhash-fps")
    roots = components(links(fps.select("fp"), hot))
    named = C.stored(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "docs", F.coalesce("root", "fp").alias("root")), "simhash-roots", roots, fps)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    size_of = named.agg(F.count(F.lit(1)).alias("fps"), F.sum("docs").alias("docs")).first()
    # a component may hold a third of all fingerprints, a fingerprint a third of all documents
    of_fp = C.join_spread(named.select("fp", "docs", "root"), best, ["root"], "n", size_of["fps"], "fp").select("fp", "docs", "component_id")
    out = C.join_spread(of_docs, of_fp, ["fp"], "docs", size_of["docs"] or 0, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars): of each component the document of the smallest doc_id.

    A document is what shares doc_id and text; without doc_id comes last, and ties go to the smallest hash of both.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = C.pick(docs, *names).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    of_docs = C.stored(fingerprints(rows, SHINGLE, "key"), "simhash")
    fps = of_docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("least"))
    roots = components(links(fps.select("fp"), HOT))
    named = fps.join(roots, fps.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("least")).select("least.key").distinct()
    return rows.join(best, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
