"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters.  A document's words stream through
the automaton, which keeps the longest suffix that occurs in any item.  A window is `window` consecutive words of an
item, or a whole item of fewer words; a document word inside an occurrence of a window is hit.

The items are dealt by a hash to blocks of about BLOCK_WORDS words; a task builds each block's automaton and writes it
to the shared folder.  A scanning task holds one automaton at a time, so memory doesn't grow with the number of items:
with one block it keeps it; with more it gathers CHUNK_BYTES of texts and sweeps them block by block, so that an
automaton is read once for so much text.  Scanning takes time in proportion to texts times blocks.

Defined cases: a null or empty text has no words and no hits; items with null or empty text make no windows; an item
without item_id hits words but isn't counted among the items; repeated items count once; without items nothing is hit;
texts and items of any length are read whole; a share of hits of just 1 in LIMIT is contaminated.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 13
BLOCK_WORDS = 500_000
CHUNK_BYTES = 32 << 20
#: A document is contaminated if at least 1 in LIMIT of its words is hit.
LIMIT = 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.items: list[tuple[list[int], str | None]] = []
        self.shortest = window

    def add(self, item: list[bytes], name: str | None) -> None:
        codes = [self.codes.setdefault(w, len(self.codes)) for w in item]
        last = 0
        for c in codes:
            last = self._extend(last, c)
        self.items.append((codes, name))
        self.shortest = min(self.shortest, len(codes))

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item has this string already
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new = len(self.len)
        self.len.append(self.len[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state and the length of the longest suffix that occurs in an item."""
        link, size, only, to, more = self.link, self.len, self.only, self.to, self.more
        v = n = 0
        for c in codes:
            w = to[v] if only[v] == c else more[v].get(c) if v in more else None
            while w is None and v:
                v = link[v]
                n = size[v]
                w = to[v] if only[v] == c else more[v].get(c) if v in more else None
            if w is None:
                v = n = 0
            else:
                v = w
                n += 1
            yield v, n

    def freeze(self) -> Automaton:
        """Packs the states, most of which have one way on, and names each window's: full ones by that at depth `window`, short items by theirs."""
        self.only, self.to = array("i", [-1]) * len(self.len), array("i", [0]) * len(self.len)
        self.more: dict[int, dict[int, int]] = {}
        for v, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.only[v], self.to[v]),) = ways.items()
            elif ways:
                self.more[v] = ways
        del self.next
        self.link, self.len = array("i", self.link), array("i", self.len)
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.level = array("i", [-1]) * len(order)
        for v in order[1:]:
            if self.len[v] >= self.window:
                up = self.link[v]
                self.level[v] = v if self.len[up] < self.window else self.level[up]
        self.full: dict[int, set[str | None]] = {}
        own: dict[int, dict[int, set[str | None]]] = {}
        for codes, name in self.items:
            if len(codes) < self.window:
                *_, (v, n) = self.walk(codes)
                own.setdefault(v, {}).setdefault(n, set()).add(name)
            else:
                for v, n in self.walk(codes):
                    if n >= self.window:
                        self.full.setdefault(self.level[v], set()).add(name)
        self.short: dict[int, list[tuple[int, set[str | None]]]] = {}
        if own:
            for v in order[1:]:
                if both := sorted(own.get(v, {}).items(), key=lambda x: x[0]) + self.short.get(self.link[v], []):
                    self.short[v] = both
        del self.items
        return self

    def find(self, text: list[bytes], hit: np.ndarray) -> tuple[set[str | None], int]:
        """Marks the words that are hit; returns the items whose windows occur and the longest match."""
        get = self.codes.get
        known = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known >= 0, [0])).astype(np.int8)))
        names: set[str | None] = set()
        longest = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # no window fits into this run of known words
                continue
            for i, (v, n) in enumerate(self.walk(known[a:b].tolist()), a + 1):
                longest = max(longest, n)
                if n >= self.window:
                    hit[i - self.window : i] = True
                    names |= self.full[self.level[v]]
                if self.short:
                    for size, of in self.short.get(v, ()):
                        if size <= n:
                            hit[i - size : i] = True
                            names |= of
        return names, longest


def build(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Writes the automata of the items (item_id, text); returns their paths, one for about block_words words."""
    folder = C.shared_folder(benchmark.sparkSession, "automata")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(words(raw)) for raw in C.raw_texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["item", "text", "n"])

    def task(key: tuple, items: pa.Table) -> pa.Table:
        block = Automaton(window)
        for name, raw in zip(items.column("item").to_pylist(), C.raw_texts(items.column("text")), strict=True):
            block.add(words(raw), name)
        path = f"{folder}/{key[0].as_py():06d}.pickle"
        C.put_file(path, pickle.dumps(block.freeze(), protocol=5))
        return pa.table({"path": [path]})

    items = C.pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text").distinct().mapInArrow(count, "item string, text string, n long").where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // block_words) or 1))
    return sorted(r.path for r in items.withColumn("block", block).groupBy("block").applyInArrow(task, "path string").collect())


_HELD: dict[str, Automaton] = {}


def _load(path: str) -> Automaton:
    if path not in _HELD:
        _HELD.clear()
        fs, name = C.open_fs(path)
        with fs.open_input_file(name) as f:
            _HELD[path] = pickle.loads(f.readall())
    return _HELD[path]


def _scan(raws: list[bytes], paths: list[str]) -> list[tuple[np.ndarray, set[str | None], int]]:
    """Of each text its hit words, the items whose windows occur and the longest match."""
    found: list[tuple[np.ndarray, set[str | None], int]] = []
    for path in paths:
        automaton = _load(path)
        for i, raw in enumerate(raws):
            text = words(raw)
            if len(found) == i:
                found.append((np.zeros(len(text), bool), set(), 0))
            hit, names, longest = found[i]
            more, n = automaton.find(text, hit)
            found[i] = hit, names | more, max(longest, n)
    return found or [(np.zeros(len(words(raw)), bool), set(), 0) for raw in raws]


def _chunks(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches by 500 rows, so many of these together that they have so many bytes."""
    held, size = [], 0
    for batch in C.slices(batches, 500):
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document of docs (doc_id, text): words, hit words, items with occurring windows, and the verdict."""
    paths = build(benchmark, window, block_words)
    least = CHUNK_BYTES if len(paths) > 1 else 0

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, least):
            rows = []
            for hit, names, longest in _scan(list(C.raw_texts(batch.column(1))), paths):
                ids, n = sorted(names - {None}), int(hit.sum())
                rows.append((len(hit), n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0 and limit * n >= len(hit), longest))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return C.pick(docs, "doc_id", "text").mapInArrow(task, SCHEMA)


def cut(raw: bytes, hit: np.ndarray) -> str:
    """The text without its hit words: each run of them goes, with what stands between them."""
    spans = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).tolist()
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without contaminated documents; from the others, hit spans are cut out."""
    paths = build(benchmark, window, block_words)
    least = CHUNK_BYTES if len(paths) > 1 else 0
    kept = C.pick(docs, "doc_id", "text", "lang", "source", "n_chars")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, least):
            raws = list(C.raw_texts(batch.column(1)))
            new, chars, keep = batch.column(1).to_pylist(), batch.column(4).to_pylist(), []
            for i, (hit, _, _) in enumerate(_scan(raws, paths)):
                n = int(hit.sum())
                if n and limit * n >= len(hit):
                    continue
                keep.append(i)
                if n:
                    new[i] = cut(raws[i], hit)
                    chars[i] = len(new[i])
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), batch.column(2), batch.column(3), pa.array(chars, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])
            yield whole.take(pa.array(keep, pa.int64()))

    return kept.mapInArrow(task, kept.schema)
