"""Token ids as binary files: one id array per file, document boundaries Elias-Fano coded beside it.

File layout, little endian:
    8 bytes  magic GLEFIDS1
    u64 documents, u64 ids, u64 documents without doc_id (they come first), i64 smallest doc_id, u8 id width, 7 x 0
    Elias-Fano block of the documents' end offsets within the file
    Elias-Fano block of doc_id - smallest doc_id, for those that have one
    the ids, `width` bytes each
Elias-Fano block: u64 count, u64 low bits per value, u64 bytes of lows, u64 bytes of highs, u64 samples, then the low
parts packed bit by bit, the unary high parts, and the bit position of every 256th one (u64).  select(i) starts at the
sample, counts ones in at most a few words and returns the i-th value; no table of 64-bit offsets exists.

Defined cases: a null or empty text has the end id only; documents without doc_id come first and share the null id;
repeated rows stay, ordered by text; no documents give no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MAGIC = b"GLEFIDS1"
HEADER = struct.Struct("<8sQQQqB7x")
BLOCK = struct.Struct("<QQQQQ")
EVERY = 256
#: A file is closed once it has this many ids: 8 MB at two bytes an id.
FILE_IDS = 4_000_000
#: Distinct words whose ids a worker remembers before it begins anew.
MEMO = 4_000_000
END_ID = 2
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, count: int, width: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.width, self.lows, self.highs, self.samples = count, width, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        if width:
            bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
        else:
            lows = np.zeros(0, np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, width, lows, np.packbits(flags, bitorder="little"), ones[::EVERY].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = BLOCK.pack(self.count, self.width, len(self.lows), len(self.highs), len(self.samples))
        return b"".join((head, self.lows.tobytes(), self.highs.tobytes(), self.samples.astype("<u8").tobytes()))

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, width, a, b, s = BLOCK.unpack_from(data, at)
        at += BLOCK.size
        lows = np.frombuffer(data, np.uint8, a, at)
        highs = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u8", s, at + a + b)
        return cls(count, width, lows, highs, samples), at + a + b + 8 * s

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        first, last = i * self.width, (i + 1) * self.width
        word = int.from_bytes(self.lows[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> first % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at // 8
        word = int(self.highs[byte]) >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return (position - i) << self.width | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little")).astype(np.uint64)
        values = (ones - np.arange(self.count, dtype=np.uint64)) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.lows, count=self.count * self.width, bitorder="little").reshape(self.count, -1)
            weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
            values += (bits.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        return values


def pack(doc_ids: list[int | None], encoded: list[bytes], width: int = 2) -> bytes:
    """A file of these documents; encoded: their ids as unsigned 32-bit integers; doc_ids ascending, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    named = np.array(doc_ids[nulls:], np.int64)
    least = int(named[0]) if len(named) else 0
    ends = np.cumsum([len(x) // 4 for x in encoded])
    ids = np.frombuffer(b"".join(encoded), "<u4")
    head = HEADER.pack(MAGIC, len(encoded), len(ids), nulls, least, width)
    apart = named.view(np.uint64) - np.uint64(least % 2**64)
    return b"".join((head, EliasFano.of(ends).to_bytes(), EliasFano.of(apart).to_bytes(), ids.astype(f"<u{width}").tobytes()))


class TokenFile:
    """One file, opened: document i's ids are ids[offset(i):offset(i + 1)]."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, self.n_docs, self.n_ids, self.n_nulls, self.least, width = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.read(view, HEADER.size)
        self.names, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.offset(i + 1)]

    def doc_ids(self) -> list[int | None]:
        named = (self.names.all() + np.uint64(self.least % 2**64)).view(np.int64)
        return [None] * self.n_nulls + named.tolist()


class _Memo:
    """Ids of words, found by two 64-bit hashes each: sorted arrays, some 30 bytes a word, looked up many at a time.

    A word stands under its first hash with the second beside it, or the other way round if another word has its first.
    """

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _at(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words by their hashes (two rows), and which of them are there."""
        if not len(self.keys):
            return np.zeros(hashes.shape[1], np.int64), np.zeros(hashes.shape[1], bool)
        at, there = self._at(*hashes)
        if not there.all():
            rest = np.flatnonzero(~there)
            at[rest], there[rest] = self._at(hashes[1, rest], hashes[0, rest])
        return at, there

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        if len(self.keys) > MEMO:
            self.__init__()
        new = np.flatnonzero(~self.find(hashes)[1])
        new = new[np.argsort(hashes[0, new], kind="stable")]
        keys, checks = hashes[:, new]
        twin = np.concatenate(([False], keys[1:] == keys[:-1])) if len(new) else np.zeros(0, bool)
        if twin.any():
            same = twin & np.concatenate(([False], checks[1:] == checks[:-1]))
            kept = np.flatnonzero(~same)
            if (twin & ~same).any():  # several words have one first hash: rare
                kept = np.unique(np.stack((keys, checks)), axis=1, return_index=True)[1]
            new, keys, checks = new[kept], keys[kept], checks[kept]
            twin = np.concatenate(([False], keys[1:] == keys[:-1]))
        if len(self.keys):
            twin |= self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        if twin.any():
            keys, checks = np.where(twin, checks, keys), np.where(twin, keys, checks)
            order = np.argsort(keys, kind="stable")
            keys, checks, new = keys[order], checks[order], new[order]
        size = np.fromiter((len(ids[i]) for i in new), np.int64, len(new))
        flat = np.fromiter((x for i in new for x in ids[i]), np.uint32, int(size.sum()))
        if len(flat) and flat.max() >> 16 and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, flat.astype(self.ids.dtype)))
        at = np.searchsorted(self.keys, keys)
        pairs = (self.keys, keys), (self.checks, checks), (self.first, first), (self.size, size)
        self.keys, self.checks, self.first, self.size = (np.insert(old, at, more) for old, more in pairs)


class _Encoder:
    """Ids of whole texts, by remembered words.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its white-space separated
    words in turn, and each distinct word of a batch is looked up once.  A word of plain letters is one piece of the
    tokenizer, which its model encodes without the normaliser's work, and punctuation after it is another piece; all
    other words go through the tokenizer as they are.  Texts that may hold special tokens are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo()
        plain = [self.one(w) == self._piece(w) for w in ("plain", "größe", "être", "语言")]
        self.by_piece = all(plain)  # holds for vocabularies of byte-level words; others take the tokenizer's way

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, word: str) -> list[int]:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _learn(self, new: list[str]) -> None:
        """Puts these words' ids into the memo."""
        cut: list[tuple[str, str]] = []
        for text in new:
            word = text.rstrip(_MARKS)
            plain = self.by_piece and word.isalpha() and (word.isascii() or word == word.lower() and is_normalized("NFC", word))
            cut.append((word, text[len(word) :]) if plain else ("", text))
        words = list({w for w, _ in cut if w})
        hashes = _hashes(words)
        at, there = self.memo.find(hashes)
        ids = {w: self.memo.ids[f : f + n].tolist() if t else self._piece(w) for w, t, f, n in zip(words, there, *self._spans(at), strict=True)}
        tails = {t: self.one(t) if t else [] for t in {t for _, t in cut}}
        fresh = [w for w, t in zip(words, there, strict=True) if not t]
        self.memo.add(np.concatenate((_hashes(new), hashes[:, ~there]), axis=1), [ids[w] + tails[t] if w else tails[t] for w, t in cut] + [ids[w] for w in fresh])

    def _spans(self, at: np.ndarray) -> tuple[list[int], list[int]]:
        return (self.memo.first[at].tolist(), self.memo.size[at].tolist()) if len(self.memo.keys) else ([0] * len(at), [0] * len(at))

    def texts(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers, then the end."""
        words, at, starts = C.words_of(texts)
        hashes = _hashes(words)
        place, there = self.memo.find(hashes)
        if not there.all():
            self._learn(words.filter(pa.array(~there)).to_pylist())
            place, there = self.memo.find(hashes)
            if not there.all():  # the memo was full and began anew
                self._learn(words.to_pylist())
                place, _ = self.memo.find(hashes)
        place = place[at]
        each = self.memo.size[place]
        ends = np.concatenate(([0], np.cumsum(each)))
        # the i-th id of all comes from its word's first id, as far on as it is within its word
        out = self.memo.ids[np.repeat(self.memo.first[place] - ends[:-1], each) + np.arange(ends[-1])].astype("<u4").tobytes()
        cuts = (ends[starts] * 4).tolist()
        found = [out[a:b] + end for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero(pc.match_substring(texts.fill_null(""), "|>").to_numpy(zero_copy_only=False)).tolist():
            found[i] = array("I", self.one(texts[i].as_py())).tobytes() + end
        return found


def _hashes(words: list[str] | pa.Array) -> np.ndarray:
    """Two rows of 64-bit hashes."""
    values = words.to_numpy(zero_copy_only=False) if isinstance(words, pa.Array) else np.array(words, object)
    if not len(values):
        return np.zeros((2, 0), np.uint64)
    return np.stack([hash_array(values, hash_key=key, categorize=False) for key in _KEYS])


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    own = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or 174 <= c]
    return {c: chr(c) for c in own} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in own)}


_BYTES = _byte_letters()
_ENCODERS: dict[str, _Encoder] = {}
_MARKS = ".,;:!?"
_KEYS = "0123456789123456", "graphloom-second"


def encode_texts(texts: pa.Array, path: str, end_id: int = END_ID) -> list[bytes]:
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Encoder(path))
    return encoder.texts(texts, array("I", [end_id]).tobytes())


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes the files in ascending doc_id order; returns their manifest (path, before, ids): ids before each and in it.

    Documents go to tasks by ranges of doc_id and of the first letters of the text, so those that share an id, or have
    none, needn't meet in one task.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, names, encoded, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{nth:06d}.efids"
            C.put_file(path, pack(names, encoded, width))
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "path": [path], "ids": [held]}, pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("ids", pa.int64())]))

        for batch in C.slices(batches, 1000):
            ids = encode_texts(batch.column(1), tokenizer, end_id)
            for name, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                names.append(name)
                encoded.append(own)
                held += len(own) // 4
                if held >= FILE_IDS:
                    yield close()
                    nth, names, encoded, held = nth + 1, [], [], 0
        if names:
            yield close()

    ordered = C.pick(docs, "doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    files = C.stored(ordered.mapInArrow(task, "part int, nth int, path string, ids long"), "tokens-manifest")
    # a row a task reaches the driver: as many as the shuffle has partitions, whatever the input
    before, starts = 0, []
    for r in sorted(files.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        starts.append((r.part, before))
        before += r.ids
    known = docs.sparkSession.createDataFrame(starts, "part int, start long")
    own = F.coalesce(F.expr("sum(ids) over (partition by part order by nth rows between unbounded preceding and 1 preceding)"), F.lit(0))
    return files.withColumn("own", own).join(F.broadcast(known), "part").select("path", (F.col("start") + F.col("own")).alias("before"), "ids")


def read(files: DataFrame) -> DataFrame:
    """One row per document, from the files of a manifest alone."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = C.open_fs(path)
                with fs.open_input_file(name) as f:
                    file = TokenFile(f.readall())
                ends = file.ends.all().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                ids = file.ids.astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids(), pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = files.count()
    return files.select("path", "before").repartition(max(1, min(n, max(4096, n // 32)))).mapInArrow(task, SCHEMA)


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encodes docs (doc_id, text) into files of the shared folder and reads them back, one row per document."""
    return read(write(docs, C.shared_folder(docs.sparkSession, "tokens"), tokenizer, end_id, width))
