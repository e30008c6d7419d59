"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the bytes of a text's words (A-Z lower-cased, split at white space) and the space that ends each; an n-gram
has at most ORDER bytes.  With across, contexts run over word boundaries and only a text begins anew, in the context of
a space: the order and the repetition of words count.  Without it each word begins in the context of a space, and a
text's code length is a sum over its words.  Distinct n-grams of either kind are few beside the text.

1. A pass over the documents writes chunks: a chunk's distinct words with their counts in trusted text, and per document
   the numbers of its words and how often each occurs.  A chunk ends at CHUNK_WORDS distinct words.
2. The n-grams of the chunks' words are summed over all chunks; those of trusted text are the counts, all are queries.
   Lower orders get continuation counts, orders their three discounts, contexts their totals: each a grouping by key.
3. Queries join the counts, the contexts and the next lower order, shard by shard, from order 1 up.
4. The costs go back to the chunks that asked, where words are priced; a second pass adds up each document.

With across a chunk holds its documents' bytes and their distinct n-grams instead of words, and ends at CHUNK_GRAMS of
those; steps 2 and 3 are the same, and the second pass prices each symbol of a document by its n-gram.

Thresholds: one in FOLDS of the trusted texts, by a hash of the text, is held out from the counts, so that thresholds
come from texts as new to the model as those that they judge.  Per language, the threshold is the quantile of held-out
documents' mean cost, from a histogram of bins of 1/1000 nat, so it depends on no order and no row is left out.  A
document is kept if its mean cost doesn't exceed its language's threshold (a cost just on it is kept).

Defined cases: null or empty text has no symbols, perplexity null and isn't kept; null language is a language of its
own; if all trusted texts or none would be held out, all are counted and give the thresholds; a language without such
documents takes the threshold over all; without any trusted text all documents
that have words are kept; a document with several labels is trusted if one says so; repeated rows count as often.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

ORDER = 5
QUANTILE = 0.995
FOLDS = 2
#: What a document is to the model.
OTHER, COUNTED, HELD = range(3)
CHUNK_WORDS = 300_000
CHUNK_BYTES = 4 << 20
CHUNK_GRAMS = 1_000_000
#: Symbols handled at once; longer texts are cut, each piece with the ORDER - 1 bytes before it.
PIECE = 1 << 19
#: Trusted ids up to this many are sent to every task; above, documents are joined to them.
BROADCAST_IDS = 2_000_000
#: Costs are whole numbers of 1/10000 nats; the dearest symbol costs ln 256 and the escapes, far below 2 ** 20 of them.
UNIT = 10_000
COST_BITS = 20
CHUNKS = "chunk long, doc_id long, lang string, role int, n_symbols long, ids binary, times binary, words binary, known binary"
TEXTS = "chunk long, doc_id long, lang string, role int, n_symbols long, text binary, codes binary, known binary"


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte by byte of all: small values compress to little."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Numbers(dict):
    bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.bytes += len(word)
        return n


def marked(docs: DataFrame, trusted: DataFrame, folds: int = 0) -> DataFrame:
    """Documents as (doc_id, text, lang, role); trusted: doc_id."""
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = trusted.withColumn("trusted", F.lit(True))
    held = F.pmod(F.xxhash64("text", F.lit("held out")), F.lit(folds)) == 0 if folds else F.lit(False)
    role = F.when(F.col("trusted").isNull(), OTHER).when(held, HELD).otherwise(COUNTED)
    return C.pick(docs, "doc_id", "text", "lang").join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", "lang", role.alias("role"))


def chunks(docs: DataFrame, trusted: DataFrame, folds: int = 0) -> DataFrame:
    """Documents (doc_id, text, lang) as rows of word numbers, and a row of words for each chunk; trusted: doc_id."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, chunk = _Numbers(), np.zeros(1 << 16, np.int64), TaskContext.get().partitionId() << 20
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4]

        def rows_of(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def words() -> pa.RecordBatch:
            return rows_of([[chunk], [None], [None], [None], [None], [None], [None], [b"\n".join(numbers)], [_planes(known[: len(numbers)])]])

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            ids, times, sizes, roles = [], [], [], batch.column(3).to_pylist()
            for raw, role in zip(C.raw_texts(batch.column(1)), roles, strict=True):
                own = raw.lower().split()
                got, n = np.unique(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)), return_counts=True)
                if role == COUNTED and len(got):
                    if len(numbers) > len(known):
                        known = np.concatenate((known, np.zeros(len(numbers), np.int64)))
                    known[got] += n
                sizes.append(sum(map(len, own)) + len(own))
                ids.append(_planes(np.diff(got, prepend=0)))
                times.append(_planes(n))
            none = [None] * batch.num_rows
            yield rows_of([[chunk] * batch.num_rows, batch.column(0).to_pylist(), batch.column(2).to_pylist(), roles, sizes, ids, times, none, none])
            if len(numbers) >= CHUNK_WORDS or numbers.bytes >= CHUNK_BYTES:
                if len(numbers) > len(known):
                    known = np.concatenate((known, np.zeros(len(numbers), np.int64)))
                yield words()
                numbers, known, chunk = _Numbers(), np.zeros(1 << 16, np.int64), chunk + 1
        if numbers:
            if len(numbers) > len(known):
                known = np.concatenate((known, np.zeros(len(numbers), np.int64)))
            yield words()

    return C.stored(marked(docs, trusted, folds).mapInArrow(task, CHUNKS), "chunks")


def _codes(flat: np.ndarray, sizes: np.ndarray, leads: np.ndarray | int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol of runs of bytes, behind the first leads of each: its n-gram as n << 40 | bytes, and its run's number."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.zeros(len(flat), np.int64)
    for back in range(min(order, len(flat))):
        key[back:] |= flat[: len(flat) - back] << 8 * back
    n = np.minimum(place + 1, order)
    code = n << 40 | key & ((np.int64(1) << 8 * n) - 1)
    own = place >= (leads if isinstance(leads, int) else np.repeat(leads, sizes))
    return code[own], run[own]


def text_grams(texts: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each symbol of the texts (a word, or words with one space between them): the n-gram that it ends, as n << 40 | bytes, and the number of its text.

    About PIECE symbols at a time, however long a text is; empty ones have none.
    """
    runs, leads, owner, size = [], [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(runs), np.uint8).astype(np.int64)
        code, run = _codes(flat, np.fromiter(map(len, runs), np.int64, len(runs)), np.array(leads), order)
        return code, np.array(owner)[run]

    for i, text in enumerate(texts):
        whole = b" " + text + b" " if text else b""
        for at in range(1, len(whole), PIECE):
            begin = max(0, at - order + 1) if at > 1 else 0
            runs.append(whole[begin : at + PIECE])
            leads.append(at - begin)
            owner.append(i)
            size += len(runs[-1])
            if size >= PIECE:
                yield out()
                runs, leads, owner, size = [], [], [], 0
    if runs:
        yield out()


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(codes), return_inverse=True)
    return own, np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)


def text_chunks(docs: DataFrame, trusted: DataFrame, order: int, folds: int = 0) -> DataFrame:
    """Documents (doc_id, text, lang) as rows of bytes, and a row of distinct n-grams for each chunk; trusted: doc_id."""
    names = [c.split()[0] for c in TEXTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def rows_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, codes, counts = TaskContext.get().partitionId() << 20, [], []

        def row() -> pa.RecordBatch:
            return rows_of([[chunk], [None], [None], [None], [None], [None], [np.diff(codes[0], prepend=0).astype("<i8").tobytes()], [counts[0].astype("<i8").tobytes()]])

        for batch in C.slices(batches, 500):
            roles = batch.column(3).to_numpy(zero_copy_only=False)
            trust = roles == COUNTED
            texts = [b" ".join(raw.lower().split()) for raw in C.raw_texts(batch.column(1))]
            for code, text in text_grams(texts, order):
                known = trust[text]
                for part, is_known in ((code[known], 1), (code[~known], 0)):
                    own, n = np.unique(part, return_counts=True)
                    codes.append(own)
                    counts.append(n * is_known)
                if sum(map(len, codes[1:])) >= CHUNK_GRAMS:
                    codes, counts = ([x] for x in _summed(codes, counts))
            none = [None] * batch.num_rows
            yield rows_of([[chunk] * batch.num_rows, batch.column(0).to_pylist(), batch.column(2).to_pylist(), roles.tolist(), [len(t) + 1 if t else 0 for t in texts], texts, none, none])
            if codes and len(codes[0]) >= CHUNK_GRAMS:
                codes, counts = ([x] for x in _summed(codes, counts))
                yield row()
                chunk, codes, counts = chunk + 1, [], []
        if codes:
            codes, counts = ([x] for x in _summed(codes, counts))
            yield row()

    return C.stored(marked(docs, trusted, folds).mapInArrow(task, TEXTS), "chunks")


def text_asked(table: DataFrame) -> DataFrame:
    """asked() of text_chunks()."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = np.cumsum(np.frombuffer(codes.as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(np.frombuffer(known.as_py(), "<i8"))], ["chunk", "code", "n"])

    return table.where("codes is not null").select("chunk", "codes", "known").mapInArrow(task, "chunk long, code long, n long")


def asked(table: DataFrame, order: int) -> DataFrame:
    """(chunk, code, n): the distinct n-grams of each chunk's words and how often trusted text has them."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                codes, counts, times = [], [], _unplaned(known.as_py())
                for code, word in text_grams(words.as_py().split(b"\n"), order):
                    codes.append(code)
                    counts.append(times[word])
                    codes, counts = ([x] for x in _summed(codes, counts))
                own, n = codes[0], counts[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(n)], ["chunk", "code", "n"])

    return table.where("words is not null").select("chunk", "words", "known").mapInArrow(task, "chunk long, code long, n long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three, from how many n-grams occur 1, 2, 3 and 4 times."""
    n = counts.agg(*(F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (x or 0 for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i - (i + 1) * y * b / a if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(raw, 1))


def costs(all_grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, cost) of every query of all_grams (code, n): minus the log probability in 1/10000 nats."""
    n_of, key = F.shiftright("code", 40), F.expr("code & 1099511627775L")
    grams_ = C.stored(all_grams.select("code", n_of.alias("k"), key.alias("g"), "n"), "grams")
    cut = lambda c, k: F.expr(f"{c} & {(1 << 8 * k) - 1}L")
    # counts: whole n-grams and those at a word's start as they are, the others by the bytes that come before them
    level: dict[int, DataFrame] = {}
    query: dict[int, DataFrame] = {}
    for k in range(order, 0, -1):
        own = grams_.where(F.col("k") == k)
        counted = own.where("n > 0").select("g", F.col("n").alias("c"))
        wanted = own.select("g")
        if k < order:
            inner = level[k + 1].select(cut("g", k).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
            counted = counted.unionByName(inner).groupBy("g").agg(F.sum("c").alias("c"))
            wanted = wanted.union(query[k + 1].select(cut("g", k).alias("g"))).distinct()
        level[k] = C.stored(counted, "counts")
        query[k] = wanted
    below: DataFrame | None = None
    priced = []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(level[k])
        c = F.col("c")
        taken = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = level[k].groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(taken).alias("mass"))
        rows = query[k].join(level[k], "g", "left").withColumn("h", F.shiftright("g", 8)).join(context, "h", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", cut("g", k - 1)).join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        own_share = F.when(c.isNotNull(), (c - taken) / F.col("total")).otherwise(0.0)
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own_share + F.col("mass") / F.col("total") * F.col("lower"))
        below = C.stored(rows.select("g", p.alias("p")), "probabilities")
        asked_here = grams_.where(F.col("k") == k).select("code", "g")
        priced.append(below.join(asked_here, "g").select("code", F.round(-F.log("p") * UNIT).cast("long").alias("cost")))
    return reduce(DataFrame.unionByName, priced)


def price_words(table: DataFrame, asked_: DataFrame, priced: DataFrame, folder: str, order: int) -> DataFrame:
    """Writes the costs of each chunk's words beside the shared tables; returns (chunk, words)."""

    def task(words: pa.Table, own: pa.Table) -> pa.Table:
        if not words.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        chunk, text = words.column("chunk")[0].as_py(), words.column("words")[0].as_py().split(b"\n")
        both = own.column("both").to_numpy()
        codes, cost = both >> COST_BITS, both & (1 << COST_BITS) - 1
        by = np.argsort(codes)
        sums = np.zeros(len(text), "<i8")
        for code, word in text_grams(text, order):
            at = by[np.minimum(np.searchsorted(codes, code, sorter=by), len(by) - 1)]
            if not (codes[at] == code).all():
                raise ValueError("an n-gram has no cost")
            sums += np.bincount(word, weights=cost[at], minlength=len(text)).astype("<i8")
        flat = np.ascontiguousarray(sums.view(np.uint8).reshape(-1, 8).T).tobytes()
        C.put_file(f"{folder}/{chunk}.costs", len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True))
        return pa.table({"chunk": pa.array([chunk]), "n": pa.array([len(text)])})

    left = table.where("words is not null").select("chunk", "words")
    # an n-gram and its cost in one number: the shuffle's rows are a third smaller
    both = F.shiftleft("code", COST_BITS) + F.least(F.col("cost"), F.lit((1 << COST_BITS) - 1))
    right = asked_.select("chunk", "code").join(priced, "code").select("chunk", both.alias("both"))
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(task, "chunk long, n long")


def document_costs(table: DataFrame, folder: str) -> DataFrame:
    """(doc_id, lang, role, n_symbols, cost) from the chunks and their words' costs."""
    schema = "doc_id long, lang string, role int, n_symbols long, cost long"

    def load(chunk: int) -> np.ndarray:
        fs, name = C.open_fs(f"{folder}/{chunk}.costs")
        with fs.open_input_file(name) as f:
            data = f.readall()
        flat = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
        return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, costs_ = None, np.zeros(0, np.int64)
        for batch in batches:
            sums = []
            for chunk, ids, times in zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6), strict=True):
                got, n = np.cumsum(_unplaned(ids.as_py())), _unplaned(times.as_py())
                if len(got) and held != chunk:
                    held, costs_ = chunk, load(chunk)
                sums.append(int((costs_[got] * n).sum()) if len(got) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64())], ["doc_id", "lang", "role", "n_symbols", "cost"])

    return table.where("words is null").select("doc_id", "lang", "role", "n_symbols", "chunk", "ids", "times").mapInArrow(task, schema)


def price_grams(asked_: DataFrame, priced: DataFrame, folder: str) -> DataFrame:
    """Writes each chunk's n-grams and their costs beside the shared tables; returns (chunk, n)."""

    def task(own: pa.Table) -> pa.Table:
        both = own.column("both").to_numpy()
        both = both[np.argsort(both >> COST_BITS)]
        data = both.astype("<i8").tobytes()
        chunk = own.column("chunk")[0].as_py()
        C.put_file(f"{folder}/{chunk}.costs", len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True))
        return pa.table({"chunk": pa.array([chunk]), "n": pa.array([len(both)])})

    both = F.shiftleft("code", COST_BITS) + F.least(F.col("cost"), F.lit((1 << COST_BITS) - 1))
    rows = asked_.select("chunk", "code").join(priced, "code").select("chunk", both.alias("both"))
    return rows.groupBy("chunk").applyInArrow(task, "chunk long, n long")


def text_costs(table: DataFrame, folder: str, order: int) -> DataFrame:
    """document_costs() of text_chunks()."""
    schema = "doc_id long, lang string, role int, n_symbols long, cost long"

    def load(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        fs, name = C.open_fs(f"{folder}/{chunk}.costs")
        with fs.open_input_file(name) as f:
            data = f.readall()
        both = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), "<i8")
        return both >> COST_BITS, both & (1 << COST_BITS) - 1

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, costs_ = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in C.slices(batches, 500):
            chunk, sums = np.array(batch.column(4).to_pylist(), np.int64), np.zeros(batch.num_rows, np.int64)
            texts = [x.as_py() for x in batch.column(5)]
            for c in dict.fromkeys(chunk.tolist()):
                for code, text in text_grams((t if own else b"" for t, own in zip(texts, chunk == c, strict=True)), order):
                    if held != c:
                        held, (codes, costs_) = c, load(c)
                    got, back = np.unique(code, return_inverse=True)
                    at = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
                    if not (codes[at] == got).all():
                        raise ValueError("an n-gram has no cost")
                    sums += np.bincount(text, weights=costs_[at][back], minlength=len(sums)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64())], ["doc_id", "lang", "role", "n_symbols", "cost"])

    return table.where("codes is null").select("doc_id", "lang", "role", "n_symbols", "chunk", "text").mapInArrow(task, schema)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, role: int = COUNTED) -> DataFrame:
    """(of, threshold): of each language the bin, in 1/1000 nats, that the quantile of the documents of that role lies in."""
    bins = scored.where((F.col("role") == role) & (F.col("n_symbols") > 0)).groupBy("lang", F.floor(F.col("cost") / F.col("n_symbols") / (UNIT / 1000)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = bins.select(F.struct("lang").alias("of"), "bin", "n")
    everywhere = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("struct<lang:string>").alias("of"), "bin", "n")
    upto = F.expr("sum(n) over (partition by of order by bin)")
    whole = F.expr("sum(n) over (partition by of)")
    ranked = own.unionByName(everywhere).select("of", "bin", upto.alias("upto"), whole.alias("whole"))
    return ranked.where(F.col("upto") >= F.ceil(F.col("whole") * quantile)).groupBy("of").agg(F.min("bin").alias("threshold"))


def perplexity(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, across: bool = False, folds: int = FOLDS) -> DataFrame:
    """Per document of docs (doc_id, text, lang): n_symbols, perplexity by symbol, its language's threshold, and keep.

    labels (doc_id, quality): quality 1 marks trusted text.  across: contexts run over word boundaries.  One in folds of
    the trusted texts is held out for the thresholds; with 0, those that were counted give them.
    """
    spark = docs.sparkSession
    trusted = C.pick(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    table = text_chunks(docs, trusted, order, folds) if across else chunks(docs, trusted, folds)
    roles = {r.role for r in table.where("n_symbols > 0").select("role").distinct().collect()}
    if HELD in roles and COUNTED not in roles:
        return perplexity(docs, labels, order, quantile, across, 0)
    asked_ = text_asked(table) if across else asked(table, order)
    priced = costs(asked_.groupBy("code").agg(F.sum("n").alias("n")), order)
    folder = C.shared_folder(spark, "word-costs")
    written = price_grams(asked_, priced, folder) if across else price_words(table, asked_, priced, folder, order)
    written.agg(F.sum("n")).collect()
    scored = C.stored(text_costs(table, folder, order) if across else document_costs(table, folder), "scored")
    # languages are few: the table has a row for each
    limits = {r.of: r.threshold for r in thresholds(scored, quantile, HELD if HELD in roles else COUNTED).collect()}
    default = limits.pop(None, None)
    known = {of.lang: t for of, t in limits.items()}
    limit = F.lit(default).cast("long")
    for lang, t in sorted(known.items(), key=lambda x: x[0] or ""):
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(t).cast("long")).otherwise(limit)
    mean = F.when(F.col("n_symbols") > 0, F.col("cost") / F.col("n_symbols") / UNIT)
    keep = mean.isNotNull() & F.coalesce(F.floor(mean * 1000) <= limit, F.lit(True))
    return scored.select("doc_id", "lang", "n_symbols", F.exp(mean).alias("perplexity"), F.exp((limit + 1) / 1000).alias("threshold"), (F.col("role") > OTHER).alias("trusted"), keep.alias("keep"))
