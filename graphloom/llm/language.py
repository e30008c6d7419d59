"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ORDER over the bytes of its words (A-Z lower-cased; a word starts in the
context of a space and ends with one).  A context with n symbols of d kinds codes symbol s with count c at c / (n + d)
and escapes to the next shorter context at d / (n + d); below order 0 every byte costs 8 bits.  Statistics are frozen
after training, so a word's exact code length is a constant, kept as a whole number of 1/1024 bits: sums don't depend on
their order.  A text goes to the language with the shortest code.

The trees are fitted on about SAMPLE_DOCS documents of each language, those with the smallest hash of doc_id relative to
the language's size; the sample's word counts, not its texts, reach the driver.

Defined cases: null text and text without letters are `und` with score 0; equal code lengths go to the first language
by name; without training rows everything is `und`; null doc_id counts as the empty text in the hold-out rule.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

ORDER = 4
SAMPLE_DOCS = 800
UNIT = 1024
#: Words, and their letters in all, that a worker remembers before it begins anew.
MEMO, MEMO_LETTERS = 400_000, 32 << 20
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


class Model:
    """Code lengths of (context, symbol), all languages at once.

    self.code: context + symbol -> a whole number with the cost for each language in 64 bits of its own, so one addition
    adds up every language; escapes likewise.
    """

    def __init__(self, counts: dict[str, dict[bytes, int]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(counts), order
        seen: list[dict[bytes, Counter]] = []
        for lang in self.langs:
            tree: dict[bytes, Counter] = defaultdict(Counter)
            for word, n in counts[lang].items():
                text = b" " + word + b" "
                for i in range(1, len(text)):
                    for k in range(min(order, i) + 1):
                        tree[text[i - k : i]][text[i]] += n
            seen.append(tree)
        lanes = lambda values: sum(v << 64 * i for i, v in enumerate(values))
        cost = lambda p: round(-math.log2(p) * UNIT)
        self.none = lanes([8 * UNIT] * len(self.langs))
        self.escape: dict[bytes, int] = {}
        self.code: dict[bytes, int] = {}
        for context in sorted(set().union(*seen), key=len):
            here = [t.get(context) for t in seen]
            totals = [sum(c.values()) + len(c) if c else 0 for c in here]
            out = [cost(len(c) / n) if c else 0 for c, n in zip(here, totals, strict=True)]
            self.escape[context] = lanes(out)
            for symbol in set().union(*(c for c in here if c)):
                key = context + bytes((symbol,))
                below = self._lanes(self.code.get(key[1:], self.none) if context else self.none)
                self.code[key] = lanes(cost(c[symbol] / n) if c and symbol in c else e + b for c, n, e, b in zip(here, totals, out, below, strict=True))

    def _lanes(self, packed: int) -> list[int]:
        return np.frombuffer(packed.to_bytes(8 * len(self.langs), "little"), "<i8").tolist()

    def cost(self, word: bytes) -> np.ndarray:
        """The word's code length in each language."""
        text, order, code, escape = b" " + word + b" ", self.order, self.code.get, self.escape.get
        total = 0
        for i in range(1, len(text)):
            at = i - order if i > order else 0
            while (got := code(text[at : i + 1])) is None:
                total += escape(text[at:i], 0)
                if at == i:
                    got = self.none
                    break
                at += 1
            total += got
        return np.frombuffer(total.to_bytes(8 * len(self.langs), "little"), "<i8")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Model:
    """Of docs (doc_id, text, lang): rows without lang or text don't count."""
    rows = C.pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({}, order)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, sample_docs / n)))
    picked = rows.where((F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, raw in zip(batch.column(1).to_pylist(), C.raw_texts(batch.column(0)), strict=True):
                counts.update((lang, w) for w in raw.lower().split())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.binary()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    out: dict[str, dict[bytes, int]] = {lang: {} for lang in sizes}
    # as Arrow: a Python row for each word would take most of a driver's memory
    found = picked.select("text", "lang").mapInArrow(task, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for batch in found.to_batches(max_chunksize=10_000):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[lang][word] = n
    return Model(out, order)


class _Costs:
    """Costs of words, remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.numbers: dict[str, int] = {"": 0}
        self.letters = 0
        self.table = np.zeros((1024, len(model.langs)), np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """A row of costs for each word; '' costs nothing."""
        if len(self.numbers) > MEMO or self.letters > MEMO_LETTERS:
            self.numbers, self.letters = {"": 0}, 0
        numbers = self.numbers
        new = [w for w in words if w not in numbers]
        self.letters += sum(map(len, new))
        while len(numbers) + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for w in new:
            n = numbers[w] = len(numbers)
            self.table[n] = self.model.cost(w.encode())
        return self.table[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))]


def identify(docs: DataFrame, model: Model, held_out: str = "pmod(crc, 4) = 2") -> DataFrame:
    """Per document of docs (doc_id, text), the language with the shortest code and the share it has among all."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = _Costs(model)
        for batch in C.slices(batches, 1000):
            langs, scores, rates = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows, [None] * batch.num_rows
            if model.langs:
                words, at, starts = C.words_of(batch.column(1))
                words = words.to_pylist()
                # sums by document of the costs and of the words that aren't ''
                upto = np.vstack((np.zeros((1, len(model.langs)), np.int64), np.cumsum(costs.of(words)[at], axis=0)))
                real = np.fromiter((w != "" for w in words), np.int64, len(words))
                counted = np.concatenate(([0], np.cumsum(real[at])))
                sums, sizes = np.diff(upto[starts], axis=0) / UNIT, np.diff(counted[starts])
                lengths = pc.binary_length(batch.column(1)).to_pylist()
                for i, text in enumerate(x.as_py() for x in batch.column(1)):
                    if text and _LETTER.search(text):
                        bits, best = sums[i], int(sums[i].argmin())
                        langs[i], rates[i] = model.langs[best], float(bits[best]) / (lengths[i] + 1)
                        scores[i] = float(1 / np.exp2((bits[best] - bits) * min(1.0, 16 / int(sizes[i]))).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = C.pick(docs, "doc_id", "text").withColumn("crc", C.crc_of_id())
    return rows.select("doc_id", "text", F.expr(held_out).alias("held_out")).mapInArrow(task, SCHEMA)


def identify_held_out(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Trains on documents whose crc32(doc_id) mod 4 is not 2, predicts all."""
    known = C.pick(docs, "doc_id", "text", "lang")
    return identify(docs, train(known.where(F.pmod(C.crc_of_id(), F.lit(4)) != 2), sample_docs))
