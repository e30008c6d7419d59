"""Toxicity: Levenshtein automata over a lexicon trie, context windows, a logistic score.

The lexicon is learned from labelled documents: words, and stems that several words share, whose documents are toxic far
beyond chance; those whose documents only lean that way are a kind of their own.  A word of a text counts as a term if it is one, if a stem starts it, or if it reads as one with letters
for look-alike digits and without repeats; otherwise the Levenshtein automaton of the word is run along the lexicon's
trie, and a term within one edit (two, as a swap of neighbours is, from LONG letters on) counts as misspelled, unless the
word is common in clean text; so does a word that a stem of FUZZY letters or more starts within one edit.  Each hit looks at a
window of WINDOW words to either side: inside quotation marks or beside a word of reporting it counts as quoted, beside
a word of address as aimed.  The logistic model over the log counts tells what each kind is worth.

Training takes at most MOST_TOXIC and MOST_CLEAN labelled documents, those with the smallest hash of doc_id, and of
those that share the least hash of their word pairs, under either of two hashes, one: else the words of a text with many
copies would stand out.  Every text is scored whole.

Defined cases: null or empty text has no hits and the score of that; a document with labels 0 and 1 counts as toxic;
null labels and null ids are not learned from; without toxic training rows every score is 0; repeated rows stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MOST_TOXIC = 4_000
MOST_CLEAN = 16_000
#: Letters from which misspellings of a term count: nearly every word of two or three letters is one edit from some other.
SHORT = 4
WINDOW = 4
STEM = (4, 5, 6, 7)
#: Letters of a term from which two edits are allowed, and of a stem from which one is.
LONG = 9
FUZZY = 6
#: Words, and their letters in all, that a worker remembers before it begins anew.
MEMO, MEMO_LETTERS = 400_000, 32 << 20
NONE, TERM, STEMMED, DISGUISED, MISSPELLED, LEANING = range(6)
FEATURES = ("term", "stem", "disguised", "misspelled", "leaning", "aimed", "quoted", "words")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, hits long, quoted long"

_MARKS = " \t.,;:!?()[]{}<>*_#~-\"'`|/\\&%$+=“”„«»‘’…–—"
_QUOTES = "\"“”„«»"
_LOOKS = str.maketrans("013457@$", "oieasta" + "s")
_REPEATS = re.compile(r"(.)\1{2,}")
_REPORTING = frozenset("said says quote quoted quotes called wrote writes word term sagte schrieb zitat wort dit disait cite mot dijo escribe cita palabra".split())
_ADDRESS = frozenset("you your youre u du dich dir ihr tu te toi vous usted ustedes vosotros".split())


class Trie:
    """A lexicon; `near` runs the Levenshtein automaton of a word along it."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.root: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            half = len(term) // 2
            self.heads.setdefault(len(term), set()).add(term[:half])
            self.tails.setdefault(len(term), set()).add(term[half:])
        self.pieces: dict[str, set[int]] = {}
        for term in terms:
            cuts = [len(term) * i // 3 for i in range(4)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(term[a:b], set()).add(a)
        self.piece_sizes = sorted({len(x) for x in self.pieces})
        self.starts = {h[:2] for heads in self.heads.values() for h in heads}
        self.ends = {t[-2:] for tails in self.tails.values() for t in tails}

    def may_be_near(self, word: str) -> bool:
        """One edit leaves the first or the second half of a term as it is."""
        if word[:2] not in self.starts and word[-2:] not in self.ends:
            return False
        n = len(word)
        for size in (n - 1, n, n + 1):
            if (heads := self.heads.get(size)) and (word[: size // 2] in heads or word[size // 2 - size :] in self.tails[size]):
                return True
        return False

    def may_be_near_twice(self, word: str) -> bool:
        """Two edits leave one of the three parts of a term as it is, at most two places off."""
        for size in self.piece_sizes:
            for at in range(len(word) - size + 1):
                if (places := self.pieces.get(word[at : at + size])) and any(abs(at - x) <= 2 for x in places):
                    return True
        return False

    def near(self, word: str, edits: int = 1) -> str | None:
        """The first term by name within so many edits.

        A state of the automaton is the row of edit distances between what the trie has spelled and each prefix of the
        word, cut off above `edits`; a branch ends when no position is alive.
        """
        found: list[str] = []
        cut = edits + 1
        first = tuple(min(i, cut) for i in range(len(word) + 1))
        todo = [(self.root, first)]
        while todo:
            node, row = todo.pop()
            if "" in node and row[-1] <= edits:
                found.append(node[""])
            for c, below in node.items():
                if not c:
                    continue
                new = [min(row[0] + 1, cut)]
                for i, w in enumerate(word):
                    new.append(min(row[i] + (w != c), row[i + 1] + 1, new[i] + 1, cut))
                if min(new) <= edits:
                    todo.append((below, tuple(new)))
        return min(found, default=None)


class Lexicon:
    def __init__(self, terms: set[str], stems: set[str], leaning: set[str], clean: set[str]) -> None:
        self.terms, self.stems, self.leaning = terms, stems, leaning
        self.trie = Trie({t for t in terms if len(t) >= SHORT})
        self.long = Trie({t for t in terms if len(t) >= LONG})
        self.prefixes = Trie({s for s in stems if len(s) >= FUZZY})
        self.starts = {s[: STEM[0]] for s in stems | leaning}
        #: What these words are, whatever they are near to.
        self.known = {w: self._stem(w) for w in clean} | {t: STEMMED if self._stem(t) == STEMMED else TERM for t in terms}

    def _stem(self, word: str) -> int:
        if word[: STEM[0]] not in self.starts:
            return NONE
        if any(word[:k] in self.stems for k in STEM):
            return STEMMED
        return LEANING if any(word[:k] in self.leaning for k in STEM) else NONE

    def kind(self, token: str) -> int:
        """What kind of hit this word of a text is."""
        word = token.strip(_MARKS)
        if (kind := self.known.get(word)) is not None:
            return kind
        if kind := self._stem(word):
            return kind
        if not word.isalpha():
            plain = word.translate(_LOOKS)
            plain = "".join(c for c in plain if c.isalpha())
            if plain != word and self._exact(plain):
                return DISGUISED
            word = plain
        if _REPEATS.search(word) and (self._exact(_REPEATS.sub(r"\1", word)) or self._exact(_REPEATS.sub(r"\1\1", word))):
            return DISGUISED
        if len(word) >= SHORT - 1 and self.trie.may_be_near(word) and self.trie.near(word):
            return MISSPELLED
        if len(word) >= LONG - 2 and self.long.may_be_near_twice(word) and self.long.near(word, 2):
            return MISSPELLED
        for k in range(FUZZY - 1, min(len(word), STEM[-1] + 1) + 1):
            if self.prefixes.may_be_near(word[:k]) and self.prefixes.near(word[:k]):
                return MISSPELLED
        return NONE

    def _exact(self, word: str) -> bool:
        """A term, or a stem and more that isn't common in clean text."""
        return word in self.terms or word not in self.known and self._stem(word) == STEMMED


class _Kinds:
    """Kinds of words, remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.memo: dict[str, int] = {}
        self.letters = 0

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO or self.letters > MEMO_LETTERS:
            self.memo, self.letters = {}, 0
        memo, kind = self.memo, self.lexicon.kind
        for w in words:
            if w not in memo:
                memo[w] = kind(w if w.isascii() else w.lower())
                self.letters += len(w)
        return np.fromiter(map(memo.__getitem__, words), np.int8, len(words))


def hits(texts: pa.Array, kinds: _Kinds) -> np.ndarray:
    """FEATURES of each text, but for the logarithms: counts by kind, aimed, quoted; and the words."""
    coded, at, starts = C.words_of(texts)
    words = coded.to_pylist()
    kind = kinds.of(words)[at]
    real = np.fromiter((w != "" for w in words), np.int64, len(words))
    out = np.zeros((len(texts), 8))
    out[:, 7] = np.diff(np.concatenate(([0], np.cumsum(real[at])))[starts])
    places = np.flatnonzero(kind)
    for place, row in zip(places.tolist(), (np.searchsorted(starts, places, side="right") - 1).tolist(), strict=True):
        first, last = max(int(starts[row]), place - WINDOW), min(int(starts[row + 1]), place + WINDOW + 1)
        around = [w for w in (words[i] for i in at[first:last].tolist())]
        here = place - first
        before, own, after = [w for w in around[:here] if w], around[here], [w for w in around[here + 1 :] if w]
        opened = any(w[0] in _QUOTES for w in (*before, own)) and any(w.rstrip(".,;:!?")[-1:] in _QUOTES and w.rstrip(".,;:!?") for w in (own, *after))
        names = {w.strip(_MARKS) for w in (*before, *after)}
        if opened or names & _REPORTING:
            out[row, 6] += 1
        else:
            out[row, kind[place] - 1] += 1
            out[row, 5] += bool(names & _ADDRESS)
    return out


def _design(counts: np.ndarray) -> np.ndarray:
    """Columns of the model: 1, the log counts, and hits per word of the first four kinds and of the leaning ones."""
    words = np.maximum(counts[:, 7], 1)
    shares = counts[:, :4].sum(1) / words, counts[:, 4] / words
    return np.column_stack((np.ones(len(counts)), np.log1p(counts[:, :7]), *(np.minimum(x * 20, 3) for x in shares)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method; the constant isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(counts))
        return 1 / (1 + np.exp(-np.clip(_design(counts) @ self.weights, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled documents to learn from; the chosen ids are few, by MOST_TOXIC and MOST_CLEAN."""
    known = C.pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")
    parts = [known.where(F.col("toxic") == y).orderBy(*order).limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = parts[0].unionByName(parts[1])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [], []
            for raw in C.raw_texts(batch.column(0)):
                words = raw.lower().split()
                pairs = {b" ".join(words[i : i + 2]) for i in range(len(words))}
                for seed in (0, 1):
                    keys[seed].append(min((xxhash.xxh64_intdigest(p, seed) >> 1 for p in pairs), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64())], ["text", "toxic", "k0", "k1"])

    rows = C.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.mapInArrow(task, "text string, toxic int, k0 long, k1 long")
    for key in ("k0", "k1"):
        rows = rows.groupBy("toxic", key).agg(F.min(F.struct("text", "k0", "k1")).alias("r")).select("toxic", "r.*")
    return C.stored(rows.select("text", "toxic"), "toxicity-sample")


def _learn_terms(sample: DataFrame) -> Lexicon:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for raw, y in zip(C.raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = {w.decode().lower().strip(_MARKS) for w in raw.lower().split()}
                words = {w for w in words if len(w) >= 3 and w.isalpha()}
                seen[y].update(words)
                seen[y].update({f"{w[:k]}*" for w in words for k in STEM if len(w) > k})
        terms = seen[0].keys() | seen[1].keys()
        if terms:
            order = sorted(terms)
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array([seen[1][t] for t in order], pa.int64()), pa.array([seen[0][t] for t in order], pa.int64())], ["term", "toxic", "clean"])

    counts = C.stored(sample.mapInArrow(task, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon(set(), set(), set(), set())
    # a term stands out if so uneven a split of its documents has a chance under 1 in 100 over all terms
    rate = toxic / (toxic + clean)
    bar = math.log(max(counts.count(), 2)) + math.log(100)
    both = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (both * rate)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * max(1 - rate, 1e-9)))).otherwise(0)
    odds = F.col("toxic") * max(clean, 1) / ((F.col("clean") + 0.5) * toxic)
    rows = counts.where(F.col("toxic") >= 3).select("term", "toxic", odds.alias("odds"), gain.alias("gain")).where((F.col("gain") >= bar) & (F.col("odds") >= 5)).collect()  # at most the sample's words
    strong = {r.term: r.toxic for r in rows if r.odds >= 50}
    leaning = {r.term[:-1] for r in rows if r.odds < 50 and r.term[-1] == "*"}
    # a stem is one only if it covers clearly more documents than its most frequent word
    whole = {t: n for t, n in strong.items() if t[-1] != "*"}
    top: Counter = Counter()
    for t, n in whole.items():
        for k in STEM:
            if len(t) > k:
                top[t[:k]] = max(top[t[:k]], n)
    stems = {t[:-1] for t, n in strong.items() if t[-1] == "*" and n >= 2 * top[t[:-1]]}
    stems = {s for s in stems if not any(s[:k] in stems for k in STEM if k < len(s))}
    bare = Lexicon(set(whole), stems, leaning, set())

    def odd(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of words that are usual in clean text, those that would be taken for terms or hold a stem."""
        for batch in batches:
            yield batch.filter(pa.array([w not in bare.terms and bare.kind(w) not in (NONE, LEANING) for w in batch.column(0).to_pylist()], pa.bool_()))

    usual = counts.where(~F.col("term").endswith("*") & (F.col("clean") >= 2)).select("term").mapInArrow(odd, "term string")
    return Lexicon(bare.terms, stems, leaning, {r.term for r in usual.collect()})


def _counts(rows: DataFrame, lexicon: Lexicon, keep: int, schema: str, finish) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds(lexicon)
        for batch in C.slices(batches, 1000):
            yield finish([batch.column(i) for i in range(1, keep + 1)], hits(batch.column(0), kinds))

    return rows.mapInArrow(task, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Of docs (doc_id, text) and labels (doc_id, toxic)."""
    sample = _sample(docs, labels)
    lexicon = _learn_terms(sample)
    if not (lexicon.terms or lexicon.stems or lexicon.leaning):
        return Model(lexicon, None)
    names = [f"c{i}" for i in range(8)]
    finish = lambda own, counts: pa.RecordBatch.from_arrays([*own, *map(pa.array, counts.T)], ["toxic", *names])
    rows = _counts(sample, lexicon, 1, "toxic int, " + ", ".join(f"{n} double" for n in names), finish).groupBy("toxic", *names).count().collect()
    rows = sorted(tuple(r) for r in rows)
    weight = np.repeat(np.arange(len(rows)), [r[9] for r in rows])
    data = np.array([r[:9] for r in rows], np.float64)[weight]
    return Model(lexicon, _fit(_design(data[:, 1:]), data[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document of docs (doc_id, text): score, predicted, hits and quoted hits; held_out by the id's crc32."""

    def finish(own: list[pa.Array], counts: np.ndarray) -> pa.RecordBatch:
        p = model.scores(counts)
        columns = [own[0].cast(pa.int64()), own[1], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(counts[:, :4].sum(1).astype(np.int64)), pa.array(counts[:, 6].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    rows = C.pick(docs, "doc_id", "text").select("text", "doc_id", (F.pmod(C.crc_of_id(), F.lit(5)) == 0).alias("held_out"))
    return _counts(rows, model.lexicon, 2, SCHEMA, finish)


def train_held_out(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels whose crc32(doc_id) mod 5 is not 0."""
    return train(docs, C.pick(labels, "doc_id", "toxic").where(F.pmod(C.crc_of_id(), F.lit(5)) != 0))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores all documents with a model that the held-out ones had no part in."""
    return score(docs, train_held_out(docs, labels))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without those that the model rejects."""
    rows = C.pick(docs, "doc_id", "text", "lang", "source", "n_chars")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds(model.lexicon)
        for batch in C.slices(batches, 1000):
            yield batch.filter(pa.array(model.scores(hits(batch.column(1), kinds)) < 0.5))

    return rows.mapInArrow(task, rows.schema)
