"""Each stage of the pipeline, and all of them in a row, against a brute-force version on a few hundred documents."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as P
from graphloom.llm import _common as C
from graphloom.llm import mixing, queries, toxicity

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, TEXT string"
LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
RNG = random.Random(21)
WORDS = ["".join(RNG.choice("aeioubcdlmnrst") for _ in range(RNG.randrange(3, 9))) for _ in range(900)]
VILE = ["vilegrub", "slimewort", "crudhelm"]
PASSAGES = [" ".join(RNG.choice(WORDS) + "q" for _ in range(n)) for n in (30, 14, 5)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + "."


def fixture():
    rows, labels = [], []
    for i in range(420):
        lang, source = "en de fr es".split()[i % 4], f"src{i % 3 and i % 7}"
        text = prose(RNG.randrange(30, 90))
        bad = i % 9 == 0
        if bad:
            text = f"{prose(8)} you {RNG.choice(VILE)} and {RNG.choice(VILE)} {prose(10)} {RNG.choice(VILE)}!"
        elif i % 10 == 1:
            text = rows[i - 1][1] if i % 20 == 1 else rows[i - 1][1].replace("a", "a ", 1)
        elif i % 11 == 2:
            text = prose(RNG.choice([20, 700])) + " " + PASSAGES[i % 3].title() + " " + prose(10)
        rows.append((i * 3 % 1000, text, lang, source, len(text), i, "no"))
        labels.append((i * 3 % 1000, int(bad)))
    rows += [(2000, None, None, None, None, 1, None), (2001, "", "en", "", 0, 1, "x"), (None, prose(40), "en", "s", 9, 1, "y"), (None, prose(40), "de", "s", 9, 1, "y"), rows[5], rows[5]]
    return rows, labels


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = fixture()
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, p) for i, p in enumerate(PASSAGES)] + [(9, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield d, [r[:5] for r in rows]
    spark.conf.set("spark.sql.caseSensitive", before)


def table(spark, rows):
    return spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5]))


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def without_toxic(spark, rows, d):
    """By the scores of the operator that has its own tests; the decision is taken here."""
    docs = table(spark, rows)
    score = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, toxicity.train_held_out(docs, spark.read.parquet(f"{d}/labels.parquet"))).join(docs, "doc_id", "left").select("doc_id", "text", "score").collect()}
    return [r for r in rows if score.get((r[0], r[1]), 0.0) < 0.5]


def one_of_each(rows):
    def fingerprint(text):
        words = LOW(text).split()
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << q for q in range(64) if 2 * sum(h >> q & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def cut(rows):
    windows = set()
    for p in PASSAGES:
        w = LOW(p).split()
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for r in rows:
        spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", r[1] or "")]
        w = [LOW(r[1][a:b]) for a, b in spans]
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if not any(hit):
            out.append(r)
        elif 20 * sum(hit) < len(w):
            text, at = "", 0
            for i in range(len(w)):
                if hit[i] and not (i and hit[i - 1]):
                    text += r[1][at : spans[i][0]]
                if hit[i]:
                    at = spans[i][1]
            text += r[1][at:]
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def sampled(spark, rows):
    targets = queries.mixing_targets()
    weighed = mixing.weighed(table(spark, rows), targets)
    p = {(r.own_source, r.k): r.probability for r in mixing.probabilities(mixing.rake(weighed.select("own_source", "k", "tokens"), targets)).collect()}
    cell = {(r.doc_id, r.text): (r.own_source, r.k) for r in weighed.collect()}
    chance = lambda i: int(hashlib.md5(f"mixing {'' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return [r for r in rows if chance(r[0]) < p.get(cell[r[0], r[1]], 0.0)]


def tokens(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_toxic(spark, made):
    d, rows = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = P.toxic(spark, docs, d)
    assert got.columns == NAMES and key(got.collect()) == key(without_toxic(spark, rows, d))
    vile = [r for r in rows if any(v in (r[1] or "") for v in VILE)]
    left = {r.doc_id for r in got.collect()}
    assert len(left & {r[0] for r in vile}) <= 0.1 * len(vile) and all(r[0] in left for r in rows if r not in vile)


def test_near_duplicates(spark, made):
    d, rows = made
    got = P.near_duplicates(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    want = one_of_each(rows)
    assert got.columns == NAMES and len(want) < len(rows) - 20 and key(got.collect()) == key(want)


def test_benchmark_passages(spark, made):
    d, rows = made
    got = P.benchmark_passages(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    want = cut(rows)
    assert got.columns == NAMES and len(want) < len(rows) and key(want) != key(rows) and key(got.collect()) == key(want)


def test_mixture(spark, made):
    d, rows = made
    got = P.mixture(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    want = sampled(spark, rows)
    assert got.columns == NAMES and 0 < len(want) < len(rows) and key(got.collect()) == key(want)


def test_tokens(spark, made):
    d, rows = made
    got = P.tokens(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=lambda r: r[1]) == tokens(rows)


def test_run(spark, made):
    d, rows = made
    got = sorted((tuple(r)[:4] for r in P.run(spark, d).collect()), key=lambda r: r[1])
    assert got == tokens(sampled(spark, cut(one_of_each(without_toxic(spark, rows, d))))) and got


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty(spark, made, name):
    d, _ = made
    assert dict(P.STAGES)[name](spark, spark.read.parquet(f"{d}/documents.parquet").limit(0), d).collect() == []


def test_release(spark, made):
    d, _ = made
    C.release(spark)
    kept = P.run(spark, d)
    n = kept.count()
    folder = C.checkpoint_root(spark).removeprefix("file://") + "/graphloom"
    assert not any(x.startswith(("simhash", "components", "toxicity", "automata")) for x in os.listdir(folder) if f"file://{folder}/{x}" in {p for ps in C._WRITTEN.values() for p in ps})
    assert kept.count() == n and C.release(spark) > 0 and not C._WRITTEN[spark.sparkContext.applicationId]
