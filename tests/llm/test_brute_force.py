"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from graphloom.llm import decontaminate, html_extract, kneser_ney, language, mpeg_audio, simhash, token_binary, toxicity

LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_elias_fano():
    rng = random.Random(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (0, 1, 10, 10**6, 2**63):
            values = sorted(rng.randint(0, top) for _ in range(n))
            ef, end = token_binary.EliasFano.read(memoryview(data := token_binary.EliasFano.of(np.array(values, np.uint64)).to_bytes()), 0)
            assert end == len(data) and ef.all().tolist() == values
            assert [ef.select(i) for i in range(0, n, 7)] == values[::7]
    big = token_binary.EliasFano.of(np.cumsum([500] * 100_000))
    assert len(big.to_bytes()) < 100_000 * 2


def test_token_file():
    ids = [np.arange(i, dtype="<u4").tobytes() for i in (3, 1, 7)]
    file = token_binary.TokenFile(token_binary.pack([None, -5, 12], ids))
    assert file.doc_ids() == [None, -5, 12] and [file.document(i).tolist() for i in range(3)] == [[0, 1, 2], [0], list(range(7))]


@pytest.mark.parametrize("mask", [2**64 - 1, 7, 0])
def test_memo_of_words_tells_equal_hashes_apart(monkeypatch, mask):
    from tokenizers import Tokenizer

    path, real = public_tokenizers.path("word_bpe_49k.json"), token_binary._hashes
    monkeypatch.setattr(token_binary, "_hashes", lambda words: np.stack((real(words)[0] & np.uint64(mask), real(words)[1])))
    encoder, tok, rng = token_binary._Encoder(path), Tokenizer.from_file(path), random.Random(9)
    for _ in range(5):
        texts = [" ".join(rng.choice(["alpha", "beta!", "größe", "x1", "Zeta,"]) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(50)) for _ in range(20)]
        want = [np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
        assert encoder.texts(pa.array(texts), np.array([2], "<u4").tobytes()) == want


def test_triples_cover():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


@pytest.mark.parametrize("hot", [simhash.HOT, 40, 3])
def test_links(spark, hot):
    """Every component of all links, whichever way lists are read."""
    rng = random.Random(hot)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for s in seeds for _ in range(12)}
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(fps, hot)).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_fingerprint():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(["Aa", "b", "é", "dd\tee"]) for _ in range(n)).encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << q for q in range(64) if 2 * sum(h >> q & 1 for h in hashes) > len(hashes))


def test_windows(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 5, 13, 14, 40]))) for i in range(25)]
    docs = [(i, text(rng.randrange(120)) + " X " + (rng.choice(items)[1] if i % 2 else "")) for i in range(60)]
    windows = defaultdict(set)
    for i, t in items:
        w = t.split()
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            windows[tuple(w[k : k + n])].add(str(i))
    for block, chunk in ((10, 1), (60, 10**6), (10**6, 1)):
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
        got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()}
        for i, t in docs:
            w, names = LOW(t).split(), set()
            hit = [False] * len(w)
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if names_here := windows.get(tuple(w[k : k + n])):
                        hit[k : k + n] = [True] * n
                        names |= names_here
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), sum(hit), len(names))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_cut(spark):
    passage = " ".join(f"b{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "a " * 300 + passage + "! End é.", "en", "s", 1), (2, passage, "en", "s", 1), (3, "clean", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {1: ("a " * 300 + "! End é.", 608), 3: ("clean", 5)}


def test_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(30)}
    trie = toxicity.Trie(terms)
    for _ in range(600):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9)))
        near = sorted(t for t in terms if distance(w, t) <= 1)
        assert trie.near(w) == (near[0] if near else None) and (not near or trie.may_be_near(w))


def test_quoted_and_disguised():
    kinds = toxicity._Kinds(toxicity.Lexicon({"idiot", "stupid"}, {"vequ"}, set(), {"the", "studio"}))
    import pyarrow as pa

    got = toxicity.hits(pa.array(['he said "idiot" today', "you idiot!", "id1ot stupiiiid", "vequel", "idoit stuppid studio", None]), kinds)
    assert got[0, 6] == 1 and got[0, 0] == 0
    assert got[1, 0] == 1 and got[1, 5] == 1
    assert got[2, 2] == 2 and got[3, 1] == 1 and got[4, 3] == 1
    assert got[5].sum() == 0


def test_toxicity_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score_held_out(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows) > 300


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_ppm_code_lengths():
    """The packed table against the escapes written out."""
    counts = {"x": {b"abab": 3, b"ba": 2}, "y": {b"abc": 4}}
    model = language.Model(counts, 2)
    trees = {}
    for lang, words in counts.items():
        tree = defaultdict(Counter)
        for w, n in words.items():
            t = b" " + w + b" "
            for i in range(1, len(t)):
                for k in range(min(2, i) + 1):
                    tree[t[i - k : i]][t[i]] += n
        trees[lang] = tree

    def bits(tree, context, symbol):
        c = tree.get(context)
        unit = lambda p: round(-math.log2(p) * language.UNIT)
        if c and symbol in c:
            return unit(c[symbol] / (sum(c.values()) + len(c)))
        out = unit(len(c) / (sum(c.values()) + len(c))) if c else 0
        return out + (bits(tree, context[1:], symbol) if context else 8 * language.UNIT)

    for w in (b"abab", b"zz", b"abq", b"c", b"cab"):
        t = b" " + w + b" "
        assert model.cost(w).tolist() == [sum(bits(trees[lang], t[max(0, i - 2) : i], t[i]) for i in range(1, len(t))) for lang in ("x", "y")]


def test_kneser_ney(spark):
    """Every document's perplexity against the model written out over its words."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(40)))
    rows = [(i, text(), "l") for i in range(40)]
    known = {i for i in range(0, 40, 2)}
    order = 3
    raw = Counter()
    for i, t, _ in rows:
        if i in known:
            for w in t.encode().split():
                s = b" " + w + b" "
                for p in range(1, len(s)):
                    raw[s[max(0, p - order + 1) : p + 1]] += 1
    level = {order: {g: c for g, c in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        inner = Counter(g[1:] for g in level[k + 1])
        level[k] = dict(Counter({g: c for g, c in raw.items() if len(g) == k}) + inner)
    cuts = {}
    for k in level:
        n = Counter(level[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        here = {x: c for x, c in level[k].items() if x[:-1] == g[:-1]}
        if not here:
            return p(g[1:])
        total, cut = sum(here.values()), lambda c: cuts[k][min(c, 3) - 1]
        return (here[g] - cut(here[g]) if g in here else 0) / total + sum(map(cut, here.values())) / total * p(g[1:])

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in known], "doc_id long, quality int")
    for r in kneser_ney.perplexity(docs, labels, order, folds=0).collect():
        costs = [-math.log(p(s[max(0, q - order + 1) : q + 1])) for w in rows[r.doc_id][1].encode().split() for s in [b" " + w + b" "] for q in range(1, len(s))]
        assert r.n_symbols == len(costs)
        if costs:
            assert r.perplexity == pytest.approx(math.exp(sum(costs) / len(costs)), rel=1e-3)


def test_mpeg_resync():
    rng = random.Random(7)
    payload = bytes(rng.getrandbits(8) for _ in range(64 * 90))
    data = mpeg_audio.wrap(payload)
    s = mpeg_audio.parse(data)
    assert mpeg_audio.unwrap(data, s) == payload and s.bad_crc == 0 and s.table_frames == s.frames and s.microseconds == s.frames * 24_000
    tag = b"ID3\x03\x00\x00\x00\x00\x00\x12TIT2\x00\x00\x00\x06\x00\x00\x00Title\x00\x00"
    noisy = mpeg_audio.parse(tag + b"\xff\xfb junk" + data + b"TAG" + bytes(125))
    assert noisy.title == "Title" and noisy.skipped == 7 and noisy.frames == s.frames and noisy.offsets[0] == s.offsets[0] + len(tag) + 7
    bad = bytearray(data)
    bad[s.offsets[1] + 4] ^= 1
    assert mpeg_audio.parse(bytes(bad)).bad_crc == 1


def test_templates(spark):
    banner = "<div><ul><li>Buy now</li></ul></div>"
    pages = [(i, f"http://h.x/{i}", f"<html><body>{banner}<article><h1>T{i}</h1><p>Shared text.</p><p>Own &amp; only {i}</p></article><footer>f</footer></body></html>") for i in range(30)]
    pages += [(100 + i, f"http://k.x/{i}", f"<body><div>site line</div><div class='comments'><p>c</p></div><p>story {i}</p></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\nShared text.\nOwn & only 3" and got[105] == "story 5"
