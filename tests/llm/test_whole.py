"""Operators do the whole job: what earlier rounds left out."""

import math
import random
from collections import Counter

import pytest

from graphloom.llm import html_extract, kneser_ney, mpeg_audio, queries, simhash, toxicity


@pytest.mark.parametrize("order", [1, 3, 5])
def test_kneser_ney_across_words(spark, order):
    """Perplexities against the model written out over whole texts."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(40)))
    rows = [(i, text(), "l") for i in range(40)]
    known = set(range(0, 40, 2))
    whole = [b" " + b" ".join(t.encode().split()) + b" " if t.split() else b"" for _, t, _ in rows]
    raw = Counter(s[max(0, p - order + 1) : p + 1] for i, s in enumerate(whole) if i in known for p in range(1, len(s)))
    level = {order: {g: c for g, c in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        level[k] = dict(Counter({g: c for g, c in raw.items() if len(g) == k}) + Counter(g[1:] for g in level[k + 1]))
    cuts, following = {}, {}
    for k in level:
        n = Counter(level[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
        for g, c in level[k].items():
            following.setdefault((k, g[:-1]), {})[g] = c

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        here = following.get((k, g[:-1]))
        if not here:
            return p(g[1:])
        total, cut = sum(here.values()), lambda c: cuts[k][min(c, 3) - 1]
        return (here[g] - cut(here[g]) if g in here else 0) / total + sum(map(cut, here.values())) / total * p(g[1:])

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in known], "doc_id long, quality int")
    for r in kneser_ney.perplexity(docs, labels, order, across=True, folds=0).collect():
        s = whole[r.doc_id]
        costs = [-math.log(p(s[max(0, q - order + 1) : q + 1])) for q in range(1, len(s))]
        assert r.n_symbols == len(costs)
        if costs:
            assert r.perplexity == pytest.approx(math.exp(sum(costs) / len(costs)), rel=1e-3)


@pytest.mark.parametrize("piece", [1, 3, 17])
def test_pieces_do_not_matter(monkeypatch, piece):
    texts = [b"ab cd", b"", b"x", b"abc " * 30 + b"d"]
    want = [(int.from_bytes(g, "big") | len(g) << 40, i) for i, t in enumerate(texts) if t for s in [b" " + t + b" "] for q in range(1, len(s)) for g in [s[max(0, q - 4) : q + 1]]]
    monkeypatch.setattr(kneser_ney, "PIECE", piece)
    assert [x for code, i in kneser_ney.text_grams(texts, 5) for x in zip(code.tolist(), i.tolist(), strict=True)] == want


def test_op9_sees_the_order_of_words(spark, tmp_path):
    words = "the cat sat upon a mat while dogs ran far away".split()
    prose = " ".join(words * 5)
    rows = [(i, prose, "en") for i in range(5)] + [(10, " ".join(words[::-1] * 5), "en"), (11, " ".join(w for w in words for _ in range(5)), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.perplexity, r.keep) for r in queries.op9_kneser_ney(spark, str(tmp_path)).collect()}
    assert got[0][1] and not got[10][1] and not got[11][1]
    assert got[10][0] > got[0][0] < got[11][0]


@pytest.mark.parametrize("few", [0, html_extract.BROADCAST_HASHES])
def test_templates_count_pages(spark, few):
    """A block on 12 of a host's 200 pages goes, one on 9 stays."""
    page = lambda i: f"<body>{'<div>twelve</div>' if i < 12 else ''}{'<div>nine</div>' if i < 9 else ''}<p>story {i}</p></body>"
    pages = spark.createDataFrame([(i, "http://h.x/", page(i)) for i in range(200)] + [(999, "http://k.x/", page(0))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, few=few).collect()}
    assert got == {i: "nine\n" * (i < 9) + f"story {i}" for i in range(200)} | {999: "twelve\nnine\nstory 0"}


def test_text_that_reads_as_a_tag():
    for raw in (b"TAG" + b"A" * 125, b"x" * 6400 + b"TAG" + b"A" * 125, b"TAG" + b"B" * 100):
        payload = mpeg_audio.payload_of(raw)
        data = mpeg_audio.wrap(payload)
        s = mpeg_audio.parse(data)
        assert mpeg_audio.unwrap(data, s) == payload and s.table_frames == s.frames and not s.skipped and not s.tag_bytes
        t = mpeg_audio.parse(data + b"TAG" + bytes(125))
        assert mpeg_audio.unwrap(data, t) == payload and t.frames == s.frames and not t.skipped and t.tag_bytes == 128
        cut = mpeg_audio.parse(data[:-1] + b"TAG" + bytes(125))
        assert cut.tag_bytes == 128 and cut.frames == s.frames - 1


def test_misspelled_stems_and_long_terms():
    lexicon = toxicity.Lexicon({"wretched", "scoundrel", "vermintide"}, {"vermin"}, set(), {"varmint"})
    kind = lexicon.kind
    assert kind("vermintide") == kind("verminous") == toxicity.STEMMED
    assert kind("vermntide") == kind("vermimous") == kind("scuondrel") == kind("scundrl") == kind("vrmintdie") == toxicity.MISSPELLED
    assert kind("verm1ntide") == kind("verm1nous") == kind("vermiiiinous") == toxicity.DISGUISED
    assert kind("varmint") == kind("wrtchde") == kind("scandal") == toxicity.NONE


def test_one_of_each_without_and_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a, "en"), (None, a, "de"), (1, a, "en"), (None, b, "en"), (None, b, "fr"), (1, c, "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=repr) == sorted([(1, a), (None, b), (1, c)], key=repr)


@pytest.mark.parametrize("across", [True, False])
def test_thresholds_come_from_held_out_texts(spark, across):
    """Thresholds and keep against a plain computation over the perplexities."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30)))
    rows = [(i, text(), "xy"[i % 2]) for i in range(300)] + [(900, "zz " * 9, "z"), (901, "a" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    trusted = labels.select("doc_id")
    role = {r.doc_id: r.role for r in kneser_ney.marked(docs, trusted, 5).collect()}
    assert 10 < sum(v == kneser_ney.HELD for v in role.values()) < 80
    got = {r.doc_id: r for r in kneser_ney.perplexity(docs, labels, 3, 0.9, across, 5).collect()}
    bins = {i: math.floor(math.log(r.perplexity) * 1000 + 1e-6) for i, r in got.items()}

    def at(ids):
        have = sorted(bins[i] for i in ids)
        return have[math.ceil(len(have) * 0.9) - 1]

    held = [i for i, v in role.items() if v == kneser_ney.HELD]
    limit = {lang: at([i for i in held if got[i].lang == lang] or held) for lang in "xyz"}
    for i, r in got.items():
        assert r.trusted == (i < 200)
        assert math.log(r.threshold) * 1000 - 1 == pytest.approx(limit[r.lang], abs=1.01)
        assert r.keep == (bins[i] <= limit[r.lang]) or abs(bins[i] - limit[r.lang]) <= 1


def test_very_long_words(spark):
    docs = spark.createDataFrame([(1, "ab" * 1_500_000, "x"), (2, "ab ab", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    for across in (True, False):
        assert {r.doc_id: r.n_symbols for r in kneser_ney.perplexity(docs, labels, across=across).collect()} == {1: 3_000_001, 2: 6}
