"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns: every operator has a defined result."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import decontaminate, html_extract, kneser_ney, language, mixing, mpeg_audio, queries, simhash, token_binary, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, `list` string, c0 double, part int"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (5, "one two three four five six", "en", "a", 27, 1, "x", 0.5, 1),
        (3, "one two three four five six", "en", "a", 27, 1, "x", 0.5, 1),
        (3, "one two three four five six", "en", "a", 27, 1, "x", 0.5, 1),
        (4, None, None, None, None, None, None, None, None),
        (None, "no id here at all", "de", "b", 17, 2, None, None, 2),
        (6, "", "fr", "", 0, None, None, None, None),
        (7, " \t\n ", "fr", "b", 4, None, None, None, None),
        (8, LONG, "en", "b", len(LONG), None, None, None, None),
        (-9, "Ünïcödé 语言 😀 <|endoftext|> it's DON'T", None, "c", 30, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(token_binary.token_binary(docs, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_binary.token_binary(none, path).collect() == []


def test_mixing(docs, none):
    rows = mixing.mix(docs, queries.mixing_targets()).collect()
    assert len(rows) == 9 and all(0 <= r.probability <= 1 for r in rows)
    assert len({(r.kept, r.probability) for r in rows if r.doc_id == 3}) == 1
    assert mixing.mix(none, queries.mixing_targets()).collect() == []
    assert mixing.sampled(none, queries.mixing_targets()).collect() == []
    assert set(mixing.sampled(docs, queries.mixing_targets()).columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_warc(spark):
    html = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/1", html, 7), (2, "http://a/ü\r\nX: y", html, 7), (2, "http://a/2", html, 7), (None, None, html, 7), (3, None, None, 7), (4, "http://b", "", 7), (5, "u", "short", 7), (6, "u", "short", 7)], "page_id long, url string, html string, digest int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {(1, "revisit", 2, 2003), (2, "response", None, 2003), (None, "revisit", 2, 2003), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5)}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (99, 0)], "doc_id long, toxic int")
    rows = toxicity.score_held_out(docs, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert toxicity.score_held_out(none, labels).collect() == []
    assert len(toxicity.score_held_out(docs, labels.limit(0)).collect()) == 9


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "http://[bad", "<p>a&nbsp;b<p>c</b></i><div>d"), (3, "http://h/x", "no tags & more"), (4, "http://h/y", "<" * 3000 + "p>x")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "a b\nc\nd", 7), (3, "no tags & more", 14)]
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_simhash(docs, none):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    zero = {r for r in rows if r[1] == "0" * 16}
    assert zero == {(4, "0" * 16, 4), (6, "0" * 16, 4), (7, "0" * 16, 4)}
    assert {r[2] for r in rows if r[0] in (3, 5)} == {3}
    assert {r[2] for r in rows if r[0] is None} == {None}
    assert simhash.simhash_components(none).collect() == []
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in simhash.one_of_each(docs).collect()) == [(False, 0), (True, -9), (True, 3), (True, 4), (True, 8)]


def test_media(docs, none):
    rows = mpeg_audio.media_features(docs).collect()
    assert len(rows) == 9
    assert {r.payload_bytes for r in rows if r.doc_id in (4, 6)} == {64}
    assert mpeg_audio.media_features(none).collect() == []


def test_language(docs, none):
    got = {r.doc_id: r.lang_pred for r in language.identify_held_out(docs).collect()}
    assert got[4] == got[6] == got[7] == "und" and got[8] in ("en", "de", "fr")
    assert language.identify_held_out(none).collect() == []


def test_perplexity(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (8, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = kneser_ney.perplexity(docs, labels).collect()
    assert len(rows) == 9
    assert all((r.perplexity is None) == (r.n_symbols == 0) and not (r.n_symbols == 0 and r.keep) for r in rows)
    assert kneser_ney.perplexity(none, labels).collect() == []
    assert all(r.keep for r in kneser_ney.perplexity(docs, labels.limit(0)).collect() if r.n_symbols)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "TWO three four"), (None, "no id here"), (2, None), (3, ""), (4, "!!"), (1, "TWO three four")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()}
    assert (3, 6, 3, 1) in got and (4, 0, 0, 0) in got and (None, 5, 3, 0) in got
    assert decontaminate.contamination(none, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_names_that_differ_in_case_only(spark):
    docs = spark.createDataFrame([(1, "other", "one two", "en", "s", 7, None, 9)], "Doc_ID long, TEXT string, text string, lang string, source string, n_chars long, Lang string, doc_id long")
    labels = spark.createDataFrame([(9, 1, 1, 0)], "doc_id long, toxic int, quality int, TOXIC int")
    bench = spark.createDataFrame([(1, "one two", "no")], "item_id long, text string, TEXT string")
    assert decontaminate.contamination(docs, bench).first().n_hit == 2
    assert simhash.simhash_components(docs).first().component_id == 9
    assert simhash.one_of_each(docs).first().text == "one two"
    assert mpeg_audio.media_features(docs).first().n_bytes == 7
    assert language.identify_held_out(docs).count() == toxicity.score_held_out(docs, labels).count() == kneser_ney.perplexity(docs, labels).count() == 1
    assert mixing.mix(docs, queries.mixing_targets()).first().source == "s"
    pages = spark.createDataFrame([(1, "u", "<p>a", "<p>b")], "page_id long, url string, html string, HTML string")
    assert html_extract.extract(pages).first().text == "a" and warc.round_trip(pages).first().payload_bytes == 4
