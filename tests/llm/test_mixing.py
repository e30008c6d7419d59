"""Raked probabilities against the targets, against raking written out, and against SQL."""

import random
from collections import defaultdict

import duckdb
import pytest

from graphloom.llm import mixing as M
from graphloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, n, seed, langs="ab", sources="xyz", topics=(".", "license")):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(1, 60) + rng.choice(topics), rng.choice(langs), rng.choice(sources), 1) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def fit(docs, targets):
    return M.rake(M.weighed(docs, targets).select("own_source", "k", "tokens"), targets)


def shares(fitted, targets):
    out = defaultdict(dict)
    for r in M.achieved(fitted, targets).collect():
        out[r.axis][r["class"]] = r.share
    return out


TARGETS = M.Targets(languages={"a": 0.7, "b": 0.3}, topics={"license": 0.4, M.OTHER: 0.6}, sources={"x": 0.5, "y": 0.2, "z": 0.3}, budget=0.4)


def test_targets_are_met(spark):
    f = fit(made(spark, 400, 1), TARGETS)
    got = shares(f, TARGETS)
    assert f.error < 1e-9 and got["all"][""] == pytest.approx(0.4, abs=1e-5)
    for axis, want in (("language", TARGETS.languages), ("topic", TARGETS.topics), ("source", TARGETS.sources)):
        assert got[axis] == pytest.approx(want, abs=1e-4)


def test_budget_is_cut_to_what_is_there(spark):
    """One language in twenty is to be half of what is kept: a tenth can be."""
    docs = made(spark, 800, 2, langs="a" * 19 + "b", sources="x")
    t = M.Targets(languages={"a": 0.5, "b": 0.5}, topics={M.OTHER: 1.0}, budget=0.9)
    f = fit(docs, t)
    have = {r.lang: r.n for r in M.weighed(docs, t).groupBy("lang").agg({"tokens": "sum"}).toDF("lang", "n").collect()}
    assert shares(f, t)["language"] == pytest.approx({"a": 0.5, "b": 0.5}, abs=1e-4)
    assert f.budget == pytest.approx(2 * have["b"] / (have["a"] + have["b"]), rel=1e-6)


def test_capped_cells_by_hand(spark):
    """Raking under probabilities against the same written out over cells."""
    docs = made(spark, 60, 3, sources="xxxxxy")
    t = M.Targets(languages={"a": 0.5, "b": 0.5}, topics={"license": 0.5, M.OTHER: 0.5}, sources={"x": 0.6, "y": 0.4}, budget=0.9)
    f = fit(docs, t)
    cells = defaultdict(float)
    for r in M.weighed(docs, t).collect():
        cells[r.own_source, r.k // 2, r.k % 2] += r.tokens
    whole = sum(cells.values())
    p = dict.fromkeys(cells, f.budget)
    for _ in range(20_000):
        for axis, goals in ((0, {"x": 0.6, "y": 0.4}), (1, {0: 0.5, 1: 0.5}), (2, {0: 0.5, 1: 0.5})):
            for name, goal in goals.items():
                own = [c for c in cells if c[axis] == name]
                full = sum(cells[c] for c in own if p[c] >= 1)
                move = sum(cells[c] * p[c] for c in own if p[c] < 1)
                need = goal * f.budget * whole
                by = (need - full) / move if move and need > full else need / (full + move)
                for c in own:
                    p[c] *= by
    got = {(r.own_source, r.k // 2, r.k % 2): r.probability for r in M.probabilities(f).collect()}
    assert got == pytest.approx({c: min(1, x) for c, x in p.items()}, abs=2e-6)
    assert any(x >= 1 for x in p.values())


def test_what_excludes_one_another(spark):
    """Every license is in b, yet b has no target: no budget meets both, nothing fails, and the report says so."""
    rows = [(i, "license" if i % 2 else ".", "b" if i % 2 else "a", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    t = M.Targets(languages={"a": 1.0, "b": 0.0}, topics={"license": 0.5, M.OTHER: 0.5})
    f = fit(docs, t)
    assert shares(f, t)["topic"] == {"*": 1.0, "license": 0.0} and f.budget == 0.5
    t = M.Targets(languages={"a": 0.9, "b": 0.1}, topics={"license": 0.9, M.OTHER: 0.1})
    f = fit(docs, t)
    assert f.error > 0.1 and all(0 <= r.probability <= 1 for r in M.probabilities(f).collect())


def test_a_class_of_few_tokens_does_not_empty_the_mixture(spark):
    """Two tokens can't be a tenth of much: they are all kept, and the others keep their shares to one another."""
    rows = [(i, "w " * 20 + ".", "ab"[i % 2], "s", 1) for i in range(400)] + [(900, "w .", "c", "s", 1)]
    t = M.Targets(languages={"a": 0.6, "b": 0.3, "c": 0.1}, topics={M.OTHER: 1.0}, budget=0.4, least=0.2)
    f = fit(spark.createDataFrame(rows, DOCS), t)
    got = shares(f, t)["language"]
    assert f.error < 1e-9 and f.budget == 0.2 and got["a"] == pytest.approx(2 * got["b"], rel=1e-4)
    assert {r.probability for r in M.mix(spark.createDataFrame(rows, DOCS), t).where("lang = 'c'").collect()} == {1.0}


def test_hot_and_tiny_sources(spark):
    """A source of most rows, many of one row: tempered, none asked for more than it has."""
    rows = [(i, "w " * 20 + ".", "ab"[i % 2], "hot" if i % 3 else f"s{i}", 1) for i in range(600)]
    t = M.Targets(languages={"a": 0.6, "b": 0.4}, topics={M.OTHER: 1.0}, budget=0.5)
    f = fit(spark.createDataFrame(rows, DOCS), t)
    assert f.error < 1e-9 and f.budget == 0.5
    assert shares(f, t)["language"] == pytest.approx(t.languages, abs=1e-4)
    assert shares(f, t)["source"]["hot"] < 2 / 3


def test_kept_rows_follow_the_shares(spark):
    rows = M.mix(made(spark, 6000, 5), TARGETS).where("kept").collect()
    whole = sum(r.tokens for r in rows)
    assert sum(r.tokens for r in rows if r.lang == "a") / whole == pytest.approx(0.7, abs=0.04)
    assert sum(r.tokens for r in rows if r.source == "x") / whole == pytest.approx(0.5, abs=0.04)


def test_production_targets(spark, sf):
    """Expected shares within half a point of the targets, and all rows as SQL has them."""
    t = queries.mixing_targets()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = fit(docs, t)
    got = shares(f, t)
    for axis, want in (("language", t.languages), ("topic", t.topics)):
        there = sum(want[c] for c in got[axis])
        assert got[axis] == pytest.approx({c: want[c] / there for c in got[axis]}, abs=0.005)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, M.mix(docs, t).collect()), key=repr) == sorted(con.sql(M.oracle(t)).fetchall(), key=repr)
