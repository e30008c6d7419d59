"""Names with many definitions: what is shuffled or written between stages grows with calls and functions, not with their product."""

import random

import duckdb
import pytest

from graphloom.operators import decisions, resolve, search
from graphloom.plans import QUERIES, SQL
from graphloom.sources import stores


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The driver's tables, few names with many definitions each."""
    d = tmp_path_factory.mktemp("crowded")
    c = duckdb.connect()
    kind = "['ECONOMY', 'PROMO', 'SMALL'][p % 3 + 1]"
    tables = {
        "part": f"SELECT p AS p_partkey, ['blue', 'red'][p % 2 + 1] || ' anvil' AS p_name, 'Brand#1' || (1 + p % 4) AS p_brand, {kind} AS p_type, (1 + p % 50)::INT AS p_size FROM range(3000) t(p)",
        "customer": "SELECT c AS c_custkey, 'C' || c AS c_name, (c % 25)::INT AS c_nationkey FROM range(600) t(c)",
        "orders": "SELECT o AS o_orderkey, o * 7 % 600 AS o_custkey, TIMESTAMP '1995-01-01' AS o_orderdate FROM range(500) t(o)",
        "supplier": "SELECT s AS s_suppkey, 'S' || s % 51 AS s_name, (s % 51 % 25)::INT AS s_nationkey FROM range(102) t(s)",
        "events": "SELECT e AS event_id, e % 11 AS user_id, (e % 331)::DOUBLE - 40 AS value FROM range(4000) t(e)",
    }
    for name, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d)


def expected(d, name):
    c = duckdb.connect()
    for t in ("part", "customer", "orders", "supplier", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = c.sql(SQL[name])
    return found.columns, sorted(found.fetchall(), key=repr)


def shuffled(df):
    """The most records that an exchange of the executed plan wrote."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        metric = node.metrics().get("shuffleRecordsWritten")
        most = max([most] + ([metric.get().value()] if metric.isDefined() else []))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def joined(df):
    """The most rows that a join of the executed plan gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        if "Join" in kind:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def held(spark, d, name, monkeypatch):
    """The query's rows are its SQL's; (rows, most records of an exchange, most rows of a checkpoint)."""
    written, cut = [0], resolve.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(resolve, "cut_lineage", counted)
    df = QUERIES[name](spark, d)
    columns, want = expected(d, name)
    assert sorted(df.columns) == sorted(columns)
    df = df.select(*columns)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    return len(want), shuffled(df), max(written)


def test_class_lift(spark, crowded, monkeypatch):
    """Calls were checkpointed with each of their targets, though only the unresolved ones count here."""
    assert held(spark, crowded, "res18_class_lift", monkeypatch)[2] <= 600


def test_external_calls(spark, crowded, monkeypatch):
    assert held(spark, crowded, "res19_external_calls", monkeypatch)[2] <= 600


def test_ladder(spark, crowded, monkeypatch):
    """Calls were checkpointed twice; now nothing is."""
    rows, moved, written = held(spark, crowded, "res12_call_ladder", monkeypatch)
    assert rows > 5_000 and written == 0 and moved < rows / 2


def test_call_edges(spark, crowded, monkeypatch):
    """A call was checkpointed with each of its targets."""
    rows, _, written = held(spark, crowded, "res20_call_edges", monkeypatch)
    assert rows > 1_500 and written <= 500


def test_imports(spark, crowded, monkeypatch):
    rows, moved, written = held(spark, crowded, "res11_import_followed", monkeypatch)
    assert rows > 2_000 and written == 0 and moved <= 9_000


def test_tightest(spark, crowded, monkeypatch):
    """Each point met every interval around it: the join's rows are bounded by the places and blocks that are asked for."""
    df = QUERIES["rnk10_tightest"](spark, crowded)
    columns, want = expected(crowded, "rnk10_tightest")
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want != []
    assert joined(df) <= 20_000


def test_tightest_of_any_length(spark):
    """Against brute force: negative places, intervals of one place up to thousands, none around a point, equal lengths."""
    rand = random.Random(4)
    held = [(k, i, lo, lo + rand.choice((0, 1, 6, 24, 25, 26, 80, 700, 5000))) for i in range(300) for k, lo in [(rand.choice("ab"), rand.randrange(-3000, 3000))]] + [("a", 900, 5, 4)]
    asked = [(rand.choice("abc"), p, rand.randrange(-3500, 4000)) for p in range(500)]
    want = {}
    for k, p, at in asked:
        around = [(hi - lo, i) for key, i, lo, hi in held if key == k and lo <= at <= hi]
        if around:
            want[p] = min(around)[1]
    points, intervals = spark.createDataFrame(asked, "key string, point long, at long"), spark.createDataFrame(held, "key string, id long, lo long, hi long")
    for bucket in (1, 25, 10_000):
        assert {r.point: r.interval for r in search.tightest(points, intervals, bucket).collect()} == want


def test_governing(spark, crowded):
    """Each node under a path met each decision on it before the first five were taken."""
    df = QUERIES["dec04_governing"](spark, crowded)
    columns, want = expected(crowded, "dec04_governing")
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want
    assert joined(df) <= 7_000


def test_governed_counts(spark, crowded):
    df = QUERIES["dec05_governed_nodes"](spark, crowded)
    columns, want = expected(crowded, "dec05_governed_nodes")
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want
    assert joined(df) <= 7_000


def test_governed_counts_are_lengths(spark):
    """Several paths, nested ones, exact ones and anchors beside them: as many as the lists hold."""
    anchor = "array<struct<node_id string, path string, hash string>>"
    rows = [("a", "accepted", [("rs1:r:func:p/x.py#f@0", "p/x.py", None)], ["p/", "p/q/"]), ("b", "proposed", [("rs1:r:func:z.py#f@0", "z.py", "h")], ["p/q/y.py"]), ("c", "rejected", [], ["p/"]), ("d", "accepted", [("rs1:o:func:z.py#f@0", "p/q/y.py", None)], []), ("e", "accepted", None, ["p/", "p/q/"])]
    decs = spark.createDataFrame(rows, f"id string, status string, anchors {anchor}, paths array<string>")
    nodes = spark.createDataFrame([(f"rs1:r:func:{p}#{f}@0", p, "h") for p in ("p/x.py", "p/q/y.py", "z.py", "pp/x.py") for f in "fg"], "id string, file_path string, content_hash string")
    lists = decisions.governed_nodes(decisions.governing(decs, nodes, most=None)).collect()
    counts = {(r.id, r.status): r.governs for r in decisions.governed_counts(decs, nodes).collect()}
    assert counts == {(r.id, r.status): len(r.governs) for r in lists} == {("a", "accepted"): 4, ("b", "proposed"): 4, ("d", "accepted"): 1, ("e", "accepted"): 4}


@pytest.mark.parametrize("name", ["flt03_by_name", "flt04_content_hash"])
def test_lookups(spark, crowded, name, monkeypatch):
    """A join gave each pair by itself, and the hashes' were all sorted: now packs meet, in tasks of their own."""
    monkeypatch.setattr(stores, "PACKED", 100)
    df = QUERIES[name](spark, crowded)
    columns, want = expected(crowded, name)
    df = df.select(*columns)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    assert joined(df) <= len(want) / 20 and shuffled(df) <= len(want) / 20


def test_exported_once_for_each_of_a_name(spark, crowded):
    """Two suppliers of each name: the SQL gives a document for each pair of them."""
    df = QUERIES["src22_exported"](spark, crowded)
    columns, want = expected(crowded, "src22_exported")
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert len(want) == 204 and got == want


def test_groups_over_one_chunk(spark, crowded, monkeypatch):
    monkeypatch.setattr(resolve, "CHUNK", 7)
    held(spark, crowded, "res20_call_edges", monkeypatch)
    held(spark, crowded, "res12_call_ladder", monkeypatch)


def test_single_targets_within_a_group(spark):
    """A method that self names besides a bare call of its name: the edge of that one has both sites, the others one."""
    calls = spark.createDataFrame([("c", "a.py", "a.py", "S.f", "run", "self", 0), ("c", "a.py", "a.py", "S.f", "run", None, 1)], "caller_id string, caller_path string, caller_file_id string, caller_qualified string, callee string, receiver string, seq long")
    funcs = spark.createDataFrame([("m", "run", "S.run", "a.py"), ("l", "run", "S.run", "a.py"), ("n", "run", "T.run", "b.py")], "id string, name string, qualified string, file_path string")
    types = spark.createDataFrame([], "id string, label string, name string, qualified string, file_path string")
    names = spark.createDataFrame([], "file_id string, local string, path string, original string")
    more = types, names, spark.createDataFrame([], "file_id string, alias string, target string"), spark.createDataFrame([], "caller_id string, local string, class_id string")
    whole = resolve.call_edges(calls, resolve.resolve_calls(calls, funcs, *more), types, names)[0]
    groups = resolve.call_edges(calls, resolve.place_calls(calls, funcs, *more), types, names, funcs)[0]
    assert groups.columns == whole.columns
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, whole.collect())) == [("c", "l", "ambiguous", 0.33, 1), ("c", "m", "exact", 1.0, 2), ("c", "n", "ambiguous", 0.33, 1)]
