"""The build from a folder of files, ignore rules, stores, lookups, caches, discovery, the gate and the log."""

import json

import pytest

from graphloom.operators import decisions, guard, search
from graphloom.sources import build, jsonl, stores, tree

FILES = {
    "a/base.py": "class Base:\n    def go(self):\n        return 1\n\ndef helper(x):\n    return x\n",
    "a/svc.py": "from .base import Base, helper as h\nfrom libs.ext.mod import Far\nfrom . import base\n\nclass Svc(Base):\n    def run(self):\n        b = Base()\n        b.go()\n        self.mid()\n        h(1)\n        base.helper(2)\n    def mid(self):\n        helper(3)\n\nclass Odd(Far):\n    pass\n\ndef make():\n    return Svc()\n",
    "b/x.ts": "import { y } from './y.js';\nexport function main() {\n  y();\n}\n",
    "b/y.ts": "export function y() {\n}\n",
    "notes.md": "# hi",
    "bad.py": "def (",
}


@pytest.fixture(scope="module")
def graph(spark):
    children = spark.createDataFrame([("libs/ext", "ext")], "prefix string, repo string")
    return build.build(spark.createDataFrame(list(FILES.items()), "path string, source string"), "r", children)


def test_build(graph):
    edges = {(r.src.removeprefix("rs1:r:"), r.type, r.dst.removeprefix("rs1:r:"), r.resolution, r.confidence) for r in graph.edges.collect()}
    run = "func:a/svc.py#Svc.run@1"
    assert {e for e in edges if e[1] == "CALLS"} == {
        (run, "CALLS", "func:a/base.py#Base.go@1", "exact", 1.0),
        (run, "CALLS", "func:a/svc.py#Svc.mid@1", "exact", 1.0),
        (run, "CALLS", "func:a/base.py#helper@1", "exact", 1.0),
        ("func:a/svc.py#Svc.mid@1", "CALLS", "func:a/base.py#helper@1", "name_match", 0.7),
        ("func:b/x.ts#main@0", "CALLS", "func:b/y.ts#y@0", "exact", 1.0),
    }
    assert {e[:3] for e in edges if e[1] == "INHERITS"} == {("class:a/svc.py#Svc", "INHERITS", "class:a/base.py#Base")}
    assert {e[:3] for e in edges if e[1] == "INSTANTIATES"} == {(run, "INSTANTIATES", "class:a/base.py#Base"), ("func:a/svc.py#make@0", "INSTANTIATES", "class:a/svc.py#Svc")}
    assert {e[:3] for e in edges if e[1] == "IMPORTS"} == {("file:a/svc.py", "IMPORTS", "file:a/base.py"), ("file:b/x.ts", "IMPORTS", "file:b/y.ts")}
    assert ("dir:.", "CONTAINS", "dir:a") in {e[:3] for e in edges} and ("dir:.", "CONTAINS", "file:notes.md") in {e[:3] for e in edges}
    assert [(r.from_id, r.external_heritage) for r in graph.external_heritage.collect()] == [("rs1:r:class:a/svc.py#Odd", ["INHERITS|Far"])]
    assert {t for r in graph.external_imports.collect() for t in r.external_import_targets} == {"rs1:ext:file:mod.py"}
    stats = graph.stats().first()
    assert (stats.files, stats.warnings) == (6, 1)
    ids = [r.id for r in graph.nodes.collect()]
    assert len(ids) == len(set(ids)) == stats.nodes


def test_cached_facts_give_the_same_graph(spark, graph):
    changed = FILES | {"b/y.ts": "export function y() {\n  z();\n}\nfunction z() {\n}\n"}
    files = spark.createDataFrame(list(changed.items()), "path string, source string")
    key = lambda g: sorted(map(tuple, g.edges.select("src", "type", "dst", "resolution", "confidence").collect()), key=repr)
    assert key(build.build(files, "r", cached=graph.facts)) == key(build.build(files, "r"))


def test_own_extractor(spark):
    class Lines:
        def facts(self, path, source, language):
            return [(path, "function", i, line, line, i + 1, i + 1, json.dumps({"arity": 0})) for i, line in enumerate(source.splitlines())]

    rows = build.extract(spark.createDataFrame([("a.q", "one\ntwo", "q")], "path string, source string, language string"), {"q": Lines()})
    assert [r.name for r in rows.collect()] == ["one", "two"]


def test_ignore_rules(spark, tmp_path):
    tree_ = {".gitignore": "*.log\n!keep.log\n/out/\nbuild/\ndocs/**/tmp\n", "a.log": "", "keep.log": "", "out/x.py": "", "sub/out/x.py": "", "sub/build/y.py": "", "docs/a/b/tmp/z.md": "", "docs/tmp.md": "", "sub/.gitignore": "z?.py\n", "sub/z1.py": "", "z1.py": "", "build": ""}
    for p, s in tree_.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    rules = tree.ignore_rules(spark, f"file://{tmp_path}")
    assert rules[0] == ("", "*.log") and rules[-1] == ("sub", "z?.py")
    files = spark.createDataFrame([(p,) for p in tree_ if ".git" not in p], "path string")
    assert {r.path for r in tree.not_ignored(files, rules).collect()} == {"keep.log", "sub/out/x.py", "docs/tmp.md", "z1.py", "build"}


def test_boundaries_and_discovery(spark, tmp_path):
    for p in (".git", "x/y/.git", "x/y/z/.git", "w"):
        (tmp_path / p).mkdir(parents=True)
    assert [r.prefix for r in tree.boundaries(spark, f"file://{tmp_path}").collect()] == ["x/y"]
    assert stores.walk_up(str(tmp_path / "w")) == str(tmp_path.resolve()) and stores.walk_down(str(tmp_path)) == [str(tmp_path / "x/y")]
    assert [p for p, _ in stores.federated(str(tmp_path))] == ["x/y", "x/y/z"]
    same = {stores.repo_id("c1", u) for u in ("https://host/o/r.git", "git@host:o/r.git", "ssh://git@host/o/r")}
    assert len(same) == 1 and len(same.pop()) == 12 and stores.repo_id("", "", "/a") != stores.repo_id("", "", "/b")


def test_both_stores_agree(spark, graph, tmp_path):
    names = ["name", "qualified_name", "file_path", "path", "start_line", "end_line", "content_hash"]
    jsonl.write_lines(jsonl.node_lines(graph.nodes, names), f"{tmp_path}/lines/nodes.jsonl")
    jsonl.write_lines(jsonl.edge_lines(graph.edges, ["resolution", "confidence", "call_sites"]), f"{tmp_path}/lines/edges.jsonl")
    lines = stores.open_store(spark, f"{tmp_path}/lines", "r")
    tables = stores.TableStore(spark, f"{tmp_path}/tables")
    tables.upsert(lines.nodes(), lines.edges().selectExpr("*", "'r' as repo_id"))
    tables.upsert(lines.nodes(), lines.edges().selectExpr("*", "'r' as repo_id"))
    opened = stores.open_store(spark, f"{tmp_path}/tables")
    assert isinstance(lines, stores.LinesStore) and isinstance(opened, stores.TableStore)
    key = lambda s: sorted(map(tuple, stores.target_rows(s.nodes()).collect()), key=repr)
    assert key(lines) == key(opened) and lines.edges().count() == opened.edges().count() == graph.edges.count()
    assert tables.purge(["r", "none"]) == 1
    with pytest.raises(LookupError):
        stores.open_store(spark, None).nodes()
    assert stores.open_store(spark, None).search_corpus().count() == 0
    with pytest.raises(ValueError, match="backend"):
        stores.open_store(spark, "x", backend="y")


def test_merge_driver_sidecars_and_shards(spark, tmp_path):
    line = lambda i, s: json.dumps({"id": i, "labels": ["F"], "s": s}, separators=(",", ":"))
    for name, rows in {"base": ["a1", "b1", "c1"], "ours": ["a2", "b1"], "theirs": ["a1", "b3", "c1", "d4"]}.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(line(r[0], r[1]) + "\n" for r in rows))
    got = stores.merge_files(spark, *(str(tmp_path / f"{n}.jsonl") for n in ("base", "ours", "theirs")), "graph/nodes.jsonl")
    assert [r.value for r in got.collect()] == [line("a", "2"), line("b", "3"), line("d", "4")]
    side = tmp_path / "side"
    for who, at in (("x", "2024-01-01"), ("y", "2024-02-01")):
        stores.upsert_sidecar(str(side / f"summaries-{who}.jsonl"), {"id": "n", "summary_at": at, "semantic_summary": who})
    stores.upsert_sidecar(str(side / "summaries-x.jsonl"), {"id": "m", "summary_at": "2024-01-01", "semantic_summary": "x"})
    assert {(r.id, r.source) for r in stores.sidecar(spark, str(side)).collect()} == {("n", "summaries-y.jsonl"), ("m", "summaries-x.jsonl")}
    path = f"{tmp_path}/shards"
    rows = [(f"n{i}", f'{{"id":"n{i}"}}') for i in range(40)]
    tree.write_shards(spark.createDataFrame(rows, "id string, line string"), path)
    read = lambda: {r.value: r.file_path for r in spark.read.option("recursiveFileLookup", "true").text(path).select("value", "_metadata.file_path").collect()}
    before = read()
    assert set(before) == {v for _, v in rows}
    tree.write_shards(spark.createDataFrame(rows[1:], "id string, line string"), path)
    after = read()
    assert set(after) == {v for _, v in rows[1:]} and sum(before[v] != after[v] for v in after) < 20


def test_caches_export_and_embeddings(spark, graph, tmp_path):
    made = []
    for head in ("h1", "h1", "h2", "h3", "h4"):
        made.append(stores.temporal_cache(spark, str(tmp_path / "cache"), head, 1, lambda head=head: made.append(head) or spark.createDataFrame([(head,)], "h string")).first().h)
    assert made == ["h1", "h1", "h1", "h2", "h2", "h3", "h3", "h4", "h4"] and len(list((tmp_path / "cache").iterdir())) <= 4
    stores.bake(graph.nodes, graph.edges, spark.createDataFrame([("a", "b", 3)], "a string, b string, support long"), "r", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).first().nodes == graph.nodes.count()

    class Fake:
        name, dims = "fake", 2

        def embed(self, texts, kind):
            return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "abc"), (2, None)], "id long, doc string")
    assert {r.id: list(r.v) for r in stores.embed(docs, Fake()).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    Fake.dims = 3
    with pytest.raises(Exception, match="dimensions"):
        stores.embed(docs, Fake()).collect()


def test_gate_and_log(spark, tmp_path):
    @stores.mutating
    def touch(spark):
        return "done"

    with pytest.raises(stores.ReadOnlySession):
        touch(spark)
    spark.conf.set("graphloom.writes", "true")
    assert touch(spark) == "done"
    spark.conf.unset("graphloom.writes")
    log = stores.ToolLog(str(tmp_path / "s1.jsonl"))
    log.put("2024-01-01T00:00:00Z", "find", {"q": 1, "k": 2}, json.dumps({"node_ids": ["a", "b"], "path": "p"}))
    log.close()
    row = tree.session_log(spark, str(tmp_path / "s1.jsonl")).first()
    assert (row.session_id, row.tool, list(row.node_ids)) == ("s1", "find", ["a", "b", "p"])


def test_guard(spark):
    spark.range(5).selectExpr("id", "id as `add`").createOrReplaceTempView("v")
    for q in ("select id, `add` from v", "with a as (select * from v) select count(*) n from a where id in (select id from v)", "select /* drop */ 'x;' as s from v", "values (1), (2)"):
        assert guard.run_read_only(spark, q).count() > 0
    for q in ("select * from text.`/etc/hostname`", "with a as (select * from text.`/etc/hostname`) select * from a", "select (select max(value) from text.`/etc/hostname`)", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select `reflect`('a', 'b')", "drop table v", "select 1; select 2", "select * from range(9)", "select transform(id) using 'cat' from v", "select input_file_name() from v"):
        with pytest.raises(guard.NotReadOnly):
            guard.run_read_only(spark, q)
    with pytest.raises(guard.NotReadOnly, match="registered"):
        guard.run_read_only(spark, "select * from v", views=["w"])
    assert [r.id for r in guard.run_read_only(spark, "select id from v order by id desc", max_bytes=20).collect()] == [4, 3]


def test_conformance_profile(spark):
    """The three-function graph: run calls helper and mid, mid calls helper."""
    from graphloom.operators import traverse

    edges = spark.createDataFrame([("run", "helper"), ("run", "mid"), ("mid", "helper")], "src string, dst string")
    down = traverse.profile(edges, spark.createDataFrame([("run",)], "id string")).where("side = 'down'").collect()
    assert {(r.id, r.distance) for r in down} == {("helper", 1), ("mid", 1)}
    assert {r.src for r in traverse.callers(edges, spark.createDataFrame([("helper",)], "id string")).collect()} == {"mid", "run"}


def test_vector_ranks(spark):
    import random

    rng = random.Random(3)
    rows = [(i, round(rng.random(), 1)) for i in range(60)]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {r[0]: n for n, r in enumerate(order, 1)}
    ids = spark.createDataFrame([(order[40][0],), (order[2][0],), (999,)], "id long")
    got = {r.id: r["rank"] for r in search.vector_ranks(spark.createDataFrame(rows, "id long, similarity double"), ids, 5).collect()}
    assert got == {i: n for i, n in want.items() if n <= 5 or i == order[40][0]}


def test_anchor_filter(spark):
    rows = [("d1", [("rs1:a:func:p.py#f@0", "p.py")], ["lib/"]), ("d2", [], ["p.py"])]
    decs = spark.createDataFrame([(i, "t", "accepted", "2024", [dict(zip(("node_id", "path"), a, strict=True)) for a in an], p, "c", "d") for i, an, p in rows], "id string, title string, status string, decided_at string, anchors array<struct<node_id string, path string>>, paths array<string>, context string, decision string")
    ids = lambda a: {r.id for r in decisions.listed(decs, anchor=a).collect()}
    assert ids("rs1:b:func:p.py#f@0") == {"d1"} and ids("p.py") == {"d1", "d2"} and ids("lib/x.py") == {"d1"} and ids("q") == set()
