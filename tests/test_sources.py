"""Sources, sinks, extraction, guards and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import geometry, guard, temporal
from graphloom.sources import extract_python, jsonl, tree
from graphloom.streaming import streams


def test_canonical_lines(spark, tmp_path):
    nodes = spark.createDataFrame([("b", ["File"], "z", None), ("a", ["Function", "X"], 'q"uote', 3)], "id string, labels array<string>, name string, line long")
    jsonl.write_lines(jsonl.node_lines(nodes, ["name", "line"]), str(tmp_path / "n"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "n")).collect()]
    assert sorted(lines) == ['{"id":"a","labels":["Function","X"],"line":3,"name":"q\\"uote"}', '{"id":"b","labels":["File"],"name":"z"}']
    back = jsonl.read_nodes(spark, str(tmp_path / "n"))
    assert {(r.id, tuple(r.labels)) for r in back.collect()} == {("a", ("Function", "X")), ("b", ("File",))}
    edges = spark.createDataFrame([("a", "CALLS", "b", 0.5)], "src string, type string, dst string, confidence double")
    assert jsonl.edge_lines(edges, ["confidence"]).first().value == '{"from":"a","type":"CALLS","to":"b","confidence":0.5}'


def test_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id":"a","labels":["F"]}\nnot json\n{"labels":["F"]}\n\n')
    path = str(tmp_path / "n.jsonl")
    assert [r.id for r in jsonl.read_nodes(spark, path, strict=False).collect()] == ["a"]
    with pytest.raises(Exception, match="malformed line"):
        jsonl.read_nodes(spark, path).select("line").collect()


def test_git_log(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    (tmp_path / "log").write_text(f"{a}\x1f2024-02-01\x1fAnn\x1fa@x\x00\nM\x00x.py\x00R100\x00old.py\x00new.py\x00{b}\x1f2024-01-01\x1fBob\x1fb@x\x00\nA\x00old.py\x00")
    rows = tree.git_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r.sha, r.day, r.author) for r in rows] == [(a, "2024-02-01", "Ann"), (b, "2024-01-01", "Bob")]
    assert [tuple(f) for f in rows[0].files] == [("M", "x.py", None), ("R100", "old.py", "new.py")]
    assert [tuple(f) for f in rows[1].files] == [("A", "old.py", None)]
    flat = tree.git_log(spark, str(tmp_path / "log")).select(F.lit("r").alias("repo"), "seq", "sha", F.explode("files").alias("f")).select("repo", "seq", "sha", "f.status", "f.path", "f.rename_to")
    assert {(r.sha, r.path) for r in temporal.canonical_paths(flat).collect()} == {(a, "x.py"), (a, "new.py"), (b, "new.py")}


def test_bulk_commits_count_in_churn_only(spark):
    rows = [(f"s{i}", "2024-01-01", "a", f"f{j}") for i in range(3) for j in range(2)] + [("big", "2024-01-02", "a", f"f{j}") for j in range(51)]
    changes = spark.createDataFrame(rows, "sha string, day string, author string, path string")
    assert [tuple(r) for r in temporal.co_changes(changes).collect()] == [("f0", "f1", 3)]
    assert temporal.churn(changes).where("path = 'f0'").first().change_count == 4


def test_extract(spark):
    source = "import os.path\nfrom . import util as u\nfrom ..a import b\nLIMIT = 1\nclass C(Base):\n    x = 2\n    def run(self, a, *b):\n        k = Foo()\n        self.go(k)\n        k.stop()\n        def inner():\n            hidden()\ndef run(): pass\ndef run(): pass\n"
    rows = extract_python.extract(spark.createDataFrame([("p/q/m.py", source), ("bad.py", "def ("), ("null.py", None)], "path string, source string")).collect()
    of = lambda kind: [(r.name, r.qualified) for r in rows if r.kind == kind and r.path == "p/q/m.py"]
    assert of("function") == [("run", "C.run"), ("inner", "C.run.inner"), ("run", "run"), ("run", "run.1")]
    assert of("class") == [("C", "C")] and of("heritage") == [("Base", "C")]
    assert [(r.name, json.loads(r.body)["kind"]) for r in rows if r.kind == "variable"] == [("LIMIT", "const"), ("x", "class")]
    assert sorted((r.name, json.loads(r.body)["receiver"]) for r in rows if r.kind == "call" and r.qualified == "C.run") == [("Foo", None), ("go", "self"), ("stop", "k")]
    assert [(r.name, json.loads(r.body)["bound_local"]) for r in rows if r.kind == "construction"] == [("Foo", "k")]
    assert ["p/a.py", "p/a/__init__.py"] in [json.loads(r.body)["candidates"] for r in rows if r.kind == "import"]
    assert [r.name for r in rows if r.kind == "error"] == ["SyntaxError"]


def test_tree(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/.hidden/c.py", "node_modules/d.js", "nested/e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\r\n")
    files = tree.source_tree(spark, str(tmp_path), ["node_modules"])
    assert {r.path for r in files.collect()} == {"a.py", "sub/b.py", "nested/e.py"}
    assert {r.path for r in tree.without_nested(files, spark.createDataFrame([("nested",)], "prefix string")).collect()} == {"a.py", "sub/b.py"}
    assert files.select("content_hash").distinct().count() == 1
    assert tree.changed_files(files, files.where("path = 'a.py'")).count() == 2


def test_shards_and_slices(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", json.dumps({"id": f"n{i}", "summary_at": "2024-01-01"})) for i in range(40)], "id string, line string")
    tree.write_shards(rows, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 40
    nodes = spark.createDataFrame([("a", "f", 1, 2), ("b", "f", 2, 3), ("c", "f", 3, 3)], "id string, file_path string, start_line int, end_line int")
    files = spark.createDataFrame([("f", "one\ntwo\nthree")], "path string, source string")
    assert {(r.id, r.text) for r in tree.source_slices(nodes, files, 18).collect()} == {("a", "one\ntwo"), ("b", "two\nthree")}


def test_session_log(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"ts":"2024-01-01T00:00:00.000Z","tool":"impact","resultBytes":10,"nodeIds":["a"]}\nbroken\n{"tool":"x"}\n')
    rows = tree.session_log(spark, str(tmp_path)).collect()
    assert [(r.session_id, r.tool, r.result_bytes, r.ok) for r in rows] == [("s1", "impact", 10, True)]


@pytest.mark.parametrize("query", ["insert into t select 1", "select 1; select 2", "drop table x", "explain select 1", "with a as (select 1) delete from b", ""])
def test_not_read_only(spark, query):
    with pytest.raises(guard.NotReadOnly):
        guard.assert_read_only(query, spark)


def test_read_only_allows_words_in_literals(spark):
    assert guard.run_read_only(spark, "select 'drop; table' as v -- delete").first().v == "drop; table"


def test_caps_admit_the_first_row(spark):
    rows = spark.createDataFrame([(1, "x" * 100), (2, "y")], "id long, v string")
    assert [r.id for r in guard.capped(rows, "id", max_bytes=10).collect()] == [1]


def test_mulberry():
    import pandas as pd

    def scalar(seed):
        a = seed & 0xFFFFFFFF
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ a >> 15) * (1 | a)) & 0xFFFFFFFF
            t = (t ^ (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) & 0xFFFFFFFF)) & 0xFFFFFFFF
            yield (t ^ t >> 14) / 4294967296

    for seed in (0, 1, 2**32 - 1, 123456):
        g = scalar(seed)
        assert [float(x[0]) for x in geometry.mulberry32(pd.Series([seed]), 3)] == [next(g) for _ in range(3)]


def test_fnv(spark):
    from graphloom.functions.text import fnv1a

    def scalar(s):
        h = 0x811C9DC5
        for c in s.encode():
            h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
        return h

    words = ["", "a", "foobar", "rs1:x:func:a.py#f@0"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv1a(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: scalar(w) for w in words}


def test_idle_session_stream(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(i, t(m), 1, "a", 0.0, "{}") for i, m in enumerate((0, 2, 20, 21))] + [(9, datetime.datetime(2024, 1, 2), 2, "a", 0.0, "{}")], streams.EVENTS).write.parquet(str(tmp_path / "in"))
    query = streams.idle_sessions(streams.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.user_id, r.n) for r in spark.table("idle").collect()) == [(1, 2), (1, 2)]


def test_new_heads_run_once(spark, tmp_path):
    seen = []
    for name, sha in (("a", "s1"), ("b", "s1"), ("c", "s2")):
        spark.createDataFrame([("r", sha, ord(name))], "repo string, sha string, seq long").coalesce(1).write.json(str(tmp_path / "heads" / name))
    heads = spark.readStream.schema("repo string, sha string, seq long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "heads"))
    streams.on_new_head(heads, lambda repo, sha: seen.append(sha), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert seen == ["s1", "s2"]
    for name, sha in (("d", "s2"), ("e", "s3")):
        spark.createDataFrame([("r", sha, ord(name))], "repo string, sha string, seq long").coalesce(1).write.json(str(tmp_path / "heads" / name))
    streams.on_new_head(heads, lambda repo, sha: seen.append(sha), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert seen == ["s1", "s2", "s3"]


def test_pending_drift(spark, tmp_path):
    schema = "repo string, id string, change string, consumed boolean"
    spark.createDataFrame([("r", "a", "modified", False), ("r", "b", "removed", False)], schema).coalesce(1).write.json(str(tmp_path / "d" / "1"))
    spark.createDataFrame([("r", "a", None, True)], schema).coalesce(1).write.json(str(tmp_path / "d" / "2"))
    changes = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "d"))
    out = {}

    def keep(rows, _):
        out.update({r.id: r.change for r in rows.collect()})

    streams.pending_changes(changes).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert out == {"a": None, "b": "removed"}
