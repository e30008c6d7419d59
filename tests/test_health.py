import json
import random

from pyspark.sql import functions as F

from graphloom.operators import documents, health, rollup, temporal


DECISIONS = "repo string, id string, title string, status string, decided_at string, context string, decision string, consequences string, alternatives string, superseded_by string, anchors array<struct<path:string,node_id:string,kind:string>>, paths array<string>, supersedes array<string>"


def test_documents(spark):
    a = ("r", "adr:2024-01-02-use-x", "Use X", "accepted", "2024-01-02", "Why.", "X it is.\n\n## Really.\n# so", None, None, None, [("a.py", "n", None), (None, "n2", "Function")], ["src/"], None)
    b = ("r", "adr:2024-01-01-old", "Old", "superseded", "2024-01-01", None, "Y", "It costs.", "", a[1], None, None, ["adr:z"])
    c = ("s", "adr:2024-01-05-other", "Other", "proposed", "2024-01-05", "", "Z", None, None, None, [], [], [])
    out = {(r.repo, r.number): r for r in documents.exported(spark.createDataFrame([a, b, c], DECISIONS)).collect()}
    assert {k: r.file for k, r in out.items()} == {("r", 1): "0001-2024-01-01-old.md", ("r", 2): "0002-2024-01-02-use-x.md", ("s", 1): "0001-2024-01-05-other.md"}
    assert out["r", 2].text == (
        "# 2. Use X\n\nDate: 2024-01-02\n\n## Status\n\naccepted\n\n## Context\n\nWhy.\n\n## Decision\n\nX it is.\n\n\\## Really.\n\\# so\n\n"
        "## Governs\n\n- a.py (node)\n- n2 (Function)\n- src/\n\n<!-- graphloom export: adr:2024-01-02-use-x -->\n"
    )
    assert "## Status\n\nsuperseded (superseded by adr:2024-01-02-use-x)\n\n## Context\n\n\n\n## Decision" in out["r", 1].text and "- adr:z\n" in out["r", 1].text and "Alternatives" not in out["r", 1].text
    docs = spark.createDataFrame([(r.file, r.text) for r in out.values()], "file string, text string")
    got = {r.title: r for r in documents.parsed(docs).collect()}
    assert all(r.ok for r in got.values()) and got["Use X"].decision == "X it is. ## Really. # so" and got["Use X"].status == "accepted"
    assert (got["Old"].status, got["Old"].context, got["Old"].consequences, got["Old"].decided_at) == ("superseded", None, "It costs.", "2024-01-01")


def test_documents_of_others(spark):
    texts = {
        "1.md": "# 12. Use Y\r\nDate: 2023-05-06\r\n## Status\r\nAccepted (late)\r\n## Decision\r\n  yes\r\n## decision\r\nforged\r\n",
        "2.md": "# Use Y\nDate: 2023-05-06\n## Status\naccepted\n## Decision\nagain",
        "3.md": "# Undated\n## Status\nproposed\n## Decision\n<!-- no -->\nyes\nDate: 2020-01-01",
        "4.md": "no title",
        "5.md": "# T\n## Status\nunsure\n## Decision\nx",
        "6.md": "# T\n## Status\naccepted\n## Decision\n\n",
        "7.md": "",
        "8.md": None,
        "9.md": "# Known\nDate: 2022-01-01\n## Status\naccepted\n## Decision\nx",
    }
    docs = spark.createDataFrame(list(texts.items()), "file string, text string")
    new, none, held = documents.imported(docs, spark.createDataFrame([("adr:2022-01-01-known",)], "id string"), "2025-01-01")
    assert sorted((r.id, r.status, r.context, r.decision, r.file) for r in new.collect()) == [
        ("adr:2023-05-06-use-y", "accepted", "", "yes", "1.md"),
        ("adr:2025-01-01-undated", "proposed", "", "yes Date: 2020-01-01", "3.md"),
    ]
    assert sorted(r.file for r in none.collect()) == ["4.md", "5.md", "6.md", "7.md", "8.md"]
    assert sorted(r.file for r in held.collect()) == ["2.md", "9.md"]
    again, _, _ = documents.imported(docs, new.select("id"), "2025-01-01")
    assert [r.id for r in again.collect()] == ["adr:2022-01-01-known"]


def test_canonical_decision():
    assert health.canonical_decision({"z": 1, "id": "a", "b": {"d": None, "c": [{"y": 1, "x": 2}]}}) == '{\n  "id": "a",\n  "b": {\n    "c": [\n      {\n        "x": 2,\n        "y": 1\n      }\n    ]\n  },\n  "z": 1\n}\n'


def test_touched_ids(spark):
    result = json.dumps({"id": "a", "rows": [{"node_id": "b", "name": "n"}, {"node_id": "a"}], "id_list": 3})
    assert health.touched_ids(result) == ["a", "b"] and health.touched_ids("{") == []
    assert len(health.touched_ids(json.dumps([{"id": str(i)} for i in range(99)]))) == 25
    assert [r.node_ids for r in health.with_touched_ids(spark.createDataFrame([("s", result), ("t", None)], "session_id string, result string")).orderBy("session_id").collect()] == [["a", "b"], []]


def test_checks_and_gate(spark):
    nodes = spark.createDataFrame([("a", None, "needs_enrichment"), ("b", "x" * 1001, "fresh"), ("c", "[l](u) ```", "stale")], "id string, summary string, state string")
    checks = health.summary_checks(nodes)
    assert {r["check"]: r.n for r in checks.collect()} == {"missing": 1, "stale": 1, "too_long": 1, "fence": 1, "link": 1}
    assert health.gate(checks, ["link", "stale"]).first().failed == ["link", "stale"] and not health.gate(checks, ["link"]).first().ok


def test_crumbs(spark):
    row = spark.range(1).select(health.crumbs(F.array(*map(F.lit, "aabcdef"))).alias("v"), health.crumbs(F.array(*map(F.lit, "abba"))).alias("w")).first()
    assert row.v == ["a", "…", "e", "f"] and row.w == ["a", "b", "a"]


def test_segments_and_lens(spark):
    rows = health.segment_counts(spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, weight double"), 10).collect()
    assert {r.id: r.segments for r in rows} == {1: 7, 2: 3}
    edges = spark.createDataFrame([("a", "b", "CALLS", "exact", 1.0), ("a", "c", "IMPORTS", "ambiguous", 0.2)], "src string, dst string, type string, resolution string, confidence double")
    assert rollup.filter_edges(edges, ["CALLS"], 0.0).count() == 1 and rollup.filter_edges(edges, ["IMPORTS"], 0.0, audit=True).first().dst == "c"


def test_rename_cycle(spark):
    rows = [("r", 0, "R100", "a", "b"), ("r", 1, "R100", "b", "a"), ("r", 2, "M", "a", None), ("s", 0, "M", "a", None)]
    got = temporal.canonical_paths(spark.createDataFrame(rows, "repo string, seq long, status string, path string, rename_to string")).collect()
    assert len(got) == 4 and {r.path for r in got if r.repo == "s"} == {"a"}


def test_canonical_paths_against_a_plain_walk(spark):
    """Names that come, go and come back, in two repositories; each change sees the renames before it in the log."""
    rng = random.Random(7)
    rows = []
    for repo in ("r", "s"):
        for i in range(250):
            a, b = rng.choice("abcdefgh"), rng.choice("abcdefgh")
            rows.append((repo, i // 3, i % 3, "R090" if i % 4 == 0 else "C" if i % 9 == 0 else "M", a, b if i % 4 == 0 or i % 9 == 0 else None, i))
    want, alias = {}, {"r": {}, "s": {}}
    for repo, _, _, status, path, to, i in rows:
        own, name = alias[repo], path if status == "M" else to
        while own.get(name, name) != name:
            name = own[name]
        want[repo, i] = name
        if status != "M":
            own[path] = name
    shuffled = rng.sample(rows, len(rows))
    table = spark.createDataFrame(shuffled, "repo string, seq int, pos int, status string, path string, rename_to string, i int")
    got = temporal.canonical_paths(table)
    assert got.columns == table.columns
    assert {(r.repo, r.i): r.path for r in got.collect()} == want
    assert temporal.canonical_paths(table.limit(0)).count() == 0
