"""Queries over whole tables against brute force."""

from collections import defaultdict

import pytest

from graphloom.plans import QUERIES
from graphloom.plans import workload as W


@pytest.fixture(scope="module")
def graph(spark, sf):
    down, up = defaultdict(set), defaultdict(set)
    for r in W.edges(spark, sf).collect():
        down[r.src].add(r.dst)
        up[r.dst].add(r.src)
    return down, up


def rows(spark, sf, name, *columns):
    got = [tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_two_hops(spark, sf, graph):
    down, _ = graph
    via = defaultdict(set)
    for a, mids in down.items():
        for m in mids:
            for b in down.get(m, ()):
                via[a, b].add(m)
    assert rows(spark, sf, "trv03_callees_2hop", "source", "id", "via") == {(*k, len(v)) for k, v in via.items()}


def test_profiles(spark, sf, graph):
    down, up = graph
    want = set()
    for t in down.keys() | up.keys():
        near = down.get(t, set())
        far = sorted({b for m in near for b in down.get(m, ())})[:26]
        places = [(i, b) for i, b in enumerate(far) if b not in near and b != t]
        for side, distance, found in (("up", 1, list(enumerate(sorted(up.get(t, ()))))), ("down", 1, list(enumerate(sorted(near)))), ("down", 2, places)):
            cut = any(i >= 25 for i, _ in found)
            want |= {(t, side, distance, b, cut) for i, b in found if i < 25}
    assert rows(spark, sf, "trv04_profile", "target", "side", "distance", "id", "truncated") == want


def test_neighbors_and_prose(spark, sf, graph):
    down, up = graph
    want = {(a, b) for a in down.keys() | up.keys() for b in down.get(a, set()) | up.get(a, set()) if a != b}
    assert rows(spark, sf, "trv08_neighbors", "id", "neighbor") == want



def test_spanning_trees(spark, sf):
    """Each brand's tree holds all its parts and has the weight that Kruskal's method finds."""
    clusters = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        clusters[r.p_brand][r.p_partkey] = (r.p_size, r.p_partkey % 97)
    trees = defaultdict(list)
    for r in QUERIES["geo01_spanning_tree"](spark, sf).collect():
        trees[r.cluster].append((r.a, r.b))
    for brand, points in clusters.items():
        apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(points[a], points[b], strict=True))  # noqa: E731, B023

        def joined(edges):
            root = {p: p for p in points}  # noqa: B023

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            used = []
            for a, b in edges:
                if find(a) != find(b):
                    root[find(a)] = find(b)
                    used.append((a, b))
            return used

        least = joined(sorted(((a, b) for a in points for b in points if a < b), key=lambda e: apart(*e)))
        assert len(joined(trees[brand])) == len(trees[brand]) == len(points) - 1
        assert sum(apart(*e) for e in trees[brand]) == sum(apart(*e) for e in least)
