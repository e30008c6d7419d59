"""Bounded traversal over edges (src, dst).

Breadth-first levels are joins of the frontier with the edges and an anti-join with what was seen; each level is a
checkpoint in the shared folder, so the plan of level n doesn't hold those before it and a lost executor costs one level.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path

#: Weights of edge types and resolutions in neighbour ranking.
TYPE_WEIGHT = {"CALLS": 5, "INHERITS": 4, "IMPLEMENTS": 4, "INSTANTIATES": 3, "IMPORTS": 2}
RESOLUTION_WEIGHT = {"exact": 2, "name_match": 1, "ambiguous": 0}
#: The wording of a profile.
NO_SUMMARY, CALLED_BY, CALLS, UNSURE = "no summary yet (read and enrich)", "Called by ", "Calls ", " \u2014 verify]"
NEIGHBOR_NO_SUMMARY = " (no summary yet \u2014 read and enrich)"
MAX_NEIGHBORS = 25
MAX_NODES = 500


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of spark.checkpoint.dir; where none is set, in one of our own in local mode only."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into targets (id)."""
    return edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")


def callees_at_two(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, via count): distinct ends of paths of two edges."""
    first = callees(edges, sources).select(F.col("dst").alias("mid"), F.col("src").alias("source"))
    return first.join(edges.select(F.col("src").alias("mid"), F.col("dst").alias("id")), "mid").groupBy("source", "id").agg(F.countDistinct("mid").alias("via"))


def reach(steps: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(id, depth) of what steps (a -> b) lead to from seeds (id) within depth, or at all; seeds have depth 0.

    The steps are computed once; each level is a table of its own, and what was seen is their union.
    """
    steps = cut_lineage(steps)
    seen = cut_lineage(seeds.select("id", F.lit(0).alias("depth")))
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        new = steps.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut_lineage(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """Reverse reach: who is affected by seeds, without them."""
    return reach(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), seeds, depth).where("depth > 0")


def impact_capped(edges: DataFrame, seed: DataFrame, depth: int, most: int = MAX_NODES) -> DataFrame:
    """(id, depth, place): the first `most` nodes in order of discovery: by the finder's place, then by id.

    Only the seen nodes, at most `most` and one frontier, are ranked in one place.
    """
    steps = cut_lineage(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    seen = cut_lineage(seed.select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")))
    frontier = seen
    for level in range(1, depth + 1):
        found = steps.join(frontier.select(F.col("id").alias("a"), "place"), "a").groupBy(F.col("b").alias("id")).agg(F.min("place").alias("by"))
        new = found.join(seen, "id", "left_anti").orderBy("by", "id").limit(most)
        held = seen.count() - 1
        ranked = new.select("id", F.lit(level).alias("depth"), (F.expr("row_number() over (order by by, id)") + held).cast("long").alias("place"))
        frontier = cut_lineage(ranked.where(F.col("place") <= most))
        seen = seen.unionByName(frontier)
        if seen.count() - 1 >= most or frontier.isEmpty():
            break
    return seen.where("depth > 0")


def split_tests(rows: DataFrame, path: str = "file_path") -> DataFrame:
    return rows.withColumn("is_test", is_test_path(F.coalesce(F.col(path), F.lit(""))))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b")


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(id, depth) within depth in either direction, over edges of the given types."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    return reach(both_ways(kept).distinct(), seeds, depth)


def edge_score(kind: Column, resolution: Column, confidence: Column) -> Column:
    weight = F.lit(0)
    for name, w in TYPE_WEIGHT.items():
        weight = F.when(kind == name, w).otherwise(weight)
    trust = F.lit(0)
    for name, w in RESOLUTION_WEIGHT.items():
        trust = F.when(resolution == name, w).otherwise(trust)
    return weight * 100 + trust * 10 + F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))


def ranked_neighbors(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, neighbor, score, distance, place): neighbours by strongest edge, then nearest, then id; positions (id, x, y, z)."""
    score = edge_score(F.col("type"), F.col("resolution"), F.col("confidence"))
    pairs = edges.where("src <> dst").select("src", "dst", score.alias("score"))
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "score").union(pairs.select("dst", "src", "score"))
    best = both.groupBy("id", "neighbor").agg(F.max("score").alias("score"))
    a = positions.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = positions.select(F.col("id").alias("neighbor"), "x", "y", "z")
    apart = F.expr("(ax - x) * (ax - x) + (ay - y) * (ay - y) + (az - z) * (az - z)")
    rows = best.join(a, "id", "left").join(b, "neighbor", "left").select("id", "neighbor", "score", F.coalesce(apart, F.lit(float("inf"))).alias("distance"))
    return rows.withColumn("place", F.expr("row_number() over (partition by id order by score desc, distance, neighbor)"))


def ring_step(ring: DataFrame, step: int = 1) -> DataFrame:
    """(id, neighbor, next): the neighbour `step` places on in each ring, around its end; ring has id, neighbor, place."""
    sized = ring.withColumn("n", F.expr("count(*) over (partition by id)"))
    to = sized.select("id", F.col("place").alias("to"), F.col("neighbor").alias("next"))
    return sized.withColumn("to", F.pmod(F.col("place") - 1 + step, F.col("n")) + 1).join(to, ["id", "to"]).select("id", "neighbor", "next")


def profile(edges: DataFrame, targets: DataFrame, most: int = MAX_NEIGHBORS) -> DataFrame:
    """(target, side, distance, id, truncated): callers and callees by id up to `most`, then callees at two hops.

    One more than `most` is fetched to tell truncation; the two-hop list is cut before the nearer ones are taken out.
    """
    seeds, edges = targets.select(F.col("id").alias("target")), cut_lineage(edges.select("src", "dst"))
    rank = lambda rows: rows.withColumn("r", F.expr("row_number() over (partition by target order by id)"))
    up = rank(edges.join(seeds, F.col("dst") == F.col("target")).select("target", F.col("src").alias("id")).distinct())
    down = cut_lineage(rank(edges.join(seeds, F.col("src") == F.col("target")).select("target", F.col("dst").alias("id")).distinct()))
    two = down.select("target", F.col("id").alias("mid")).join(edges, F.col("mid") == F.col("src")).select("target", F.col("dst").alias("id")).distinct()
    two = rank(two).where(F.col("r") <= most + 1).join(down.select("target", "id"), ["target", "id"], "left_anti").where("id <> target")
    out = None
    for side, distance, rows in (("up", 1, up), ("down", 1, down), ("down", 2, two)):
        flagged = rows.withColumn("truncated", F.expr("max(r) over (partition by target)") > most)
        part = flagged.where(F.col("r") <= most).select("target", F.lit(side).alias("side"), F.lit(distance).alias("distance"), "id", "truncated")
        out = part if out is None else out.unionByName(part)
    return out


def prose(targets: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(id, text): a profile as sentences.

    targets: (id, repo_id, name, file_path, start_line, end_line, summary); neighbors: (target, side 'up' or 'down', id,
    repo_id, name, summary, resolution, confidence), which come in order of id.  Neighbours of another repository name
    it; called ones that aren't exact say how sure they are.
    """
    t = targets.select(F.col("id").alias("target"), F.col("repo_id").alias("home"), "name", "file_path", "start_line", "end_line", "summary")
    n = neighbors.join(t.select("target", "home"), "target")
    unsure = F.concat(F.lit(" ["), "resolution", F.coalesce(F.concat(F.lit(", confidence "), F.col("confidence").cast("string")), F.lit("")), F.lit(UNSURE))
    words = F.concat(
        "name",
        F.coalesce(F.concat(F.lit(" ("), F.nullif("summary", F.lit("")), F.lit(")")), F.lit(NEIGHBOR_NO_SUMMARY)),
        F.coalesce(F.when(F.col("repo_id") != F.col("home"), F.concat(F.lit(" [repo: "), "repo_id", F.lit("]"))), F.lit("")),
        F.coalesce(F.when((F.col("side") == "down") & (F.col("resolution") != "exact"), unsure), F.lit("")),
    )
    listed = n.withColumn("words", words).groupBy("target").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("id", "words")))).alias(s) for s in ("up", "down")))
    said = lambda side, lead, join: F.when(F.size(side) > 0, F.concat(F.lit(lead), F.array_join(F.transform(side, lambda x: x["words"]), join), F.lit(".")))
    head = F.concat("name", F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    first = F.coalesce(F.concat(head, F.lit(": "), F.nullif("summary", F.lit("")), F.lit(".")), F.concat(head, F.lit(f" \u2014 {NO_SUMMARY}.")))
    return t.join(listed, "target", "left").select(F.col("target").alias("id"), F.concat_ws(" ", first, said("up", CALLED_BY, ", "), said("down", CALLS, "; ")).alias("text"))
