"""Degrees, hierarchies and rolled-up edges.  Hierarchies are paths: a node's ancestors are its key's prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rolled-up edges that are kept, by count.
MAX_BUNDLES = 2500
#: How sure a resolution is, best last.
RESOLUTION_RANK = {"ambiguous": 0, "name_match": 1, "exact": 2}


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def least_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, confidence): the least of a node's edges, 1 without any."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "confidence").groupBy("id").agg(F.min("confidence").alias("confidence"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def ancestors(nodes: DataFrame, chain: Column) -> DataFrame:
    """(id, ancestor, depth) of nodes whose chain holds their ancestors' keys, outermost first, and their own last."""
    return nodes.select("id", F.posexplode(chain).alias("depth", "ancestor"))


def descendant_counts(nodes: DataFrame, chain: Column) -> DataFrame:
    """(ancestor, descendants): how many leaves lie under each key."""
    return ancestors(nodes, chain).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"))


def cluster_tree(nodes: DataFrame, chain: Column) -> DataFrame:
    """(key, parent, depth, leaves): a parent-pointer tree with every missing level filled in from the chains."""
    rows = nodes.select("id", F.posexplode(chain).alias("depth", "key"), chain.alias("chain"))
    rows = rows.withColumn("parent", F.when(F.col("depth") > 0, F.get("chain", F.col("depth") - 1)))
    return rows.groupBy("key", "parent", "depth").agg(F.count(F.lit(1)).alias("leaves"))


def flattened(tree: DataFrame, chain: Column) -> DataFrame:
    """tree in pre-order: ordered by the array of ancestor keys, which a parent's is a prefix of."""
    return tree.orderBy(chain)


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value, the first by name on a tie."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(group).agg(F.max("n").alias("most"))
    return counts.join(most, group).where(F.col("n") == F.col("most")).groupBy(group).agg(F.min(value).alias(value), F.max("n").alias("n"))


def visible(tree: DataFrame, chain: Column, expanded: DataFrame) -> DataFrame:
    """Keys of tree (key, chain) all of whose ancestors are expanded (key) and that aren't expanded themselves."""
    each = tree.select("key", F.explode(F.slice(chain, 1, F.size(chain) - 1)).alias("ancestor"))
    closed = each.join(expanded.select(F.col("key").alias("ancestor")), "ancestor", "left_anti").select("key").distinct()
    return tree.join(closed, "key", "left_anti").join(expanded.select("key"), "key", "left_anti")


def representatives(nodes: DataFrame, chain: Column, shown: DataFrame) -> DataFrame:
    """(id, rep): the deepest shown key (key) on each node's chain."""
    return ancestors(nodes, chain).join(shown.select(F.col("key").alias("ancestor")), "ancestor").groupBy("id").agg(F.max_by("ancestor", "depth").alias("rep"))


def lod_representatives(reps: DataFrame, shown: DataFrame, active: DataFrame) -> DataFrame:
    """(id, rep) of reps (id, rep, is_symbol, file): a symbol gives way to its file's shown core, unless the file (file) is active."""
    core = shown.select(F.col("key").alias("file"), F.lit(True).alias("has_core"))
    on = active.select("file", F.lit(True).alias("is_active"))
    rows = reps.join(core, "file", "left").join(on, "file", "left")
    return rows.select("id", F.when(F.col("is_symbol") & F.col("is_active").isNull() & F.col("has_core"), F.col("file")).otherwise(F.col("rep")).alias("rep"))


def filter_edges(edges: DataFrame, hidden: list[str], least: float, audit: bool = False) -> DataFrame:
    """Edges of shown types above the confidence; in an audit only uncertain ones, whatever else is set."""
    if audit:
        return edges.where(F.col("resolution") != "exact")
    kept = edges.where(F.col("confidence") >= least)
    return kept.where(~F.col("type").isin(*hidden)) if hidden else kept


def bundles(edges: DataFrame, reps: DataFrame, most: int = MAX_BUNDLES) -> DataFrame:
    """(a, b, count, dominant_type, best_resolution) of edges (src, dst, type, resolution) between representatives.

    First by (a, b, type), which is as far as a hot pair's rows are combined before the shuffle, then by (a, b).
    """
    left = reps.select(F.col("id").alias("src"), F.col("rep").alias("a"))
    right = reps.select(F.col("id").alias("dst"), F.col("rep").alias("b"))
    return bundle_pairs(edges.join(left, "src").join(right, "dst"), most)


def bundle_pairs(rows: DataFrame, most: int = MAX_BUNDLES) -> DataFrame:
    """The same of rows (a, b, type, resolution)."""
    rank = F.lit(0)
    for name, r in RESOLUTION_RANK.items():
        rank = F.when(F.col("resolution") == name, r).otherwise(rank)
    typed = rows.where("a <> b").groupBy("a", "b", "type").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    pairs = typed.groupBy("a", "b").agg(F.sum("n").alias("count"), F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("t"), F.max("best").alias("best"))
    names = F.array(*(F.lit(n) for n in RESOLUTION_RANK))
    out = pairs.select("a", "b", "count", F.col("t.type").alias("dominant_type"), F.get(names, F.col("best")).alias("best_resolution"))
    return out.orderBy(F.desc("count"), "a", "b").limit(most)


def attenuation(length: Column, diagonal: Column, near: float = 0.15, far: float = 0.6, least: float = 0.25) -> Column:
    """1 for short edges, `least` for long ones, a line between, by the share of the scene's diagonal."""
    share = length / diagonal
    return F.when(diagonal <= 0, 1.0).when(share <= near, 1.0).when(share >= far, least).otherwise(1.0 - (share - near) / (far - near) * (1.0 - least))


def bounds(points: DataFrame) -> DataFrame:
    """Least and largest x, y, z, and the diagonal."""
    rows = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))))
    return rows.withColumn("diagonal", F.sqrt(sum((F.pow(F.col(f"max_{c}") - F.col(f"min_{c}"), 2) for c in ("x", "y", "z")), F.lit(0.0))))


def tour(nodes: DataFrame, edges: DataFrame, chain: Column, modules: int = 3) -> DataFrame:
    """(stop, key, score): the modules with most descendants, the largest hub, the type with most heritage edges and the entry point.

    nodes: (id, kind, ..) and what chain needs; edges: (src, dst, type).
    """
    under = descendant_counts(nodes, chain)
    inner = ancestors(nodes, chain).where("ancestor <> id").select("ancestor").distinct()
    top = under.join(inner, "ancestor").orderBy(F.desc("descendants"), "ancestor").limit(modules).select(F.lit("module").alias("stop"), F.col("ancestor").alias("key"), F.col("descendants").alias("score"))
    deg = degrees(edges)
    hub = deg.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(1).select(F.lit("hub").alias("stop"), F.col("id").cast("string").alias("key"), (F.col("in_degree") + F.col("out_degree")).alias("score"))
    kinds = nodes.select(F.col("id").cast("string").alias("key"), "kind")
    types = degree(edges.where(F.col("type").isin("INHERITS", "IMPLEMENTS"))).select(F.col("id").cast("string").alias("key"), F.col("degree").alias("score"), F.col("id").alias("own"))
    types = types.join(kinds.where(F.col("kind").isin("Class", "Interface")), "key").orderBy(F.desc("score"), "own").limit(1).select(F.lit("type").alias("stop"), "key", "score")
    driver = deg.where("out_degree > 0").withColumn("key", F.col("id").cast("string")).join(kinds.where("kind = 'Function'"), "key").join(hub.select("key"), "key", "left_anti")
    entry = driver.orderBy(F.desc("out_degree"), "id").limit(1).select(F.lit("entry").alias("stop"), "key", F.col("out_degree").alias("score"))
    return top.unionByName(hub).unionByName(types).unionByName(entry)
