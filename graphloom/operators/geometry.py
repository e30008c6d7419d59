"""Layout helpers: seeded positions, spanning trees, bundle paths and budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a

#: Layout iterations by number of nodes; particles of a bundle.
ITERATIONS = ((500, 200), (2000, 150), (6000, 100))
LEAST_ITERATIONS, MAX_PARTICLES = 70, 4
MAX_CLUSTER = 50_000
#: Particles in all; opacity by resolution, its floor, gain and ink budget; sizes by kind of cluster.
PARTICLE_BUDGET = 3000
OPACITY = {"exact": 0.75, "name_match": 0.42, "ambiguous": 0.15}
OPACITY_FLOOR, OPACITY_GAIN, INK_BUDGET, INK_FLOOR = 0.15, 0.18, 220, 0.04
SIZES = {"galaxy": 6.0, "dir": 3.5, "file": 2.6}
SIZE_BASE, SIZE_GAIN, SIZE_MIN, SIZE_MAX = 1.4, 0.9, 1.0, 12.0


def mulberry32(seed: pd.Series, steps: int) -> list[np.ndarray]:
    """The first numbers in [0, 1) of the 32-bit generator, for many seeds at once."""
    mask = np.uint64(0xFFFFFFFF)
    a = seed.to_numpy(np.uint64) & mask
    out = []
    for _ in range(steps):
        a = (a + np.uint64(0x6D2B79F5)) & mask
        t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & mask
        t = (t ^ ((t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & mask)) & mask)) & mask
        out.append(((t ^ (t >> np.uint64(14))) & mask).astype(np.float64) / 4294967296.0)
    return out


def positions(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """(id, x, y, z): a point of the cube, from the id's hash alone."""
    seeded = nodes.select("id", fnv1a(F.col("id").cast("string")).alias("seed"))

    def place(frames):
        for f in frames:
            x, y, z = (np.floor(((v * 2 - 1) * radius) * 1e6 + 0.5) / 1e6 for v in mulberry32(f["seed"], 3))
            yield pd.DataFrame({"id": f["id"], "x": x, "y": y, "z": z})

    kind = nodes.schema["id"].dataType.simpleString()
    return seeded.mapInPandas(place, f"id {kind}, x double, y double, z double")


def spanning_tree(points: DataFrame) -> DataFrame:
    """(cluster, a, b), a < b, by Prim's method in each cluster of points (cluster, place, x, y, z); ties to the lower place.

    A cluster is what one screen draws: one of more than MAX_CLUSTER points is an error, not a task without end.
    """

    def prim(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        p = frame[["x", "y", "z"]].to_numpy(np.float64)
        names = frame["place"].to_numpy()
        n = len(p)
        if n > MAX_CLUSTER:
            raise ValueError(f"a cluster of {n} points: at most {MAX_CLUSTER} are drawn at once")
        near, by, inside, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
        at = 0
        for _ in range(n - 1):
            inside[at] = True
            d = ((p - p[at]) ** 2).sum(1)
            better = ~inside & (d < near)
            near[better], by[better] = d[better], at
            at = int(np.where(inside, np.inf, near).argmin())
            edges.append((frame["cluster"].iloc[0], *sorted((names[by[at]], names[at]))))
        return pd.DataFrame(sorted(edges), columns=["cluster", "a", "b"])

    kind = points.schema["cluster"].dataType.simpleString()
    return points.groupBy("cluster").applyInPandas(prim, f"cluster {kind}, a long, b long")


def common_depth(a: Column, b: Column) -> Column:
    """How many ancestors two chains share."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    return F.coalesce(F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False) - 1, F.lit(-1))


def bundle_path(a: Column, b: Column) -> Column:
    """From one key up to the lowest common ancestor and down to the other."""
    shared = F.size(F.array_intersect(a, b))
    up = F.reverse(F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0))))
    turn = F.when(shared > 0, F.array(F.element_at(a, shared))).otherwise(F.array().cast("array<string>"))
    return F.concat(up, turn, F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0))))


def particles(count: Column) -> Column:
    """1 + floor(log2(1 + n)), MAX_PARTICLES at most."""
    return F.least(F.lit(MAX_PARTICLES), F.floor(F.log2(count + 1) + 1e-9) + 1).cast("int")


def layout_iterations(nodes: Column) -> Column:
    out = F.lit(LEAST_ITERATIONS)
    for most, n in reversed(ITERATIONS):
        out = F.when(nodes <= most, n).otherwise(out)
    return out


def node_size(kind: Column, degree: Column) -> Column:
    """By the kind of cluster and the logarithm of the degree, within bounds."""
    base = F.lit(SIZE_BASE)
    for name, size in SIZES.items():
        base = F.when(kind == name, size).otherwise(base)
    return F.least(F.greatest(base + F.log1p(degree.cast("double")) * SIZE_GAIN, F.lit(SIZE_MIN)), F.lit(SIZE_MAX))


def bundle_opacity(resolution: Column, count: Column) -> Column:
    """A resolution's opacity, more for many edges, within its floor and 1."""
    base = F.lit(OPACITY_FLOOR)
    for name, value in OPACITY.items():
        base = F.when(resolution == name, value).otherwise(base)
    return F.least(F.greatest(base * (1 + OPACITY_GAIN * F.log1p(count.cast("double"))), F.lit(OPACITY_FLOOR)), F.lit(1.0))


def edge_scale(drawn: Column) -> Column:
    """What keeps the ink of all drawn edges within its budget."""
    return F.when(drawn <= INK_BUDGET, 1.0).otherwise(F.greatest(F.lit(INK_FLOOR), INK_BUDGET / drawn))


def allocate_particles(bundles: DataFrame, budget: int = PARTICLE_BUDGET) -> DataFrame:
    """(place, particles) of bundles (place, count, priority), in draw order by place, out of a budget.

    Priority bundles get theirs first.  Of the others each gets one, and the heavier ones more while any is left; if
    there are more bundles than budget, every k-th gets one.  Running sums are over top lists of `budget` rows at most,
    places among the others come from counts by blocks of places, so no task sees all bundles.
    """
    want = particles(F.col("count"))
    first = bundles.where("priority").select("place", want.alias("want")).orderBy("place").limit(budget)
    first = first.withColumn("upto", F.expr("sum(want) over (order by place rows unbounded preceding)")).select("place", F.greatest(F.least("want", F.lit(budget) - F.col("upto") + F.col("want")), F.lit(0)).alias("particles"))
    used = first.agg(F.sum("particles")).first()[0] or 0
    others, left = bundles.where("not priority"), budget - used
    n = others.count()
    if left <= 0 or not n:
        return first.where("particles > 0")
    if n > left:
        block = others.select("place", "count", F.floor(F.col("place") / 65_536).alias("block"))
        starts, at = [], 0
        for r in sorted(block.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for 65,536 places
            starts.append((r.block, at))
            at += r.n
        before = others.sparkSession.createDataFrame(starts, "block long, start long")
        nth = F.col("start") + F.expr("row_number() over (partition by block order by place)") - 1
        each = block.join(F.broadcast(before), "block").select("place", nth.alias("nth")).where(F.col("nth") % -(-n // left) == 0)
        return first.where("particles > 0").unionByName(each.select("place", F.lit(1).alias("particles")))
    more = others.select("place", (want - 1).alias("want")).orderBy("place").limit(budget)
    spare = left - n
    more = more.withColumn("upto", F.expr("sum(want) over (order by place rows unbounded preceding)"))
    more = more.select("place", (1 + F.greatest(F.least("want", F.lit(spare) - F.col("upto") + F.col("want")), F.lit(0))).alias("particles"))
    return first.where("particles > 0").unionByName(more)


def to_minimap(points: DataFrame, width: int, height: int, pad: int = 6) -> DataFrame:
    """points (id, x, y) with px, py: fitted into a canvas at one scale, centred, y upwards."""
    b = points.agg(*(f(c).alias(n + c) for c in ("x", "y") for n, f in (("min_", F.min), ("max_", F.max)))).first()
    span = [max(b[f"max_{c}"] - b[f"min_{c}"], 1e-6) if b["min_x"] is not None else 1e-6 for c in "xy"]
    scale = min(max(size - 2 * pad, 1) / s for size, s in zip((width, height), span, strict=True))
    centre = [((b[f"min_{c}"] or 0.0) + (b[f"max_{c}"] or 0.0)) / 2 for c in "xy"]
    px = F.col("x") * scale + (width / 2 - centre[0] * scale)
    return points.select("id", px.alias("px"), (F.lit(float(height)) - (F.col("y") * scale + (height / 2 - centre[1] * scale))).alias("py"))


def nearest_point(points: DataFrame, x: float, y: float, z: float) -> DataFrame:
    apart = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
    return points.agg(F.min_by("id", F.struct(apart, F.col("id"))).alias("id"))
