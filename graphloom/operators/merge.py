"""Snapshot differences, three-way merges and folds of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids that a delta lists.
DELTA_IDS = 200
#: Properties that people or agents write, and those that only say where something stands.
AUTHORED = ("semantic_summary", "purpose_summary", "summary_of_hash", "summary_model", "summary_at", "summary_by")
POSITIONAL = ("start_line", "end_line")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of snapshots (id, content_hash, props): added, removed or modified.

    Modified: the hashes differ if both have one, else the props, which hold neither authored nor positional ones.
    """
    a, b = old.select("id", F.struct("content_hash", "props").alias("o")), new.select("id", F.struct("content_hash", "props").alias("n"))
    hashes = F.col("o.content_hash").isNotNull() & F.col("n.content_hash").isNotNull()
    differs = F.when(hashes, F.col("o.content_hash") != F.col("n.content_hash")).otherwise(~F.col("o.props").eqNullSafe(F.col("n.props")))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differs, "modified")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def capped(changes: DataFrame, most: int = DELTA_IDS) -> DataFrame:
    """(change, ids, n, truncated): the first ids of each kind and exact counts.

    Each kind's first ids are a top list of their own, so no task sees a whole kind.
    """
    counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    tops = reduce(DataFrame.unionByName, (changes.where(F.col("change") == c).orderBy("id").limit(most) for c in ("added", "removed", "modified")))
    lists = tops.groupBy("change").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(lists, "change").withColumn("truncated", F.col("n") > most)


def union_deltas(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    return pending.unionByName(fresh).distinct()


def without(changes: DataFrame, ids: DataFrame, suffix: Column | None = None) -> DataFrame:
    """Changes whose id isn't among ids (id), nor the same behind another repository if suffix is given."""
    left = changes.join(ids.select("id"), "id", "left_anti")
    if suffix is None:
        return left
    known = ids.select(suffix.alias("suffix")).where("suffix is not null")
    return left.withColumn("suffix", suffix).join(known, "suffix", "left_anti").drop("suffix")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, body, side) of (id, body): ours unless only theirs changed; a deletion yields to a change."""
    b, o, t = (df.select("id", F.struct("body").alias(n)) for df, n in ((base, "b"), (ours, "o"), (theirs, "t")))
    rows = b.join(o, "id", "full_outer").join(t, "id", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    side = F.when(same("o", "b"), "theirs").when(same("t", "b"), "ours").when(F.col("o").isNull(), "theirs").otherwise("ours")
    picked = rows.withColumn("side", side).withColumn("pick", F.when(F.col("side") == "theirs", F.col("t")).otherwise(F.col("o")))
    return picked.where("pick is not null").select("id", F.col("pick.body").alias("body"), "side")


def three_way_summaries(rows: DataFrame) -> DataFrame:
    """rows (id, content_hash, ours struct, theirs struct): the summary that belongs to the merged content, ours first."""
    fits = lambda s: F.col(f"{s}.summary_of_hash").eqNullSafe(F.col("content_hash")) & F.col(s).isNotNull()
    pick = F.when(fits("ours"), F.col("ours")).when(fits("theirs"), F.col("theirs")).otherwise(F.coalesce("ours", "theirs"))
    return rows.withColumn("summary", pick)


def three_way_edges(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Edges (src, type, dst, body): ours where both have it; a deletion on one side takes out what the base had."""
    keys = ["src", "type", "dst"]
    b = base.select(*keys, F.lit(True).alias("in_base"))
    o = ours.select(*keys, F.struct("body").alias("o"))
    t = theirs.select(*keys, F.struct("body").alias("t"))
    rows = o.join(t, keys, "full_outer").join(b, keys, "left")
    kept = rows.where("(o is not null and t is not null) or in_base is null")
    return kept.select(*keys, F.coalesce("o.body", "t.body").alias("body"))


def graft(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """nodes (id, content_hash, ...) with the summary written for just that content."""
    s = summaries.select("id", F.col("summary_of_hash").alias("content_hash"), "summary")
    return nodes.join(s, ["id", "content_hash"], "left")


def fold(records: DataFrame) -> DataFrame:
    """(id, line, at, won) of one source's records (id, at, line): the newest wins, then the smaller line by its bytes.

    Equal lines are one record.
    """
    rows = records.select("id", "line", "at").distinct()
    best = rows.groupBy("id").agg(F.max_by(F.struct("at", "line"), F.coalesce("at", F.lit(""))).alias("any"), F.max(F.coalesce("at", F.lit(""))).alias("newest"))
    least = rows.join(best.select("id", "newest"), "id").where(F.coalesce("at", F.lit("")) == F.col("newest")).groupBy("id").agg(F.min("line").alias("winner"))
    return rows.join(least, "id").select("id", "line", "at", (F.col("line") == F.col("winner")).alias("won"))


def fold_sources(records: DataFrame) -> DataFrame:
    """(id, line, at, source) over sources (id, at, line, source): each source's winner, then the newest; on a tie the later source."""
    rows = records.withColumn("t", F.coalesce("at", F.lit("")))
    newest = rows.groupBy("id", "source").agg(F.max("t").alias("t"))
    winners = rows.join(newest, ["id", "source", "t"]).groupBy("id", "source", "t").agg(F.min("line").alias("line"))
    best = winners.groupBy("id").agg(F.max(F.struct("t", "source", "line")).alias("b"))
    return best.select("id", F.col("b.line").alias("line"), F.nullif(F.col("b.t"), F.lit("")).alias("at"), F.col("b.source").alias("source"))


def is_conflict_marker(line: Column) -> Column:
    return line.rlike(r"^(<{7}|={7}|>{7}|\|{7})( |$)")


def absorb(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records (id, line), warnings (what, n)) of raw lines (line): conflict markers and lines without an id are left out and counted."""
    kept = lines.where("trim(line) <> ''").withColumn("id", F.expr("try_variant_get(try_parse_json(line), '$.id', 'string')"))
    what = F.when(is_conflict_marker(F.col("line")), "conflict").when(F.col("id").isNull(), "malformed")
    rows = kept.withColumn("what", what)
    return rows.where("what is null").select("id", "line"), rows.where("what is not null").groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def conflict_log(existing: DataFrame, losers: DataFrame) -> DataFrame:
    """(line): both logs' lines, each once, sorted, so that merging logs in any order ends alike."""
    return existing.select("line").union(losers.select("line")).where("trim(line) <> ''").distinct().orderBy("line")


def has_summary(record: Column) -> Column:
    """Of a JSON line: one of the prose fields is a string with more than white space."""
    each = [F.get_json_object(record, f"$.{k}") for k in ("semantic_summary", "purpose_summary")]
    quoted = [record.rlike(rf'"{k}"\s*:\s*"') for k in ("semantic_summary", "purpose_summary")]
    return reduce(Column.__or__, (q & (F.length(F.trim(F.coalesce(e, F.lit("")))) > 0) for e, q in zip(each, quoted, strict=True)))


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first row, by seq, of each id."""
    names = [c for c in nodes.columns if c not in ("id", "seq")]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*names), "seq").alias("r")).select("id", "r.*")


def dedupe_edges(edges: DataFrame, numbers: list[str], others: list[str]) -> DataFrame:
    """One edge per (src, type, dst): the largest numbers, and of the other properties the first by seq that isn't null."""
    aggs = [F.max(c).alias(c) for c in numbers] + [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in others]
    return edges.groupBy("src", "type", "dst").agg(*aggs)


def alive(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    return summaries.join(nodes.select("id"), "id", "left_semi")


def overlay(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """nodes with their summary where its hash is still the node's, and stale told apart from missing."""
    s = summaries.select("id", "summary", "summary_of_hash")
    joined = nodes.join(s, "id", "left")
    fresh = F.col("summary_of_hash").eqNullSafe(F.col("content_hash"))
    return joined.withColumn("state", F.when(F.col("summary").isNull(), "needs_enrichment").when(~fresh, "stale").otherwise("fresh")).withColumn("summary", F.when(fresh, F.col("summary")))
