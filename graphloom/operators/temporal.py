"""Change history: churn, ownership, co-change.  changes: (sha, day, author, path, seq), a row per commit and file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files of a commit that counts for co-change, least support, partners and authors listed.
MAX_FILES, MIN_SUPPORT, TOP_PARTNERS, TOP_AUTHORS = 50, 3, 20, 5
MONTHS, MAX_COMMITS = 12, 1000


def recent(commits: DataFrame, now: str, months: int = MONTHS, most: int = MAX_COMMITS) -> DataFrame:
    """Commits (sha, day, parents) of the window that aren't merges, the newest `most`."""
    return commits.where((F.col("day") >= F.add_months(F.lit(now).cast("date"), -months)) & (F.col("parents") < 2)).orderBy(F.desc("day"), "sha").limit(most)


def churn(changes: DataFrame) -> DataFrame:
    """(path, change_count, last_changed) over all commits, bulk ones too."""
    return changes.select("sha", "path", "day").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("change_count"), F.max("day").alias("last_changed"))


def owners(changes: DataFrame, top: int = TOP_AUTHORS) -> DataFrame:
    """(path, author, commits, place): the authors with most commits, then by name."""
    counts = changes.select("sha", "path", "author").distinct().groupBy("path", "author").agg(F.count(F.lit(1)).alias("commits"))
    return counts.withColumn("place", F.expr("row_number() over (partition by path order by commits desc, author)")).where(F.col("place") <= top)


def co_changes(changes: DataFrame, support: int = MIN_SUPPORT, most: int = MAX_FILES) -> DataFrame:
    """(a, b, support) of file pairs a < b that change together in commits of 2 to `most` files.

    Commits are counted first, so that a bulk commit's files are never gathered.  Those of the others become one sorted
    array, at most `most` long, and its pairs come from the array: no commit gives more than most * (most - 1) / 2 rows.
    """
    rows = changes.select("sha", "path").distinct()
    small = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    sets = rows.join(small.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("files"))
    firsts = sets.select(F.posexplode("files").alias("i", "a"), "files")
    pairs = firsts.select("a", F.explode(F.expr("slice(files, i + 2, greatest(size(files) - i - 1, 0))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)


def partners(pairs: DataFrame, counts: DataFrame, top: int = TOP_PARTNERS) -> DataFrame:
    """(path, other, support, confidence, place): both directions of pairs, by confidence, support, other."""
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), "support").union(pairs.select("b", "a", "support"))
    rows = both.join(counts.select("path", "change_count"), "path").select("path", "other", "support", (F.col("support") / F.col("change_count")).alias("confidence"))
    return rows.withColumn("place", F.expr("row_number() over (partition by path order by confidence desc, support desc, other)")).where(F.col("place") <= top)


def renamed(changes: DataFrame, key: str = "repo") -> DataFrame:
    """(key, path, seq, pos, now): from that change on, back in time, path is called now today.

    Only renames and copies are gathered, a repository's in one task, as each depends on those before it.  A name that
    is renamed again further back stands for another file there: its later entry counts, for it and what leads to it.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["seq", "pos", "path", "rename_to"], kind="stable")
        up: dict[str, str] = {}  # a forest: a root is called what it is
        below: dict[str, set[str]] = {}
        out = []
        for seq, pos, path, to in zip(frame["seq"], frame["pos"], frame["path"], frame["rename_to"], strict=True):
            while to in up:
                to = up[to]
            if path in up:
                below[up.pop(path)].discard(path)
            if to != path:
                up[path] = to
                below.setdefault(to, set()).add(path)
            todo = [path]
            while todo:
                name = todo.pop()
                out.append((seq, pos, name, to))
                todo += sorted(below.get(name, ()))
        moved = pd.DataFrame(out, columns=["seq", "pos", "path", "now"])
        return moved.assign(**{key: frame[key].iloc[0]})[[key, "path", "seq", "pos", "now"]]

    kind = changes.schema[key].dataType.simpleString()
    rows = _placed(changes).where(_moves()).select(key, F.col("seq").cast("long").alias("seq"), "pos", "path", "rename_to")
    return rows.groupBy(key).applyInPandas(walk, f"{key} {kind}, path string, seq long, pos long, now string")


def _moves() -> Column:
    return F.coalesce(F.col("status").rlike("^[RC]") & F.col("rename_to").isNotNull(), F.lit(False))


def _placed(changes: DataFrame) -> DataFrame:
    return changes.withColumn("pos", F.col("pos").cast("long") if "pos" in changes.columns else F.lit(0).cast("long"))


def canonical_paths(changes: DataFrame, key: str = "repo") -> DataFrame:
    """changes (repo, seq newest first, pos in the commit if there, status, path, rename_to) with path as it is called now.

    Each row looks its name (a rename's new one) up among the entries of `renamed` that come before it: an equi-join on
    the name, whose rows are as few as renames.
    """
    entry = F.struct("seq", "pos", "now")
    names = renamed(changes, key).groupBy(key, F.col("path").alias("_name")).agg(F.array_sort(F.collect_list(entry)).alias("_moves"))
    rows = _placed(changes).withColumn("_name", F.when(_moves(), F.col("rename_to")).otherwise(F.col("path"))).join(names, [key, "_name"], "left")
    at = F.struct(F.col("seq").cast("long"), F.col("pos"))
    last = F.try_element_at(F.filter("_moves", lambda e: F.struct(e["seq"], e["pos"]) < at), F.lit(-1))
    return rows.withColumn("path", F.coalesce(last["now"], "_name")).select(changes.columns)


def coupling_links(pairs: DataFrame, place: DataFrame) -> DataFrame:
    """(a, b, support, confidence) between visible clusters: the strongest pair of files; place (path, cluster)."""
    left = place.select(F.col("path"), F.col("cluster").alias("ca"))
    right = place.select(F.col("path").alias("other"), F.col("cluster").alias("cb"))
    rows = pairs.join(left, "path").join(right, "other").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.struct("support", "confidence").alias("s"))
    return rows.groupBy("a", "b").agg(F.max("s").alias("s")).select("a", "b", "s.support", "s.confidence")
