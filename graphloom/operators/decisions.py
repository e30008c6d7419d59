"""Decision records: anchors, governance, drift, lists, integrity.

decisions: (id, title, status, decided_at, anchors array<struct<node_id, path, name, kind, hash>>, paths array<string>,
supersedes array<string>, superseded_by, body_hash, file_order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import id_repo, id_suffix, path_prefixes
from .traverse import cut_lineage

#: Precedence of statuses, order and number of governing decisions, moves between statuses, budget.
PRECEDENCE = {"superseded": 4, "deprecated": 3, "rejected": 2, "accepted": 1, "proposed": 0}
GOVERNING = {"accepted": 0, "proposed": 1}
MAX_GOVERNING = 5
MOVES = {"proposed": ("accepted", "rejected"), "accepted": ("deprecated",), "rejected": (), "deprecated": (), "superseded": ()}
BUDGET = 100
IMMUTABLE = ("title", "context", "decision", "consequences", "alternatives", "decided_at", "decided_by")


def by_map(column: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, v in values.items():
        out = F.when(column == name, v).otherwise(out)
    return out


def dedupe(decisions: DataFrame) -> DataFrame:
    """One record per id: the status that takes precedence, then the first file."""
    names = [c for c in decisions.columns if c != "id"]
    order = F.struct(by_map(F.col("status"), PRECEDENCE), -F.col("file_order"))
    return decisions.groupBy("id").agg(F.max_by(F.struct(*names), order).alias("r")).select("id", "r.*")


def anchor_states(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """anchors (decision, node_id, hash) with state and resolved_node_id against nodes (id, content_hash)."""
    live = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("exact_id"), F.col("content_hash").alias("exact_hash"))
    suffixes = nodes.select(id_suffix(F.col("id")).alias("suffix"), "id", "content_hash").where("suffix is not null").groupBy("suffix").agg(F.min("id").alias("fork_id"), F.min_by("content_hash", "id").alias("fork_hash"))
    hashes = nodes.where("content_hash is not null").groupBy(F.col("content_hash").alias("hash")).agg(F.min("id").alias("moved_id"))
    rows = anchors.withColumn("suffix", id_suffix(F.col("node_id"))).join(live, "node_id", "left").join(suffixes, "suffix", "left").join(hashes, "hash", "left")
    found = F.coalesce("exact_id", "fork_id")
    content = F.when(F.col("exact_id").isNotNull(), F.col("exact_hash")).otherwise(F.col("fork_hash"))
    state = (
        F.when(found.isNotNull() & (F.col("hash").isNull() | content.isNull() | (F.col("hash") == content)), "current")
        .when(found.isNotNull(), "stale")
        .when(F.col("moved_id").isNotNull(), "moved")
        .otherwise("orphaned")
    )
    return rows.select("decision", "node_id", "hash", state.alias("state"), F.coalesce(found, "moved_id").alias("resolved_node_id"))


def _over(decisions: DataFrame, nodes: DataFrame, root_repo: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Live decisions over nodes: direct anchors, anchors of the same file, the governed paths (id, status, p), and (node_id, p) of the paths that nodes lie under.

    Direct anchors meet nodes by the id's suffix or the id; paths meet them by equality and, for directories, by the
    nodes' ancestors, so all are equi-joins.
    """
    live = decisions.where(F.col("status").isin(*GOVERNING))
    n = nodes.select(F.col("id").alias("node_id"), "file_path", "content_hash", id_repo(F.col("id")).alias("repo"), F.coalesce(id_suffix(F.col("id")), "id").alias("suffix"))
    anchors = live.select("id", "status", F.posexplode("anchors").alias("pos", "a"))
    keyed = anchors.select("id", "status", "pos", F.coalesce(id_suffix(F.col("a.node_id")), F.col("a.node_id")).alias("suffix"), F.col("a.hash").alias("hash"))
    direct = keyed.join(n, "suffix").groupBy("node_id", "id", "status").agg(F.min_by(F.struct("hash", "content_hash"), "pos").alias("h"))
    both = F.col("h.hash").isNotNull() & F.col("h.content_hash").isNotNull()
    direct = direct.select("node_id", "id", "status", F.lit("direct").alias("via"), F.when(both, F.when(F.col("h.hash") == F.col("h.content_hash"), "current").otherwise("stale")).alias("anchor_state"))
    placed = n.where("file_path <> ''")
    beside = anchors.select("id", "status", F.col("a.path").alias("file_path"), id_repo(F.col("a.node_id")).alias("a_repo")).join(placed, "file_path").where("repo is null or a_repo = repo").select("node_id", "id", "status")
    inside = placed if root_repo is None else placed.where(F.col("repo").isNull() | (F.col("repo") == root_repo))
    paths = live.select("id", "status", F.explode("paths").alias("p")).where("p is not null").distinct()
    ups = F.expr("transform(slice(split(file_path, '/'), 1, size(split(file_path, '/')) - 1), (x, i) -> concat(concat_ws('/', slice(split(file_path, '/'), 1, i + 1)), '/'))")
    under = inside.select("node_id", F.explode(F.array_distinct(F.concat(ups, F.array("file_path")))).alias("p")).distinct()
    return direct, beside, paths, under.join(paths.select("p").distinct(), "p", "left_semi")


def governing(decisions: DataFrame, nodes: DataFrame, root_repo: str | None = None, most: int | None = MAX_GOVERNING) -> DataFrame:
    """(node_id, id, status, via, anchor_state, place): decisions over each of nodes (id, file_path, content_hash).

    Ids are unique (`dedupe`).  Of a path's decisions only the first `most` can be among the first `most` of a node under
    it, whatever else is over that node, so no node meets the others.
    """
    direct, beside, paths, under = _over(decisions, nodes, root_repo)
    if most:
        paths = paths.withColumn("o", by_map(F.col("status"), GOVERNING)).withColumn("n", F.expr("row_number() over (partition by p order by o, id desc)")).where(F.col("n") <= most)
    contains = beside.unionByName(under.join(paths, "p").select("node_id", "id", "status")).distinct().join(direct, ["node_id", "id"], "left_anti")
    rows = direct.unionByName(contains.withColumn("via", F.lit("contains")).withColumn("anchor_state", F.lit(None).cast("string")))
    rows = rows.withColumn("o", by_map(F.col("status"), GOVERNING)).withColumn("place", F.expr("row_number() over (partition by node_id order by o, id desc)")).drop("o")
    return rows.where(F.col("place") <= most) if most else rows


def governed_nodes(rows: DataFrame) -> DataFrame:
    """(id, status, governs) from governing rows without a limit."""
    return rows.groupBy("id", "status").agg(F.array_sort(F.collect_set("node_id")).alias("governs"))


def governed_counts(decisions: DataFrame, nodes: DataFrame, root_repo: str | None = None) -> DataFrame:
    """(id, status, governs): how many nodes `governed_nodes` lists, without the list.

    Decisions with equal paths govern equal nodes by them: these are counted once for each set of paths, and only nodes
    that a decision reaches otherwise are counted for the decision itself.
    """
    direct, beside, paths, under = _over(decisions, nodes, root_repo)
    sets = paths.groupBy("id", "status").agg(F.array_sort(F.collect_set("p")).alias("paths"))
    covered = sets.select("paths").distinct().select("paths", F.explode("paths").alias("p")).join(under, "p").select("paths", "node_id").distinct()
    by_paths = sets.join(covered.groupBy("paths").agg(F.count(F.lit(1)).alias("n")), "paths").select("id", "status", "n")
    others = direct.select("node_id", "id", "status").unionByName(beside).distinct()
    held = others.join(sets, ["id", "status"]).join(covered, ["paths", "node_id"], "left_semi").select("node_id", "id", "status")
    rest = others.join(held, ["node_id", "id", "status"], "left_anti").groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"))
    return by_paths.unionByName(rest).groupBy("id", "status").agg(F.sum("n").alias("governs"))


def affected(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, reason) of decisions that a delta (id, change) touches: removed, then modified, then path."""
    live = decisions.where(F.col("status").isin(*GOVERNING))
    c = changes.where("change <> 'added'").select(F.coalesce(id_suffix(F.col("id")), "id").alias("suffix"), "change")
    anchors = live.select("id", F.explode("anchors").alias("a")).select("id", F.coalesce(id_suffix(F.col("a.node_id")), F.col("a.node_id")).alias("suffix"))
    hits = anchors.join(c, "suffix").select("id", F.when(F.col("change") == "removed", 0).otherwise(1).alias("rank"))
    path = F.regexp_extract("id", r"^rs1:[^:]+:[a-z]+:([^#]*)", 1)
    touched = changes.select(path.alias("file_path")).where("file_path <> ''").distinct()
    ups = touched.select(F.explode(F.array_union(path_prefixes(F.col("file_path")), F.transform(path_prefixes(F.col("file_path")), lambda p: F.concat(p, F.lit("/"))))).alias("p")).distinct()
    exact = touched.select(F.col("file_path").alias("p"))
    paths = live.select("id", F.explode("paths").alias("p"))
    under = paths.where(F.col("p").endswith("/")).join(ups, "p", "left_semi").unionByName(paths.where(~F.col("p").endswith("/")).join(exact, "p", "left_semi"))
    best = hits.unionByName(under.select("id", F.lit(2).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    return best.select("id", F.get(F.array(F.lit("removed"), F.lit("modified"), F.lit("path")), F.col("rank")).alias("reason"))


def anchored(anchor: str) -> Column:
    """Whether a decision has this node, in whatever repository, as an anchor, or governs this path."""
    if anchor.startswith("rs1:"):
        suffix = id_suffix(F.lit(anchor))
        return F.exists("anchors", lambda a: (a["node_id"] == anchor) | F.coalesce(id_suffix(a["node_id"]) == suffix, F.lit(False)))
    under = lambda p: (p == anchor) | (p.endswith("/") & F.startswith(F.lit(anchor), p))
    return F.exists("anchors", lambda a: a["path"] == anchor) | F.exists("paths", under)


def listed(decisions: DataFrame, status: str | None = None, text: str | None = None, limit: int = 50, anchor: str | None = None) -> DataFrame:
    """The newest decisions of a status, with an anchor, and with a text in title, context or decision."""
    rows = decisions if status is None else decisions.where(F.col("status") == status)
    if anchor is not None:
        rows = rows.where(anchored(anchor))
    if text:
        rows = rows.where(reduce(Column.__or__, (F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in ("title", "context", "decision"))))
    return rows.orderBy(F.desc("decided_at"), "id").limit(min(limit, 50))


def state_counts(states: DataFrame) -> DataFrame:
    """(decision, current, stale, moved, orphaned) of anchor states."""
    return states.groupBy("decision").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("current", "stale", "moved", "orphaned")))


def supersession(decisions: DataFrame) -> DataFrame:
    """(id, superseded_by): as recorded, else the first decision that lists it."""
    listing = decisions.select(F.col("id").alias("by"), F.explode("supersedes").alias("id")).groupBy("id").agg(F.min("by").alias("by"))
    return decisions.join(listing, "id", "left").select("id", F.coalesce("superseded_by", "by").alias("superseded_by"))


def supersession_chain(decisions: DataFrame) -> DataFrame:
    """(id, newer, steps): every decision that supersedes id, directly or through others; cycles end where they close."""
    links = supersession(decisions).where("superseded_by is not null").select("id", F.col("superseded_by").alias("newer"))
    links = cut_lineage(links.where("id <> newer"))
    out = frontier = links.withColumn("steps", F.lit(1))
    while True:
        more = frontier.join(links.select(F.col("id").alias("newer"), F.col("newer").alias("next")), "newer").where("id <> next").select("id", F.col("next").alias("newer"), (F.col("steps") + 1).alias("steps"))
        frontier = cut_lineage(more.join(out, ["id", "newer"], "left_anti").dropDuplicates(["id", "newer"]))
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def record(decisions: DataFrame, new: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, pending) after new decisions: those that they supersede are flipped, the drift that their anchors cover is taken off.

    new: like decisions, with checked fields and minted ids; pending: (id, change).
    """
    by = new.select(F.col("id").alias("by"), F.explode("supersedes").alias("id")).groupBy("id").agg(F.min("by").alias("by"))
    old = decisions.join(new.select("id"), "id", "left_anti").join(by, "id", "left")
    flipped = old.withColumn("superseded_by", F.coalesce("by", "superseded_by")).withColumn("status", F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")))
    covered = new.select(F.explode("anchors").alias("a")).select(F.coalesce(id_suffix(F.col("a.node_id")), F.col("a.node_id")).alias("suffix")).distinct()
    left = pending.withColumn("suffix", F.coalesce(id_suffix(F.col("id")), F.col("id"))).join(covered, "suffix", "left_anti").drop("suffix")
    return flipped.select(*decisions.columns).unionByName(new.select(*decisions.columns)), left


def body_hash(decisions: DataFrame) -> DataFrame:
    """decisions with computed_hash: SHA-256 of the JSON of the fields that may not change, in order of their names."""
    return decisions.withColumn("computed_hash", F.sha2(F.to_json(F.struct(*sorted(c for c in IMMUTABLE if c in decisions.columns))), 256))


def move_allowed(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, bs in MOVES.items():
        for b in bs:
            out = out | ((old == a) & (new == b))
    return out


def reaffirm(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision, node_id, hash) anchors stamped again with the live hash; orphans keep theirs."""
    anchors = decisions.select(F.col("id").alias("decision"), F.explode("anchors").alias("a")).select("decision", "a.node_id", "a.hash")
    states = anchor_states(anchors, nodes)
    live = nodes.select(F.col("id").alias("resolved_node_id"), "content_hash")
    return states.join(live, "resolved_node_id", "left").select("decision", F.coalesce("resolved_node_id", "node_id").alias("node_id"), F.coalesce("content_hash", "hash").alias("hash"))


def integrity(decisions: DataFrame) -> DataFrame:
    """(check, id) of what is wrong: duplicates, changed bodies, dangling references, cycles, too many accepted ones."""
    ids = decisions.select("id").distinct()
    duplicate = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("check"), "id")
    changed = body_hash(decisions).where("body_hash is not null and body_hash <> computed_hash").select(F.lit("changed").alias("check"), "id")
    links = decisions.select("id", F.explode("supersedes").alias("to")).distinct()
    dangling = links.join(ids.select(F.col("id").alias("to")), "to", "left_anti").select(F.lit("dangling").alias("check"), "id").distinct()
    # ids that only lead to ids without links can't be on a cycle: they are taken off from the ends until none is left
    open_ = links.join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    open_, before = cut_lineage(open_), -1
    while (n := open_.count()) not in (before, 0):
        before = n
        starts, ends = open_.select(F.col("id").alias("to")).distinct(), open_.select(F.col("to").alias("id")).distinct()
        open_ = open_.join(starts, "to", "left_semi").join(ends, "id", "left_semi")
        open_ = cut_lineage(open_)
    cycle = open_.select(F.lit("cycle").alias("check"), "id").distinct()
    accepted = decisions.where("status = 'accepted'").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUDGET).select(F.lit("budget").alias("check"), F.col("n").cast("string").alias("id"))
    return duplicate.unionByName(changed).unionByName(dangling).unionByName(cycle).unionByName(accepted)
