"""Queries on snapshots, merges, folds, resolution, federation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, federation, merge, resolve
from ..operators.traverse import cut_lineage
from . import workload as W
from .registry import query

_OLD = "old AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN sha256(p_name) END AS content_hash, p_type AS props FROM part WHERE p_partkey % 7 <> 0)"
_NEW = "new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN sha256(CASE WHEN p_partkey % 11 = 0 THEN p_name || '!' ELSE p_name END) END AS content_hash, CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE p_type END AS props FROM part WHERE p_partkey % 6 <> 0)"
_DELTA = f"{_OLD}, {_NEW}, dl AS (SELECT id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.content_hash IS NOT NULL AND n.content_hash IS NOT NULL THEN CASE WHEN o.content_hash <> n.content_hash THEN 'modified' END WHEN o.props IS DISTINCT FROM n.props THEN 'modified' END AS change FROM old o FULL JOIN new n USING (id))"


def _snapshots(spark, d):
    p, k = W.table(spark, d, "part"), F.col("p_partkey")
    old = p.where(k % 7 != 0).select(k.alias("id"), F.when(k % 5 != 0, F.sha2("p_name", 256)).alias("content_hash"), F.col("p_type").alias("props"))
    name = F.when(k % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    new = p.where(k % 6 != 0).select(k.alias("id"), F.when(k % 5 != 0, F.sha2(name, 256)).alias("content_hash"), F.when(k % 10 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("props"))
    return old, new


@query("set01_delta", f"WITH {_DELTA} SELECT id, change FROM dl WHERE change IS NOT NULL")
def _(spark, d):
    return merge.delta(*_snapshots(spark, d))


@query("set02_capped_delta", f"WITH {_DELTA}, r AS (SELECT change, id, row_number() OVER (PARTITION BY change ORDER BY id) AS n, count(*) OVER (PARTITION BY change) AS c FROM dl WHERE change IS NOT NULL) SELECT change, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, any_value(c) AS n, any_value(c) > 200 AS truncated FROM r WHERE n <= 200 GROUP BY 1")
def _(spark, d):
    return merge.capped(merge.delta(*_snapshots(spark, d))).select("change", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"), "n", "truncated")


@query("set03_delta_union", f"WITH {_DELTA} SELECT id, change FROM dl WHERE change IS NOT NULL UNION SELECT p_partkey, 'modified' FROM part WHERE p_partkey % 3 = 0")
def _(spark, d):
    pending = W.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("modified").alias("change"))
    return merge.union_deltas(pending, merge.delta(*_snapshots(spark, d)))


@query("set04_delta_minus", f"WITH {_DELTA} SELECT id, change FROM dl WHERE change IS NOT NULL AND id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0)")
def _(spark, d):
    return merge.without(merge.delta(*_snapshots(spark, d)), W.table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id")))


_SIDES = """b AS (SELECT c_custkey AS id, c_name AS body FROM customer WHERE c_custkey % 9 <> 0),
o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' ours' ELSE c_name END AS body FROM customer WHERE c_custkey % 5 <> 0),
t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' theirs' ELSE c_name END AS body FROM customer WHERE c_custkey % 7 <> 0)"""


def _sides(spark, d):
    c, k = W.table(spark, d, "customer"), F.col("c_custkey")
    change = lambda n, word: F.when(k % n == 0, F.concat("c_name", F.lit(word))).otherwise(F.col("c_name")).alias("body")
    return c.where(k % 9 != 0).select(k.alias("id"), F.col("c_name").alias("body")), c.where(k % 5 != 0).select(k.alias("id"), change(4, " ours")), c.where(k % 7 != 0).select(k.alias("id"), change(3, " theirs"))


@query("set05_three_way", f"""WITH {_SIDES}, j AS (SELECT coalesce(b.id, o.id, t.id) AS id, b.body AS bb, o.body AS ob, t.body AS tb FROM b FULL JOIN o ON b.id = o.id FULL JOIN t ON t.id = coalesce(b.id, o.id)),
s AS (SELECT *, CASE WHEN ob IS NOT DISTINCT FROM bb THEN 'theirs' WHEN tb IS NOT DISTINCT FROM bb THEN 'ours' WHEN ob IS NULL THEN 'theirs' ELSE 'ours' END AS side FROM j) SELECT id, CASE WHEN side = 'theirs' THEN tb ELSE ob END AS body, side FROM s WHERE CASE WHEN side = 'theirs' THEN tb ELSE ob END IS NOT NULL""")
def _(spark, d):
    return merge.three_way(*_sides(spark, d))


@query("set06_summary_pick", "WITH r AS (SELECT c_custkey AS id, c_name AS h, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'x' END AS oh, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'y' END AS th FROM customer) SELECT id, CASE WHEN oh = h THEN 'ours' WHEN th = h THEN 'theirs' ELSE 'ours' END AS side FROM r")
def _(spark, d):
    k = F.col("c_custkey")
    side = lambda n, other, word: F.struct(F.when(k % n == 0, F.col("c_name")).otherwise(other).alias("summary_of_hash"), F.lit(word).alias("side"))
    rows = W.table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("content_hash"), side(2, "x", "ours").alias("ours"), side(3, "y", "theirs").alias("theirs"))
    return merge.three_way_summaries(rows).select("id", F.col("summary.side").alias("side"))


_EDGE_SIDES = "x AS (SELECT DISTINCT l_orderkey AS src, l_returnflag AS type, l_partkey AS dst FROM lineitem), b AS (SELECT * FROM x WHERE (src + dst) % 3 <> 0), o AS (SELECT *, 'o' AS body FROM x WHERE (src + dst) % 4 <> 0), t AS (SELECT *, 't' AS body FROM x WHERE (src + dst) % 5 <> 0)"


@query("set07_three_way_edges", f"WITH {_EDGE_SIDES} SELECT src, type, dst, coalesce(o.body, t.body) AS body FROM o FULL JOIN t USING (src, type, dst) LEFT JOIN (SELECT *, true AS ib FROM b) b USING (src, type, dst) WHERE (o.body IS NOT NULL AND t.body IS NOT NULL) OR ib IS NULL")
def _(spark, d):
    x = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("dst")).distinct()
    return merge.three_way_edges(x.where("(src + dst) % 3 <> 0"), x.where("(src + dst) % 4 <> 0").withColumn("body", F.lit("o")), x.where("(src + dst) % 5 <> 0").withColumn("body", F.lit("t")))


@query("set08_graft", f"WITH {_NEW}, s AS (SELECT p_partkey AS id, sha256(p_name) AS h, p_type AS summary FROM part) SELECT new.id, content_hash, summary FROM new LEFT JOIN s ON s.id = new.id AND h = content_hash")
def _(spark, d):
    s = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("summary_of_hash"), F.col("p_type").alias("summary"))
    return merge.graft(_snapshots(spark, d)[1].select("id", "content_hash"), s)


_RECORDS = "rc AS (SELECT user_id AS id, CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS \"at\", props AS line, (event_id % 3)::INT AS source FROM events)"


def _records(spark, d):
    e = W.table(spark, d, "events")
    return e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 13 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("at"), F.col("props").alias("line"), (F.col("event_id") % 3).cast("int").alias("source"))


@query("set09_fold", f"WITH {_RECORDS}, u AS (SELECT DISTINCT id, \"at\", line FROM rc), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY coalesce(\"at\", '') DESC, line) AS n FROM u), m AS (SELECT id, line AS w FROM r WHERE n = 1) SELECT id, line, \"at\", line = w AS won FROM u JOIN m USING (id)")
def _(spark, d):
    return merge.fold(_records(spark, d))


@query("set10_fold_sources", f"WITH {_RECORDS}, w AS (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY coalesce(\"at\", '') DESC, line) AS n FROM rc), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(\"at\", '') DESC, source DESC) AS k FROM w WHERE n = 1) SELECT id, line, \"at\", source FROM r WHERE k = 1")
def _(spark, d):
    return merge.fold_sources(_records(spark, d))


@query("set11_has_summary", "WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"semantic_summary\":\"does x\"}' WHEN 1 THEN '{\"semantic_summary\":\"  \",\"purpose_summary\":7}' WHEN 2 THEN '{\"purpose_summary\":\"why\"}' ELSE props END AS line FROM events) SELECT event_id, event_id % 4 IN (0, 2) AS has FROM l")
def _(spark, d):
    n = F.col("event_id") % 4
    line = F.when(n == 0, '{"semantic_summary":"does x"}').when(n == 1, '{"semantic_summary":"  ","purpose_summary":7}').when(n == 2, '{"purpose_summary":"why"}').otherwise(F.col("props"))
    return W.table(spark, d, "events").select("event_id", F.coalesce(merge.has_summary(line), F.lit(False)).alias("has"))


@query("set12_absorbed", "WITH l AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '<<<<<<< HEAD' WHEN 1 THEN '{bad' WHEN 2 THEN '{\"x\":1}' ELSE '{\"id\":\"' || user_id || '\"}' END AS line, event_id % 6 AS m FROM events) SELECT CASE WHEN m = 0 THEN 'conflict' WHEN m IN (1, 2) THEN 'malformed' ELSE 'kept' END AS what, count(*) AS n FROM l GROUP BY 1")
def _(spark, d):
    n = F.col("event_id") % 6
    line = F.when(n == 0, "<<<<<<< HEAD").when(n == 1, "{bad").when(n == 2, '{"x":1}').otherwise(F.concat(F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('"}')))
    kept, warned = merge.absorb(W.table(spark, d, "events").select(line.alias("line")))
    return warned.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n"))


@query("set13_conflict_lines", "WITH e AS (SELECT props AS line FROM events WHERE event_id % 3 = 0), l AS (SELECT props AS line FROM events WHERE event_id % 3 = 1) SELECT DISTINCT line FROM (SELECT * FROM e UNION ALL SELECT * FROM l)")
def _(spark, d):
    e = W.table(spark, d, "events")
    return merge.conflict_log(e.where("event_id % 3 = 0").select(F.col("props").alias("line")), e.where("event_id % 3 = 1").select(F.col("props").alias("line")))


@query("set12_conflict_lines", "WITH l AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '<<<<<<< HEAD' WHEN 1 THEN '=======' WHEN 2 THEN '>>>>>>> b' WHEN 3 THEN '||||||| base' WHEN 4 THEN '<<<<<<<<' ELSE props END AS line FROM events) SELECT event_id % 6 < 4 AS marker, count(*) AS n FROM l GROUP BY 1")
def _(spark, d):
    n = F.col("event_id") % 6
    line = F.when(n == 0, "<<<<<<< HEAD").when(n == 1, "=======").when(n == 2, ">>>>>>> b").when(n == 3, "||||||| base").when(n == 4, "<<<<<<<<").otherwise(F.col("props"))
    return W.table(spark, d, "events").select(merge.is_conflict_marker(line).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query("set13_conflict_log", f"WITH {_RECORDS} SELECT DISTINCT id, line FROM rc WHERE source = 0 UNION SELECT DISTINCT id, line FROM rc WHERE source = 1")
def _(spark, d):
    r = _records(spark, d)
    return r.where("source = 0").select("id", "line").union(r.where("source = 1").select("id", "line")).distinct()


@query("set14_node_dedupe", "WITH r AS (SELECT l_orderkey AS id, l_partkey AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem) SELECT id, body FROM r WHERE n = 1")
def _(spark, d):
    rows = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("body"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("seq"))
    return merge.dedupe_nodes(rows)


@query("set15_edge_dedupe", "SELECT l_orderkey AS src, 'CALLS' AS type, l_linenumber AS dst, max(l_quantity) AS quantity, max(l_tax) AS tax, arg_min(l_returnflag, (l_extendedprice, l_partkey, l_returnflag)) AS flag FROM lineitem GROUP BY 1, 2, 3")
def _(spark, d):
    rows = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit("CALLS").alias("type"), F.col("l_linenumber").alias("dst"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.struct("l_extendedprice", "l_partkey", "l_returnflag").alias("seq"))
    return merge.dedupe_edges(rows, ["quantity", "tax"], ["flag"])


@query("set16_alive", f"WITH {_NEW} SELECT p_partkey AS id, p_type AS summary FROM part WHERE p_partkey IN (SELECT id FROM new)")
def _(spark, d):
    return merge.alive(W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("summary")), _snapshots(spark, d)[1])


@query("set17_overlay", f"WITH {_NEW}, s AS (SELECT p_partkey AS id, sha256(p_name) AS h, p_type AS summary FROM part WHERE p_partkey % 4 <> 0) SELECT new.id, CASE WHEN h IS NOT DISTINCT FROM content_hash THEN summary END AS summary, CASE WHEN summary IS NULL THEN 'needs_enrichment' WHEN h IS DISTINCT FROM content_hash THEN 'stale' ELSE 'fresh' END AS state FROM new LEFT JOIN s USING (id)")
def _(spark, d):
    s = W.table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("summary_of_hash"), F.col("p_type").alias("summary"))
    return merge.overlay(_snapshots(spark, d)[1], s).select("id", "summary", "state")


@query("res30_dangling", f"WITH {W.EDGES} SELECT src, dst, call_sites FROM ed WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 5) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(spark, d):
    return resolve.without_dangling(W.edges(spark, d), W.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"))).select("src", "dst", "call_sites")


@query("res31_containment", f"WITH {W.PAGES}, s AS (SELECT DISTINCT string_split(path, '/') AS p, path AS f FROM pp), e AS (SELECT p, f, unnest(range(1, len(p) + 1)) AS n FROM s), c AS (SELECT array_to_string(p[1:n], '/') AS child, f FROM e) SELECT DISTINCT CASE WHEN contains(child, '/') AND regexp_extract(child, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(child, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent, child, child = f AS child_is_file FROM c")
def _(spark, d):
    return resolve.containment(W.page_paths(spark, d).select("path").distinct())


# calls of parts by name: a file is a brand, a directory a type; names are shared by several parts
_FACTS = """fn AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) || (p_partkey % 40) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'K.' ELSE '' END || split_part(p_name, ' ', 1) || (p_partkey % 40) AS qualified, lower(split_part(p_type, ' ', 1)) || '/' || p_brand AS file_path FROM part),
cl AS (SELECT o_orderkey AS seq, (o_custkey % 50) AS caller_id, lower(split_part(p_type, ' ', 1)) || '/' || p_brand AS caller_path, split_part(p_name, ' ', 1) || ((o_orderkey + o_custkey) % 40) AS callee, CASE WHEN o_orderkey % 4 = 0 THEN 'obj' END AS receiver FROM orders JOIN part ON p_partkey = 1 + o_custkey % (SELECT count(*) FROM part))"""


def _facts(spark, d):
    p, o = W.table(spark, d, "part"), W.table(spark, d, "orders")
    name = F.split("p_name", " ")[0]
    path = F.concat(F.lower(F.split("p_type", " ")[0]), F.lit("/"), "p_brand")
    own = F.concat(name, (F.col("p_partkey") % 40).cast("string"))
    funcs = p.select(F.col("p_partkey").alias("id"), own.alias("name"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "K.").otherwise(""), own).alias("qualified"), path.alias("file_path"))
    n = p.count()
    calls = o.withColumn("p_partkey", 1 + F.col("o_custkey") % n).join(p, "p_partkey").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 50).alias("caller_id"),
        path.alias("caller_path"),
        path.alias("caller_file_id"),
        F.lit("f").alias("caller_qualified"),
        F.concat(name, ((F.col("o_orderkey") + F.col("o_custkey")) % 40).cast("string")).alias("callee"),
        F.when(F.col("o_orderkey") % 4 == 0, "obj").alias("receiver"),
    )
    empty = lambda schema: spark.createDataFrame([], schema).where(F.lit(False))  # noqa: E731  # known to the planner as empty
    return calls, funcs, empty("id long, label string, name string, qualified string, file_path string"), empty("file_id string, local string, path string, original string"), empty("file_id string, alias string, target string"), empty("caller_id long, local string, class_id long")


_LADDER = f"""WITH {_FACTS}, d AS (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM fn), n AS (SELECT name, count(*) AS n FROM fn GROUP BY 1),
c AS (SELECT *, regexp_extract(caller_path, '^(.*)/[^/]*$', 1) AS dir FROM cl),
r2 AS (SELECT seq, caller_id, d.id AS target, 'exact' AS resolution, 1.0::DOUBLE AS confidence FROM c JOIN d ON d.file_path = caller_path AND d.name = callee AND NOT contains(qualified, '.') WHERE receiver IS NULL),
c3 AS (SELECT c.* FROM c ANTI JOIN r2 USING (seq) WHERE receiver IS NULL),
l AS (SELECT seq, caller_id, d.id AS target, count(*) OVER (PARTITION BY seq) AS k FROM c3 JOIN n ON n.name = callee AND n > 1 JOIN d ON d.name = callee AND d.dir = c3.dir WHERE c3.dir <> ''),
r3 AS (SELECT seq, caller_id, target, CASE WHEN k = 1 THEN 'name_match' ELSE 'ambiguous' END AS resolution, CASE WHEN k = 1 THEN 0.8::DOUBLE ELSE floor(0.8::DOUBLE / k * 100 + 0.5) / 100 END AS confidence FROM l),
r4 AS (SELECT seq, caller_id, d.id AS target, CASE WHEN n = 1 THEN 'name_match' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN 0.7::DOUBLE ELSE floor(1.0::DOUBLE / n * 100 + 0.5) / 100 END AS confidence FROM (SELECT c3.* FROM c3 ANTI JOIN r3 USING (seq)) c3 JOIN n ON n.name = callee JOIN d ON d.name = callee),
r6 AS (SELECT seq, caller_id, d.id AS target, CASE WHEN n = 1 THEN 'name_match' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE floor(1.0::DOUBLE / n * 100 + 0.5) / 100 END AS confidence FROM c JOIN n ON n.name = callee JOIN d ON d.name = callee WHERE receiver IS NOT NULL),
rs AS (SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r6)"""


@query("res12_call_ladder", _LADDER + " SELECT * FROM rs")
def _(spark, d):
    return resolve.resolve_calls(*_facts(spark, d))


@query("res20_call_edges", _LADDER + ", q AS (SELECT *, row_number() OVER (PARTITION BY caller_id, target ORDER BY confidence DESC, seq) AS n, count(*) OVER (PARTITION BY caller_id, target) AS call_sites FROM rs) SELECT caller_id AS src, target AS dst, resolution, confidence, call_sites FROM q WHERE n = 1")
def _(spark, d):
    calls, *facts = _facts(spark, d)
    calls = cut_lineage(resolve.distinct_calls(calls))
    return resolve.call_edges(calls, resolve.place_calls(calls, *facts), facts[1], facts[2], facts[0])[0]


_TYPES = """ty AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'Interface' ELSE 'Class' END AS label, 'T' || (s_suppkey % 37) AS name, 'T' || (s_suppkey % 37) AS qualified, 'n' || s_nationkey || '/f' || (s_suppkey % 3) AS file_path FROM supplier),
hr AS (SELECT c_custkey AS seq, c_custkey AS from_id, 'n' || c_nationkey || '/f' || (c_custkey % 3) AS from_path, 'T' || (c_custkey % 60) AS base FROM customer),
u AS (SELECT name, count(*) AS n, min(id) AS id FROM ty GROUP BY 1), f AS (SELECT file_path, name, count(*) AS n, min(id) AS id FROM ty GROUP BY 1, 2), dd AS (SELECT name, split_part(file_path, '/', 1) AS dir, count(*) AS n, min(id) AS id FROM ty GROUP BY 1, 2),
tr AS (SELECT seq, from_id, CASE WHEN f.n = 1 THEN f.id WHEN u.n > 1 AND dd.n = 1 THEN dd.id WHEN u.n = 1 THEN u.id END AS target, CASE WHEN f.n = 1 THEN 'exact' ELSE 'name_match' END AS resolution, CASE WHEN f.n = 1 THEN 1.0::DOUBLE WHEN u.n > 1 AND dd.n = 1 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM hr LEFT JOIN f ON f.file_path = from_path AND f.name = base LEFT JOIN u ON u.name = base LEFT JOIN dd ON dd.name = base AND dd.dir = split_part(from_path, '/', 1))"""


def _type_facts(spark, d):
    s, c = W.table(spark, d, "supplier"), W.table(spark, d, "customer")
    place = lambda nation, key: F.concat(F.lit("n"), F.col(nation).cast("string"), F.lit("/f"), (F.col(key) % 3).cast("string"))
    name = F.concat(F.lit("T"), (F.col("s_suppkey") % 37).cast("string"))
    types = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "Interface").otherwise("Class").alias("label"), name.alias("name"), name.alias("qualified"), place("s_nationkey", "s_suppkey").alias("file_path"))
    k = F.col("c_custkey")
    rows = c.select(k.alias("seq"), (k + 1_000_000).alias("from_id"), place("c_nationkey", "c_custkey").alias("from_path"), place("c_nationkey", "c_custkey").alias("from_file_id"), F.when(k % 2 == 0, "INHERITS").otherwise("IMPLEMENTS").alias("edge_type"), F.concat(F.lit("T"), (k % 60).cast("string")).alias("base"), (k % 5 == 0).alias("label_refine"))
    return rows, types, spark.createDataFrame([], "file_id string, local string, path string, original string")


@query("res23_type_ladder", f"WITH {_TYPES} SELECT seq AS ref, target, resolution, confidence FROM tr WHERE target IS NOT NULL")
def _(spark, d):
    rows, types, bindings = _type_facts(spark, d)
    return resolve.resolve_types(rows.select(F.col("seq").alias("ref"), "from_id", "from_path", "from_file_id", "base"), types, bindings)


@query("res23_scoped_types", "WITH ty AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'K' || (p_partkey % 8) ELSE 'N' || (p_partkey % 5) END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'K' || (p_partkey % 8) ELSE 'K' || (p_partkey % 6) || '.N' || (p_partkey % 5) END AS qualified, p_brand AS file_path FROM part), rf AS (SELECT id AS ref, id AS from_id, qualified AS scope, file_path, 'N' || (id % 5) AS base FROM ty), o AS (SELECT file_path, qualified, max(id) AS id FROM ty GROUP BY 1, 2), c AS (SELECT ref, o.id AS target, 2 AS depth FROM rf JOIN o ON o.file_path = rf.file_path AND contains(scope, '.') AND o.qualified = split_part(scope, '.', 1) || '.' || base UNION ALL SELECT ref, o.id, 1 FROM rf JOIN o ON o.file_path = rf.file_path AND o.qualified = base) SELECT ref, arg_max(target, depth) AS target FROM c GROUP BY 1")
def _(spark, d):
    k = F.col("p_partkey")
    n = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    types = W.table(spark, d, "part").select(k.alias("id"), F.lit("Class").alias("label"), F.when(k % 3 == 0, n("K", 8)).otherwise(n("N", 5)).alias("name"), F.when(k % 3 == 0, n("K", 8)).otherwise(F.concat(n("K", 6), F.lit("."), n("N", 5))).alias("qualified"), F.col("p_brand").alias("file_path"))
    refs = types.select(F.col("id").alias("ref"), F.col("id").alias("from_id"), F.col("file_path").alias("from_path"), F.col("file_path").alias("from_file_id"), F.concat(F.lit("N"), (F.col("id") % 5).cast("string")).alias("base"))
    out = resolve.resolve_types(refs, types, spark.createDataFrame([], "file_id string, local string, path string, original string"))
    # rung 1a alone: the references whose scopes hold the base
    scopes = types.select("file_path", "qualified")
    parts = F.split("qualified", r"\.")
    tried = refs.join(types.select(F.col("id").alias("from_id"), "qualified"), "from_id").select("ref", "from_path", F.explode(F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i), F.col("base")))).alias("wanted"))
    scoped = tried.join(scopes, (F.col("from_path") == F.col("file_path")) & (F.col("wanted") == F.col("qualified")), "left_semi").select("ref").distinct()
    return out.join(scoped, "ref", "left_semi").select("ref", "target")


@query("res28_heritage", f"WITH {_TYPES} SELECT from_id + 1000000 AS src, CASE WHEN seq % 5 = 0 THEN CASE label WHEN 'Interface' THEN 'IMPLEMENTS' ELSE 'INHERITS' END WHEN seq % 2 = 0 THEN 'INHERITS' ELSE 'IMPLEMENTS' END AS type, target AS dst, resolution, confidence FROM tr JOIN ty ON ty.id = target")
def _(spark, d):
    return resolve.heritage_edges(*_type_facts(spark, d))[0]


@query("res28_unresolved_heritage", f"WITH {_TYPES} SELECT from_id + 1000000 AS from_id, CASE WHEN seq % 2 = 0 THEN 'INHERITS' ELSE 'IMPLEMENTS' END || '|' || 'T' || (seq % 60) AS spec FROM tr WHERE target IS NULL")
def _(spark, d):
    return resolve.heritage_edges(*_type_facts(spark, d))[1].select("from_id", F.col("external_heritage")[0].alias("spec"))


_IMPORTS = """im AS (SELECT o_orderkey AS seq, 'f' || (o_custkey % 300) AS file_id, ['q' || (o_orderkey % 90), 'p' || (o_orderkey % 50), 'p' || (o_orderkey % 70)] AS candidates, 's' || (o_orderkey % 20) AS local FROM orders), fl AS (SELECT DISTINCT 'p' || (p_partkey % 60) AS path FROM part),
fi AS (SELECT seq, file_id, local, list_filter(candidates, lambda c: c IN ('p0') OR regexp_matches(c, '^p([0-9]|[1-5][0-9])$'))[1] AS target FROM im)"""


def _imports(spark, d):
    k = F.col("o_orderkey")
    mod = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    rows = W.table(spark, d, "orders").select(k.alias("seq"), F.concat(F.lit("f"), (F.col("o_custkey") % 300).cast("string")).alias("file_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 300).cast("string")).alias("path"), F.array(F.struct(mod("s", 20).alias("local"), mod("s", 20).alias("original"))).alias("symbols"), F.array(mod("q", 90), mod("p", 50), mod("p", 70)).alias("candidates"), F.lit(False).alias("reexport"))
    files = W.table(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 60).cast("string")).alias("path")).distinct()
    return rows, files


@query("res01_import_targets", f"WITH {_IMPORTS} SELECT seq, file_id, target FROM fi WHERE target IS NOT NULL")
def _(spark, d):
    return resolve.existing_candidate(*_imports(spark, d)).select("seq", "file_id", "target")


@query("res05_import_edges", f"WITH {_IMPORTS} SELECT file_id AS src, target AS dst_path, array_to_string(list_sort(list(DISTINCT local)), ',') AS symbols FROM fi WHERE target IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    rows, files = _imports(spark, d)
    funcs = spark.createDataFrame([], "id long, name string, qualified string, file_path string")
    return resolve.import_bindings(rows, files, funcs)[1].select("src", "dst_path", F.concat_ws(",", "symbols").alias("symbols"))


@query("res17_import_bindings", f"WITH {_IMPORTS} SELECT file_id, local, arg_max(target, seq) AS path, local AS original FROM fi WHERE target IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    rows, files = _imports(spark, d)
    funcs = spark.createDataFrame([], "id long, name string, qualified string, file_path string")
    return resolve.import_bindings(rows, files, funcs)[0]


@query("fed01_members", "WITH RECURSIVE l AS (SELECT n_regionkey::BIGINT AS src, 100 + n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT 100 + c_nationkey::BIGINT, 1000 + c_custkey FROM customer), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN l ON src = id WHERE depth < 8) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, d):
    n = W.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.lit(100) + F.col("n_nationkey").cast("long")).alias("dst"))
    c = W.table(spark, d, "customer").select((F.lit(100) + F.col("c_nationkey").cast("long")).alias("src"), (F.lit(1000) + F.col("c_custkey")).alias("dst"))
    return federation.members(n.union(c), spark.createDataFrame([(1,)], "id long"))


@query("fed02_first_nodes", "WITH x AS (SELECT c_custkey AS id, 0 AS source, c_name AS body FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer) SELECT id, arg_min(source, source) AS source, arg_min(body, source) AS body FROM x GROUP BY 1")
def _(spark, d):
    c = W.table(spark, d, "customer")
    x = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(0).alias("source"), F.col("c_name").alias("body")).unionByName(c.select(F.col("c_custkey").alias("id"), F.lit(1).alias("source"), F.col("c_mktsegment").alias("body")))
    return federation.first_nodes(x)


@query("fed03_federates_to", "SELECT c_custkey AS src, s_suppkey AS dst FROM customer JOIN supplier ON c_custkey % 200 = s_suppkey")
def _(spark, d):
    proxies = W.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).alias("federated_repo_id"))
    return federation.federates_to(proxies, W.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("repo_id"))).select("src", "dst")


_STITCH = """fn AS (SELECT p_partkey AS id, p_partkey % 5 AS repo, p_name || '|' || p_brand AS name FROM part), wt AS (SELECT c_custkey AS src, c_custkey % 5 AS repo, p_name || '|' || p_brand AS name FROM customer JOIN part ON p_partkey = 1 + c_custkey % (SELECT count(*) FROM part)),
sc AS (SELECT c_custkey AS src, (c_custkey + 1) % 5 AS repo FROM customer WHERE c_custkey % 3 = 0), a AS (SELECT src, wt.name, min(fn.id) AS dst FROM wt JOIN sc USING (src) JOIN fn ON fn.repo = sc.repo AND fn.name = wt.name WHERE fn.repo <> wt.repo GROUP BY 1, 2 HAVING count(DISTINCT fn.id) = 1),
b AS (SELECT src, wt.name, min(fn.id) AS dst FROM wt JOIN fn ON fn.name = wt.name AND fn.repo <> wt.repo WHERE src NOT IN (SELECT src FROM a) GROUP BY 1, 2 HAVING count(DISTINCT fn.id) = 1)"""


@query("fed04_stitch_calls", f"WITH {_STITCH} SELECT src, name, dst, 0.6::DOUBLE AS confidence FROM a UNION ALL SELECT src, name, dst, 0.5::DOUBLE FROM b")
def _(spark, d):
    p, c = W.table(spark, d, "part"), W.table(spark, d, "customer")
    name = F.concat_ws("|", "p_name", "p_brand")
    funcs = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("repo"), name.alias("name"))
    n = p.count()
    wanted = c.withColumn("p_partkey", 1 + F.col("c_custkey") % n).join(p, "p_partkey").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") % 5).alias("repo"), name.alias("name"))
    scopes = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") + 1) % 5).alias("repo"))
    return federation.stitch_calls(wanted, funcs, scopes)


@query("fed06_stitch_imports", "SELECT DISTINCT c_custkey AS src, t AS dst FROM (SELECT c_custkey, unnest([c_custkey * 2, c_custkey * 3]) AS t FROM customer) WHERE t IN (SELECT p_partkey FROM part)")
def _(spark, d):
    k = F.col("c_custkey")
    files = W.table(spark, d, "customer").select(k.alias("id"), F.array(k * 2, k * 3).alias("external_import_targets"))
    return federation.stitch_imports(files, W.table(spark, d, "part").select(F.col("p_partkey").alias("id"))).select("src", "dst")


@query("fed07_stitch_heritage", "WITH ty AS (SELECT s_suppkey AS id, s_suppkey % 4 AS repo, 'T' || (s_suppkey % 83) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Interface' ELSE 'Class' END AS label FROM supplier), w AS (SELECT c_custkey AS src, c_custkey % 4 AS repo, 'T' || (c_custkey % 120) AS name FROM customer) SELECT src, CASE WHEN min(label) = 'Interface' THEN 'IMPLEMENTS' ELSE 'INHERITS' END AS type, min(ty.id) AS dst, 0.7::DOUBLE AS confidence FROM w JOIN ty ON ty.name = w.name AND ty.repo <> w.repo GROUP BY src, w.name HAVING count(DISTINCT ty.id) = 1")
def _(spark, d):
    s, c = W.table(spark, d, "supplier"), W.table(spark, d, "customer")
    types = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("repo"), F.concat(F.lit("T"), (F.col("s_suppkey") % 83).cast("string")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Interface").otherwise("Class").alias("label"))
    rows = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("repo"), F.array(F.concat(F.lit("INHERITS|T"), (F.col("c_custkey") % 120).cast("string"))).alias("external_heritage"))
    return federation.stitch_heritage(rows, types)


@query("res34_repo_collisions", "SELECT c_nationkey AS repo_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return federation.collisions(W.table(spark, d, "customer").select(F.col("c_nationkey").alias("repo_id")))


# decisions: a supplier's record anchors two parts and governs a folder of types
_DEC = """dc AS (SELECT 'adr:' || s_suppkey AS id, ['accepted', 'proposed', 'rejected', 'superseded'][s_suppkey % 4 + 1] AS status, strftime(DATE '2024-01-01' + (s_suppkey % 300)::INT, '%Y-%m-%d') AS decided_at, s_suppkey AS k FROM supplier),
nd AS (SELECT 'rs1:r' || p_partkey % 3 || ':func:' || lower(replace(p_type, ' ', '/')) || '/' || p_partkey || '.py#f@0' AS id, lower(replace(p_type, ' ', '/')) || '/' || p_partkey || '.py' AS file_path, sha256(p_name) AS content_hash, p_partkey FROM part),
an AS (SELECT dc.id AS decision, dc.status, 'rs1:r' || CASE WHEN k % 2 = 0 THEN p_partkey % 3 ELSE 9 END || ':func:' || CASE WHEN k % 7 = 0 THEN 'gone' ELSE '' END || file_path || '#f@0' AS node_id, file_path AS path, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'old' ELSE content_hash END AS hash FROM dc JOIN nd ON p_partkey IN (k, k + 1))"""


def _decisions(spark, d):
    s, p = W.table(spark, d, "supplier"), W.table(spark, d, "part")
    path = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    nodes = p.select(F.concat(F.lit("rs1:r"), (F.col("p_partkey") % 3).cast("string"), F.lit(":func:"), path, F.lit("#f@0")).alias("id"), path.alias("file_path"), F.sha2("p_name", 256).alias("content_hash"), "p_partkey")
    k = F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, ("accepted", "proposed", "rejected", "superseded"))), (k % 4).cast("int"))
    base = s.select(F.concat(F.lit("adr:"), k.cast("string")).alias("id"), status.alias("status"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd").alias("decided_at"), k.alias("k"), F.explode(F.array(k, k + 1)).alias("p_partkey"))
    node_id = F.concat(F.lit("rs1:r"), F.when(F.col("k") % 2 == 0, F.col("p_partkey") % 3).otherwise(9).cast("string"), F.lit(":func:"), F.when(F.col("k") % 7 == 0, "gone").otherwise(""), F.col("file_path"), F.lit("#f@0"))
    stamp = F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 3 == 0, "old").otherwise(F.col("content_hash"))
    rows = base.join(nodes.drop("id"), "p_partkey").select("id", "status", "decided_at", "k", F.struct(node_id.alias("node_id"), F.col("file_path").alias("path"), stamp.alias("hash")).alias("anchor"))
    out = rows.groupBy("id", "status", "decided_at", "k").agg(F.sort_array(F.collect_list("anchor")).alias("anchors"))
    return out.withColumn("paths", F.array(F.lit("promo/"))).withColumn("title", F.concat(F.lit("Decision "), F.col("k").cast("string"))), nodes.drop("p_partkey")


@query("dec02_anchor_states", f"""WITH {_DEC}, x AS (SELECT an.*, regexp_extract(node_id, '^rs1:[^:]+(:.+)$', 1) AS sx FROM an), sf AS (SELECT regexp_extract(id, '^rs1:[^:]+(:.+)$', 1) AS sx, min(id) AS fid, arg_min(content_hash, id) AS fh FROM nd GROUP BY 1), hs AS (SELECT content_hash AS hash, min(id) AS mid FROM nd GROUP BY 1),
j AS (SELECT decision, node_id, x.hash, coalesce(nd.id, fid) AS found, CASE WHEN nd.id IS NOT NULL THEN nd.content_hash ELSE fh END AS c, mid FROM x LEFT JOIN nd ON nd.id = node_id LEFT JOIN sf USING (sx) LEFT JOIN hs ON hs.hash = x.hash)
SELECT decision, node_id, hash, CASE WHEN found IS NOT NULL AND (hash IS NULL OR hash = c) THEN 'current' WHEN found IS NOT NULL THEN 'stale' WHEN mid IS NOT NULL THEN 'moved' ELSE 'orphaned' END AS state, coalesce(found, mid) AS resolved_node_id FROM j""")
def _(spark, d):
    decs, nodes = _decisions(spark, d)
    return decisions.anchor_states(decs.select(F.col("id").alias("decision"), F.explode("anchors").alias("a")).select("decision", "a.node_id", "a.hash"), nodes)


@query("dec04_governing", f"""WITH {_DEC}, live AS (SELECT an.*, regexp_extract(node_id, '^rs1:[^:]+(:.+)$', 1) AS sx, regexp_extract(node_id, '^rs1:([^:]+):.+$', 1) AS repo FROM an WHERE status IN ('accepted', 'proposed')), n AS (SELECT *, regexp_extract(id, '^rs1:[^:]+(:.+)$', 1) AS sx, regexp_extract(id, '^rs1:([^:]+):.+$', 1) AS repo FROM nd),
dr AS (SELECT n.id AS node_id, decision AS id, status, CASE WHEN hash IS NOT NULL THEN CASE WHEN hash = content_hash THEN 'current' ELSE 'stale' END END AS anchor_state FROM live JOIN n USING (sx)),
ct AS (SELECT DISTINCT n.id AS node_id, decision AS id, status FROM live JOIN n ON n.file_path = live.path AND live.repo = n.repo UNION SELECT DISTINCT n.id, dc.id, status FROM dc JOIN n ON starts_with(file_path, 'promo/') WHERE status IN ('accepted', 'proposed') AND dc.id IN (SELECT decision FROM an)),
al AS (SELECT node_id, id, status, 'direct' AS via, anchor_state FROM dr UNION ALL SELECT node_id, id, status, 'contains', NULL FROM ct WHERE (node_id, id) NOT IN (SELECT (node_id, id) FROM dr)),
rk AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE status WHEN 'accepted' THEN 0 ELSE 1 END, id DESC) AS place FROM al) SELECT node_id, id, status, via, anchor_state, place FROM rk WHERE place <= 5""")
def _(spark, d):
    decs, nodes = _decisions(spark, d)
    return decisions.governing(decs, nodes).withColumn("place", F.col("place").cast("long"))


@query("dec07_affected", f"""WITH {_DEC}, ch AS (SELECT id, CASE WHEN p_partkey % 3 = 0 THEN 'removed' WHEN p_partkey % 3 = 1 THEN 'modified' ELSE 'added' END AS change, file_path FROM nd WHERE p_partkey < 60), l AS (SELECT decision AS id, regexp_extract(node_id, '^rs1:[^:]+(:.+)$', 1) AS sx FROM an WHERE status IN ('accepted', 'proposed')),
h AS (SELECT l.id, CASE change WHEN 'removed' THEN 0 ELSE 1 END AS r FROM l JOIN ch ON sx = regexp_extract(ch.id, '^rs1:[^:]+(:.+)$', 1) WHERE change <> 'added' UNION ALL SELECT DISTINCT dc.id, 2 FROM dc WHERE status IN ('accepted', 'proposed') AND dc.id IN (SELECT decision FROM an) AND EXISTS (SELECT 1 FROM ch WHERE starts_with(file_path, 'promo/'))) SELECT id, ['removed', 'modified', 'path'][min(r) + 1] AS reason FROM h GROUP BY 1""")
def _(spark, d):
    decs, nodes = _decisions(spark, d)
    n = F.regexp_extract("file_path", r"(\d+)\.py$", 1).cast("long")
    changes = nodes.where(n < 60).select("id", F.when(n % 3 == 0, "removed").when(n % 3 == 1, "modified").otherwise("added").alias("change"))
    return decisions.affected(decs, changes)


@query("dec08_list", f"WITH {_DEC} SELECT id, status, decided_at FROM dc WHERE status = 'accepted' AND id IN (SELECT decision FROM an) ORDER BY decided_at DESC, id LIMIT 50")
def _(spark, d):
    return decisions.listed(_decisions(spark, d)[0], "accepted").select("id", "status", "decided_at")


@query("dec08_search", f"WITH {_DEC}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'Use COPPER' ELSE 'plain' END AS title, CASE WHEN k % 4 = 0 THEN 'because copper lasts' END AS context, CASE WHEN k % 5 = 0 THEN 'Copper it is' ELSE 'tin' END AS decision FROM dc WHERE id IN (SELECT decision FROM an)) SELECT id, decided_at FROM t WHERE k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 ORDER BY decided_at DESC, id LIMIT 50")
def _(spark, d):
    k = F.col("k")
    decs = _decisions(spark, d)[0].withColumns({"title": F.when(k % 3 == 0, "Use COPPER").otherwise("plain"), "context": F.when(k % 4 == 0, "because copper lasts"), "decision": F.when(k % 5 == 0, "Copper it is").otherwise("tin")})
    return decisions.listed(decs, text="copPER").select("id", "decided_at")


@query("dec08_anchored", f"WITH {_DEC}, q AS (SELECT 'adr:' || k AS id FROM (SELECT min(k) AS k FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0))), o AS (SELECT regexp_extract(node_id, '^rs1:[^:]+(:.+)$', 1) AS sx FROM an WHERE decision = (SELECT id FROM q) ORDER BY node_id LIMIT 1) SELECT DISTINCT dc.id, decided_at FROM dc JOIN an ON an.decision = dc.id WHERE regexp_extract(node_id, '^rs1:[^:]+(:.+)$', 1) = (SELECT sx FROM o)")
def _(spark, d):
    decs = _decisions(spark, d)[0]
    first = decs.where("k % 7 <> 0").orderBy("k").select(F.array_min(F.transform("anchors", lambda a: a["node_id"])).alias("n")).first()["n"]
    return decisions.listed(decs, anchor=first.replace("rs1:r", "rs1:other")).select("id", "decided_at")


@query("dec09_chain", "WITH RECURSIVE dc AS (SELECT s_suppkey AS id, [s_suppkey * 2, s_suppkey + 1] AS s, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 7 END AS sb FROM supplier), l AS (SELECT unnest(s) AS id, id AS b FROM dc), m AS (SELECT id, min(b) AS b FROM l GROUP BY 1), e AS (SELECT dc.id, coalesce(sb, b) AS newer FROM dc LEFT JOIN m ON m.id = dc.id WHERE coalesce(sb, b) IS NOT NULL AND coalesce(sb, b) <> dc.id), r(id, newer) AS (SELECT id, newer FROM e UNION SELECT r.id, e.newer FROM r JOIN e ON e.id = r.newer WHERE r.id <> e.newer) SELECT id, newer FROM r")
def _(spark, d):
    k = F.col("s_suppkey")
    decs = W.table(spark, d, "supplier").select(k.alias("id"), F.array(k * 2, k + 1).alias("supersedes"), F.when(k % 10 == 0, k + 7).alias("superseded_by"))
    return decisions.supersession_chain(decs).select("id", "newer")


@query("dec10_record", "WITH dc AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'accepted' ELSE 'proposed' END AS status FROM supplier), nw AS (SELECT 100000 + s_suppkey AS id, s_suppkey * 3 AS old FROM supplier WHERE s_suppkey % 5 = 0), b AS (SELECT old, min(id) AS b FROM nw GROUP BY 1) SELECT dc.id, CASE WHEN b IS NULL THEN status ELSE 'superseded' END AS status, b AS superseded_by FROM dc LEFT JOIN b ON old = dc.id UNION ALL SELECT id, 'accepted', NULL FROM nw")
def _(spark, d):
    k = F.col("s_suppkey")
    node = lambda n: F.struct(F.concat(F.lit("rs1:r:func:"), n.cast("string")).alias("node_id"))
    s = W.table(spark, d, "supplier")
    old = s.select(k.alias("id"), F.when(k % 2 == 0, "accepted").otherwise("proposed").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.array().cast("array<bigint>").alias("supersedes"), F.array(node(k)).alias("anchors"))
    new = s.where("s_suppkey % 5 = 0").select((100_000 + k).alias("id"), F.lit("accepted").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.array(k * 3).alias("supersedes"), F.array(node(k)).alias("anchors"))
    return decisions.record(old, new, old.select(F.col("anchors")[0]["node_id"].alias("id"), F.lit("modified").alias("change")))[0].select("id", "status", "superseded_by")


@query("dec10_pending", "SELECT 'rs1:q:func:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 0")
def _(spark, d):
    k = F.col("s_suppkey")
    node = lambda repo: F.concat(F.lit(f"rs1:{repo}:func:"), k.cast("string"))
    s = W.table(spark, d, "supplier")
    shape = s.select(k.alias("id"), F.lit("accepted").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.array().cast("array<bigint>").alias("supersedes"), F.array(F.struct(node("r").alias("node_id"))).alias("anchors"))
    return decisions.record(shape.limit(0), shape.where("id % 5 = 0"), s.select(node("q").alias("id"), F.lit("modified").alias("change")))[1].select("id")


@query("dec09_supersession", "WITH dc AS (SELECT s_suppkey AS id, [s_suppkey * 2, s_suppkey + 1] AS s, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 7 END AS sb FROM supplier), l AS (SELECT unnest(s) AS id, id AS b FROM dc), m AS (SELECT id, min(b) AS b FROM l GROUP BY 1) SELECT dc.id, coalesce(sb, b) AS superseded_by FROM dc LEFT JOIN m ON m.id = dc.id")
def _(spark, d):
    k = F.col("s_suppkey")
    decs = W.table(spark, d, "supplier").select(k.alias("id"), F.array(k * 2, k + 1).alias("supersedes"), F.when(k % 10 == 0, k + 7).alias("superseded_by"))
    return decisions.supersession(decs)


@query("dec01_dedupe", "WITH x AS (SELECT s_suppkey // 2 AS id, ['superseded', 'deprecated', 'rejected', 'accepted', 'proposed'][s_suppkey % 5 + 1] AS status, s_suppkey AS file_order FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'superseded' THEN 4 WHEN 'deprecated' THEN 3 WHEN 'rejected' THEN 2 WHEN 'accepted' THEN 1 ELSE 0 END DESC, file_order) AS n FROM x) SELECT id, status, file_order FROM r WHERE n = 1")
def _(spark, d):
    k = F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, ("superseded", "deprecated", "rejected", "accepted", "proposed"))), (k % 5).cast("int"))
    return decisions.dedupe(W.table(spark, d, "supplier").select(F.floor(k / 2).alias("id"), status.alias("status"), k.alias("file_order")))


@query("dec13_status_moves", "WITH s AS (SELECT unnest(['proposed', 'accepted', 'rejected', 'deprecated', 'superseded']) AS a) SELECT x.a AS old, y.a AS new, (x.a = 'proposed' AND y.a IN ('accepted', 'rejected')) OR (x.a = 'accepted' AND y.a = 'deprecated') AS allowed FROM s x, s y")
def _(spark, d):
    s = spark.createDataFrame([(a, b) for a in decisions.PRECEDENCE for b in decisions.PRECEDENCE], "old string, new string")
    return s.withColumn("allowed", decisions.move_allowed(F.col("old"), F.col("new")))


@query("dec15_integrity", "WITH RECURSIVE dc AS (SELECT s_suppkey // 2 AS id, [s_suppkey // 2 + 1, CASE WHEN s_suppkey % 8 = 0 THEN s_suppkey // 2 - 3 ELSE 1000000 END] AS s, CASE WHEN s_suppkey % 9 = 0 THEN 'wrong' WHEN s_suppkey % 9 = 1 THEN sha256('{\"title\":\"t\"}') END AS h FROM supplier), l AS (SELECT DISTINCT id, unnest(s) AS t FROM dc), e AS (SELECT * FROM l WHERE t IN (SELECT id FROM dc)), r(id, t) AS (SELECT id, t FROM e UNION SELECT r.id, e.t FROM r JOIN e ON e.id = r.t), cy AS (SELECT id FROM r WHERE id = t), fw(id) AS (SELECT DISTINCT id FROM r WHERE t IN (SELECT id FROM cy)), bw(id) AS (SELECT DISTINCT t FROM r WHERE id IN (SELECT id FROM cy)) SELECT 'duplicate' AS check, id::VARCHAR AS id FROM dc GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'changed', id::VARCHAR FROM dc WHERE h = 'wrong' UNION ALL SELECT DISTINCT 'dangling', id::VARCHAR FROM l WHERE t NOT IN (SELECT id FROM dc) UNION ALL SELECT DISTINCT 'cycle', id::VARCHAR FROM cy UNION ALL SELECT DISTINCT 'cycle', fw.id::VARCHAR FROM fw JOIN bw USING (id) WHERE fw.id NOT IN (SELECT id FROM cy) UNION ALL SELECT 'budget', n::VARCHAR FROM (SELECT count(*) AS n FROM dc) WHERE n > 100")
def _(spark, d):
    k = F.col("s_suppkey")
    half = F.floor(k / 2).cast("long")
    links = F.array((half + 1).cast("string"), F.when(k % 8 == 0, half - 3).otherwise(1_000_000).cast("string"))
    stamp = F.when(k % 9 == 0, "wrong").when(k % 9 == 1, F.sha2(F.lit('{"title":"t"}'), 256))
    return decisions.integrity(W.table(spark, d, "supplier").select(half.cast("string").alias("id"), links.alias("supersedes"), F.lit("accepted").alias("status"), stamp.alias("body_hash"), F.lit("t").alias("title")))
