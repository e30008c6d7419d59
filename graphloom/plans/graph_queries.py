"""Queries on history, traversal and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, rollup, temporal, traverse
from . import workload as W
from .registry import query

_PAIRS = f"""WITH {W.CHANGES},
c AS (SELECT DISTINCT sha, path FROM changes),
n AS (SELECT sha FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
k AS (SELECT c.* FROM c JOIN n USING (sha)),
pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS support FROM k x JOIN k y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 3),
counts AS (SELECT path, count(DISTINCT sha) AS change_count FROM changes GROUP BY 1)"""


@query("tmp04_co_changes", _PAIRS + " SELECT a, b, support FROM pairs")
def _(spark, d):
    return temporal.co_changes(W.changes(spark, d))


@query("cochange_topk", _PAIRS + """, r AS (SELECT path, other, support, support / change_count::DOUBLE AS confidence FROM (SELECT a AS path, b AS other, support FROM pairs UNION ALL SELECT b, a, support FROM pairs) JOIN counts USING (path)),
q AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, support DESC, other) AS place FROM r)
SELECT path, other, support, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, place FROM q WHERE place <= 20""")
def cochange_topk(spark, d):
    c = W.changes(spark, d)
    rows = temporal.partners(temporal.co_changes(c), temporal.churn(c))
    return rows.withColumn("confidence", F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6).withColumn("place", F.col("place").cast("long"))


@query("tmp02_churn", f"WITH {W.CHANGES} SELECT path, count(DISTINCT sha) AS change_count, max(day)::VARCHAR AS last_changed FROM changes GROUP BY 1")
def _(spark, d):
    return temporal.churn(W.changes(spark, d)).withColumn("last_changed", F.col("last_changed").cast("string"))


@query("tmp03_owners", f"""WITH {W.CHANGES}, c AS (SELECT path, author, count(DISTINCT sha) AS commits FROM changes GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, author) AS place FROM c) SELECT path, author, commits, place FROM r WHERE place <= 5""")
def _(spark, d):
    return temporal.owners(W.changes(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("tmp06_lookup", f"WITH {W.CHANGES}, c AS (SELECT path, count(DISTINCT sha) AS change_count, max(day)::VARCHAR AS last_changed FROM changes GROUP BY 1) SELECT p_partkey AS path, change_count, last_changed, CASE WHEN change_count IS NULL THEN 'no history in the window' WHEN change_count >= 40 THEN 'changes often' END AS note FROM part LEFT JOIN c ON p_partkey = path")
def _(spark, d):
    c = temporal.churn(W.changes(spark, d)).withColumn("last_changed", F.col("last_changed").cast("string"))
    rows = W.table(spark, d, "part").select(F.col("p_partkey").alias("path")).join(c, "path", "left")
    return rows.withColumn("note", F.when(F.col("change_count").isNull(), "no history in the window").when(F.col("change_count") >= 40, "changes often"))


@query("tmp07_window", """SELECT sha, day::VARCHAR AS day FROM (SELECT o_orderkey AS sha, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS parents FROM orders)
WHERE day >= DATE '1997-06-01' AND parents < 2 ORDER BY day DESC, sha LIMIT 1000""")
def _(spark, d):
    o = W.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(1).alias("parents"))
    return temporal.recent(o, "1998-06-01").select("sha", F.col("day").cast("string").alias("day"))


@query("agg14_coupling", _PAIRS + """, p AS (SELECT p_partkey AS path, p_brand AS cluster FROM part),
r AS (SELECT path, other, support, support / change_count::DOUBLE AS confidence FROM (SELECT a AS path, b AS other, support FROM pairs UNION ALL SELECT b, a, support FROM pairs) JOIN counts USING (path)),
t AS (SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, support, confidence FROM r JOIN p x ON r.path = x.path JOIN p y ON r.other = y.path WHERE x.cluster <> y.cluster),
z AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY support DESC, confidence DESC) AS n FROM t)
SELECT a, b, support, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence FROM z WHERE n = 1""")
def _(spark, d):
    c = W.changes(spark, d)
    pairs = temporal.partners(temporal.co_changes(c), temporal.churn(c), 1 << 30)
    place = W.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("cluster"))
    return temporal.coupling_links(pairs, place).withColumn("confidence", F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6)


_SEED = f"WITH RECURSIVE {W.EDGES}, seed AS (SELECT min(dst) AS id FROM ed)"


@query("trv01_callers", f"WITH {W.EDGES} SELECT dst, src, call_sites FROM ed WHERE dst = (SELECT min(dst) FROM ed)")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.callers(e, W.smallest_target(e)).select("dst", "src", "call_sites")


@query("trv02_callees", f"WITH {W.EDGES} SELECT src, dst, call_sites FROM ed WHERE src = (SELECT min(dst) FROM ed)")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.callees(e, W.smallest_target(e)).select("src", "dst", "call_sites")


@query("trv03_callees_2hop", f"WITH {W.EDGES} SELECT a.src AS source, b.dst AS id, count(DISTINCT a.dst) AS via FROM ed a JOIN ed b ON a.dst = b.src GROUP BY 1, 2")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.callees_at_two(e, e.select(F.col("src").alias("id")).distinct())


@query("trv04_profile", f"""WITH {W.EDGES}, s AS (SELECT dst AS target FROM ed UNION SELECT src FROM ed),
u AS (SELECT target, src AS id, row_number() OVER (PARTITION BY target ORDER BY src) AS r FROM ed JOIN s ON dst = target),
w AS (SELECT target, dst AS id, row_number() OVER (PARTITION BY target ORDER BY dst) AS r FROM ed JOIN s ON src = target),
t0 AS (SELECT DISTINCT w.target, ed.dst AS id FROM w JOIN ed ON w.id = ed.src),
t1 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS r FROM t0),
t AS (SELECT t1.* FROM t1 ANTI JOIN w USING (target, id) WHERE t1.r <= 26 AND id <> target),
x AS (SELECT 'up' AS side, 1 AS distance, * FROM u UNION ALL SELECT 'down', 1, * FROM w UNION ALL SELECT 'down', 2, * FROM t),
y AS (SELECT *, max(r) OVER (PARTITION BY side, distance, target) > 25 AS truncated FROM x) SELECT target, side, distance, id, truncated FROM y WHERE r <= 25""")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.profile(e, e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())


@query("trv05_impact_d2", _SEED + ", r(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT ed.src, depth + 1 FROM r JOIN ed ON ed.dst = r.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.impact(e, W.smallest_target(e), 2)


@query("trv05_impact_capped", f"""WITH {W.EDGES}, seed AS (SELECT min(dst) AS id FROM ed),
a1 AS (SELECT src AS id, row_number() OVER (ORDER BY src) AS place FROM ed WHERE dst = (SELECT id FROM seed) AND src <> (SELECT id FROM seed)),
b0 AS (SELECT src AS id, min(place) AS p FROM ed JOIN a1 ON dst = a1.id WHERE src NOT IN (SELECT id FROM a1) AND src <> (SELECT id FROM seed) GROUP BY 1),
b1 AS (SELECT id, row_number() OVER (ORDER BY p, id) + (SELECT count(*) FROM a1) AS place FROM b0),
c0 AS (SELECT src AS id, min(place) AS p FROM ed JOIN b1 ON dst = b1.id WHERE src NOT IN (SELECT id FROM a1) AND src NOT IN (SELECT id FROM b1) AND src <> (SELECT id FROM seed) AND (SELECT count(*) FROM a1) + (SELECT count(*) FROM b1) < 500 GROUP BY 1),
c1 AS (SELECT id, row_number() OVER (ORDER BY p, id) + (SELECT count(*) FROM a1) + (SELECT count(*) FROM b1) AS place FROM c0),
z AS (SELECT id, 1 AS depth, place FROM a1 UNION ALL SELECT id, 2, place FROM b1 UNION ALL SELECT id, 3, place FROM c1) SELECT id, depth, place FROM z WHERE place <= 500""")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.impact_capped(e, W.smallest_target(e), 3)


@query("trv05_impact_split", _SEED + """, r(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT ed.src, depth + 1 FROM r JOIN ed ON ed.dst = r.id WHERE depth < 2),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0), q AS (SELECT id, depth, CASE WHEN id % 4 = 0 THEN 'src/tests/' ELSE 'src/' END || p_brand || '.py' AS file_path FROM m JOIN part ON p_partkey = id)
SELECT id, depth, file_path, list_contains(string_split(lower(file_path), '/'), 'tests') AS is_test FROM q""")
def _(spark, d):
    e = W.edges(spark, d)
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 4 == 0, "src/tests/").otherwise("src/"), "p_brand", F.lit(".py")).alias("file_path"))
    return traverse.split_tests(traverse.impact(e, W.smallest_target(e), 2).join(p, "id"))


@query("trv06_impact_all", _SEED + ", r(id) AS (SELECT id FROM seed UNION SELECT ed.src FROM r JOIN ed ON ed.dst = r.id) SELECT count(*) AS n, sum(id) AS ids FROM r WHERE id <> (SELECT id FROM seed)")
def _(spark, d):
    e = W.edges(spark, d)
    return traverse.impact(e, W.smallest_target(e), None).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("trv07_neighborhood_d2", "WITH RECURSIVE " + W.TYPED + ", b AS (SELECT src AS x, dst AS y FROM te WHERE type IN ('CALLS', 'IMPORTS') UNION SELECT dst, src FROM te WHERE type IN ('CALLS', 'IMPORTS')), r(id, depth) AS (SELECT min(dst), 0 FROM ed UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, d):
    e = W.typed_edges(spark, d)
    return traverse.neighborhood(e, W.smallest_target(e), 2, ["CALLS", "IMPORTS"])


@query("trv08_neighbors", f"WITH {W.EDGES} SELECT DISTINCT a AS id, b AS neighbor FROM (SELECT src AS a, dst AS b FROM ed UNION ALL SELECT dst, src FROM ed) WHERE a <> b")
def _(spark, d):
    return traverse.both_ways(W.edges(spark, d)).select(F.col("a").alias("id"), F.col("b").alias("neighbor")).distinct()


_RANKED = f"""WITH {W.TYPED}, s AS (SELECT src, dst, CASE type WHEN 'CALLS' THEN 5 WHEN 'INHERITS' THEN 4 WHEN 'IMPLEMENTS' THEN 4 WHEN 'INSTANTIATES' THEN 3 ELSE 2 END * 100 + CASE resolution WHEN 'exact' THEN 2 WHEN 'name_match' THEN 1 ELSE 0 END * 10 + confidence AS score FROM te WHERE src <> dst),
b AS (SELECT id, neighbor, max(score) AS score FROM (SELECT src AS id, dst AS neighbor, score FROM s UNION ALL SELECT dst, src, score FROM s) GROUP BY 1, 2),
p AS (SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS x, (p_partkey % 89)::DOUBLE AS y, p_size::DOUBLE AS z FROM part),
q AS (SELECT b.id, neighbor, score, (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z) AS distance FROM b JOIN p a ON a.id = b.id JOIN p c ON c.id = neighbor),
ring AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, distance, neighbor) AS place FROM q)"""


def _ring(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).cast("double").alias("x"), (F.col("p_partkey") % 89).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    return traverse.ranked_neighbors(W.typed_edges(spark, d), p).withColumn("place", F.col("place").cast("long"))


@query("trv09_ranked_neighbors", _RANKED + " SELECT id, neighbor, floor(score * 100 + 0.5) / 100 AS score, distance, place FROM ring")
def _(spark, d):
    return _ring(spark, d).withColumn("score", F.floor(F.col("score") * 100 + 0.5) / 100)


@query("trv10_ring_step", _RANKED + ", n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ring) SELECT a.id, a.neighbor, b.neighbor AS next FROM n a JOIN ring b ON a.id = b.id AND b.place = (a.place % a.n) + 1")
def _(spark, d):
    return traverse.ring_step(_ring(spark, d))


_DASH = "\u2014"


@query("trv11_prose", f"""WITH {W.TYPED}, n AS (SELECT p_partkey AS id, 'r' || p_partkey % 2 AS repo, p_name AS name, p_brand AS path, p_size AS line, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS summary FROM part),
w AS (SELECT t.id AS target, side, far, n.name || CASE WHEN n.summary IS NULL THEN ' (no summary yet {_DASH} read and enrich)' ELSE ' (' || n.summary || ')' END || CASE WHEN n.repo <> t.repo THEN ' [repo: ' || n.repo || ']' ELSE '' END || CASE WHEN side = 'down' AND resolution <> 'exact' THEN ' [' || resolution || ', confidence ' || confidence || ' {_DASH} verify]' ELSE '' END AS x
FROM (SELECT dst AS target, 'up' AS side, src AS far, resolution, confidence FROM te UNION ALL SELECT src, 'down', dst, resolution, confidence FROM te) JOIN n t ON t.id = target JOIN n ON n.id = far),
g AS (SELECT target, string_agg(x, ', ' ORDER BY far) FILTER (side = 'up') AS up, string_agg(x, '; ' ORDER BY far) FILTER (side = 'down') AS down FROM w GROUP BY 1)
SELECT id, n.name || ' (' || path || ':' || line || '-' || (line + 9) || ')' || CASE WHEN summary IS NULL THEN ' {_DASH} no summary yet (read and enrich).' ELSE ': ' || summary || '.' END || coalesce(' Called by ' || up || '.', '') || coalesce(' Calls ' || down || '.', '') AS text FROM n LEFT JOIN g ON target = id""")
def _(spark, d):
    k = F.col("p_partkey")
    n = W.table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("repo_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"), F.when(k % 3 == 0, F.col("p_type")).alias("summary"))
    e = W.typed_edges(spark, d).select("src", "dst", "resolution", "confidence")
    ends = e.select(F.col("dst").alias("target"), F.lit("up").alias("side"), F.col("src").alias("id"), "resolution", "confidence").union(e.select("src", F.lit("down"), "dst", "resolution", "confidence"))
    return traverse.prose(n, ends.join(n.select("id", "repo_id", "name", "summary"), "id"))


@query("agg01_degree", f"WITH {W.EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1")
def _(spark, d):
    return rollup.degree(W.edges(spark, d))


@query("agg02_degrees", f"WITH {W.EDGES} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM ed UNION ALL SELECT dst, 1, 0 FROM ed) GROUP BY 1")
def _(spark, d):
    return rollup.degrees(W.edges(spark, d))


@query("agg03_min_confidence", f"WITH {W.TYPED}, m AS (SELECT id, min(confidence) AS c FROM (SELECT src AS id, confidence FROM te UNION ALL SELECT dst, confidence FROM te) GROUP BY 1) SELECT p_partkey AS id, coalesce(c, 1.0)::DOUBLE AS confidence FROM part LEFT JOIN m ON id = p_partkey")
def _(spark, d):
    return rollup.least_confidence(W.parts(spark, d), W.typed_edges(spark, d))


def _chain():
    parts = F.split(F.concat_ws("/", "host", F.regexp_replace("path", "/$", "")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


_CHAIN = f"WITH {W.PAGES}, s AS (SELECT id, string_split(host || '/' || regexp_replace(path, '/$', ''), '/') AS p FROM pp), ch AS (SELECT id, unnest(range(1, len(p) + 1)) AS n, p FROM s), an AS (SELECT id, (n - 1)::INT AS depth, array_to_string(p[1:n], '/') AS ancestor, CASE WHEN n > 1 THEN array_to_string(p[1:n - 1], '/') END AS parent FROM ch)"


@query("agg04_cluster_tree", _CHAIN + " SELECT ancestor AS key, parent, depth, count(*) AS leaves FROM an GROUP BY 1, 2, 3")
def _(spark, d):
    return rollup.cluster_tree(W.page_paths(spark, d), _chain())


@query("agg05_preorder", _CHAIN + " SELECT ancestor AS key, depth, count(*) AS leaves FROM an GROUP BY 1, 2 ORDER BY string_split(ancestor, '/')")
def _(spark, d):
    return rollup.flattened(rollup.cluster_tree(W.page_paths(spark, d), _chain()).select("key", "depth", "leaves"), F.split("key", "/"))


@query("agg06_ancestors", _CHAIN + " SELECT id, ancestor, depth FROM an")
def _(spark, d):
    return rollup.ancestors(W.page_paths(spark, d), _chain())


@query("agg07_descendants", _CHAIN + " SELECT ancestor, count(*) AS descendants FROM an GROUP BY 1")
def _(spark, d):
    return rollup.descendant_counts(W.page_paths(spark, d), _chain())


@query("agg07_region_rollup", """WITH l AS (SELECT r_name, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT key, count(*) AS customers FROM (SELECT r_name AS key FROM l UNION ALL SELECT r_name || '/' || n_name FROM l) GROUP BY 1""")
def _(spark, d):
    n = W.table(spark, d, "nation").join(F.broadcast(W.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = W.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.explode(F.array("r_name", F.concat_ws("/", "r_name", "n_name"))).alias("key"), "customers").groupBy("key").agg(F.sum("customers").alias("customers"))


@query("agg08_dominant_language", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS p FROM c) SELECT source, lang, n FROM r WHERE p = 1")
def _(spark, d):
    return rollup.dominant(W.table(spark, d, "documents"), "source", "lang")


_SHOWN = _CHAIN + ", ex AS (SELECT DISTINCT ancestor AS key FROM an WHERE depth = 0), ks AS (SELECT DISTINCT ancestor AS key, depth FROM an), vis AS (SELECT key FROM ks WHERE depth = 1)"


def _shown(spark, d):
    pages = W.page_paths(spark, d)
    tree = rollup.cluster_tree(pages, _chain()).select("key", "depth")
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda n: F.concat_ws("/", F.slice(F.split("key", "/"), 1, n)))
    return pages, rollup.visible(tree, chain, tree.where("depth = 0").select("key").distinct())


@query("agg10_visible", _SHOWN + " SELECT key, depth FROM ks WHERE key IN (SELECT key FROM vis)")
def _(spark, d):
    return _shown(spark, d)[1]


@query("agg11_representatives", _SHOWN + " SELECT id, max(ancestor) AS rep FROM an WHERE depth = 1 GROUP BY 1")
def _(spark, d):
    pages, shown = _shown(spark, d)
    return rollup.representatives(pages, _chain(), shown)


@query("agg12_bundles", """WITH r AS (SELECT c_nationkey AS a, s_nationkey + 100 AS b, o_orderpriority AS type, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'name_match' ELSE 'ambiguous' END AS resolution
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
t AS (SELECT a, b, type, count(*) AS n, max(CASE resolution WHEN 'exact' THEN 2 WHEN 'name_match' THEN 1 ELSE 0 END) AS best FROM r GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, type) AS p, sum(n) OVER (PARTITION BY a, b) AS c, max(best) OVER (PARTITION BY a, b) AS m FROM t)
SELECT a, b, c::BIGINT AS count, type AS dominant_type, ['ambiguous', 'name_match', 'exact'][m + 1] AS best_resolution FROM q WHERE p = 1 ORDER BY c DESC, a, b LIMIT 2500""")
def _(spark, d):
    t = lambda n: W.table(spark, d, n)
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    how = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "name_match").otherwise("ambiguous")
    return rollup.bundle_pairs(rows.select(F.col("c_nationkey").alias("a"), (F.col("s_nationkey") + 100).alias("b"), F.col("o_orderpriority").alias("type"), how.alias("resolution")))


@query("agg13_attenuation", "WITH b AS (SELECT sqrt(pow(max(p_size) - min(p_size), 2) + pow(max(p_partkey % 97) - min(p_partkey % 97), 2)) AS g FROM part), s AS (SELECT p_partkey AS id, p_size / g AS h FROM part, b) SELECT id, floor(CASE WHEN h <= 0.15 THEN 1.0 WHEN h >= 0.6 THEN 0.25 ELSE 1.0 - (h - 0.15) / (0.6 - 0.15) * 0.75 END * 1e6 + 0.5) / 1e6 AS weight FROM s")
def _(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))
    diagonal = rollup.bounds(p).first()["diagonal"]
    return p.select("id", (F.floor(rollup.attenuation(F.col("x"), F.lit(diagonal)) * 1e6 + 0.5) / 1e6).alias("weight"))


@query("rnk11_tour", f"""WITH {W.TYPED}, k AS (SELECT p_partkey AS id, ['Function', 'Class', 'Interface', 'Variable'][p_partkey % 4 + 1] AS kind, string_split(replace(p_type, ' ', '/') || '/' || p_brand, '/') AS p FROM part),
a AS (SELECT array_to_string(p[1:n], '/') AS k FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM k)),
m AS (SELECT 'module' AS stop, k AS key, count(*) AS score FROM a GROUP BY k ORDER BY score DESC, k LIMIT 3),
g AS (SELECT id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM te UNION ALL SELECT dst, 1, 0 FROM te) GROUP BY 1),
h AS (SELECT 'hub' AS stop, id, i + o AS score FROM g ORDER BY i + o DESC, id LIMIT 1),
t AS (SELECT 'type' AS stop, id, count(*) AS score FROM (SELECT src AS id FROM te WHERE type IN ('INHERITS', 'IMPLEMENTS') UNION ALL SELECT dst FROM te WHERE type IN ('INHERITS', 'IMPLEMENTS')) JOIN k USING (id) WHERE kind IN ('Class', 'Interface') GROUP BY id ORDER BY 3 DESC, id LIMIT 1),
e AS (SELECT 'entry' AS stop, id, o FROM g JOIN k USING (id) WHERE kind = 'Function' AND o > 0 AND id NOT IN (SELECT id FROM h) ORDER BY o DESC, id LIMIT 1)
SELECT * FROM m UNION ALL SELECT stop, id::VARCHAR, score FROM h UNION ALL SELECT stop, id::VARCHAR, score FROM t UNION ALL SELECT stop, id::VARCHAR, o FROM e""")
def _(spark, d):
    kind = F.get(F.array(*map(F.lit, ("Function", "Class", "Interface", "Variable"))), (F.col("id") % 4).cast("int"))
    p = W.parts(spark, d).select("id", kind.alias("kind"), F.split("file_path", "/").alias("p"))
    chain = F.concat(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat_ws("/", F.slice("p", 1, n))), F.array(F.col("id").cast("string")))
    return rollup.tour(p.withColumn("id", F.col("id").cast("string")), W.typed_edges(spark, d), chain)


@query("agg11_lod", "WITH r AS (SELECT p_partkey AS id, p_partkey % 3 <> 0 AS s, p_brand AS f, CASE WHEN p_partkey % 3 <> 0 THEN 's' || p_partkey ELSE p_type END AS rep FROM part) SELECT id, CASE WHEN s AND f LIKE '%1' AND f NOT LIKE 'Brand#2%' THEN f ELSE rep END AS rep FROM r")
def _(spark, d):
    k = F.col("p_partkey")
    reps = W.table(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.col("p_type")).alias("rep"), (k % 3 != 0).alias("is_symbol"), F.col("p_brand").alias("file"))
    files = reps.select("file").distinct()
    return rollup.lod_representatives(reps, files.where("file like '%1'").select(F.col("file").alias("key")), files.where("file like 'Brand#2%'"))


@query("geo05_allocation", f"WITH {W.EDGES}, o AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS place, call_sites AS c FROM ed), p AS (SELECT place, least(4, floor(log2(1 + c) + 1e-9)::INT + 1) AS w FROM o WHERE c >= 2), q AS (SELECT place, w, sum(w) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS u FROM p), a AS (SELECT place, greatest(0, least(w, 3000 - u + w))::INT AS particles FROM q), n AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS k, count(*) OVER () AS m FROM o WHERE c < 2), l AS (SELECT 3000 - coalesce(sum(particles), 0) AS l FROM a) SELECT place, particles FROM a WHERE particles > 0 UNION ALL SELECT place, 1 FROM n, l WHERE l > 0 AND k % (CASE WHEN m > l THEN ceil(m::DOUBLE / l)::BIGINT ELSE 1 END) = 0")
def _(spark, d):
    e = W.edges(spark, d).orderBy("src", "dst")
    ordered = traverse.cut_lineage(e.withColumn("at", F.monotonically_increasing_id()))
    # places without gaps: how many rows each part holds, then the place within it
    starts, before = [], 0
    for r in sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    known = spark.createDataFrame(starts, "part long, start long")
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(known), "part").select((F.col("start") + F.expr("at & 8589934591")).alias("place"), F.col("call_sites").alias("count"), (F.col("call_sites") >= 2).alias("priority"))
    return geometry.allocate_particles(placed).select("place", F.col("particles").cast("int").alias("particles"))


@query("geo06_minimap", "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y FROM part), b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p), s AS (SELECT *, least(188 / greatest(b - a, 1e-6), 88 / greatest(d - c, 1e-6)) AS s FROM b) SELECT id, floor((x * s + (100 - (a + b) / 2 * s)) * 1e6 + 0.5) / 1e6 AS px, floor((100 - (y * s + (50 - (c + d) / 2 * s))) * 1e6 + 0.5) / 1e6 AS py FROM p, s")
def _(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    return geometry.to_minimap(p, 200, 100).select("id", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("px", "py")))


@query("flt10_filter_edges", f"WITH {W.TYPED} SELECT src, dst, type, resolution FROM te WHERE confidence >= 0.04 AND type NOT IN ('IMPORTS')")
def _(spark, d):
    return rollup.filter_edges(W.typed_edges(spark, d), ["IMPORTS"], 0.04).select("src", "dst", "type", "resolution")


@query("flt10_audit_edges", f"WITH {W.TYPED} SELECT src, dst, type, resolution FROM te WHERE resolution <> 'exact'")
def _(spark, d):
    return rollup.filter_edges(W.typed_edges(spark, d), ["IMPORTS"], 0.9, audit=True).select("src", "dst", "type", "resolution")


@query("flt12_bucketed", f"WITH {W.TYPED}, i AS (SELECT *, 'rs1:r' || src % 3 || ':func:' || src AS a, CASE WHEN dst % 7 = 0 THEN 'x:' ELSE 'rs1:r' || dst % 3 || ':func:' END || dst AS b, CASE WHEN src % 2 = 0 THEN resolution END AS r FROM te) SELECT a AS src, b AS dst, type, coalesce(r, CASE WHEN confidence >= 0.95 THEN 'exact' WHEN confidence >= 0.5 THEN 'name_match' ELSE 'ambiguous' END) AS bucket, starts_with(b, 'rs1:') AND src % 3 <> dst % 3 AS cross_repo FROM i WHERE type <> 'IMPORTS'")
def _(spark, d):
    from ..functions.paths import bucket_confidence, crosses_repositories

    text = lambda c: F.col(c).cast("string")
    a = F.concat(F.lit("rs1:r"), (F.col("src") % 3).cast("string"), F.lit(":func:"), text("src"))
    b = F.concat(F.when(F.col("dst") % 7 == 0, "x:").otherwise(F.concat(F.lit("rs1:r"), (F.col("dst") % 3).cast("string"), F.lit(":func:"))), text("dst"))
    e = rollup.filter_edges(W.typed_edges(spark, d), ["IMPORTS"], 0.0)
    return e.select(a.alias("src"), b.alias("dst"), "type", bucket_confidence(F.when(F.col("src") % 2 == 0, F.col("resolution")), F.col("confidence")).alias("bucket"), crosses_repositories(a, b).alias("cross_repo"))


@query("geo03_bundle_path", """WITH c AS (SELECT p_partkey AS id, string_split(p_type, ' ') AS p FROM part), k AS (SELECT id, list_transform(range(1, len(p) + 1), lambda n: array_to_string(p[1:n], '/')) AS c FROM c),
q AS (SELECT a.id, a.c AS x, b.c AS y, len(list_filter(a.c, lambda v: list_contains(b.c, v))) AS s FROM k a JOIN k b ON b.id = a.id + 1)
SELECT id, array_to_string(list_concat(list_concat(list_reverse(x[s + 1:]), CASE WHEN s > 0 THEN [x[s]] ELSE [] END), y[s + 1:]), ' ') AS path FROM q""")
def _(spark, d):
    s = F.split("p_type", " ")
    k = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.concat_ws("/", F.slice(s, 1, n))).alias("c"))
    b = k.select((F.col("id") - 1).alias("id"), F.col("c").alias("y"))
    return k.join(b, "id").select("id", F.concat_ws(" ", geometry.bundle_path(F.col("c"), F.col("y"))).alias("path"))


@query("geo05_particles", f"WITH {W.EDGES} SELECT src, dst, least(4, floor(log2(1 + call_sites) + 1e-9)::INT + 1) AS particles FROM ed")
def _(spark, d):
    return W.edges(spark, d).select("src", "dst", geometry.particles(F.col("call_sites")).alias("particles"))


@query("geo06_bounds", "SELECT min(p_size)::DOUBLE AS min_x, max(p_size)::DOUBLE AS max_x, min(p_partkey % 97)::DOUBLE AS min_y, max(p_partkey % 97)::DOUBLE AS max_y, arg_min(p_partkey, (pow(p_size - 10, 2) + pow(p_partkey % 97 - 20, 2), p_partkey)) AS nearest FROM part")
def _(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))
    near = geometry.nearest_point(p, 10.0, 20.0, 0.0).first()["id"]
    return rollup.bounds(p).select("min_x", "max_x", "min_y", "max_y", F.lit(near).cast("long").alias("nearest"))


@query("geo01_spanning_tree")
def _(spark, d):
    p = W.table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("place"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return geometry.spanning_tree(p)


@query("scl04_positions")
def _(spark, d):
    return geometry.positions(W.parts(spark, d))
