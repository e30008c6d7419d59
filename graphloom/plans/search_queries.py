"""Queries on search, ranking, text functions, guards and telemetry."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import guard, search, sessions
from . import workload as W
from .registry import query

_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda t: len(t) > 1)"


def _bm25_sql(corpus: str, fields: dict[str, float], tokens: list[str], limit: int) -> str:
    f = list(fields)
    sql = f"WITH {corpus}, t AS (SELECT id, " + ", ".join(_TOKENS.format(c) + f" AS {c}" for c in f) + " FROM corpus), "
    sql += "s AS (SELECT id, " + ", ".join(f"len({c}) AS n_{c}" for c in f) + ", " + ", ".join(f"len(list_filter({c}, lambda t: t = '{q}')) AS tf_{i}_{c}" for c in f for i, q in enumerate(tokens)) + " FROM t), "
    sql += "g AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"sum(n_{c})::DOUBLE / count(*) AS m_{c}" for c in f) + ", " + ", ".join(f"count(*) FILTER ({' OR '.join(f'tf_{i}_{c} > 0' for c in f)})::DOUBLE AS df_{i}" for i in range(len(tokens))) + " FROM s), "
    parts = [f"ln(1 + (n - df_{i} + 0.5) / (df_{i} + 0.5)) * (0.0 + " + " + ".join(f"{w!r} * (tf_{i}_{c} * 2.2) / (tf_{i}_{c} + 1.2 * (1 - 0.75 + 0.75 * (n_{c} / CASE WHEN m_{c} > 0 THEN m_{c} ELSE 1 END)))" for c, w in fields.items()) + ")" for i in range(len(tokens))]
    hit = " OR ".join(f"tf_{i}_{c} > 0" for i in range(len(tokens)) for c in f)
    return sql + f"r AS (SELECT id, floor(({' + '.join(parts)})::DOUBLE * 1e6 + 0.5) / 1e6 AS score FROM s, g WHERE {hit}) SELECT id, score FROM r ORDER BY score DESC, id LIMIT {limit}"


_PART_FIELDS = {"qualified_name": 10.0, "name": 8.0, "summary": 4.0, "signature": 2.0, "file_path": 1.0}
_PART_QUERY = "copper brassPlate Brand#21"


@query("rnk02_bm25f_parts", _bm25_sql(W.PARTS + ", corpus AS (SELECT * FROM parts)", _PART_FIELDS, search.query_tokens(_PART_QUERY), 125))
def _(spark, d):
    return search.bm25f(W.parts(spark, d), _PART_QUERY, 125).select("id", "score")


@query("rnk02_bm25f_documents", _bm25_sql("corpus AS (SELECT doc_id AS id, text AS summary, lang AS name FROM documents)", {"name": 8.0, "summary": 4.0}, ["the", "und", "les", "token"], 200))
def _(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), F.col("lang").alias("name"))
    return search.bm25f(docs, "the und les token", 200, {"name": 8.0, "summary": 4.0}).select("id", "score")


@query("rnk01_tokenize", "SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, " + _TOKENS.format("text") + " AS t FROM documents)")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.concat_ws(" ", "t").alias("tokens"))


_COSINE = "c AS (SELECT vec_id AS id, floor(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) * 1e6 + 0.5) / 1e6 AS similarity FROM embeddings)"


def _query_vector(spark, d):
    return list(W.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def _vectors(spark, d):
    return W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("rnk03_cosine", f"WITH {_COSINE} SELECT id, similarity FROM c ORDER BY similarity DESC, id LIMIT 50")
def _(spark, d):
    return search.nearest(_vectors(spark, d), _query_vector(spark, d), 50)


@query("rnk04_rrf", f"""WITH {_COSINE}, a AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM c ORDER BY rank LIMIT 100),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 100)
SELECT id, floor((coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0)) * 1e9 + 0.5) / 1e9 AS score FROM a FULL JOIN b USING (id)""")
def _(spark, d):
    a = search.ranked(search.nearest(_vectors(spark, d), _query_vector(spark, d), 100), F.desc("similarity"), F.asc("id"))
    p = W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice").orderBy(F.desc("p_retailprice"), "id").limit(100)
    b = search.ranked(p, F.desc("p_retailprice"), F.asc("id"))
    return search.fuse(a, b).select("id", (F.floor(F.col("score") * 1e9 + 0.5) / 1e9).alias("score"))


_HYBRID = _bm25_sql(W.PARTS + ", corpus AS (SELECT * FROM parts)", _PART_FIELDS, search.query_tokens(_PART_QUERY), 125)


@query("rnk05_hybrid", f"""WITH {_COSINE}, lx AS ({_HYBRID}), a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lx), b AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM c)
SELECT id, floor((coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0)) * 1e9 + 0.5) / 1e9 AS score, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN a.rank IS NOT NULL THEN 'lexical' ELSE 'vector' END AS via FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 25""")
def _(spark, d):
    return search.hybrid(W.parts(spark, d), _vectors(spark, d), _PART_QUERY, _query_vector(spark, d))


def _quality(token: str, value: str) -> str:
    v = f"lower({value})"
    return f"CASE WHEN {v} = '{token}' THEN 1.0 WHEN starts_with({v}, '{token}') THEN 0.7 WHEN NOT contains({v}, '{token}') THEN 0.0 WHEN regexp_matches({v}[instr({v}, '{token}') - 1], '[a-z0-9]') THEN 0.25 ELSE 0.5 END"


_BEST = {t: "greatest(" + ", ".join(f"{_quality(t, f)} * {w!r}" for f, w in search.VIEWER_WEIGHTS.items()) + ")" for t in ("medium", "brand#2")}


@query("rnk07_weighted_search", f"WITH {W.PARTS}, s AS (SELECT id, name, ({_BEST['medium']})::DOUBLE AS a, ({_BEST['brand#2']})::DOUBLE AS b FROM parts) SELECT id, name, floor((a + b) * 1e6 + 0.5) / 1e6 AS score FROM s WHERE a > 0 AND b > 0 ORDER BY score DESC, name, id LIMIT 50")
def _(spark, d):
    return search.weighted_search(W.parts(spark, d), "Medium BRAND#2", 50).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


_KINDS = ("Function", "Class", "Interface", "Enum", "Variable", "File", "Directory", "Repository", "Other")


@query("rnk08_bucket", f"WITH k AS (SELECT p_partkey AS id, {list(_KINDS)}[p_partkey % 9 + 1] AS kind FROM part) SELECT id, kind, CASE WHEN kind IN ('Function', 'Class', 'Interface', 'Enum', 'Variable') THEN 'symbols' WHEN kind = 'File' THEN 'files' ELSE 'directories' END AS bucket FROM k")
def _(spark, d):
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 9).cast("int"))
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), paths.search_bucket(kind).alias("bucket"))


@query("rnk05_kinds", f"""WITH {_COSINE}, lx AS ({_bm25_sql(W.PARTS + ", corpus AS (SELECT id, name, qualified_name, summary, signature, file_path FROM parts WHERE id % 3 = 1 UNION ALL SELECT 1000000 + s_suppkey, 'copper ' || s_name, '', 'brass plate', '', '' FROM supplier)", _PART_FIELDS, search.query_tokens(_PART_QUERY), 125)}), a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lx), b AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM c WHERE id % 3 = 1 AND id IN (SELECT p_partkey FROM part))
SELECT id, floor((coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0)) * 1e9 + 0.5) / 1e9 AS score, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN a.rank IS NOT NULL THEN 'lexical' ELSE 'vector' END AS via FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 25""")
def _(spark, d):
    parts = W.parts(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 1, "Function").otherwise("File"))
    made = W.table(spark, d, "supplier").select((F.lit(1_000_000) + F.col("s_suppkey")).alias("id"), F.concat(F.lit("copper "), "s_name").alias("name"), F.lit("brass plate").alias("summary"))
    return search.hybrid(parts, _vectors(spark, d), _PART_QUERY, _query_vector(spark, d), kinds=["Function", "Decision"], decisions=made)


@query("rnk09_precision_recall", """WITH r AS (SELECT DISTINCT lang AS task, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), f AS (SELECT DISTINCT lang AS task, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 800),
c AS (SELECT task, count(*) FILTER (r.id IS NOT NULL) AS nr, count(*) FILTER (f.id IS NOT NULL) AS nf, count(*) FILTER (r.id IS NOT NULL AND f.id IS NOT NULL) AS hit FROM r FULL JOIN f USING (task, id) GROUP BY 1),
p AS (SELECT task, CASE WHEN nf > 0 THEN hit / nf::DOUBLE WHEN nr = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN nr > 0 THEN hit / nr::DOUBLE ELSE 1.0 END AS recall FROM c)
SELECT task, floor(precision * 1e6 + 0.5) / 1e6 AS precision, floor(recall * 1e6 + 0.5) / 1e6 AS recall, floor(CASE WHEN precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0.0 END * 1e6 + 0.5) / 1e6 AS f FROM p""")
def _(spark, d):
    rows = W.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(W.table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("task"), F.col("doc_id").alias("id"), "quality", "n_chars")
    out = search.precision_recall(rows.where("quality = 1").select("task", "id"), rows.where("n_chars >= 800").select("task", "id"))
    return out.select("task", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("precision", "recall", "f")))


@query("rnk10_tightest", """WITH i AS (SELECT p_partkey AS id, p_size AS lo, p_size + p_partkey % 60 AS hi, p_brand AS key FROM part), q AS (SELECT event_id AS point, value::INT % 100 AS pos, 'Brand#' || (1 + user_id % 5) || (1 + event_id % 5) AS key FROM events),
h AS (SELECT point, id, row_number() OVER (PARTITION BY point ORDER BY hi - lo, id) AS n FROM q JOIN i ON q.key = i.key AND pos BETWEEN lo AND hi) SELECT point, id AS interval FROM h WHERE n = 1""")
def _(spark, d):
    i = W.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 60).alias("hi"))
    at = F.bround("value", 0).cast("int") % 100
    e = W.table(spark, d, "events").select(F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 5).cast("string"), (1 + F.col("event_id") % 5).cast("string")).alias("key"), F.col("event_id").alias("point"), at.cast("long").alias("at"))
    return search.tightest(e, i, 25)


@query("rnk06_stale_embeddings", "WITH d AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS doc_hash FROM documents), k AS (SELECT id, CASE WHEN id % 3 = 0 THEN doc_hash ELSE 'old' END AS known FROM d WHERE id % 2 = 0) SELECT id, doc_hash FROM d LEFT JOIN k USING (id) WHERE known IS NULL OR known <> doc_hash")
def _(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("doc"))
    cache = docs.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.sha2("doc", 256)).otherwise("old").alias("doc_hash"))
    return search.stale_embeddings(docs, cache)


_BASE = "string_split(path, '/')[-1]"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"


@query("scl01_paths", f"WITH {W.PAGES} SELECT id, path, {_BASE} AS basename, {_DIR} AS dir, CASE WHEN {_DIR} = '' THEN '.' ELSE {_DIR} END AS parent, lower(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)) AS extension FROM pp")
def _(spark, d):
    p = F.col("path")
    return W.page_paths(spark, d).select("id", "path", paths.basename_of(p).alias("basename"), paths.dir_of(p).alias("dir"), paths.parent_of(p).alias("parent"), paths.extension_of(p).alias("extension"))


_NAMED = "n AS (SELECT p_partkey AS id, ['src', 'tests', 'docs', 'pkg/Foo.Tests', '__tests__', 'spec'][p_partkey % 6 + 1] || '/' || ['a', 'test_b', 'c_test', 'FooTest', 'd.spec', 'e_tests', 'Contest'][p_partkey % 7 + 1] || '.' || ['py', 'java', 'cs', 'md', 'json', 'rs', 'tsx', 'txt', 'lock', 'go', 'xyz'][p_partkey % 11 + 1] AS path FROM part)"


def _named(spark, d):
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))
    path = F.concat(at(("src", "tests", "docs", "pkg/Foo.Tests", "__tests__", "spec"), 6), F.lit("/"), at(("a", "test_b", "c_test", "FooTest", "d.spec", "e_tests", "Contest"), 7), F.lit("."), at(("py", "java", "cs", "md", "json", "rs", "tsx", "txt", "lock", "go", "xyz"), 11))
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))


_TEST = "(len(list_filter(string_split(lower(path), '/'), lambda s: s IN ('test', 'tests') OR ends_with(s, '.tests'))) > 0 OR starts_with(lower(b), 'test_') OR contains(lower(b), '_test.') OR contains(lower(b), '.test.') OR contains(lower(b), '.spec.') OR contains(lower(b), '.tests.') OR ends_with(b, 'Test.java') OR ends_with(b, 'Tests.java') OR ends_with(b, 'Tests.cs'))"


@query("ext22_classify", f"""WITH {_NAMED}, q AS (SELECT id, path, string_split(path, '/')[-1] AS b, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)) AS e FROM n)
SELECT id, path, CASE WHEN e = 'py' THEN 'python' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e = 'rs' THEN 'rust' WHEN e = 'go' THEN 'go' WHEN e = 'java' THEN 'java' WHEN e = 'cs' THEN 'csharp' WHEN e = 'md' THEN 'markdown' WHEN e = 'json' THEN 'json' ELSE 'unknown' END AS language,
CASE WHEN {_TEST} THEN 'testing' WHEN e IN ('md', 'txt') THEN 'docs' WHEN e IN ('json', 'lock') THEN 'config' ELSE 'doing' END AS role, {_TEST} AS is_test FROM q""")
def _(spark, d):
    p, e = F.col("path"), paths.extension_of(F.col("path"))
    return _named(spark, d).select("id", "path", paths.language_for(e).alias("language"), paths.role_for(p, e).alias("role"), paths.is_test_path(p).alias("is_test"))


@query("flt09_viewer_tests", f"WITH {_NAMED} SELECT id, path, regexp_matches(path, '(?i)(^|[/\\\\])test_[^/\\\\]*\\.[^/\\\\]+$') OR regexp_matches(path, '(?i)_tests?\\.[^/\\\\]+$') OR regexp_matches(path, '(?i)\\.(test|spec)\\.[^/\\\\]+$') OR regexp_matches(path, '(?i)[^/\\\\]+Tests?\\.(java|cs|kt|scala)$') OR len(list_filter(string_split(lower(path), '/'), lambda s: s IN ('test', 'tests', '__tests__', 'spec', 'specs', 'testing'))) > 0 AS is_test FROM n")
def _(spark, d):
    return _named(spark, d).select("id", "path", paths.is_test_path_viewer(F.col("path")).alias("is_test"))


@query("agg09_languages", "SELECT DISTINCT CASE lower(trim(lang)) WHEN 'c#' THEN 'csharp' WHEN 'ts' THEN 'typescript' ELSE lower(trim(lang)) END AS language FROM documents")
def _(spark, d):
    return W.table(spark, d, "documents").select(paths.normalize_language(F.col("lang")).alias("language")).distinct()


@query("ext19_variable_kind", "WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '_')) WHEN p_partkey % 3 = 1 THEN '__' ELSE p_name END AS name FROM part) SELECT id, CASE WHEN regexp_full_match(name, '[A-Z_]*[A-Z][A-Z_]*') THEN 'const' ELSE 'module' END AS kind FROM n")
def _(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(F.col("p_partkey") % 3 == 1, "__").otherwise(F.col("p_name"))
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), paths.module_var_kind(name).alias("kind"))


_SPOILED = "s AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || '```x```' WHEN 2 THEN '[' || text || '](http://x.y)' WHEN 3 THEN chr(1) || chr(7) || '  ' ELSE text || chr(2) END AS t FROM conversations)"
_TRIM = "trim(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))"


def _spoiled(spark, d):
    t, n = F.col("text"), F.col("turn") % 5
    return W.table(spark, d, "conversations").select("conv_id", "turn", F.when(n == 0, t).when(n == 1, F.concat(t, F.lit("```x```"))).when(n == 2, F.concat(F.lit("["), t, F.lit("](http://x.y)"))).when(n == 3, "\x01\x07  ").otherwise(F.concat(t, F.lit("\x02"))).alias("t"))


@query("scl07_sanitize", f"WITH {_SPOILED}, v AS (SELECT conv_id, turn, {_TRIM} AS v FROM s), e AS (SELECT *, CASE WHEN length(v) = 0 THEN 'EMPTY' WHEN length(v) > 1000 THEN 'TOO_LONG' WHEN contains(v, '```') THEN 'HAS_FENCE' WHEN regexp_matches(v, '\\[[^\\]]*\\]\\([^)]*\\)') THEN 'HAS_LINK' END AS error FROM v) SELECT conv_id, turn, error IS NULL AS ok, CASE WHEN error IS NULL THEN v END AS value, error FROM e")
def _(spark, d):
    return _spoiled(spark, d).select("conv_id", "turn", text.sanitize(F.col("t")).alias("r")).select("conv_id", "turn", "r.*")


@query("scl08_neutralize", f"WITH {_SPOILED} SELECT conv_id, turn, nullif(trim(regexp_replace(replace(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '```', ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), ' ' || chr(10) || chr(9) || chr(13)), '') AS value FROM s")
def _(spark, d):
    return _spoiled(spark, d).select("conv_id", "turn", text.neutralize(F.col("t")).alias("value"))


@query("dec11_mint_ids", "WITH b AS (SELECT p_partkey AS seq, p_name AS title, p_brand AS body, 'adr:2024-01-01-' || regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS base FROM part), tk AS (SELECT DISTINCT base AS id FROM b WHERE seq % 10 = 0 UNION SELECT DISTINCT base || '-' || substr(sha256(body), 1, 6) FROM b WHERE seq % 15 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) = 1 AND base NOT IN (SELECT id FROM tk) AS plain, base || '-' || substr(sha256(body), 1, 6) AS salted FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY plain, salted ORDER BY seq) - 1 + (salted IN (SELECT id FROM tk))::INT AS k FROM p) SELECT seq, CASE WHEN plain THEN base WHEN k > 0 THEN salted || '.' || k ELSE salted END AS decision_id FROM n")
def _(spark, d):
    rows = W.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.lit("2024-01-01").alias("day"), F.col("p_name").alias("title"), F.col("p_brand").alias("body"))
    base = text.decision_id(F.col("day"), F.col("title"))
    taken = rows.where("seq % 10 = 0").select(base.alias("id")).union(rows.where("seq % 15 = 0").select(F.concat(base, F.lit("-"), F.substring(F.sha2("body", 256), 1, 6)))).distinct()
    return text.mint_ids(rows, taken).select("seq", "decision_id")


@query("dec11_mint_id", "WITH b AS (SELECT p_partkey AS id, 'adr:2024-01-01-' || regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS base, p_type FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) > 1 AS taken FROM b) SELECT id, CASE WHEN taken THEN base || '-' || substr(sha256(p_type), 1, 6) ELSE base END AS decision_id FROM t")
def _(spark, d):
    p = W.table(spark, d, "part").withColumn("taken", F.expr("row_number() over (partition by trim(both '-' from regexp_replace(lower(p_name), '[^a-z0-9]+', '-')) order by p_partkey) > 1"))
    return p.select(F.col("p_partkey").alias("id"), text.decision_id(F.lit("2024-01-01"), F.col("p_name"), F.col("p_type"), F.col("taken")).alias("decision_id"))


@query("scl06_hashes", "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g')) AS content_hash, substr(sha256(doc_id::VARCHAR), 1, 7) AS short, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM documents")
def _(spark, d):
    t = F.coalesce("text", F.lit(""))
    return W.table(spark, d, "documents").select("doc_id", text.content_hash(t).alias("content_hash"), text.short_sha(F.sha2(F.col("doc_id").cast("string"), 256)).alias("short"), text.estimated_tokens(F.length(t)).alias("tokens"))


@query("scl11_agent_slug", "WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '-- ' WHEN p_partkey % 5 = 1 THEN p_name || '.' || p_type ELSE p_name END AS v FROM part), s AS (SELECT id, regexp_replace(substr(regexp_replace(regexp_replace(lower(substr(v, 1, 256)), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 40), '[-.]+$', '') AS g FROM n) SELECT id, CASE WHEN g = '' THEN 'agent' ELSE g END AS slug FROM s")
def _(spark, d):
    v = F.when(F.col("p_partkey") % 5 == 0, "-- ").when(F.col("p_partkey") % 5 == 1, F.concat_ws(".", "p_name", "p_type")).otherwise(F.col("p_name"))
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.agent_slug(v).alias("slug"))


@query("scl12_relative_age", "WITH s AS (SELECT event_id, event_id * event_id AS s FROM events) SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31104000 THEN s // 2592000 || 'mo ago' ELSE s // 31104000 || 'y ago' END AS age FROM s")
def _(spark, d):
    return W.table(spark, d, "events").select("event_id", text.relative_age(F.col("event_id") * F.col("event_id")).alias("age"))


@query("scl14_payload", """SELECT event_id, octet_length(encode(props)) AS bytes, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events""")
def _(spark, d):
    return W.table(spark, d, "events").select("event_id", F.octet_length("props").cast("long").alias("bytes"), F.concat_ws(",", F.array_sort(F.json_object_keys("props"))).alias("keys"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("scl05_fingerprint", "SELECT p_partkey AS id, printf('%x', " + _FNV.format("p_name || chr(10) || p_type || chr(10)") + ") AS print FROM part")
def _(spark, d):
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.fingerprint(F.array("p_name", "p_type")).alias("print"))


@query("scl09_field_caps", "WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE repeat(p_name, (p_partkey % 12)::INT) END AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE repeat('c', (p_partkey * 3 % 2300)::INT) END AS context, 'ok' AS decision, CASE WHEN p_partkey % 3 = 0 THEN repeat('q', (p_partkey % 2200)::INT) END AS consequences, CASE WHEN p_partkey % 4 = 0 THEN '```' WHEN p_partkey % 4 = 1 THEN repeat('a', (p_partkey % 1100 + 1)::INT) END AS alternatives FROM part) SELECT id, CASE WHEN length(trim(title)) = 0 THEN 'title EMPTY' WHEN length(title) > 120 THEN 'title TOO_LONG' WHEN length(coalesce(context, '')) = 0 THEN 'context EMPTY' WHEN length(context) > 2000 THEN 'context TOO_LONG' WHEN length(consequences) = 0 THEN 'consequences EMPTY' WHEN length(consequences) > 2000 THEN 'consequences TOO_LONG' WHEN contains(alternatives, '```') THEN 'alternatives HAS_FENCE' WHEN length(alternatives) > 1000 THEN 'alternatives TOO_LONG' ELSE 'fine' END AS verdict FROM f")
def _(spark, d):
    k = F.col("p_partkey")
    times = lambda c, n: F.expr(f"repeat({c}, cast({n} as int))")
    rows = W.table(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 7 == 0, " ").otherwise(times("p_name", "p_partkey % 12")).alias("title"),
        F.when(k % 5 != 0, times("'c'", "p_partkey * 3 % 2300")).alias("context"),
        F.lit("ok").alias("decision"),
        F.when(k % 3 == 0, times("'q'", "p_partkey % 2200")).alias("consequences"),
        F.when(k % 4 == 0, "```").when(k % 4 == 1, times("'a'", "p_partkey % 1100 + 1")).alias("alternatives"),
    )
    return rows.select("id", text.sanitize_fields().alias("r")).select("id", F.when(F.col("r.ok"), "fine").otherwise(F.concat_ws(" ", "r.field", "r.error")).alias("verdict"))


@query("scl15_sizes", f"WITH {W.EDGES} SELECT src, dst, floor(least(1.0, greatest(0.15, CASE call_sites % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.42 ELSE 0.15 END * (1 + 0.18 * ln(1 + call_sites)))) * 1e6 + 0.5) / 1e6 AS opacity, floor(least(12.0, greatest(1.0, CASE src % 4 WHEN 0 THEN 6 WHEN 1 THEN 3.5 WHEN 2 THEN 2.6 ELSE 1.4 END + 0.9 * ln(1 + dst))) * 1e6 + 0.5) / 1e6 AS size, floor(CASE WHEN dst <= 220 THEN 1.0 ELSE greatest(0.04, 220::DOUBLE / dst) END * 1e6 + 0.5) / 1e6 AS scale FROM ed")
def _(spark, d):
    from ..operators import geometry

    at = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    six = lambda c, n: (F.floor(c * 1e6 + 0.5) / 1e6).alias(n)
    opacity = geometry.bundle_opacity(at(("exact", "name_match", "ambiguous"), "call_sites"), F.col("call_sites"))
    return W.edges(spark, d).select("src", "dst", six(opacity, "opacity"), six(geometry.node_size(at(("galaxy", "dir", "file", "symbol"), "src"), F.col("dst")), "size"), six(geometry.edge_scale(F.col("dst")), "scale"))


@query("scl03_fnv1a", "SELECT p_partkey AS id, " + _FNV.format("p_name") + " AS hash FROM part")
def _(spark, d):
    return W.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.fnv1a(F.col("p_name")).alias("hash"))


@query("flt13_summary_state", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'needs_enrichment' WHEN p_partkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    return W.table(spark, d, "part").select(k.alias("id"), text.summary_state(F.when(k % 4 != 0, F.col("p_type")), F.when(k % 3 != 0, F.sha2("p_name", 256)), F.sha2("p_name", 256)).alias("state"))


@query("flt16_caps", "WITH j AS (SELECT doc_id, lang, octet_length(encode('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}')) AS b, n_chars FROM documents), r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS n, sum(b) OVER (ORDER BY n_chars, doc_id) AS s FROM j) SELECT doc_id, n_chars FROM r WHERE n <= 200 AND (n = 1 OR s <= 4096)")
def _(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    return guard.capped(docs, "n_chars", "doc_id", max_bytes=4096).select("doc_id", "n_chars")


@query("flt14_read_only", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand ORDER BY n DESC, brand LIMIT 200")
def _(spark, d):
    W.table(spark, d, "part").createOrReplaceTempView("graphloom_nodes")
    return guard.run_read_only(spark, "SELECT p_brand AS brand, count(*) AS n FROM graphloom_nodes WHERE p_size > :size GROUP BY p_brand ORDER BY n DESC, brand", args={"size": 10})


@query("flt01_lookups", f"WITH {W.PARTS} SELECT id, name, qualified_name, file_path, CASE WHEN id = 7 THEN 'id' WHEN file_path = 'PROMO/Brand#2' THEN 'path' ELSE 'name' END AS via FROM parts WHERE id = 7 OR (file_path = 'PROMO/Brand#2') OR name = (SELECT min(name) FROM parts)")
def _(spark, d):
    p = W.parts(spark, d)
    least, path = p.agg(F.min("name")).first()[0], F.col("file_path") == "PROMO/Brand#2"
    rows = p.where((F.col("id") == 7) | path | (F.col("name") == least))
    return rows.select("id", "name", "qualified_name", "file_path", F.when(F.col("id") == 7, "id").when(path, "path").otherwise("name").alias("via"))


@query("flt06_corpus", f"WITH {W.PARTS} SELECT id, name, coalesce(nullif(qualified_name, ''), name) AS qualified_name, file_path FROM parts WHERE id % 3 <> 0 ORDER BY id")
def _(spark, d):
    return W.parts(spark, d).where("id % 3 <> 0").select("id", "name", F.coalesce(F.nullif("qualified_name", F.lit("")), "name").alias("qualified_name"), "file_path").orderBy("id")


_LOG = "lg AS (SELECT user_id AS session_id, ts, event_type AS tool, length(props) * 10 AS result_bytes, value >= 5 AS ok FROM events)"


def _events(spark, d):
    return W.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _log(spark, d):
    e = W.table(spark, d, "events")
    ids = F.array(F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")))
    return e.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), (F.length("props") * 10).cast("long").alias("result_bytes"), ids.alias("node_ids"), (F.col("value") >= 5).alias("ok"))


_STATS = "count(*) AS records, sum(result_bytes)::BIGINT AS result_bytes, count(*) FILTER (NOT ok) AS failed, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms"
_TOKENS_SAVED = "floor(result_bytes / 4.0 + 0.5)::BIGINT AS tokens, floor(floor(result_bytes / 4.0 + 0.5)::DOUBLE * 8.4::DOUBLE + 0.5)::BIGINT AS grep_tokens"


@query("agg15_session_stats", f"WITH {_LOG}, s AS (SELECT session_id, {_STATS} FROM lg GROUP BY 1) SELECT *, {_TOKENS_SAVED} FROM s")
def _(spark, d):
    return sessions.stats(_log(spark, d)).select("session_id", "records", "result_bytes", "failed", "duration_ms", "tokens", "grep_tokens")


@query("agg16_all_sessions", f"WITH {_LOG}, s AS (SELECT {_STATS} FROM lg) SELECT *, {_TOKENS_SAVED} FROM s")
def _(spark, d):
    return sessions.stats(_log(spark, d), None).select("records", "result_bytes", "failed", "duration_ms", "tokens", "grep_tokens")


@query("agg15_calls_by_tool", f"WITH {_LOG} SELECT session_id, tool, count(*) AS calls FROM lg GROUP BY 1, 2")
def _(spark, d):
    return sessions.calls_by_tool(_log(spark, d))


@query("agg15_top_touched", "WITH t AS (SELECT user_id AS session_id, unnest(['n' || event_id % 7, 'n' || user_id % 3]) AS node_id FROM events), c AS (SELECT session_id, node_id, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, node_id) AS place FROM c) SELECT session_id, node_id, n, place FROM r WHERE place <= 10")
def _(spark, d):
    return sessions.top_touched(_log(spark, d)).withColumn("place", F.col("place").cast("long"))


_IDLE = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '{0}' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, k"


@query("str02_idle_sessions_5m", _IDLE.format("5 minutes"))
def _(spark, d):
    return sessions.idle_sessions(_events(spark, d), "5 minutes").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query("str02_idle_sessions_1d", _IDLE.format("1 day"))
def _(spark, d):
    return sessions.idle_sessions(_events(spark, d), "1 day").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query("str03_retention", "WITH s AS (SELECT user_id AS session_id, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT session_id, epoch_us(last) AS last FROM s, m WHERE last >= now - INTERVAL 30 DAY ORDER BY s.last DESC, session_id LIMIT 50")
def _(spark, d):
    e = _events(spark, d)
    s = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last"))
    now: datetime.datetime = e.agg(F.max("ts")).first()[0]
    return sessions.retained(s, now).select("session_id", F.unix_micros("last").alias("last"))


@query("agg17_latest_session", "SELECT user_id AS session_id, epoch_us(max(ts)) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark, d):
    s = _events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last"))
    return sessions.latest(s).select("session_id", F.unix_micros("last").alias("last"))


@query("agg18_repositories", f"WITH {W.PAGES} SELECT host, count(*) AS files, count(DISTINCT regexp_extract(path, '^[^/]*', 0)) AS folders FROM pp GROUP BY 1")
def _(spark, d):
    return W.page_paths(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.regexp_extract("path", "^[^/]*", 0)).alias("folders"))


@query("agg20_report_means", "SELECT label, floor(avg(s) * 1e6 + 0.5) / 1e6 AS mean, count(*) AS n FROM (SELECT label, list_sum(embedding::DOUBLE[]) AS s FROM embeddings) GROUP BY 1")
def _(spark, d):
    s = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return W.table(spark, d, "embeddings").select("label", s.alias("s")).groupBy("label").agg((F.floor(F.avg("s") * 1e6 + 0.5) / 1e6).alias("mean"), F.count(F.lit(1)).alias("n"))
