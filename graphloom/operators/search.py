"""Lexical, vector and fused ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, tokenize
from .traverse import cut_lineage

#: Fixed values of the ranking functions.
WEIGHTS = {"qualified_name": 10.0, "name": 8.0, "summary": 4.0, "signature": 2.0, "file_path": 1.0}
K1, B = 1.2, 0.75
RRF_K = 60
LEXICAL_POOL = 125
VIEWER_WEIGHTS = {"name": 10.0, "qualified_name": 6.0, "file_path": 3.0, "summary": 1.5}


def query_tokens(query: str) -> list[str]:
    """The distinct tokens of a query, in order; the same rule as for documents."""
    import re

    cut = re.sub(r"[^a-zA-Z0-9]+", " ", query)
    cut = re.sub(r"([a-z])([A-Z])", r"\1 \2", cut)
    cut = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", cut)
    return list(dict.fromkeys(t for t in cut.lower().split(" ") if len(t) > 1))


def bm25f(corpus: DataFrame, query: str, limit: int | None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, score, matched) of corpus (id and the weighted fields): BM25F, saturated by field before weighing.

    Texts are tokenized once, to the counts that the query needs; from that small table one pass takes the statistics of
    all fields (one row to the driver) and another scores.  Nothing is shuffled but the final top rows.
    """
    tokens = query_tokens(query)
    fields = list(weights)
    if not tokens:
        return corpus.select("id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")).limit(0)
    docs = corpus.select("id", *(tokenize(F.col(f)).alias(f) for f in fields))
    tf = lambda f, t: F.size(F.filter(f, lambda x: x == t))
    lean = cut_lineage(docs.select("id", *(F.size(f).alias(f"n_{f}") for f in fields), *(tf(f, t).alias(f"tf_{i}_{f}") for f in fields for i, t in enumerate(tokens))))
    has = [reduce(Column.__or__, (F.col(f"tf_{i}_{f}") > 0 for f in fields)) for i in range(len(tokens))]
    stats = lean.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in fields), *(F.sum(h.cast("long")).alias(f"df_{i}") for i, h in enumerate(has))).first()
    n = stats["n"]
    if not n:
        return lean.select("id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"))
    mean = {f: (stats[f"n_{f}"] / n) or 1.0 for f in fields}
    total = F.lit(0.0)
    for i in range(len(tokens)):
        df = stats[f"df_{i}"] or 0
        if df:
            idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))
            weighted = F.lit(0.0)
            for f in fields:
                c = F.col(f"tf_{i}_{f}")
                weighted = weighted + F.lit(weights[f]) * (c * (K1 + 1)) / (c + K1 * (1 - B + B * (F.col(f"n_{f}") / mean[f])))
            total = total + idf * weighted
    matched = F.array_sort(F.filter(F.array(*(F.when(h, t) for h, t in zip(has, tokens, strict=True))), lambda x: x.isNotNull()))
    rows = lean.select("id", half_up(total, 6).alias("score"), matched.alias("matched")).where(F.size("matched") > 0)
    return rows.orderBy(F.desc("score"), "id").limit(limit) if limit else rows


def cosine(a: Column, b: Column) -> Column:
    """Of double arrays; null if the lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], limit: int | None) -> DataFrame:
    """(id, similarity) of vectors (id, vector), highest first, then by id; the query is a literal in the plan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col("vector").cast("array<double>"), q)
    rows = vectors.select("id", (F.floor(score * 1e6 + 0.5) / 1e6).alias("similarity")).where("similarity is not null")
    return rows.orderBy(F.desc("similarity"), "id").limit(limit) if limit else rows


def fuse(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of rankings (id, rank)."""
    each = reduce(DataFrame.unionByName, (r.select("id", (F.lit(1.0) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("i")) for i, r in enumerate(rankings)))
    # summed in the order of the rankings
    parts = F.array_sort(F.collect_list(F.struct("i", "s")))
    return each.groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """A top list with its rank; the list is short, so one partition ranks it."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_ranks(near: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """(id, rank) by similarity of the first `limit` rows of near (id, similarity) and of those with these ids, which are few.

    The ranks of the latter are counts of what comes before them, taken in one pass: nothing sorts the corpus.
    """
    top = ranked(near.orderBy(F.desc("similarity"), "id").limit(limit), F.desc("similarity"), F.asc("id")).select("id", "rank")
    few = near.join(F.broadcast(ids.select("id")), "id", "left_semi").collect()
    if not few:
        return top
    before = [(F.col("similarity") > r.similarity) | ((F.col("similarity") == r.similarity) & (F.col("id") < r.id)) for r in few]
    counts = near.agg(*(F.count(F.when(b, 1)).alias(f"n{i}") for i, b in enumerate(before))).first()
    kind = near.schema["id"].dataType.simpleString()
    own = near.sparkSession.createDataFrame([(r.id, counts[i] + 1) for i, r in enumerate(few)], f"id {kind}, rank int")
    return top.join(own.select("id"), "id", "left_anti").unionByName(own)


def corpus_of(nodes: DataFrame, decisions: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """What is searched: nodes and decisions (id, kind and the weighted fields), of these kinds only, before any statistics."""
    rows = nodes if decisions is None else nodes.unionByName(decisions.withColumn("kind", F.lit("Decision")), allowMissingColumns=True)
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def hybrid(corpus: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 25, pool: int = LEXICAL_POOL, kinds: list[str] | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """(id, score, via): the lexical pool and the vector ranking, fused; via tells which of them has it.

    kinds: corpus and vectors are cut to them first.  Only the first `limit` vectors and those of the lexical pool can be
    in the result, so only these are ranked.
    """
    if kinds or decisions is not None:
        corpus = corpus_of(corpus, decisions, kinds)
    if kinds:
        vectors = vectors.join(corpus.select("id"), "id", "left_semi")
    lexical = cut_lineage(ranked(bm25f(corpus, query, pool), F.desc("score"), F.asc("id")))
    near = vector_ranks(nearest(vectors, vector, None), lexical, limit)
    each = lexical.select("id", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("l"), F.lit(None).cast("double").alias("v")).unionByName(near.select("id", F.lit(None).cast("double").alias("l"), (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("v")))
    both = each.groupBy("id").agg(F.max("l").alias("l"), F.max("v").alias("v"))
    via = F.when(F.col("l").isNotNull() & F.col("v").isNotNull(), "hybrid").when(F.col("l").isNotNull(), "lexical").otherwise("vector")
    score = F.coalesce("l", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))
    return both.select("id", half_up(score, 9).alias("score"), via.alias("via")).orderBy(F.desc("score"), "id").limit(limit)


def match_quality(token: str, value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    at = F.instr(v, token)
    before = F.substring(v, at - 1, F.lit(1))
    return F.when(v == token, 1.0).when(v.startswith(token), 0.7).when(at == 0, 0.0).when(before.rlike("[a-z0-9]"), 0.25).otherwise(0.5)


def weighted_search(corpus: DataFrame, query: str, limit: int = 10, weights: dict[str, float] = VIEWER_WEIGHTS) -> DataFrame:
    """(id, name, score) of rows where every token of the query is in some field; each counts by its best field."""
    tokens = query.lower().split()
    best = [F.greatest(*(match_quality(t, F.col(f)) * w for f, w in weights.items())) if len(weights) > 1 else match_quality(t, F.col(next(iter(weights)))) * next(iter(weights.values())) for t in tokens]
    rows = corpus.select("id", "name", *(b.alias(f"b{i}") for i, b in enumerate(best))).where(reduce(Column.__and__, (F.col(f"b{i}") > 0 for i in range(len(tokens)))))
    return rows.select("id", "name", reduce(Column.__add__, (F.col(f"b{i}") for i in range(len(tokens)))).alias("score")).orderBy(F.desc("score"), "name", "id").limit(limit)


def precision_recall(relevant: DataFrame, found: DataFrame, beta: float = 0.5) -> DataFrame:
    """(task, precision, recall, f) of (task, id) rows; nothing found for nothing relevant is right."""
    r = relevant.distinct().withColumn("r", F.lit(1))
    f = found.distinct().withColumn("f", F.lit(1))
    counts = r.join(f, ["task", "id"], "full_outer").groupBy("task").agg(F.sum("r").alias("nr"), F.sum("f").alias("nf"), F.count(F.expr("case when r = 1 and f = 1 then 1 end")).alias("hit"))
    p = F.when(F.coalesce("nf", F.lit(0)) > 0, F.col("hit") / F.col("nf")).otherwise(F.when(F.coalesce("nr", F.lit(0)) == 0, 1.0).otherwise(0.0))
    c = F.when(F.coalesce("nr", F.lit(0)) > 0, F.col("hit") / F.col("nr")).otherwise(1.0)
    b = beta * beta
    score = F.when(F.col("precision") + F.col("recall") > 0, (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return counts.select("task", p.alias("precision"), c.alias("recall")).withColumn("f", score)


def tightest(points: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """(point, interval): the shortest of intervals (key, id, lo, hi) around each of points (key, point, at), whole numbers all.

    An interval is the buckets that it fills, as at most two blocks of each power of two, and less than a bucket's places
    at either end.  The shortest of each block and place is kept, and each place that points have meets one row for each
    power: the work grows with points and intervals, not with how many overlap.
    """
    i = intervals.where("lo <= hi").groupBy("key", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).agg(F.min("id").alias("id"))
    i = i.withColumns({"first": F.expr(f"cast(floor((lo + {bucket - 1}) / {bucket}) as bigint)"), "end": F.expr(f"cast(floor((hi + 1) / {bucket}) as bigint)")})
    i = i.withColumn("levels", F.expr("if(first < end, length(bin(end - first)), 0)"))
    # blocks of level k that hold buckets first up to end: from l up to r; an odd l or r has one that the next level can't hold
    one = lambda at, block: f"if(l_r.l < l_r.r and {at} % 2 <> 0, struct(k, {block} as block), null)"
    blocks = F.expr(f"""filter(flatten(transform(if(levels > 0, sequence(0, levels - 1), array()), k -> transform(
        array(struct(-shiftright(-first, k) as l, shiftright(end, k) as r)), l_r -> array({one("l_r.l", "l_r.l")}, {one("l_r.r", "l_r.r - 1")})
    )[0])), x -> x is not null)""")
    ends = F.expr(f"""transform(if(levels = 0, sequence(lo, hi), concat(if(lo < first * {bucket}, sequence(lo, first * {bucket} - 1), array()), if(end * {bucket} <= hi, sequence(end * {bucket}, hi), array()))), x -> struct(-1 as k, x as block))""")
    held = i.select("key", F.struct((F.col("hi") - F.col("lo")).alias("length"), "id").alias("one"), F.explode(F.concat(blocks, ends)).alias("at")).groupBy("key", "at.k", "at.block").agg(F.min("one").alias("one"))
    most = i.agg(F.max("levels")).first()[0] or 0
    places = points.select("key", F.col("at").cast("long").alias("at")).distinct()
    asked = F.expr(f"concat(array(struct(-1 as k, at as block)), transform({'sequence(0, %d)' % (most - 1) if most else 'cast(array() as array<int>)'}, k -> struct(k, shiftright(cast(floor(at / {bucket}) as bigint), k) as block)))")
    met = places.select("key", "at", F.explode(asked).alias("p")).select("key", "at", "p.k", "p.block").join(held, ["key", "k", "block"]).groupBy("key", "at").agg(F.min("one").alias("one"))
    return points.select("key", "point", F.col("at").cast("long").alias("at")).join(met, ["key", "at"]).groupBy("point").agg(F.min("one").alias("one")).select("point", F.col("one.id").alias("interval"))


def stale_embeddings(corpus: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of corpus (id, doc) whose SHA-256 the cache (id, doc_hash) lacks."""
    hashed = corpus.select("id", F.sha2("doc", 256).alias("doc_hash"))
    return hashed.join(cache.select("id", F.col("doc_hash").alias("known")), "id", "left").where("known is null or known <> doc_hash").drop("known")
