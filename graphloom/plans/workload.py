"""The driver's tables as code-graph inputs: parts are symbols, orders are commits, events are telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """(sha, day, author, path): an order is a commit by its customer on its date, its parts are the files."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("author"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).join(orders, "sha")


CHANGES = "changes AS (SELECT o_orderkey AS sha, o_orderdate::DATE AS day, o_custkey AS author, l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, call_sites): a part calls the next one of its order."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst")).agg(F.min("l_linenumber").alias("n"))
    after = first.withColumn("src", F.expr("lag(dst) over (partition by o order by n, dst)")).where("src is not null")
    return after.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("call_sites"))


EDGES = """firsts AS (SELECT l_orderkey AS o, l_partkey AS dst, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
ed AS (SELECT src, dst, count(*) AS call_sites FROM (SELECT dst, lag(dst) OVER (PARTITION BY o ORDER BY n, dst) AS src FROM firsts) WHERE src IS NOT NULL GROUP BY 1, 2)"""


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """edges with type by the ends' keys, and confidence and resolution by the source's out-degree."""
    e = edges(spark, d)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    kinds = F.array(*map(F.lit, ("CALLS", "INHERITS", "IMPLEMENTS", "INSTANTIATES", "IMPORTS")))
    confidence = F.floor(F.lit(1.0) / F.col("out") * 100 + 0.5) / 100
    rows = e.join(out, "src").select("src", "dst", "call_sites", F.get(kinds, ((F.col("src") + F.col("dst")) % 5).cast("int")).alias("type"), confidence.alias("confidence"))
    return rows.withColumn("resolution", F.when(F.col("confidence") >= 0.95, "exact").when(F.col("confidence") >= 0.05, "name_match").otherwise("ambiguous"))


TYPED = EDGES + """,
outs AS (SELECT src, count(*) AS o FROM ed GROUP BY 1),
te0 AS (SELECT src, dst, call_sites, ['CALLS', 'INHERITS', 'IMPLEMENTS', 'INSTANTIATES', 'IMPORTS'][((src + dst) % 5)::INT + 1] AS type, floor(1.0::DOUBLE / o * 100 + 0.5) / 100 AS confidence FROM ed JOIN outs USING (src)),
te AS (SELECT *, CASE WHEN confidence >= 0.95 THEN 'exact' WHEN confidence >= 0.05 THEN 'name_match' ELSE 'ambiguous' END AS resolution FROM te0)"""


def smallest_target(e: DataFrame) -> DataFrame:
    return e.agg(F.min("dst").alias("id"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Symbols: id, name, qualified_name, summary, signature, file_path, kind."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        F.col("p_type").alias("summary"),
        F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("signature"),
        F.concat_ws("/", F.regexp_replace("p_type", " ", "/"), "p_brand").alias("file_path"),
    )


PARTS = "parts AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS summary, 'size' || p_size AS signature, replace(p_type, ' ', '/') || '/' || p_brand AS file_path FROM part)"


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """(id, host, path): pages of a site as files of a repository."""
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1).alias("path"))


PAGES = "pp AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages)"
