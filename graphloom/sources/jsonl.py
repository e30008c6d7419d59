"""Canonical JSON lines: nodes lead with id and labels, edges with from, type and to; other keys sorted, no spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select("value", F.expr("try_parse_json(value)").alias("v"))


def _fields(rows: DataFrame, required: dict[str, tuple[str, str]], strict: bool) -> DataFrame:
    out = rows.select("value", "v", *(F.expr(f"try_variant_get(v, '$.{k}', '{kind}')").alias(c) for k, (c, kind) in required.items()))
    bad = F.lit(False)
    for c, _ in required.values():
        bad = bad | F.col(c).isNull()
    if not strict:
        return out.where(~bad)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))).otherwise(F.col("value"))
    return out.withColumn("value", checked)


def read_nodes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, labels, props variant) of node lines; strict: a malformed line fails the read, else it is left out."""
    rows = _fields(_lines(spark, path), {"id": ("id", "string"), "labels": ("labels", "array<string>")}, strict)
    return rows.select("id", "labels", F.col("v").alias("props"), F.col("value").alias("line"))


def read_edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = _fields(_lines(spark, path), {"from": ("src", "string"), "type": ("type", "string"), "to": ("dst", "string")}, strict)
    return rows.select("src", "type", "dst", F.col("v").alias("props"), F.col("value").alias("line"))


def node_lines(nodes: DataFrame, props: list[str]) -> DataFrame:
    """(value) canonical lines of nodes (id, labels and the named properties), in order of id; null properties are absent."""
    lead = F.concat(F.lit('{"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"labels":'), F.to_json("labels"))
    body = F.to_json(F.struct(*(F.col(p) for p in sorted(props))))
    rows = nodes.select("id", lead.alias("_lead"), body.alias("_body"))
    tail = F.when(F.length("_body") > 2, F.concat(F.lit(","), F.expr("substring(_body, 2, length(_body) - 2)"))).otherwise(F.lit(""))
    return rows.orderBy("id").select(F.concat("_lead", tail, F.lit("}")).alias("value"))


def edge_lines(edges: DataFrame, props: list[str]) -> DataFrame:
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    lead = F.concat(F.lit('{"from":'), quoted("src"), F.lit(',"type":'), quoted("type"), F.lit(',"to":'), quoted("dst"))
    body = F.to_json(F.struct(*(F.col(p) for p in sorted(props))))
    rows = edges.select("src", "type", "dst", lead.alias("_lead"), body.alias("_body"))
    tail = F.when(F.length("_body") > 2, F.concat(F.lit(","), F.expr("substring(_body, 2, length(_body) - 2)"))).otherwise(F.lit(""))
    return rows.orderBy("src", "type", "dst").select(F.concat("_lead", tail, F.lit("}")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Range-partitioned files that read in name order as one sorted whole."""
    lines.write.mode("overwrite").text(path)
