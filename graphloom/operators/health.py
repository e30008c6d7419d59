"""Health checks, canonical decisions, crumbs and budgets."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose strings are ids or paths, keys of lists of ids, how deep and how many a result is searched for.
ID_KEYS = ("node_id", "id", "decision_id", "file_path", "path")
ID_LISTS = ("node_ids", "anchor_node_ids")
MAX_DEPTH, MAX_IDS = 6, 25


def freshness(recorded: Column, head: Column) -> Column:
    return F.when(recorded.isNull(), "unknown").when(recorded == head, "fresh").otherwise("stale")


def summary_checks(nodes: DataFrame) -> DataFrame:
    """(check, n) of nodes (id, summary, state): how many are missing, stale, too long, or hold fences or links."""
    from ..functions.text import FENCE, LINK, SUMMARY_MAX

    s = F.coalesce("summary", F.lit(""))
    checks = {"missing": F.col("state") == "needs_enrichment", "stale": F.col("state") == "stale", "too_long": F.length(s) > SUMMARY_MAX, "fence": s.contains(FENCE), "link": s.rlike(LINK)}
    rows = nodes.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in checks.items()))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks))).alias("r")).select("r.*")


def gate(checks: DataFrame, failing: list[str]) -> DataFrame:
    """(ok, failed): whether none of the failing checks found anything."""
    bad = F.array_sort(F.collect_list(F.when(F.col("check").isin(*failing) & (F.col("n") > 0), F.col("check"))))
    return checks.agg(bad.alias("failed")).select((F.size("failed") == 0).alias("ok"), "failed")


def freshness_key(files: DataFrame) -> DataFrame:
    """(newest, files, bytes) of files (modified, length): changes when any of them does."""
    return files.agg(F.max("modified").alias("newest"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def touched_ids(result: str) -> list[str]:
    """The ids that a JSON result mentions, in order, each once."""
    out: dict[str, None] = {}

    def walk(value: object, depth: int) -> None:
        if depth > MAX_DEPTH or len(out) >= MAX_IDS:
            return
        if isinstance(value, dict):
            for k, v in value.items():
                if len(out) >= MAX_IDS:
                    return
                if k in ID_KEYS and isinstance(v, str):
                    out.setdefault(v)
                elif k in ID_LISTS and isinstance(v, list):
                    for x in v:
                        if isinstance(x, str) and len(out) < MAX_IDS:
                            out.setdefault(x)
                else:
                    walk(v, depth + 1)
        elif isinstance(value, list):
            for v in value:
                walk(v, depth + 1)

    try:
        walk(json.loads(result), 0)
    except ValueError:
        return []
    return list(out)


def with_touched_ids(results: DataFrame) -> DataFrame:
    """results (session_id, result) with node_ids."""

    def task(frames: Iterable) -> Iterable:
        for f in frames:
            yield f.assign(node_ids=[touched_ids(r or "") for r in f["result"]])

    return results.select("session_id", "result").mapInPandas(task, "session_id string, result string, node_ids array<string>")


def crumbs(labels: Column, most: int = 4) -> Column:
    """Breadcrumbs without equal neighbours; of more than `most`, the first, an ellipsis and the last ones."""
    n = F.size(labels)
    kept = F.filter(labels, lambda x, i: (i == 0) | (x != F.get(labels, i - 1)))
    return F.when(F.size(kept) > most, F.concat(F.slice(kept, 1, 1), F.array(F.lit("…")), F.slice(kept, F.size(kept) - most + 3, most - 2))).when(n > 0, kept).otherwise(labels)


def segment_counts(bundles: DataFrame, budget: int, least: int = 1) -> DataFrame:
    """(id, segments) of bundles (id, weight): at least `least` each, the rest of the budget by weight."""
    whole = bundles.agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).first()
    spare = max(0, budget - whole["n"] * least)
    if not whole["total"]:
        return bundles.select("id", F.lit(least).alias("segments"))
    return bundles.select("id", (F.lit(least) + F.floor(F.col("weight") / whole["total"] * spare)).cast("int").alias("segments"))


def canonical_decision(record: dict) -> str:
    """JSON with id first, all other keys sorted at every level, two spaces, nulls left out."""

    def tidy(value):
        if isinstance(value, dict):
            return {k: tidy(value[k]) for k in sorted(value) if value[k] is not None}
        return [tidy(v) for v in value] if isinstance(value, list) else value

    rest = tidy({k: v for k, v in record.items() if k != "id"})
    return json.dumps({"id": record["id"]} | rest, indent=2, ensure_ascii=False) + "\n"
