"""Session telemetry.  log: (session_id, ts timestamp, tool, result_bytes, node_ids array<string>, ok)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the same answers cost by text search, tools that write, kept sessions and days.
GREP_MULTIPLIER = 8.4
DECISION_TOOLS, SUMMARY_TOOLS = ("record_decision",), ("write_semantic_summary",)
KEEP_SESSIONS, KEEP_DAYS, TOP_TOUCHED = 50, 30, 10


def stats(log: DataFrame, key: str | None = "session_id") -> DataFrame:
    """A row per session, or one over all: records, bytes, failures, writes, duration, estimated tokens."""
    ok = F.coalesce("ok", F.lit(True))
    ms = F.expr("unix_millis(max(ts)) - unix_millis(min(ts))")
    aggs = [
        F.count(F.lit(1)).alias("records"),
        F.sum("result_bytes").alias("result_bytes"),
        F.count(F.when(~ok, 1)).alias("failed"),
        F.count(F.when(F.col("tool").isin(*DECISION_TOOLS), 1)).alias("decisions_written"),
        F.count(F.when(F.col("tool").isin(*SUMMARY_TOOLS), 1)).alias("summaries_written"),
        F.coalesce(ms, F.lit(0)).alias("duration_ms"),
    ]
    rows = log.groupBy(key).agg(*aggs) if key else log.agg(*aggs)
    tokens = F.floor(F.col("result_bytes") / 4 + 0.5)
    rows = rows.withColumn("tokens", tokens).withColumn("grep_tokens", F.floor(F.col("tokens") * GREP_MULTIPLIER + 0.5))
    return rows.withColumn("tokens_saved", F.col("grep_tokens") - F.col("tokens"))


def calls_by_tool(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("calls"))


def top_touched(log: DataFrame, top: int = TOP_TOUCHED) -> DataFrame:
    """(session_id, node_id, n, place)."""
    counts = log.select("session_id", F.explode("node_ids").alias("node_id")).groupBy("session_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.expr("row_number() over (partition by session_id order by n desc, node_id)")).where(F.col("place") <= top)


def retained(sessions: DataFrame, now, most: int = KEEP_SESSIONS, days: int = KEEP_DAYS) -> DataFrame:
    """Of sessions (session_id, last timestamp) the newest `most` that are no older than `days`."""
    return sessions.where(F.col("last") >= F.lit(now) - F.expr(f"interval {days} days")).orderBy(F.desc("last"), "session_id").limit(most)


def idle_sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, first, last, n) of runs of events without a gap."""
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return w.drop("w")


def latest(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("last"), "session_id").limit(1)
