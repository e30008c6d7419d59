"""Structured Streaming: idle sessions, drift that accumulates until it is consumed, snapshot triggers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
IDLE = "5 minutes"
POLL = "30 seconds"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of event files; what a trigger has taken is in the checkpoint, so each file is claimed once."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def idle_sessions(events: DataFrame, gap: str = IDLE, late: str = "1 hour") -> DataFrame:
    """(user_id, first, last, n) of sessions, given out when the watermark has passed their gap."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return w.select("user_id", "first", "last", "n")


def pending_changes(changes: DataFrame) -> DataFrame:
    """changes (repo, id, change, consumed) as a stream: per repository the ids that no consumption has taken yet.

    State per (repo, id) is its last change; a consumption empties it, so pending drift outlives restarts and is
    handed over once.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        for f in frames:
            for change, consumed in zip(f["change"], f["consumed"], strict=True):
                held = None if consumed else change
        if held is None:
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({"repo": [key[0]], "id": [key[1]], "change": [held]})

    return changes.groupBy("repo", "id").applyInPandasWithState(step, "repo string, id string, change string", "change string", "update", GroupStateTimeout.NoTimeout)


def on_new_head(heads: DataFrame, reindex: Callable[[str, str], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls reindex(repo, sha) for each repository whose newest head (repo, sha, seq) differs from the one before.

    A query runs one batch at a time, which is the mutual exclusion of index runs; a batch's heads are one a repository.
    Heads that were handled are kept beside the checkpoint, a folder for each batch that had any, so a restart doesn't
    repeat them; a batch that fails midway is repeated whole.
    """
    spark, kept = heads.sparkSession, f"{checkpoint.rstrip('/')}-heads"
    schema = "repo string, sha string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{kept}/batch=-1")

    def batch(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(f"{schema}, batch long").parquet(kept).where(F.col("batch") < number)
        before = before.groupBy("repo").agg(F.max_by("sha", "batch").alias("known"))
        newest = rows.groupBy("repo").agg(F.max_by("sha", "seq").alias("sha"))
        changed = newest.join(before, "repo", "left").where(~F.col("sha").eqNullSafe(F.col("known"))).select("repo", "sha").persist()
        try:
            if changed.isEmpty():
                return
            for r in changed.toLocalIterator():
                reindex(r.repo, r.sha)
            changed.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        finally:
            changed.unpersist()

    writer = heads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
