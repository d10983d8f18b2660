"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.events import claim_key, pending_paths

PUSH = "ref string, after string, delivery_id string, token string"


def read_pushes(spark: SparkSession, path: str, max_files: int = 50) -> DataFrame:
    """Push events from JSON lines (workspace, ts, payload); a payload that doesn't parse becomes an empty one."""
    raw = spark.readStream.schema("workspace string, ts timestamp, payload string").option("maxFilesPerTrigger", max_files).json(path)
    parsed = raw.withColumn("p", F.from_json("payload", PUSH)).select("workspace", "ts", "p.*")
    return parsed.withColumn("key", claim_key(F.col("workspace"), F.col("delivery_id"), F.col("ref"), F.col("after")))


def claims(pushes: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each key once within ``horizon``; state older than that is dropped."""
    return pushes.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"])


def bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Debounced bursts of watch events (workspace, ts) per workspace, given out when no event can join them any more."""
    return events.withWatermark("ts", late).groupBy("workspace", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def index_changes(events: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch's pending paths (the newest kind of each) to ``apply`` as one delta."""

    def on_batch(batch: DataFrame, _: int) -> None:
        delta = pending_paths(batch)
        if batch.limit(1).count():
            apply(delta)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start()
