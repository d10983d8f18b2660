"""Push events, watch events and jobs as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def tracked_ref(ref: Column, branch: Column) -> Column:
    """Whether an event concerns the tracked branch; an event without ref does."""
    return F.coalesce(F.nullif(ref, F.lit("")), F.concat(F.lit("refs/heads/"), branch)) == F.concat(F.lit("refs/heads/"), branch)


def claim_key(workspace: Column, delivery: Column, ref: Column, commit: Column) -> Column:
    """What makes two deliveries the same: the delivery id, else what was pushed."""
    push = F.concat_ws(":", F.lit("push"), workspace, F.coalesce(ref, F.lit("")), F.coalesce(commit, F.lit("")))
    return F.when(F.coalesce(delivery, F.lit("")) != "", F.concat_ws(":", F.lit("delivery"), workspace, delivery)).otherwise(push)


def first_claims(events: DataFrame, order: str = "ts") -> DataFrame:
    """The first event of each ``key``.  The aggregation combines before it shuffles."""
    row = F.struct(*events.columns)
    return events.groupBy("key").agg(F.min_by(row, F.struct(order, "event_id")).alias("r")).select("r.*")


def released(claims: DataFrame, failed: DataFrame) -> DataFrame:
    """Claims (key, ...) without those whose publication failed, so that the next delivery may claim them again."""
    return claims.join(failed.select("key").distinct(), "key", "left_anti").select(*claims.columns)


def decisions(events: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``event_id``, ``workspace``, ``status``, ``reason`` of push events, in the order in which a gateway would decide.

    ``events``: event_id, workspace, token, ref, key, ts.  ``workspaces``: workspace, secret, branch, is_git.
    """
    known = events.join(workspaces, "workspace", "left")
    pre = (
        F.when(F.coalesce("token", F.lit("")) == "", "missing_token")
        .when(F.col("is_git").isNull() | ~F.col("is_git"), "unknown_workspace")
        .when(F.col("token") != F.col("secret"), "bad_token")
        .when(~tracked_ref(F.col("ref"), F.col("branch")), "ignored_ref")
        .otherwise("ok")
    )
    known = known.withColumn("pre", pre)
    ok = known.where("pre = 'ok'").groupBy("key").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("key", F.col("first.event_id").alias("first_id"))
    out = known.join(ok, "key", "left")
    reason = F.when(F.col("pre") != "ok", F.col("pre")).when(F.col("event_id") == F.col("first_id"), "accepted").otherwise("duplicate")
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("missing_token", "bad_token"), 401).when(F.col("reason") == "unknown_workspace", 404).when(F.col("reason") == "accepted", 202).otherwise(200)
    return out.select("event_id", "workspace", status.alias("status"), "reason")


def debounced(events: DataFrame, gap_ms: int = 500) -> DataFrame:
    """``workspace``, ``batch``, ``n_events``, ``first_ts``, ``last_ts``: bursts in which events follow each other within the gap.

    Built on session windows: Spark merges them partially before the shuffle.
    """
    burst = events.groupBy("workspace", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    out = burst.agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("batch", F.row_number().over(Window.partitionBy("workspace").orderBy("first_ts"))).drop("w")


def pending_paths(events: DataFrame) -> DataFrame:
    """The newest kind (changed, deleted) of each path; a move deletes its source and changes its target."""
    rows = events.select(
        "workspace",
        "seq",
        F.explode(
            F.when(F.col("kind") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("kind")), F.struct(F.col("to_path").alias("path"), F.lit("changed").alias("kind"))))
            .when(F.col("kind") == "deleted", F.array(F.struct(F.col("path"), F.lit("deleted").alias("kind"))))
            .otherwise(F.array(F.struct(F.col("path"), F.lit("changed").alias("kind"))))
        ).alias("e"),
    ).select("workspace", "seq", "e.*")
    return rows.groupBy("workspace", "path").agg(F.max_by("kind", "seq").alias("kind"))


def places(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``place``: 1, 2, ... within the workspace, by time."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("workspace").orderBy("ts", "job_id")))


def coalesced(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """``workspace``, ``batch``, ``n_jobs``: the first ``limit`` jobs of a workspace alone, all later ones as one."""
    return places(jobs).withColumn("batch", F.least("place", F.lit(limit + 1))).groupBy("workspace", "batch").agg(F.count("*").alias("n_jobs"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def ring(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """The ``size`` newest rows."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(size)


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, dict], tuple[Any, Any]], columns: list[str], out: str) -> DataFrame:
    """``rows`` with one more column, ``out`` ("name type"), that follows each key's rows in order.

    ``step`` takes what a key has in memory (None at first) and a row's ``columns``, and gives the memory after it and the
    row's value.  Rows are dealt out and sorted by key, then read as one stream with one key's memory, so that a task
    holds neither a key's rows nor its partition, however hot a key is.  A column of the new name is replaced.
    """
    more = StructType.fromDDL(out)
    name, kept = more[0].name, rows.drop(more[0].name)
    schema = StructType([*kept.schema.fields, *more.fields])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, memory = None, None
        for batch in batches:
            values = []
            for row in batch.select([*keys, *columns]).to_pylist():
                if (mine := tuple(row[k] for k in keys)) != key:
                    key, memory = mine, None
                memory, value = step(memory, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, to_arrow_type(more[0].dataType))], [*batch.schema.names, name])

    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(follow, schema)


def job_step(running: tuple | None, row: dict) -> tuple[tuple, Any]:
    """One request of a (workspace, type): absorbed by the job still running then, or the start of its own.

    A request without a time comes first, a job without an end ends when it starts.
    """
    at = micros(row["ts"])
    if running is None or at >= running[1]:
        running = (row["request_id"], max(at, micros(row["done_ts"])))
    return running, running[0]


def claim_step(holder: Any, row: dict) -> tuple[Any, str]:
    """One event of a key: ``claim`` is accepted unless the key is claimed; ``release`` frees the key if it is the holder's own
    (its ``holder`` says which event's claim is given up).  What it came to: accepted, duplicate, released or ignored."""
    if row["kind"] == "release":
        return (None, "released") if holder is not None and row["holder"] == holder else (holder, "ignored")
    return (row["event_id"], "accepted") if holder is None else (holder, "duplicate")


def micros(time: datetime | None) -> int:
    """Microseconds of a time; a missing one is before all others."""
    if time is None:
        return -(1 << 62)
    return (time.replace(tzinfo=time.tzinfo or UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def distinct_jobs(requests: DataFrame) -> DataFrame:
    """Requests with ``job_id``: one that finds the job of its (workspace, type) still running is absorbed by it, others start one.

    ``requests``: request_id, workspace, type, ts, done_ts (when its job would end, if it starts one), and any others.  What
    an absorbed request would have taken doesn't count.  ``streaming.ordered.job_stream`` does the same for a stream.
    """
    kind = dict(requests.dtypes)["request_id"]
    return in_order(requests, ["workspace", "type"], ["ts", "request_id"], job_step, ["request_id", "ts", "done_ts"], f"job_id {kind}")


def claims_in_order(events: DataFrame) -> DataFrame:
    """Events (event_id, key, kind: claim or release, holder, ts) with ``outcome``, as an inbox decides them (``claim_step``)."""
    return in_order(events, ["key"], ["ts", "event_id"], claim_step, ["event_id", "kind", "holder"], "outcome string")


def workspace_summary(workspaces: DataFrame, decided: DataFrame) -> DataFrame:
    """Each workspace with its last decision, accepted pushes, and whether its clone is what was last synced.

    ``workspaces``: workspace, clone_commit, synced_commit.  ``decided``: workspace, event_id, ts, reason.
    """
    last = decided.groupBy("workspace").agg(
        F.max_by("reason", F.struct("ts", "event_id")).alias("last_status"), F.count_if(F.col("reason") == "accepted").alias("n_accepted")
    )
    both = (F.coalesce("clone_commit", F.lit("")) != "") & (F.coalesce("synced_commit", F.lit("")) != "")
    return workspaces.join(last, "workspace", "left").select(
        "workspace",
        "last_status",
        F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
        F.coalesce(both & (F.col("clone_commit") == F.col("synced_commit")), F.lit(False)).alias("is_current"),
        F.coalesce(both & (F.col("clone_commit") != F.col("synced_commit")), F.lit(False)).alias("drifted"),
    )


def registry_diff(new: DataFrame, current: DataFrame, key: str = "workspace") -> DataFrame:
    """``workspace``, ``change``: added (only in ``new``) or removed (only in ``current``)."""
    added = new.select(key).join(current.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.union(current.select(key).join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def schedule(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_id, workspace, ts, seconds) with ``started`` and ``ended``: one after the other within a workspace.

    A job starts when it is asked for or when the one before it ends.  Unrolled, its end is the largest, over the jobs up
    to it, of that job's time plus all work from there on: a running sum and a running maximum.
    """
    order = Window.partitionBy("workspace").orderBy("ts", "job_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    work = jobs.withColumn("_sum", F.sum(F.col("seconds") * 1_000_000).over(order)).withColumn("_free", at - F.col("_sum") + F.col("seconds") * 1_000_000)
    ended = F.col("_sum") + F.max("_free").over(order)
    done = work.withColumn("ended", ended).withColumn("started", F.col("ended") - F.col("seconds") * 1_000_000)
    return done.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("started", "ended")}).drop("_sum", "_free")
