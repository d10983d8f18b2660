"""Streams with state against their batch forms, over several splits and a restart."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import events
from quillgraph.streaming import ordered

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ordered.STATE_STORE)
    yield
    spark.conf.unset(name)


def streamed(spark, tmp_path, schema, batches, make, restart_after=None):
    """Rows of a stream fed file by file; a new query takes over from the checkpoint after ``restart_after`` files."""
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    end = {"ts": (T0 + timedelta(days=9)).isoformat()}
    files = [*batches, [end]]
    parts = [files] if restart_after is None else [files[:restart_after], files[restart_after:]]
    n = 0
    for part in parts:
        for rows in part:
            file = source / f"{n:04d}.json"
            file.write_text("\n".join(json.dumps(r, default=lambda t: t.isoformat()) for r in rows) + "\n")
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age
            n += 1
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", sink).trigger(availableNow=True).start()
        query.awaitTermination(200)
    return spark.read.parquet(sink)


def split(rows, size, rng=None):
    """Runs of ``size`` rows; with ``rng``, rows may stand a few places from their time's."""
    rows = sorted(rows, key=lambda r: r["ts"])
    if rng:
        rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.random() * 4)]
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize(("size", "shuffled", "restart"), [(7, False, None), (40, True, 1)])
def test_jobs(spark, tmp_path, store, size, shuffled, restart):
    rng = random.Random(size)
    rows = []
    for i in range(80):
        at = T0 + timedelta(seconds=i * 2 + rng.random())
        rows.append({"request_id": i, "workspace": f"w{rng.randint(0, 1)}", "type": rng.choice(["sync", "index"]), "ts": at, "done_ts": at + timedelta(seconds=rng.randint(0, 40))})
    schema = "request_id long, workspace string, type string, ts timestamp, done_ts timestamp"
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    want = {(r.request_id, r.job_id) for r in events.distinct_jobs(batch).collect()}
    assert len({j for _, j in want}) < 60
    got = streamed(spark, tmp_path, schema, split(rows, size, rng if shuffled else None), lambda s: ordered.job_stream(s, "20 seconds"), restart)
    assert sorted((r.request_id, r.job_id) for r in got.where("request_id IS NOT NULL").collect()) == sorted(want)


def test_claims_and_releases(spark, tmp_path, store):
    rows = [(1, "k", "claim", None, 0), (2, "k", "claim", None, 1), (3, "k", "release", 2, 2), (4, "k", "release", 1, 3), (5, "k", "claim", None, 4), (6, "other", "claim", None, 4), (7, "k", "claim", None, 5)]
    rows = [{"event_id": e, "key": k, "kind": kind, "holder": h, "ts": T0 + timedelta(minutes=m)} for e, k, kind, h, m in rows]
    schema = "event_id long, key string, kind string, holder long, ts timestamp"
    want = {1: "accepted", 2: "duplicate", 3: "ignored", 4: "released", 5: "accepted", 6: "accepted", 7: "duplicate"}
    batch = events.claims_in_order(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert {r.event_id: r.outcome for r in batch.collect()} == want
    got = streamed(spark, tmp_path, schema, split(rows, 3), ordered.claim_stream, 1)
    assert {r.event_id: r.outcome for r in got.where("event_id IS NOT NULL").collect()} == want


def test_gate(spark, tmp_path, store):
    rows = [(1, "a", "index", 0), (2, "a", "pause", 1), (3, "a", "sync", 2), (4, "b", "sync", 2), (5, "a", "index", 3), (6, "a", "resume", 4), (7, "a", "sync", 5), (8, "b", "pause", 6), (9, "b", "sync", 7)]
    rows = [{"event_id": e, "workspace": w, "kind": k, "ts": T0 + timedelta(minutes=m)} for e, w, k, m in rows]
    got = streamed(spark, tmp_path, "event_id long, workspace string, kind string, ts timestamp", split(rows, 2), ordered.gate_stream)
    passed = {r.event_id for r in got.where("outcome = 'passed' AND event_id IS NOT NULL").collect()}
    assert passed == {1, 3, 4, 5, 7}, "what came to b after its pause waits"


def test_jobs_of_hot_keys_need_no_window(spark):
    rows = spark.range(20_000).select(F.col("id").alias("request_id"), F.lit("w").alias("workspace"), F.lit("t").alias("type"), F.timestamp_seconds("id").alias("ts"), F.timestamp_seconds(F.col("id") + 10).alias("done_ts"), F.lit("x").alias("job_id"))
    out = events.distinct_jobs(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "InPandas" not in plan and plan.count("Exchange") == 1
    assert out.where("job_id <> request_id - request_id % 10").count() == 0 and out.count() == 20_000


def test_jobs_without_times(spark):
    schema = "request_id long, workspace string, type string, ts timestamp_ntz, done_ts timestamp_ntz"
    rows = [(1, None, None, None, None), (2, None, None, T0, None), (3, None, None, T0, T0 + timedelta(1)), (4, None, None, T0 + timedelta(hours=1), None), (5, "w", None, T0, T0)]
    assert {r.request_id: r.job_id for r in events.distinct_jobs(spark.createDataFrame(rows, schema)).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    assert events.distinct_jobs(spark.createDataFrame([], schema)).count() == 0
