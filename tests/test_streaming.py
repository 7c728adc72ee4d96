from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import changefeed as C
from corpusmith.streaming import run, tasks

SCHEMA = "id string, project_id string, path string, kind string, status string, updated_at long, created_at long, retry_count int, needs_rerun boolean, received_at timestamp"
START = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches):
    """A file stream of the batches, one file each, in order."""
    for i, rows in enumerate(batches):
        full = [(*r[:9], START + timedelta(milliseconds=r[9])) for r in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def row(id_, path, kind, status, updated, at, retry=0, rerun=False, created=0):
    return (id_, "p", path, kind, status, updated, created, retry, rerun, at)


def test_latest_states_equal_batch(spark, tmp_path):
    batches = [
        [row("a", "x", "created", "pending", 1, 0), row("b", "y", "created", "done", 5, 10)],
        [row("a", "x", "created", "done", 3, 20), row("a", "./x", "created", "processing", 2, 15)],
        [row("b", "y", "created", "failed", 4, 30), row("c", None, "created", "done", 1, 1), row("a", "x", "created", "done", 3, 20)],
    ]
    stream = feed(spark, tmp_path, batches)
    got = {tuple(r) for r in run.run_once(tasks.latest_states(stream), "complete", str(tmp_path / "w")).select("id", "path", "status").collect()}
    everything = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    batch = C.latest_version(everything.where("path is not null").withColumn("path", C.normal_path(F.col("path"))), "id", ["updated_at", "created_at"])
    assert got == {tuple(r) for r in batch.select("id", "path", "status").collect()} == {("a", "x", "done"), ("b", "y", "done")}


def test_handled_once(spark, tmp_path):
    batches = [[row("a", "x", "created", "done", 1, 0), row("a", "x", "created", "done", 1, 50)], [row("a", "x", "created", "done", 1, 90), row("a", "x", "created", "done", 2, 95)]]
    stream = tasks.with_event_time(feed(spark, tmp_path, batches))
    assert run.run_once(tasks.handled_once(stream), folder=str(tmp_path / "w")).count() == 2


def test_task_states(spark, tmp_path):
    batches = [
        [row("a", "x", "created", "pending", 1, 0), row("b", "y", "created", "processing", 1, 0), row("c", "z", "created", "failed", 1, 0, 3)],
        [row("a2", "x", "deleted", "pending", 2, 1), row("b2", "y", "modified", "pending", 2, 1), row("c2", "z", "modified", "pending", 2, 1)],
        [row("b", "./y", "created", "done", 3, 2), row("a", "x", "created", "done", 0, 2)],
    ]
    out = run.run_once(tasks.task_states(feed(spark, tmp_path, batches)), "update", str(tmp_path / "w"))
    last = {}
    for r in out.collect():
        last.setdefault(r["path"], set()).add((r["id"], r["kind"], r["status"], r["needs_rerun"]))
    assert ("a2", "modified", "pending", False) in last["x"] and not any(i == "a" and s == "done" for i, _, s, _ in last["x"])
    assert ("b", "created", "processing", True) in last["y"] and ("b", "created", "done", True) in last["y"]
    assert ("c2", "modified", "pending", False) in last["z"]


def test_rate_limit(spark, tmp_path):
    rows = [("c", i, START + timedelta(milliseconds=100 * i)) for i in range(25)] + [("d", 99, START)]
    spark.createDataFrame(rows, "client string, request_id long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, request_id long, at timestamp").parquet(str(tmp_path / "in"))
    out = {r["request_id"]: r["accepted"] for r in run.run_once(tasks.accepted_requests(stream, most=4), folder=str(tmp_path / "w")).collect()}
    recent, want = [], {99: True}
    for _, i, at in rows[:25]:
        recent = [t for t in recent if t > at - timedelta(seconds=1)]
        want[i] = len(recent) < 4
        recent += [at] if want[i] else []
    assert out == want


def test_batching_and_own_writes(spark):
    df = spark.createDataFrame([(*row("a", "x", "created", "done", i, 0)[:9], START + timedelta(milliseconds=t)) for i, t in enumerate([0, 300, 900, 2000, 2100])], SCHEMA)
    assert sorted(r["changes"] for r in tasks.debounced(df).collect()) == [2, 3]
    assert {(r["start"].microsecond // 1000, r["id"]) for r in tasks.coalesced(df).collect()} == {(0, "a"), (250, "a"), (750, "a")}
    changes = spark.createDataFrame([("x", START + timedelta(seconds=s)) for s in (1, 4, 9)] + [("y", START)], "path string, at timestamp")
    writes = spark.createDataFrame([("x", START)], "path string, written_at timestamp")
    left = tasks.without_own_writes(changes, writes).collect()
    assert {(r["path"], (r["at"] - START).seconds) for r in left} == {("x", 9), ("y", 0)}


@pytest.mark.parametrize("name", ["file_change_tasks", "events"])
def test_read_stream(spark, name):
    stream = run.read_stream(spark, "/root/testdata/sf0.001", name)
    assert stream.isStreaming and stream.columns
