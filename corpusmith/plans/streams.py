"""Queries that run the streaming operators over a table until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.operators.changefeed import apply_changes
from corpusmith.streaming import run, tasks
from corpusmith.session import load


def stream_latest_states(spark: SparkSession, d: str) -> DataFrame:
    out = run.run_once(tasks.latest_states(run.read_stream(spark, d, "file_change_tasks")), "complete")
    return out.groupBy("project_id", "status").agg(F.count("*").alias("tasks"))


def stream_current_files(spark: SparkSession, d: str) -> DataFrame:
    """p2_found with the task states kept by a stream."""
    states = run.run_once(tasks.latest_states(run.read_stream(spark, d, "file_change_tasks")), "complete")
    done = states.where("status = 'done'")
    return apply_changes(done, ["project_id", "path"], ["updated_at", "created_at"], F.col("kind") == "deleted", ["id"])


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of events in append mode: windows come out once the watermark passes them, the last ones stay open."""
    events = run.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return run.run_once(counts.select(F.unix_timestamp("w.start").alias("start"), "event_type", "events"))


def burst_changes(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each project's changes, a second apart, over the whole feed as a batch."""
    rows = load(spark, d, "file_change_tasks").withColumn("received_at", F.col("received_at").cast("timestamp")).where("received_at is not null and project_id is not null")
    bursts = tasks.debounced(rows, "1 second")
    return bursts.select("project_id", F.unix_millis("start").alias("start"), "changes")


def coalesced_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "file_change_tasks").withColumn("received_at", F.col("received_at").cast("timestamp")).where("received_at is not null")
    return tasks.coalesced(rows, "1 minute").select("project_id", "path", F.unix_timestamp("start").alias("start"), "id", "kind")


def stream_handled(spark: SparkSession, d: str) -> DataFrame:
    """States of tasks, each handled once, by the number of states a task went through."""
    once = tasks.handled_once(tasks.with_event_time(run.read_stream(spark, d, "file_change_tasks").select("id", "updated_at", "received_at"), "400 days"))
    return run.run_once(once).groupBy("id").agg(F.count("*").alias("states")).groupBy("states").agg(F.count("*").alias("tasks"))


def foreign_changes(spark: SparkSession, d: str) -> DataFrame:
    """Reports of changes but for those that came within 4 seconds after a finished task of the same path."""
    rows = load(spark, d, "file_change_tasks").where("path is not null and received_at is not null")
    rows = rows.select("feed_seq", "path", F.col("received_at").cast("timestamp").alias("at"), "status")
    writes = rows.where("status = 'done'").select("path", F.col("at").alias("written_at"))
    return tasks.without_own_writes(rows.where("status <> 'done'").select("feed_seq", "path", "at"), writes).select("feed_seq", "path")


QUERIES = {f.__name__: f for f in (stream_latest_states, stream_current_files, stream_tumbling, burst_changes, coalesced_changes, stream_handled, foreign_changes)}

_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
_TASK = f"""t as (select * from (select id, project_id, {_PATH} path, status, kind, updated_at, created_at from file_change_tasks where path is not null and updated_at is not null)
  qualify row_number() over (partition by id order by updated_at desc, created_at desc, project_id desc, path desc, status desc, kind desc) = 1)"""

ORACLE = {
    "stream_latest_states": f"with {_TASK} select project_id, status, count(*) as tasks from t group by 1, 2",
    "stream_current_files": f"""with {_TASK} select project_id, path, id from (
        select *, row_number() over (partition by project_id, path order by updated_at desc, created_at desc, id desc) k from t where status = 'done') where k = 1 and kind <> 'deleted'""",
    "stream_handled": """select states, count(*) as tasks from (select id, count(*) states from (select distinct id, updated_at from file_change_tasks where received_at is not null) group by 1) group by 1""",
    "foreign_changes": """with r as (select feed_seq, path, received_at t, status from file_change_tasks where path is not null and received_at is not null)
        select feed_seq, path from (select r.*, w.t as seen from (select * from r where status <> 'done') r asof left join (select path, t from r where status = 'done') w on r.path = w.path and r.t >= w.t)
        where seen is null or t > seen + interval 4 seconds""",
    "burst_changes": """
with f as (select project_id, received_at, case when received_at - lag(received_at) over (partition by project_id order by received_at) < interval 1 second then 0 else 1 end new
  from file_change_tasks where received_at is not null and project_id is not null),
s as (select *, sum(new) over (partition by project_id order by received_at) g from f)
select project_id, epoch_ms(min(received_at)) as start, count(*) as changes from s group by project_id, g""",
    "coalesced_changes": f"""
select project_id, path, start, m.id as id, m.kind as kind from (
  select project_id, {_PATH} path, cast(epoch(date_trunc('minute', received_at)) as bigint) as start, max(struct_pack(updated_at := updated_at, id := id, kind := kind)) m
  from file_change_tasks where path is not null and updated_at is not null and received_at is not null group by 1, 2, 3)""",
}
