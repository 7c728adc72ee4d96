"""Queries on the change feed and on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.operators import changefeed as C
from corpusmith.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.current_files(load(spark, d, "file_change_tasks"))


def task_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.task_summary(load(spark, d, "file_change_tasks"))


def runnable_tasks(spark: SparkSession, d: str) -> DataFrame:
    return C.runnable_tasks(load(spark, d, "file_change_tasks"))


def watched_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "file_change_tasks").where("path is not null").select(C.normal_path(F.col("path")).alias("path")).distinct()
    return rows.where(C.watched(F.col("path"), ["raw/sources/minutes", "queries"], ["*-1?.md"], ["md", "pdf"]))


def _snapshot(spark: SparkSession, d: str, keep: Column) -> DataFrame:
    """State of every path of the feed among the rows kept: hash and size of the latest done row."""
    rows = load(spark, d, "file_change_tasks").where(F.col("path").isNotNull() & (F.col("status") == "done") & keep)
    path = F.concat_ws("/", "project_id", C.normal_path(F.col("path")))
    rows = rows.select(path.alias("path"), "updated_at", "created_at", "id", F.col("hash_after").alias("hash"), "size", "kind")
    return C.latest_version(rows, "path", ["updated_at", "created_at", "id"]).where("kind <> 'deleted'").select("path", "hash", "size")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    cut = F.col("updated_at") % 10 < 7
    return C.diff_snapshots(_snapshot(spark, d, cut), _snapshot(spark, d, F.lit(True)))


def merged_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the last two tasks of each file come to."""
    rows = load(spark, d, "file_change_tasks").where("path is not null and updated_at is not null")
    last = C.latest_version(rows.select("id", "project_id", C.normal_path(F.col("path")).alias("path"), "kind", "updated_at", "created_at"), "id", ["updated_at", "created_at"])
    # two tasks a file are kept on the map side before anything is sorted together
    order = Window.partitionBy("project_id", "path").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    two = last.withColumn("k", F.row_number().over(order)).where("k <= 2")
    kinds = two.groupBy("project_id", "path").agg(F.max(F.when(F.col("k") == 1, F.col("kind"))).alias("new"), F.max(F.when(F.col("k") == 2, F.col("kind"))).alias("old"))
    return kinds.select("project_id", "path", C.merge_kind(F.col("old"), F.col("new")).alias("kind"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.count("*").alias("events"))
    return rows.select("user_id", "event_type", "m.event_id", F.round("m.value", 6).alias("value"), "events")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    """The last three events of every user, oldest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = _events(spark, d).withColumn("k", F.row_number().over(order)).where("k <= 3")
    oldest = Window.partitionBy("user_id").orderBy(F.desc("k"))
    return last.select("user_id", F.row_number().over(oldest).cast("long").alias("position"), "event_id")


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("v"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), "event_type", "events", F.round("v", 4).alias("total"))


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), "events")


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.unix_timestamp("w.start").alias("start"), "events")


def requests_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same user in the minute up to each event.

    Each event is sorted with those of its own minute and shown to the next
    one, so that a busy user is cut into minutes instead of being one task.
    """
    at = F.unix_micros("ts")
    minute = F.floor(at / 60_000_000)
    rows = _events(spark, d).select("event_id", "user_id", at.alias("at"), F.explode(F.array(F.struct(minute.alias("m"), F.lit(True).alias("own")), F.struct((minute + 1).alias("m"), F.lit(False).alias("own")))).alias("s"))
    w = Window.partitionBy("user_id", "s.m").orderBy("at").rangeBetween(-60_000_000, 0)
    return rows.select("event_id", "s.own", F.count("*").over(w).alias("requests")).where("own").drop("own")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first event with each property value, whatever its case."""
    key = F.lower(F.get_json_object("props", "$.k"))
    rows = _events(spark, d).select(key.alias("key"), "ts", "event_id").where("key is not null")
    return rows.groupBy("key").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"), F.count("*").alias("events"))


def json_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return _events(spark, d).groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, task_summary, runnable_tasks, watched_files, snapshot_diff, merged_kinds, latest_per_key, history_window,
        tumbling_counts, sliding_counts, session_counts, requests_in_window, first_seen, json_totals,
    )
}

_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
_LAST = f"""
rows_ as (select id, project_id, {_PATH} path, status, kind, updated_at, created_at, retry_count, hash_after, size from file_change_tasks where path is not null and updated_at is not null),
task as (select * from rows_ qualify row_number() over (partition by id order by updated_at desc, created_at desc, project_id desc, path desc, kind desc, status desc, retry_count desc) = 1)"""
_KEPT = f"""(select project_id || '/' || {_PATH} path, hash_after hash, size, kind from file_change_tasks where path is not null and updated_at is not null and status = 'done' {{}}
  qualify row_number() over (partition by project_id || '/' || {_PATH} order by updated_at desc, created_at desc, id desc, hash_after desc nulls last, size desc nulls last) = 1)"""

ORACLE = {
    "p2_found": f"""with {_LAST}
select project_id, path, id from (select *, row_number() over (partition by project_id, path order by updated_at desc, created_at desc, id desc) k from task where status = 'done')
where k = 1 and kind <> 'deleted'""",
    "task_summary": """
with t as (select * from file_change_tasks where updated_at is not null and id is not null qualify row_number() over (partition by id order by updated_at desc, created_at desc, project_id desc, status desc, retry_count desc) = 1)
select project_id, count(*) as tasks, """
    + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("pending", "processing", "done", "failed", "superseded"))
    + ", cast(max(retry_count) as bigint) as most_retries from t group by 1",
    "runnable_tasks": f"with {_LAST} select id, project_id, path, kind from task where status = 'pending' or (status = 'failed' and retry_count < 3)",
    "watched_files": f"""
select distinct path from (select {_PATH} path from file_change_tasks where path is not null)
where len(list_filter(string_split(lower(path), '/'), lambda p: starts_with(p, '.') or p in ('.git', 'node_modules', '.obsidian', '.cache', '.trash', 'queries'))) = 0
  and not contains('/' || lower(path), '/raw/sources/minutes/') and not regexp_matches(lower(path), '^.*-1.\\.md$') and regexp_matches(lower(path), '[^/]\\.(md|pdf)$')""",
    "snapshot_diff": f"""
with a as (select * from {_KEPT.format("and updated_at % 10 < 7")} where kind <> 'deleted'), b as (select * from {_KEPT.format("")} where kind <> 'deleted')
select path, case when a.kind is null then 'created' when b.kind is null then 'deleted' else 'modified' end as kind, a.hash as hash_before, b.hash as hash_after
from a full join b using (path) where a.kind is null or b.kind is null or a.hash is distinct from b.hash or a.size is distinct from b.size""",
    "merged_kinds": f"""with {_LAST},
k as (select project_id, path, kind, row_number() over (partition by project_id, path order by updated_at desc, created_at desc, id desc) k from task),
m as (select project_id, path, max(kind) filter (k = 1) n, max(kind) filter (k = 2) o from k where k <= 2 group by 1, 2)
select project_id, path, case when o is null then n when o = 'created' and n = 'deleted' then 'modified' when o = 'deleted' and n = 'created' then 'modified' when o = 'created' and n = 'modified' then 'created' else n end as kind from m""",
    "latest_per_key": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, round(arg_max(value, (ts, event_id)), 6) as value, count(*) as events from events group by 1, 2",
    "history_window": """select user_id, row_number() over (partition by user_id order by k desc) as position, event_id
from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 3""",
    "tumbling_counts": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
    "sliding_counts": """select cast(s as bigint) as start, count(*) as events from (
select unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) s from events) group by 1""",
    "session_counts": """
with f as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) g from f)
select user_id, cast(floor(epoch(min(ts))) as bigint) as start, count(*) as events from s group by user_id, g""",
    "requests_in_window": "select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 60000000 preceding and current row) as requests from events",
    "first_seen": "select lower(props ->> '$.k') as key, arg_min(event_id, (ts, event_id)) as event_id, count(*) as events from events where (props ->> '$.k') is not null group by 1",
    "json_totals": "select event_type, cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as total, count(*) filter ((props ->> '$.k') is null) as missing from events group by 1",
}
