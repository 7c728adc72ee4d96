"""The change feed as a stream: batching, deduplication, task states and rate limits.

Every function takes a streaming DataFrame with an event time (timestamp) and
returns a streaming DataFrame; the caller chooses sink and trigger. Each has a
batch twin in corpusmith.operators or takes a batch DataFrame as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmith.operators.changefeed import normal_path


def with_event_time(tasks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A feed with a watermark on received_at; rows without one can't be placed in time and are dropped."""
    at = F.col("received_at").cast("timestamp")
    return tasks.withColumn("received_at", at).where("received_at is not null").withWatermark("received_at", delay)


def debounced(tasks: DataFrame, silence: str = "700 milliseconds") -> DataFrame:
    """Bursts of changes of each project, ended by silence: (project_id, start, end, changes, paths)."""
    bursts = tasks.groupBy("project_id", F.session_window("received_at", silence).alias("w")).agg(
        F.count("*").alias("changes"), F.approx_count_distinct("path").alias("paths")
    )
    return bursts.select("project_id", "w.start", "w.end", "changes", "paths")


def coalesced(tasks: DataFrame, width: str = "250 milliseconds") -> DataFrame:
    """The last change of each file in each short window: (project_id, path, start, id, kind)."""
    rows = tasks.where("path is not null and updated_at is not null").withColumn("path", normal_path(F.col("path")))
    last = rows.groupBy("project_id", "path", F.window("received_at", width).alias("w")).agg(F.max(F.struct("updated_at", "id", "kind")).alias("m"))
    return last.select("project_id", "path", "w.start", "m.id", "m.kind")


def handled_once(tasks: DataFrame) -> DataFrame:
    """Each state of a task once (id, updated_at), however often it is reported while the watermark remembers it."""
    return tasks.dropDuplicatesWithinWatermark(["id", "updated_at"])


def without_own_writes(changes: DataFrame, writes: DataFrame, seconds: int = 4) -> DataFrame:
    """Changes that don't follow a write of our own to the same path within so many seconds.

    changes: (path, at, ...), writes: (path, written_at), both with watermarks.
    An outer interval join; a change comes out once the watermark rules out a
    write for it. A write is joined by the two stretches of time it reaches
    into, so that a path written to very often doesn't meet all its changes.
    """
    step = lambda c: F.floor(F.unix_micros(F.col(c)) / (seconds * 1_000_000))
    w = writes.select(F.col("path").alias("_p"), "written_at", F.explode(F.array(step("written_at"), step("written_at") + 1)).alias("_w"))
    near = (F.col("path") == F.col("_p")) & (F.col("_c") == F.col("_w")) & (F.col("at") >= F.col("written_at"))
    near = near & (F.col("at") <= F.col("written_at") + F.expr(f"interval {seconds} seconds"))
    return changes.withColumn("_c", step("at")).join(w, near, "left_outer").where("_p is null").drop("_p", "_w", "_c", "written_at")


def accepted_requests(requests: DataFrame, most: int = 120, seconds: float = 1.0) -> DataFrame:
    """Requests a sliding-window limiter lets through: (client, request_id, at, accepted).

    requests: (client, request_id, at). Only accepted requests fill the window,
    so the answer depends on order; a client's window is kept as keyed state of
    at most ``most`` times. Within a micro-batch requests are taken by time.
    """

    def limit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        accepted = []
        for at in rows["at"].astype("int64") / 1e9 if rows["at"].dtype.str.endswith("[ns]") else rows["at"].map(lambda t: t.timestamp()):
            recent = [t for t in recent if t > at - seconds]
            accepted.append(len(recent) < most)
            if accepted[-1]:
                recent.append(at)
        state.update((recent,))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "at": rows["at"], "accepted": accepted})

    return requests.groupBy("client").applyInPandasWithState(
        limit, "client string, request_id long, at timestamp, accepted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout
    )


def task_states(tasks: DataFrame) -> DataFrame:
    """Present state of each file's work: (project_id, path, id, kind, status, retry_count, needs_rerun).

    One live task per file. A change while a task is processing asks for a
    rerun; a newer change replaces a pending task, merging kinds; a failed task
    is revived by a new change; an answer counts only if it isn't older than
    the state (updated_at). Keyed state per file; update mode.
    """

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(("id", "kind", "status", "retry_count", "needs_rerun", "updated_at"), state.get, strict=True)) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["updated_at", "created_at", "id"])
        for row in rows.to_dict("records"):
            if now is None or now["status"] in ("done", "failed", "superseded"):
                if now is None or row["updated_at"] >= now["updated_at"]:
                    now = {k: row[k] for k in ("id", "kind", "status", "retry_count", "needs_rerun", "updated_at")}
            elif row["id"] == now["id"]:
                if row["updated_at"] >= now["updated_at"]:
                    now |= {k: row[k] for k in ("status", "retry_count", "updated_at")}
                    now["needs_rerun"] = bool(now["needs_rerun"] or row["needs_rerun"])
            elif now["status"] == "processing" and row["status"] == "pending":
                now["needs_rerun"] = True
            elif row["updated_at"] >= now["updated_at"]:
                old, kind = now["kind"], row["kind"]
                merged = "modified" if {old, kind} == {"created", "deleted"} else "created" if (old, kind) == ("created", "modified") else kind
                now = {k: row[k] for k in ("id", "status", "retry_count", "needs_rerun", "updated_at")} | {"kind": merged}
        state.update((now["id"], now["kind"], now["status"], int(now["retry_count"] or 0), bool(now["needs_rerun"]), int(now["updated_at"])))
        shown = {"project_id": key[0], "path": key[1]} | {k: now[k] for k in ("id", "kind", "status", "retry_count", "needs_rerun")}
        yield pd.DataFrame([shown])

    rows = tasks.where("path is not null and updated_at is not null and id is not null").select(
        F.coalesce("project_id", F.lit("")).alias("project_id"), normal_path(F.col("path")).alias("path"), "id", "kind", "status", "updated_at", "created_at",
        F.coalesce("retry_count", F.lit(0)).cast("int").alias("retry_count"), F.coalesce("needs_rerun", F.lit(False)).alias("needs_rerun"),
    )
    return rows.groupBy("project_id", "path").applyInPandasWithState(
        advance, "project_id string, path string, id string, kind string, status string, retry_count int, needs_rerun boolean",
        "id string, kind string, status string, retry_count int, needs_rerun boolean, updated_at long", "update", GroupStateTimeout.NoTimeout,
    )


def latest_states(tasks: DataFrame) -> DataFrame:
    """The latest row of each task of a feed, as a running aggregate: (id, project_id, path, status, kind, updated_at, created_at)."""
    row = F.struct("updated_at", "created_at", "project_id", normal_path(F.col("path")).alias("path"), "status", "kind")
    best = tasks.where("path is not null and updated_at is not null").groupBy("id").agg(F.max(row).alias("m"))
    return best.select("id", "m.*")
