"""Rebuild the current state of a table from a change feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T


def normal_path(path: Column) -> Column:
    """One spelling of a relative path: ``/`` only, none doubled, no leading ``./``."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(\./)+", "")


def latest_version(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``.

    Repeated rows collapse; rows whose key or first order column is null are
    dropped, since they can't be placed. Ties beyond ``order`` go to the
    greatest remaining columns, so the choice never depends on arrival. The
    aggregate combines on the map side: a hot key costs no more than any other.
    """
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    best = df.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull()).groupBy(key).agg(F.max(row).alias("_row"))
    return best.select(key, *[F.col("_row").getField(c).alias(c) for c in df.columns if c != key])


def _cancel(images: DataFrame, keys: Sequence[str], part: Sequence[Column]) -> DataFrame:
    """Signed multiset over one partitioning: every image counts +1, the image it replaced -1.

    The image before a change is the one the preceding change of the same
    partition left. After summing, each partition keeps one image.
    """
    before = F.lag("_image").over(Window.partitionBy(*keys, *part).orderBy("_image"))
    signed = images.withColumn("_before", before).select(
        *keys,
        F.explode(F.array(F.struct(F.col("_image").alias("image"), F.lit(1).alias("n")), F.struct(F.col("_before").alias("image"), F.lit(-1).alias("n")))).alias("_s"),
    )
    return (
        signed.where(F.col("_s.image").isNotNull())
        .groupBy(*keys, F.col("_s.image").alias("_image"))
        .agg(F.sum("_s.n").alias("_n"))
        .where(F.col("_n") > 0)
        .drop("_n")
    )


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    deleted: Column,
    payload: Sequence[str],
    base: DataFrame | None = None,
    salts: int = 32,
) -> DataFrame:
    """State of a table after a feed of inserts, updates and deletes.

    Each distinct change contributes +1 for the image it leaves and -1 for the
    image it replaces (a repeated change thereby replaces itself); multiplicities are summed together with the rows of
    ``base`` and rows with a positive sum remain. A deletion leaves a tombstone
    image, which cancels what came before it and is dropped at the end.

    changes: rows in any order, repeated or late. ``order`` columns (nulls sort
    first) decide the sequence per key, then the payload.
    base: optional earlier state with ``keys`` and ``payload``; it precedes
    every change. More than one base row of a key counts as its versions, the
    greatest payload last.
    salts: a key's changes are first cancelled within this many slices, then
    across them, so that a key holding a third of the feed isn't one task.

    Null key columns form a key of their own. An empty feed gives base. Extra
    columns are ignored; only ``keys`` and ``payload`` come out.
    """

    def image(df: DataFrame, dead: Column, rank: int) -> DataFrame:
        sequence = [F.col(c) if rank else F.lit(None).cast(changes.schema[c].dataType) for c in order]
        return df.select(
            *keys,
            F.struct(
                F.lit(rank).alias("rank"),
                *[c.alias(f"o{i}") for i, c in enumerate(sequence)],
                *[F.col(c).cast(changes.schema[c].dataType).alias(f"p{i}") for i, c in enumerate(payload)],
                F.coalesce(dead, F.lit(False)).alias("dead"),
            ).alias("_image"),
        )

    images = image(changes, deleted, 1)
    if base is not None:
        images = images.unionByName(image(base, F.lit(False), 0))
    slices = images.withColumn("_salt", F.pmod(F.xxhash64("_image"), F.lit(salts)))
    left = _cancel(_cancel(slices, keys, [F.col("_salt")]), keys, [])
    return left.where(~F.col("_image.dead")).select(*keys, *[F.col(f"_image.p{i}").alias(c) for i, c in enumerate(payload)])


def current_files(tasks: DataFrame) -> DataFrame:
    """Files that exist after all changes of a task feed: project_id, path, id.

    A task is in the state of its latest row; only tasks then ``done`` have
    taken effect. Rows without id, path or updated_at say nothing. The latest
    task in effect (updated_at, then created_at, then id) decides each file.
    """
    rows = tasks.where(F.col("path").isNotNull()).select(
        "id", "updated_at", "created_at", "project_id", normal_path(F.col("path")).alias("path"), "status", "kind"
    )
    done = latest_version(rows, "id", ["updated_at", "created_at"]).where(F.col("status") == "done")
    return apply_changes(done, ["project_id", "path"], ["updated_at", "created_at"], F.col("kind") == "deleted", ["id"])


# --- snapshots, tasks and rules -----------------------------------------------------------

# Extensions of media files, names of junk files and folders that are never watched.
MEDIA = ["png", "jpg", "jpeg", "gif", "webp", "svg", "mp3", "mp4", "mov", "wav", "avi"]
JUNK = [".ds_store", "thumbs.db", "desktop.ini"]
FOLDERS_SKIPPED = [".git", "node_modules", ".obsidian", ".cache", ".trash"]


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots: (path, kind, hash_before, hash_after).

    Both: (path, hash, size), one row a path. A file with equal hash (null
    equals null: too large to hash) and size hasn't changed.
    """
    a = old.select("path", F.col("hash").alias("hash_before"), F.col("size").alias("_s0"), F.lit(1).alias("_old"))
    b = new.select("path", F.col("hash").alias("hash_after"), F.col("size").alias("_s1"), F.lit(1).alias("_new"))
    rows = a.join(b, "path", "full_outer")
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    same = F.col("_old").isNotNull() & F.col("_new").isNotNull() & F.col("hash_before").eqNullSafe(F.col("hash_after")) & F.col("_s0").eqNullSafe(F.col("_s1"))
    return rows.where(~same).select("path", kind.alias("kind"), "hash_before", "hash_after")


def merge_kind(old: Column, new: Column) -> Column:
    """Kind of two changes in a row: a file created and deleted, or deleted and created, was modified."""
    return F.when(old.isNull(), new).when((old == "created") & (new == "deleted"), "modified").when((old == "deleted") & (new == "created"), "modified").when(
        (old == "created") & (new == "modified"), "created"
    ).otherwise(new)


def watched(path: Column, excluded_dirs: Sequence[str] = (), excluded_globs: Sequence[str] = (), include: Sequence[str] = ()) -> Column:
    """Whether a path is watched: no hidden part, media, junk file, excluded folder or glob; in the included extensions if any are named.

    Folders of several parts are prefixes or infixes, single ones any part of
    the path. Globs are tried on the path and on the file name. Null paths aren't.
    """
    low = F.lower(normal_path(path))
    parts = F.split(low, "/")
    name, ext = T.file_name(low), T.extension(low)
    out = ~F.exists(parts, lambda p: p.startswith(".") | p.isin([d for d in [*FOLDERS_SKIPPED, *map(str.lower, excluded_dirs)] if "/" not in d]))
    out = out & ~ext.isin(MEDIA) & ~name.isin(JUNK)
    for folder in (d.lower().strip("/") for d in excluded_dirs if "/" in d.strip("/")):
        out = out & ~F.contains(F.concat(F.lit("/"), low), F.lit(f"/{folder}/"))
    for glob in excluded_globs:
        pattern = T.glob_pattern(glob)
        out = out & ~(low.rlike(pattern) | name.rlike(pattern))
    if include:
        out = out & ext.isin([e.lower().lstrip(".") for e in include])
    return F.coalesce(out, F.lit(False))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks by project and present state: one row a project with a count of each status."""
    rows = tasks.select("id", "project_id", "status", "updated_at", "created_at", "retry_count")
    now = latest_version(rows, "id", ["updated_at", "created_at"])
    states = ["pending", "processing", "done", "failed", "superseded"]
    return now.groupBy("project_id").agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.max("retry_count").cast("long").alias("most_retries"))


def runnable_tasks(tasks: DataFrame, most_retries: int = 3) -> DataFrame:
    """Tasks that may run next: pending ones, and failed ones with tries left; (id, project_id, path, kind)."""
    rows = tasks.where(F.col("path").isNotNull()).select("id", "project_id", normal_path(F.col("path")).alias("path"), "kind", "status", "updated_at", "created_at", "retry_count")
    now = latest_version(rows, "id", ["updated_at", "created_at"])
    ready = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < most_retries))
    return now.where(ready).select("id", "project_id", "path", "kind")
