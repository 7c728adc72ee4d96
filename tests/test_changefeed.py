import random

from pyspark.sql import functions as F

from corpusmith.operators import changefeed as C

TASK = "id string, project_id string, path string, kind string, status string, updated_at long, created_at long, extra string"


def test_normal_path(spark):
    cases = {"a\\b": "a/b", "./a//b": "a/b", "././a": "a", "a/./b": "a/./b", ".hidden": ".hidden", "": "", "a\\\\b": "a/b"}
    df = spark.createDataFrame([*cases.items(), (None, None)], "p string, want string")
    assert df.where(~C.normal_path(F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def plain_state(base, changes):
    state = dict(base)
    for key, at, tie, dead, value in sorted(changes, key=lambda c: (c[1] is not None, c[1] or 0, c[2])):
        if dead:
            state.pop(key, None)
        else:
            state[key] = value
    return state


def test_random_feeds_equal_replay(spark):
    """Late, repeated and contradictory changes, one key with a third of them, with and without a base."""
    rnd = random.Random(5)
    changes = [(rnd.choice(["hot"] * 10 + [f"k{i}" for i in range(20)]), i // 2, i, rnd.random() < 0.3, f"v{i}") for i in range(600)]
    base = {f"k{i}": f"b{i}" for i in range(0, 30, 3)}
    feed = changes + rnd.sample(changes, 200)
    rnd.shuffle(feed)
    df = spark.createDataFrame(feed, "key string, at long, tie long, dead boolean, value string")
    b = spark.createDataFrame(list(base.items()), "key string, value string")
    for start, frame in (({}, None), (base, b)):
        for salts in (1, 7):
            out = C.apply_changes(df, ["key"], ["at", "tie"], F.col("dead"), ["value"], frame, salts).collect()
            assert {r["key"]: r["value"] for r in out} == plain_state(start, changes) and len(out) == len({r["key"] for r in out})


def test_current_files(spark):
    rows = [
        ("t1", "p", "a//b.md", "created", "done", 1, 1, ""), ("t1", "p", "a/b.md", "created", "processing", 0, 1, ""),
        ("t2", "p", "./a/b.md", "deleted", "pending", 5, 5, ""),  # not in effect
        ("t3", "p", "x.md", "created", "done", 1, 1, ""), ("t4", "p", "x.md", "deleted", "done", 2, 2, ""),
        ("t5", "p", "y.md", "created", "done", 3, 1, ""), ("t6", "p", "y.md", "modified", "done", 3, 2, ""),  # tie by created_at
        ("t7", "p", None, "created", "done", 9, 9, ""), ("t8", "p", "z.md", "created", "done", None, 9, ""), (None, "p", "w.md", "created", "done", 1, 1, ""),
        ("t9", None, "n.md", "created", "done", 1, None, ""), ("t3", "p", "x.md", "created", "done", 1, 1, ""),
        ("ta", "p", "s.md", "created", "done", 1, 1, ""), ("ta", "p", "s.md", "created", "failed", 2, 1, ""),  # failed in the end
    ]
    out = {(r["project_id"], r["path"]): r["id"] for r in C.current_files(spark.createDataFrame(rows, TASK)).collect()}
    assert out == {("p", "a/b.md"): "t1", ("p", "y.md"): "t6", (None, "n.md"): "t9"}
    assert C.current_files(spark.createDataFrame([], TASK)).count() == 0


def test_diff(spark):
    old = spark.createDataFrame([("same", "h", 1), ("gone", "h", 1), ("big", None, 9), ("bigger", None, 9), ("new hash", "h", 1)], "path string, hash string, size long")
    new = spark.createDataFrame([("same", "h", 1), ("big", None, 9), ("bigger", None, 10), ("new hash", "i", 1), ("fresh", "x", 1)], old.schema)
    assert {r["path"]: r["kind"] for r in C.diff_snapshots(old, new).collect()} == {"gone": "deleted", "bigger": "modified", "new hash": "modified", "fresh": "created"}


def test_watched(spark):
    cases = {
        "wiki/a.md": True, "wiki/.b/a.md": False, "a/pic.PNG": False, "raw/x/Thumbs.db": False, "node_modules/a.md": False, "raw/tmp/a.md": False,
        "x/raw/tmp/a.md": False, "raw/tmpx/a.md": True, "draft-1.md": False, "wiki\\a.md": True, "a.exe": False, "": False,
    }
    df = spark.createDataFrame([*cases.items(), (None, False)], "p string, want boolean")
    assert [r["p"] for r in df.where(C.watched(F.col("p"), ["raw/tmp"], ["draft-?.md"], ["md", ".png"]) != F.col("want")).collect()] == []


def test_merge_kind(spark):
    cases = [(None, "created", "created"), ("created", "deleted", "modified"), ("deleted", "created", "modified"), ("created", "modified", "created"), ("modified", "deleted", "deleted")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert df.where(C.merge_kind(F.col("a"), F.col("b")) != F.col("want")).count() == 0
