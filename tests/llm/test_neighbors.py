import numpy as np
from pyspark.sql import functions as F

from corpusmith.llm import neighbors as N
from corpusmith.llm.hnsw import Graph


def brute(x, k):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def test_graph_recall():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16)) * 4
    x = (centres[rng.integers(0, 25, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    ids, d = Graph(x).search(x[:300], 11, 64)
    best = np.argsort(((x[:300, None].astype(float) - x[None]) ** 2).sum(2), axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(ids, best)]) > 0.97
    assert (np.diff(d, axis=1) >= -1e-3).all()


def test_graph_sizes():
    for n in (0, 1, 2, 5, 40):
        x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
        ids, _ = (Graph(x) if n else None, None) if not n else Graph(x).search(x, 3)
        if n:
            assert ids.shape[1] == min(3, n) and (ids[:, 0] == np.arange(n)).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>, part int, own int")


def test_all_rows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(f"c{i:03}", [float(v) for v in x[i]], 1, 2) for i in range(400)]
    out = N.nearest(frame(spark, rows), k=5, dim=8, shard=64, probes=4).toPandas()
    near = out.groupby("query_id").distance.apply(sorted).to_dict()
    best = brute(x, 5)
    hits = sum(sum(d <= best[i][-1] + 1e-5 for d in near[f"c{i:03}"]) for i in range(400))
    assert hits / 2000 > 0.9
    assert (out.id != out.query_id).all() and out.groupby("query_id").size().eq(5).all()
    assert np.allclose(out.score, 1 / (1 + out.distance))


def test_copies_and_unusable_vectors(spark):
    v = [float(i) for i in range(4)]
    rows = [(f"a{i:02}", v, 0, 0) for i in range(30)] + [
        ("none", None, 0, 0), ("short", [1.0], 0, 0), ("nan", [1.0, float("nan"), 0.0, 0.0], 0, 0), ("inf", [float("inf"), 1.0, 0.0, 0.0], 0, 0),
        ("gap", [1.0, None, 0.0, 0.0], 0, 0), (None, v, 0, 0), ("z", [9.0, 9.0, 9.0, 9.0], 0, 0),
    ]
    asked = spark.createDataFrame([("a00",), ("a29",), ("none",), ("z",), (None,), ("missing",), ("z",)], "id string")
    out = N.nearest(frame(spark, rows), asked, k=3, dim=4).toPandas()
    got = {q: list(g.sort_values(["distance", "id"]).id) for q, g in out.groupby("query_id")}
    assert got == {"a00": ["a01", "a02", "a03"], "a29": ["a00", "a01", "a02"], "z": ["a00", "a01", "a02"]}


def test_empty(spark):
    assert N.nearest(frame(spark, []), k=3, dim=4).count() == 0


def test_current_vectors(spark):
    from datetime import datetime

    rows = [("a", [1.0], datetime(2024, 1, 1)), ("a", [2.0], datetime(2024, 1, 2)), ("a", [3.0], None), (None, [1.0], None), ("b", None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, upserted_at timestamp_ntz")
    assert {r["id"]: r["embedding"] for r in N.current_vectors(df).collect()} == {"a": [2.0], "b": None}


def test_every_one_of_many_equal_rows_is_answered(spark):
    """Equal vectors at the same place of many Arrow batches are questions of their own."""
    rows = [(f"c{i:03}", [1.0, 2.0, 3.0, 4.0], 0, 0) for i in range(200)] + [("z", [9.0, 9.0, 9.0, 9.0], 0, 0)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        out = N.nearest(frame(spark, rows), k=3, dim=4).toPandas()
    finally:
        spark.conf.set(size, before)
    got = {q: sorted(g.id) for q, g in out.groupby("query_id")}
    assert got == {r[0]: [c for c in ("c000", "c001", "c002", "c003") if c != r[0]][:3] for r in rows}


def test_centres_in_two_levels():
    """Above 256 centres are looked up through coarse cells: nearly always the nearest ones all the same."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(60, 8))[rng.integers(0, 60, 6000)] * 5 + rng.normal(size=(6000, 8))).astype(np.float32)
    centres = N.Centres(x, 400)
    assert 390 <= len(centres) <= 420 and len(centres.coarse) == 20
    found = centres.nearest(x[:500], 10)
    d = ((x[:500, None] - centres.fine[None]) ** 2).sum(2)
    best = np.argsort(d, axis=1)[:, :10]
    assert np.mean(found[:, 0] == best[:, 0]) > 0.98
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, best)]) > 9


def test_recall_of_a_twentieth_against_all(spark):
    """Rows with an id divisible by 20 against all rows, in many shards: recall at 10."""
    rng = np.random.default_rng(9)
    scale = rng.uniform(0.3, 2.0, 30)
    topic = rng.integers(0, 30, 3000)
    x = (rng.normal(size=(30, 16))[topic] * 3 + rng.normal(size=(3000, 16)) * scale[topic, None]).astype(np.float32)
    rows = [(str(i), [float(v) for v in x[i]], 1, 2) for i in range(3000)]
    out = N.nearest(frame(spark, rows), F.col("id").cast("int") % 20 == 0, dim=16, shard=128).toPandas()
    near = out.groupby("query_id").distance.apply(sorted).to_dict()
    assert len(near) == 150
    d = np.sqrt(((x[::20, None].astype(float) - x[None]) ** 2).sum(2))
    best = np.sort(d, axis=1)[:, 10]
    hits = sum(sum(v <= best[i] + 1e-5 for v in near[str(i * 20)]) for i in range(150))
    assert hits / 1500 > 0.95


def test_graph_is_built_without_all_pairs():
    """No step of an insertion compares more than a small part of the shard with another one."""
    x = np.random.default_rng(2).normal(size=(2000, 8)).astype(np.float32)
    g = Graph(x)
    ids, _ = g.search(x, 1)
    assert np.mean(ids[:, 0] == np.arange(2000)) > 0.995
    assert (g.levels[0] >= 0).sum(1).min() > 0
