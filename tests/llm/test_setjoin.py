import random

from pyspark.sql import functions as F

from corpusmith.llm import setjoin as J


def sets(spark, rows):
    df = spark.createDataFrame(rows, "id long, raw array<string>, n int")
    return df.select("id", J.normal_values(F.col("raw")).alias("vals"), "n")


def brute(rows, other=None, threshold=0.6, least=3):
    clean = lambda rs: {i: frozenset(v.strip().lower() for v in (vs or []) if v and v.strip()) for i, vs in rs}
    a = clean(rows)
    b = clean(other) if other is not None else a
    return {
        (min(i, j), max(i, j)) for i, x in a.items() for j, y in b.items()
        if i != j and len(x) >= least and len(y) >= least and len(x & y) / len(x | y) >= threshold
    }


def sample(seed, n, start=0):
    """Sets around a few themes, so that many pairs lie near the threshold; one theme holds a third."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        theme = 0 if rnd.random() < 0.33 else rnd.randrange(1, 12)
        pool = [f"v{theme}_{k}" for k in range(7)] + ["common", "ai"]
        rows.append((start + i, [rnd.choice([v, v.upper(), f" {v} "]) for v in rnd.sample(pool, rnd.randint(0, 7))]))
    return rows


def test_against_brute_force(spark):
    rows = sample(1, 220)
    df = sets(spark, [(*r, 1) for r in rows] + [(*r, 1) for r in rows[:20]])
    got = [(r["id_a"], r["id_b"]) for r in J.similar_records(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_two_tables(spark):
    left, right = sample(2, 90), sample(3, 120, 1000)
    got = {(r["id_a"], r["id_b"]) for r in J.similar_records(sets(spark, [(*r, 1) for r in left]), sets(spark, [(*r, 2) for r in right])).collect()}
    assert got == brute(left, right)


def test_hot_buckets_lose_nothing(spark):
    """With every bucket treated as hot the pairs are the same."""
    rows = sample(5, 150)
    df = sets(spark, [(*r, 1) for r in rows]).where(F.size("vals") >= 3).select(F.xxhash64("vals").alias("set_id"), "vals").distinct().withColumn("side", F.lit(1))
    cool = {(r["set_a"], r["set_b"]) for r in J.similar_sets(df).collect()}
    hot = {(r["set_a"], r["set_b"]) for r in J.similar_sets(df, hot=1).collect()}
    assert cool == hot and cool


def test_nulls_and_empties(spark):
    rows = [(1, None), (2, []), (3, ["a", None, " ", "b", "c"]), (4, ["A", "b ", "c", "c"]), (None, ["a", "b", "c"]), (5, ["a", "b"])]
    got = J.similar_records(sets(spark, [(*r, 1) for r in rows])).collect()
    assert [(r["id_a"], r["id_b"], r["jaccard"]) for r in got] == [(3, 4, 1.0)]
    assert J.similar_records(sets(spark, [])).count() == 0
    classes = {r["id"]: (r["class_id"], r["links"]) for r in J.similar_classes(sets(spark, [(*r, 1) for r in rows])).collect()}
    assert classes == {1: (None, 0), 2: (None, 0), 3: (3, 0), 4: (3, 0), 5: (None, 0)}


def test_source_paths(spark):
    df = spark.createDataFrame([(["Raw\\Sources\\a\\B.md ", "/srv/x/raw/sources/a/b.md", "c.md"],)], "s array<string>")
    assert df.select(J.normal_values(F.col("s"), source_paths=True)).first()[0] == ["a/b.md", "c.md"]


def test_bucket_pairs_stream():
    """Whatever the batches, small buckets give their pairs and large ones their entries, each once."""
    import itertools

    import pyarrow as pa

    rnd = random.Random(8)
    rows = [(b, i, 4, 1) for b, n in enumerate([1, 3, 40, 2, 35, 1, 5, 60, 60, 2]) for i in sorted(rnd.sample(range(1000), n))]
    groups = {b: [r[1] for r in rows if r[0] == b] for b in range(10)}
    want = {p for ids in groups.values() if len(ids) <= 30 for p in itertools.combinations(ids, 2)}
    left = {(i, b) for b, ids in groups.items() if len(ids) > 30 for i in ids}
    for size in (1, 7, 31, 50, 500):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*p, strict=True), types, strict=True)], names=["bucket", "set_id", "n", "side"]) for p in parts]
        out = [r for batch in J._bucket_pairs(0.6, 30, None)(iter(batches)) for r in batch.to_pylist()]
        pairs = [(r["set_a"], r["set_b"]) for r in out if r["bucket"] is None]
        entries = [(r["set_a"], r["bucket"]) for r in out if r["bucket"] is not None]
        assert set(pairs) == want and sorted(entries) == sorted(left)
