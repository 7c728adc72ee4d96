import pytest

from corpusmith.functions import text as T
from corpusmith.operators import search as S

PAGES = "page_id long, path string, title string, content string"


def search(spark, pages, query):
    df = spark.createDataFrame([(i, p, t, c) for i, (p, t, c) in enumerate(pages)], PAGES)
    return [r["path"] for r in S.ranked(S.keyword_scores(df, query), "path", 50).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("pages", "query", "want"),
    [
        ([("wiki/attention.md", "Attention", "x"), ("wiki/other.md", "Other", "attention is here")], "attention", ["wiki/attention.md", "wiki/other.md"]),
        ([("wiki/a.md", "A", "only in the body: quantization")], "Quantization", ["wiki/a.md"]),
        ([("wiki/b.md", "笔记", "今天默会知识很重要"), ("wiki/c.md", "x", "无关")], "默会知识是什么", ["wiki/b.md"]),
        ([("wiki/a.md", "Flash", "attention"), ("wiki/b.md", "Flash Attention", "flash attention")], "flash attention", ["wiki/b.md", "wiki/a.md"]),
        ([("wiki/a.md", "A", "graph"), ("wiki/b.md", "B", "of the with")], "the graph of", ["wiki/a.md"]),
        ([("wiki/rope.md", "Embedding", "-"), ("wiki/z.md", "rope rope rope", "rope " * 20)], "rope", ["wiki/z.md", "wiki/rope.md"]),
        ([("wiki/s.md", "x", "deep reinforcement learning"), ("wiki/t.md", "y", "learning is deep and reinforcement works")], "deep reinforcement learning", ["wiki/s.md", "wiki/t.md"]),
        ([("wiki/a.md", "默会知识", "x")], "默会知识？", ["wiki/a.md"]),
        ([("wiki/a.md", None, None)], "", []),
        ([("wiki/a.md", None, None), (None, "null path", "match")], "match", [None]),
    ],
)
def test_keyword(spark, pages, query, want):
    assert search(spark, pages, query) == want


def test_tokens():
    assert T.query_tokens("The graph, of GRAPH-theory!") == ["graph", "theory"]
    assert T.query_tokens("知识") == ["知识"]
    assert T.query_tokens("默会知") == sorted(["默会", "会知", "默", "会", "知", "默会知"])


def test_column_tokens_equal_literal_ones(spark):
    from pyspark.sql import functions as F

    texts = ["The graph, of GRAPH-theory!", "默会知识是什么 and more", "", "a b", "x的y 图谱数据"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens_of(F.col("t"))).collect()]
    assert out == [T.query_tokens(t) for t in texts]


def test_vectors_and_fusion(spark):
    rows = [("a#0", "a", 0, "t0", [0.0, 0.0]), ("a#1", "a", 1, "t1", [0.0, 1.0]), ("b#0", "b", 0, "t2", [3.0, 4.0]), ("c#0", "c", 0, "bad", [1.0]), ("d#0", "d", 0, "bad", None), ("e#0", "e", 0, "bad", [float("nan"), 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, page_id string, chunk_index int, chunk_text string, embedding array<float>")
    near = S.nearest_chunks(chunks, [0.0, 0.0], 10)
    assert [(r["chunk_id"], round(r["score"], 6)) for r in near.orderBy("distance").collect()] == [("a#0", 1.0), ("a#1", 0.5), ("b#0", round(1 / 6, 6))]
    pages = {r["page_id"]: r for r in S.page_scores(near).collect()}
    assert pages["a"]["score"] == 1.0 and pages["a"]["best_text"] == "t0" and abs(pages["b"]["score"] - 1 / 6) < 1e-9
    a = spark.createDataFrame([("x", 1), ("y", 2)], "page_id string, rank long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "page_id string, rank long")
    fused = {r["page_id"]: r["score"] for r in S.fuse(a, b).collect()}
    assert fused == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})


def test_hybrid_without_vector(spark):
    pages = spark.createDataFrame([(1, "wiki/a.md", "graph", "x"), (2, "wiki/b.md", "b", "graph")], PAGES)
    chunks = spark.createDataFrame([], "chunk_id string, page_id long, chunk_index int, chunk_text string, embedding array<float>")
    out = S.hybrid_search(pages, chunks, "graph", None, 5).collect()
    assert [r["page_id"] for r in out] == [1, 2] and out[0]["vector_rank"] is None
    assert [r["page_id"] for r in S.hybrid_search(pages, chunks, "graph", [0.0], 5).collect()] == [1, 2]


def test_exact_ranks(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, f"p{rnd.randrange(10**6):06}", float(rnd.randrange(5))) for i in range(200)]
    hits = spark.createDataFrame(rows, "page_id long, path string, score double")
    order = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    wanted = spark.createDataFrame([(i,) for i in range(0, 200, 9)] + [(999,)], "page_id long")
    assert {r["page_id"]: r["rank"] for r in S.ranks_of(hits, wanted).collect()} == {i: order[i] for i in range(0, 200, 9)}
