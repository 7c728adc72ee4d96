import math

import pytest

from corpusmith.operators import graph as G


@pytest.fixture(scope="module")
def small(spark):
    links = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("x", None)]
    return spark.createDataFrame(links, "src string, dst string")


def test_counts(small):
    assert {(r["a"], r["b"]): r["links"] for r in G.undirected(small).collect()} == {("a", "b"): 3, ("b", "c"): 1, ("c", "d"): 1}
    assert {r["node"]: (r["links"], r["pairs"]) for r in G.link_counts(small).collect()} == {"a": (3, 1), "b": (4, 2), "c": (2, 2), "d": (1, 1)}
    deg = {r["node"]: (r["out_degree"], r["in_degree"], r["degree"], r["neighbors"]) for r in G.degrees(G.distinct_edges(small)).collect()}
    assert deg == {"a": (1, 1, 2, 1), "b": (2, 1, 3, 2), "c": (1, 1, 2, 2), "d": (0, 1, 1, 1)}


def test_relevance_by_hand(spark, small):
    nodes = spark.createDataFrame([("a", "entity"), ("b", "concept"), ("c", "source"), ("d", None)], "node string, type string")
    sources = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), ("d", "t")], "node string, source string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    out = {r["node"]: r["relevance"] for r in G.relevance(nodes, G.distinct_edges(small), sources, seeds).collect()}
    assert out == pytest.approx({"b": 6 + 8 + 1.2, "c": 1.5 / math.log(3) + 1.0})


def test_resolution(spark):
    nodes = spark.createDataFrame([("big-idea",), ("Big Idea",), ("Zed",), (None,)], "node_id string")
    links = spark.createDataFrame([("Big Idea", 1), ("big idea", 2), ("zed", 3), ("nothing", 4), (None, 5)], "target string, n int")
    out = {r["n"]: r["node_id"] for r in G.resolve_links(links, nodes).collect()}
    assert out == {1: "Big Idea", 2: "Big Idea", 3: "Zed", 4: None, 5: None}


def test_insights(spark):
    edges = spark.createDataFrame([("h", f"n{i}", 1.0) for i in range(6)] + [("n0", "n1", 5.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([("h", "source", 0, 6)] + [(f"n{i}", "concept" if i else "source", i % 4, 1 + (i < 2)) for i in range(6)], "node string, type string, community int, links long")
    out = {(r["a"], r["b"]): r["surprise"] for r in G.surprising_edges(edges, nodes).collect()}
    assert out[("h", "n1")] == 3 + 2 + 2 + 1 and out[("h", "n0")] == 3 and ("n0", "n1") in out
    gaps = {(r["gap"], r["id"]) for r in G.knowledge_gaps(edges, nodes).collect()}
    assert ("bridge", "h") in gaps and ("isolated", "n5") in gaps and ("isolated", "n0") not in gaps


def test_communities_find_cliques(spark):
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    edges = [(x, y, 1.0) for g in groups for i, x in enumerate(g) for y in g[i + 1 :]] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    first = {r["node"]: r["community"] for r in G.communities(df).collect()}
    again = {r["node"]: r["community"] for r in G.communities(df).collect()}
    assert first == again
    assert all(len({first[n] for n in g}) == 1 for g in groups) and len(set(first.values())) == 3
    m = G.modularity(df, spark.createDataFrame(list(first.items()), "node string, community string")).first()[0]
    assert m > 0.5


def test_empty(spark):
    edges = spark.createDataFrame([], "a string, b string, weight double")
    assert G.communities(edges).count() == 0
    assert G.undirected(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_search_and_filter(spark):
    nodes = spark.createDataFrame([("a", "Big graph", "concept"), ("b", "graph", "entity"), ("c", None, "concept")], "node string, label string, type string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, links long")
    hit = G.search_nodes(nodes, "GRAPH concept")
    assert [r["node"] for r in hit.collect()] == ["a"]
    assert G.induced(G.search_nodes(nodes, "graph"), edges).count() == 1


def test_page_graph_and_short_lists(spark):
    docs = [
        (1, "---\ntype: concept\nsources: [a.pdf]\n---\n# One\n[[two]] [[Two|x]] [[one]] [[nowhere]]", "wiki/concepts/one-11.md"), (2, "[[one]]", "wiki/entities/two-12.md"),
        (3, None, "wiki/entities/three.md"), (4, "[[three]]", "other/one-99.md"), (5, "[[one]]", None),
    ]
    nodes, links = G.page_graph(spark.createDataFrame(docs, "doc_id long, text string, path string"))
    assert {(r["node"], r["label"], r["type"], tuple(r["sources"])) for r in nodes.collect()} == {("one", "One", "concept", ("a.pdf",)), ("two", "two 12", "entity", ()), ("three", "three", "entity", ())}
    assert sorted(map(tuple, links.collect())) == [("one", "three"), ("one", "two"), ("one", "two"), ("two", "one")]
    none = spark.createDataFrame([], "node string, source string")
    top = G.top_related(G.relevance(nodes, G.distinct_edges(links), none, nodes))
    full = {(r["seed"], r["rank"]): (r["node"], round(r["relevance"], 2)) for r in G.fill_related(top, nodes, nodes).collect()}
    assert {k for k in full} == {(s, r) for s in ("one", "two", "three") for r in (1, 2)}
    alone = spark.createDataFrame([("a", "concept"), ("b", "entity"), ("c", None)], "node string, type string")
    lists = G.fill_related(top.limit(0), alone, alone).orderBy("seed", "rank").collect()
    assert [(r["seed"], r["node"], r["relevance"]) for r in lists] == [("a", "b", 1.2), ("a", "c", 0.5), ("b", "a", 1.2), ("b", "c", 0.5), ("c", "a", 0.5), ("c", "b", 0.5)]


def test_structural_pages_stay_out(spark):
    nodes = spark.createDataFrame([("index", "other", "x", 3, "i"), ("a", "source", "x", 1, "a"), ("b", "concept", "y", 2, "b"), ("c", "overview", "y", 1, "c")], "node string, type string, community string, links long, label string")
    edges = spark.createDataFrame([("a", "index", 1.0), ("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    assert [tuple(r) for r in G.top_surprises(edges, nodes).collect()] == [("a", "b", 8), ("b", "c", 4)]
    assert [tuple(r) for r in G.top_gaps(edges, nodes).collect()] == [("isolated", "a", 1.0)]
    shown, among = G.shown_graph(nodes, edges, "B", limit=0)
    assert [r["node"] for r in shown.collect()] == ["b"] and among.count() == 0
