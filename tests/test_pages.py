"""Page functions and integrity operators on nulls, empty tables, ties and repeated rows."""

from pyspark.sql import functions as F

from corpusmith.functions import predicates as P
from corpusmith.functions import text as T
from corpusmith.operators import integrity as I
from corpusmith.operators import search as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_summaries(spark):
    say = lambda text, path="wiki/a/big-idea.md": one(spark, text, lambda c: T.entity_summary(c, F.lit(path)))
    assert say("no front") is None and say(None) is None and say("") is None
    got = say("---\ntags: [a, b]\n---\n# Head\n| t |\nFirst " + "x" * 300)
    assert (got["slug"], got["type"], got["title"], got["tags"]) == ("big-idea", "unknown", "big-idea", ["a", "b"])
    assert len(got["description"]) == 200 and got["description"].endswith("…")
    assert say("---\ntype: entity\n---\n# only")["description"] is None


def test_lists_written(spark):
    put = lambda text: one(spark, text, lambda c: T.with_list(c, "tags", F.array(F.lit("x$1"), F.lit("y"))))
    assert put("---\ntags: [a]\nz: 1\n---\nB") == '---\ntags: ["x$1", "y"]\nz: 1\n---\nB'
    assert put("---\na: 1\ntags:\n  - a\n  - b\nz: 1\n---\nB") == '---\na: 1\ntags: ["x$1", "y"]\nz: 1\n---\nB'
    assert put("---\na: 1\n---\nB") == '---\na: 1\ntags: ["x$1", "y"]\n---\nB' and put("B") == "B" and put(None) is None


def test_routes(spark):
    df = spark.createDataFrame(
        [("raw/sources/a.pdf", "created"), ("raw/sources/a.exe", "created"), ("raw/sources/a.pdf", "deleted"), ("wiki/x.md", "deleted"), ("wiki/index.md", "deleted"), (None, "deleted"), ("raw/sources/a.pdf", None)],
        "path string, kind string",
    )
    assert [r[0] for r in df.select(P.change_route(F.col("path"), F.col("kind"))).collect()] == ["ingest", "none", "source_deleted", "page_deleted", "none", "none", "none"]
    df = spark.createDataFrame(
        [("wiki/log.md", False), ("wiki/index.md", True), ("wiki/concepts/a.md", True), ("wiki/concepts/a.md", False), ("wiki/entities/a.md", False), ("wiki/../a.md", True), (None, True), ("wiki/b.md", None)],
        "path string, fits boolean",
    )
    assert [r[0] for r in df.select(P.page_route(F.col("path"), F.col("fits"))).collect()] == ["append", "overwrite", "merge", "drop", "merge", "drop", "drop", "merge"]


def test_rewritten_links(spark):
    pages = spark.createDataFrame(
        [("a", "keep", "see [[old|x]] and [[older]] [[old]] [[", 1), ("b", "old", "gone", 2), ("c", "k2", '---\nrelated: [old, New, z]\n---\nnone', 3), ("d", "k3", None, 4), ("e", "k4", "[[new]]", 5)],
        "path string, slug string, text string, old int",
    )
    redirects = spark.createDataFrame([("old", "new"), ("same", "same")], "old string, new string")
    got = rows(I.rewrite_links(pages.select("path", "text"), redirects))
    assert got == {("a", "see [[new|x]] and [[older]] [[new]] [["), ("c", '---\nrelated: ["new", "z"]\n---\nnone')}
    out = I.merge_groups(pages, redirects)
    assert sorted((r["action"], r["path"]) for r in out.collect()) == [("backup", "a"), ("backup", "b"), ("backup", "c"), ("delete", "b"), ("write", "a"), ("write", "c")]
    assert I.merge_groups(pages, redirects.limit(0)).count() == 0


def test_dismissed_and_registered(spark):
    groups = lambda *g: spark.createDataFrame([(list(x),) for x in g], "slugs array<string>")
    got = {r["key"]: r["slugs"] for r in I.dismiss(groups("ab"), groups("bA", "ab", "c", "cc")).collect()}
    assert got == {"a|b": ["a", "b"]}
    t = lambda *r: spark.createDataFrame(list(r), "path string, name string")
    assert rows(I.first_registered([t(("p", "b"), ("p", "a"), (None, "x")), t(("p", "z"), ("q", None), ("", "y"))], "path")) == {("p", "a"), ("q", None)}


def test_images(spark):
    images = spark.createDataFrame([("a/media/7-papers--3-one--x/i.png",), ("media/one/i.png",), ("media\\none\\i.png",), ("x.png",), (None,)], "address string")
    files = spark.createDataFrame([("raw/sources/papers/one.pdf",), ("raw/sources/one.md",), ("raw/sources/one.md",), (None,)], "path string")
    got = {r["address"]: r["path"] for r in I.image_sources(images, files).collect()}
    assert got["media/one/i.png"] == "raw/sources/one.md" and got["media\\none\\i.png"] is None and got["x.png"] is None and len(got) == 5
    results = spark.createDataFrame([(1, "![a graph](x.png) ![](y.png)"), (2, "![other](x.png) ![Graph](z.png)"), (3, None)], "rank int, text string")
    hits = S.image_hits(results.select("rank", T.images_of(F.col("text")).alias("images")), "graph").orderBy(F.desc("match"), "rank", "pos").collect()
    assert [(h["address"], h["match"]) for h in hits] == [("x.png", True), ("z.png", True), ("y.png", False)]


def test_renames_folders_and_tree(spark):
    files = spark.createDataFrame([("raw/sources/a/one.pdf",), ("raw/sources/A/One.pdf",), ("raw/sources/a/two.md",), ("raw/sources/b/two.md",), ("raw/sources/three.md",), (None,)], "path string")
    assert [r["old"] for r in I.safe_renames(files).collect()] == ["One"]
    paths = spark.createDataFrame([("a/b/c.md",), ("a\\b\\c.md",), ("a/.x/d.md",), ("e.md",), (None,), ("",)], "path string")
    assert rows(I.folder_counts(paths)) == {("a", 1), ("a/b", 1)}
    pages = spark.createDataFrame([("w/index.md", "other"), ("w/a.md", "concept"), ("w/b.md", None), (None, "zzz")], "path string, type string")
    assert rows(I.page_tree(pages, ["entity", "concept"])) == {(2, "concept", 1), (3, "other", 1), (3, "zzz", 1)}
