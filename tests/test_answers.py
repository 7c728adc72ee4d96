from pyspark.sql import functions as F

from corpusmith.functions import answers as A


def test_scalars(spark):
    def say(f, v):
        return spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]

    assert say(A.is_greeting, "Hello there!! ") and say(A.is_greeting, "你好啊。") and not say(A.is_greeting, "hi, what is a graph") and not say(A.is_greeting, None) and not say(A.is_greeting, "...")
    assert say(lambda c: A.cut_bytes(c, 4), "aé数x") == "aé" and say(lambda c: A.cut_bytes(c, 6), "aé数x") == "aé数" and say(lambda c: A.cut_bytes(c, 99), "aé") == "aé" and say(lambda c: A.cut_bytes(c, 3), "") == ""
    assert say(lambda c: A.newer_version(c, F.lit("1.2.3")), "v1.10") and not say(lambda c: A.newer_version(c, F.lit("1.2.3")), "1.2.x") and not say(lambda c: A.newer_version(c, F.lit("1.2.3")), "1.2.3")
    assert say(lambda c: A.cited_numbers(c, 5), "a [9] [2] <!-- cited: 3, 1, x, 8 -->") == [3, 1] and say(lambda c: A.cited_numbers(c, 5), "[2][2] [4] [7]") == [2, 4] and say(lambda c: A.cited_numbers(c, 5), "none") == []
    assert say(A.without_thinking, "<think>a\nb</think> said <thinking>open") == "said"
    assert say(A.links_as_markdown, "a [[B c|d]] `[[x]]` ```\n[[y]]\n``` [[é]]") == "a [d](#B%20c) `[[x]]` ```\n[[y]]\n``` [é](#%C3%A9)"
    df = spark.createDataFrame([([("t", "u", None), (None, "v", "s")],)], "r array<struct<title:string,url:string,snippet:string>>")
    assert df.select(A.numbered_context(F.col("r"))).first()[0] == "[1] t\nu\n\n\n[2] \nv\ns"


def test_paths_and_lists(spark):
    from corpusmith.functions import records as R
    from corpusmith.functions import text as T
    from corpusmith.operators import integrity as I

    def say(f, v):
        return spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]

    assert say(T.safe_path, "a\\b/./c.md") == "a/b/c.md" and say(T.safe_path, "x/a:b?.md").startswith("x/a_b_.md-") and say(T.safe_path, "con.md").startswith("_con.md-")
    df = spark.createDataFrame([(["raw/sources/a.md", "A.md", None], ["q", "Q ", "r", "s", "t"])], "s array<string>, q array<string>")
    assert df.select(T.canonical_sources(F.filter("s", lambda x: x.isNotNull()), F.lit("/p/raw/sources/b.md"))).first()[0] == ["a.md", "b.md"]
    assert df.select(T.first_queries(F.transform("q", lambda v: F.trim(v)))).first()[0] == ["q", "r", "s"]
    assert say(lambda c: T.trim_listing(c, F.array(F.lit("graph")), 30), "# Head\n- Graph one\n- other\n- graph but far too long to fit\n- graph") == "# Head\n- Graph one\n- graph"
    caption = F.create_map(F.lit("a.png"), F.lit("a [nice]\npicture"))
    assert say(lambda c: T.with_captions(c, caption), "x ![](a.png) ![k](b.png) ![") == "x ![a nice picture](a.png) ![k](b.png) !["
    assert say(A.reasoning_text, 'data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}') == "hm" and say(A.reasoning_text, "data: [DONE]") == ""
    assert say(T.source_slug, "plain.pdf") == "plain" and say(T.source_slug, "") == "source" and say(T.source_slug, None) == "source"
    slug = say(T.source_slug, "papers/größe 1.pdf")
    assert slug.startswith("6-papers--") and "%20" in slug and len(say(T.source_slug, "a/" + "ü" * 300)) <= 120
    # one letter apart behind the cut
    assert say(T.source_slug, "a/" + "x" * 300) != say(T.source_slug, "a/" + "x" * 299 + "y")
    pages = spark.createDataFrame([("big-idea", "Big Idea"), (None, "Other")], "slug string, title string")
    assert {r[0] for r in I.deleted_keys(pages).collect()} == {"bigidea", "other"}
    refs = spark.createDataFrame([("x",), ("Y.pdf",), ("none",)], "reference string")
    files = spark.createDataFrame([("wiki/sources/x.md",), ("raw/sources/x",), ("raw/sources/y.pdf",)], "path string")
    assert {r["reference"]: r["path"] for r in I.resolve_files(refs, files).collect()} == {"x": "wiki/sources/x.md", "Y.pdf": "raw/sources/y.pdf", "none": None}
