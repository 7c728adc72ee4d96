import random

import pytest
from pyspark.sql import functions as F

from corpusmith.functions import language as L
from corpusmith.functions import markdown as M
from corpusmith.functions import records as R
from corpusmith.functions import text as T
from corpusmith.operators import chunking as C
from corpusmith.operators import integrity as I


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "language"),
    [
        ("The quick brown fox", "English"), ("这是中文", "Chinese"), ("これは日本語です漢字", "Japanese"), ("한국어 문장", "Korean"), ("Это по-русски", "Russian"),
        ("der Hund und die Katze", "German"), ("le chat est une bête", "French"), ("el niño y las casas", "Spanish"), ("สวัสดีครับ", "Thai"), ("مرحبا بالعالم", "Arabic"),
        ("", "English"), (None, "English"), ("Tôi yêu tiếng Việt đẹp", "Vietnamese"), ("Καλημέρα κόσμε", "Greek"), ("नमस्ते दुनिया", "Hindi"), ("ሰላም ለዓለም", "Amharic"),
        ("il gatto che dorme", "Italian"), ("漢", "English"), ("این کتاب برای شما است", "Persian"), ("هذا كتاب من المكتبة", "Arabic"), ("پچ گژ", "Persian"),
        ("jeg er hjemme og på tur", "Norwegian"), ("jeg går til bageren af lyst på ø", "Danish"), ("bu değil için şey", "Turkish"), ("aceasta este o carte în română", "Romanian"), ("não há coração", "Portuguese"),
    ],
)
def test_language(spark, text, language):
    assert one(spark, text, L.language_of) == language


def test_text_functions(spark):
    s = lambda f, v: one(spark, v, f)
    assert s(lambda c: T.occurrences(c, F.lit("aa")), "aaaaa") == 2 and s(lambda c: T.occurrences(c, F.lit("")), "x") == 0
    assert s(T.file_stem, "a\\b/.hidden") == ".hidden" and s(T.file_stem, "a/b.v2.md") == "b.v2" and s(T.extension, "a/B.MD") == "md" and s(T.extension, "a/.md") == ""
    assert s(T.folder_context, "/x/raw/sources/papers/2024/a.pdf") == "papers > 2024" and s(T.source_identity, "Raw\\Sources\\a.md") == "a.md"
    assert s(T.link_key, "wiki/Big_Idea two.md") == "bigideatwo" and s(T.slug_of, "  Ünïcode — title! ") == "ünïcode-title"
    assert s(T.host_of, "https://www.example.org/x?y") == "example.org" and s(T.host_of, "nonsense") == ""
    assert s(lambda c: T.snippet(c, "needle", 3), "aaaa\nNeedle bbbb") == "...aa Needle bb..." and s(lambda c: T.snippet(c, "zzz"), "abc") == "abc"
    assert s(lambda c: T.snippet(c, "zzz", 2, ["q", "needle"]), "aaaa Needle bbbb") == "...a Needle b..." and s(lambda c: T.snippet(c, "zzz"), None) is None
    assert [tuple(x) for x in s(T.wiki_links, "[[a]] [[ b | the b ]] [[]] [[c|]]")] == [("a", ""), ("b", "the b"), ("c", "")]
    assert s(T.local_images, "![x](a.png) ![[b.png]] ![y](http://c/d.png) ![z](a.png)") == ["a.png", "b.png"]
    assert s(T.review_title, " Missing page:  The   Thing ") == "the thing"
    front = "type: x\ntitle: 'A b'\ntags: [a, \"b\"]\nsources:\n  - s1\n  - s2\n"
    assert s(lambda c: T.scalar_field(c, "title"), front) == "A b" and s(lambda c: T.list_field(c, "tags"), front) == ["a", "b"]
    assert s(lambda c: T.list_field(c, "sources"), front) == ["s1", "s2"] and s(lambda c: T.list_field(c, "none"), front) == []
    df = spark.createDataFrame([(["A", "b"], ["a", "C", "c", " "])], "x array<string>, y array<string>")
    assert df.select(T.union_ignoring_case(F.col("x"), F.col("y"))).first()[0] == ["A", "b", "C"]


def random_markdown(rnd):
    parts = []
    for _ in range(rnd.randint(0, 12)):
        kind = rnd.randrange(6)
        words = " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", ".", ",", "!"]) for _ in range(rnd.randint(1, 120)))
        parts.append(["#" * rnd.randint(1, 4) + " Head " + words[:20], words, "```\n# not a heading\n\n" + words + "\n```", "| a | b |\n|---|---|\n| c | d |", "- " + words, words.replace(" ", "")][kind])
    return "\n\n".join(parts) + "\n" * rnd.randint(0, 3)


def test_chunks_cover_every_character_once():
    rnd = random.Random(3)
    for _ in range(60):
        text = rnd.choice(["", "---\na: b\n---\n\n"]) + random_markdown(rnd)
        for options in (M.Options(), M.Options(60, 90, 20, 15)):
            out = M.chunks(text, options)
            at = M.front_end(text)
            for i, c in enumerate(out):
                assert c["chunk_index"] == i and not text[at : c["char_start"]].strip() and c["char_end"] > c["char_start"] >= c["overlap_start"]
                assert c["char_start"] - c["overlap_start"] <= options.overlap and c["oversized"] == (c["char_end"] - c["char_start"] > options.most)
                at = c["char_end"]
            assert not text[at:].strip()


def test_chunk_headings():
    out = M.chunks("# A\n\ntext\n\n## B\n\nmore\n\n```\n# no\n```\n\n# C\nend")
    assert [c["heading_path"] for c in out] == ["# A", "# A > ## B", "# C"]


def test_answer_parsers(spark):
    text = "x\n---FILE: wiki/a.md---\n```\n---END FILE---\n```\nbody\n---END FILE---\n---FILE: ---\nq\n---END FILE---\n---FILE: wiki/b.md---\nopen"
    df = spark.createDataFrame([(1, text, 7), (2, None, 7), (3, "", 7)], "id long, text string, path int")
    out = [tuple(r) for r in C.parse_files(df).collect()]
    assert out == [(1, "wiki/a.md", "```\n---END FILE---\n```\nbody", ""), (1, None, None, "no path"), (1, "wiki/b.md", "open", "not closed")]
    review = "---REVIEW: odd | A title---\nSome text\nOPTIONS: Yes | No\nPAGES: a.md, b.md\n---END REVIEW---"
    got = C.parse_reviews(spark.createDataFrame([(1, review)], "id long, text string")).first()
    assert (got["type"], got["title"], got["description"], got["options"], got["pages"], got["queries"]) == ("confirm", "A title", "Some text", ["Yes", "No"], ["a.md", "b.md"], [])
    assert M.first_json('x {"a": "}{", "b": {"c": 1}} {') == '{"a": "}{", "b": {"c": 1}}' and M.first_json("{ no") is None


def test_records(spark):
    assert R.front_record("\n---\ntitle: x\ntags: [a, b]\nrelated: [[p]], [[q]]\nmore: {a: 1}\n---\nbody") == {"title": ["x"], "tags": ["a", "b"], "related": ["[[p]]", "[[q]]"], "more": ['{"a": "1"}']}
    assert R.front_record("no front") is None and R.front_record("---\n: : :\n---\n") is None
    assert R.sanitize("```markdown\n---\na: b\n---\ntext\n```") == "---\na: b\n---\ntext" and R.sanitize("title: x\n---\nbody") == "---\ntitle: x\n---\nbody"
    assert R.link_first_mentions("---\na: Term\n---\n`Term` Term Term", [("Term", "term-page")]) == "---\na: Term\n---\n`Term` [[term-page|Term]] Term"
    assert R.fnv64("") == "cbf29ce484222325"


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([50, 60, 40, 20, 10])] + [(2, 0, 9, 500)], "query_id long, rank long, page_id long, size long")
    out = [(r["rank"], r["used"]) for r in C.pack_context(df, 100).orderBy("rank").collect()]
    assert out == [(0, 50), (2, 90), (4, 100)]


def test_links_after_deletion(spark):
    f = lambda c: I.strip_links(c, ["deadpage"])
    assert one(spark, "a [[Dead Page]] b [[dead-page|shown]] [[live]] [[x", f) == "a Dead Page b shown [[live]] [[x"
    assert one(spark, "- [[dead_page]] x\n- [[live]]\ntext [[dead_page]]", lambda c: I.clean_listing(c, F.array(F.lit("deadpage")))) == "- [[live]]\ntext [[dead_page]]"
    assert one(spark, "[[old]] [[old|x]] [[older]]", lambda c: I.redirect_links(c, {"old": "new"})) == "[[new]] [[new|x]] [[older]]"


def test_reviews(spark):
    items = spark.createDataFrame(
        [("missing-page", "Missing page: X", "", ["a"], ["q1"], None, 1), ("missing-page", "x ", "said", ["b", "a"], None, "s", 2), (None, None, None, None, None, None, 3)],
        "type string, title string, description string, pages array<string>, queries array<string>, source string, ord int",
    )
    out = {r["key"]: r for r in I.merge_reviews(items).collect()}
    assert out["x"]["pages"] == 2 and out["x"]["queries"] == 1 and out[""]["pages"] == 0
    values = I.review_values(items).where("field = 'pages'").orderBy("ord", "pos")
    assert [r["value"] for r in values.collect()] == ["a", "b"]
    assert out["x"]["description"] == "said" and out["x"]["source"] == "s" and out[""]["type"] == "confirm"
    r = spark.createDataFrame([(1, "missing-page", "Big Idea", None), (2, "missing-page", "other", ["wiki/here.md"]), (3, "duplicate", "d", ["here.md", "gone.md"]), (4, "duplicate", "d", ["here.md"]), (5, "suggestion", "here", None), (6, "missing-page", "nowhere", [])], "review_id int, type string, title string, pages array<string>")
    ids = spark.createDataFrame([("big-idea",), ("Here",)], "id string")
    assert {x["review_id"]: x["resolved"] for x in I.sweep_reviews(r, ids).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_page_merge_and_cache(spark):
    schema = "path string, body string, tags array<string>, sources array<string>"
    old = spark.createDataFrame([("same", "b", ["x"], []), ("lists", "b", ["x"], []), ("short", "b" * 100, ["x"], []), ("new body", "b" * 10, [], [])], schema)
    new = spark.createDataFrame([("same", "b ", ["X"], []), ("lists", "b", ["y"], []), ("short", "c", ["y"], []), ("new body", "c" * 9, [], []), ("fresh", "f", None, None)], schema)
    assert {r["path"]: r["outcome"] for r in I.merge_pages(old, new, "d").collect()} == {"same": "same", "lists": "lists", "short": "rejected", "new body": "updated", "fresh": "created"}
    cache = spark.createDataFrame([("a", "h", ["x"]), ("b", "h", ["x", "gone"]), ("c", "old", ["x"])], "source string, hash string, outputs array<string>")
    src = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "new")], "source string, hash string")
    assert [r[0] for r in I.cache_hits(cache, src, spark.createDataFrame([("x",)], "path string")).collect()] == ["a"]
    fate = I.delete_fate(spark.createDataFrame([(1, "A"), (1, "b"), (2, "a"), (3, "c"), (2, "a"), (4, None)], "page_id long, source string"), spark.createDataFrame([("a",)], "source string"))
    assert {r["page_id"]: r["fate"] for r in fate.collect()} == {1: "keep", 2: "delete"}


def test_traces_stamps_and_listings(spark):
    pages = [(1, "wiki/sources/report-2024.md", "text"), (2, "wiki/a.md", '---\nsources: ["x/Report.pdf"]\n---\nsays "report.pdf"'), (3, "wiki/b.md", 'the "REPORT.pdf" says'), (4, None, None)]
    out = I.pages_of_source(spark.createDataFrame(pages, "page_id long, path string, text string"), spark.createDataFrame([("raw/sources/report.pdf",), (None,)], "source string"))
    assert {(r["page_id"], r["way"]) for r in out.collect()} == {(1, "summary"), (2, "listed"), (3, "quoted")}
    stamp = lambda text: one(spark, text, lambda c: T.with_scalar(c, "updated", F.lit("now")))
    assert stamp("---\na: 1\nupdated: x\n---\nBody") == "---\na: 1\nupdated: now\n---\nBody" and stamp("---\na: 1\n---\n") == "---\na: 1\nupdated: now\n---\n"
    assert stamp("Body") == "Body" and stamp(None) is None
    listing = "# Index\n- [[gone]] x\n- [[kept]]\n* [[Gone|label]]\n- [t](wiki/gone.md)\nsee [[gone]]"
    assert one(spark, listing, lambda c: I.without_lines_of(c, F.array(F.lit("gone")))) == "# Index\n- [[kept]]\n* [[Gone|label]]"
    assert one(spark, "  chunk\nof text ", lambda c: T.vector_snippet(c, F.lit(" A > B "))) == "A > B: chunk of text"
    assert one(spark, "x" * 200, lambda c: T.vector_snippet(c, F.lit(None).cast("string"))) == "x" * 160 + "..." and one(spark, None, lambda c: T.vector_snippet(c, F.lit("h"))) == ""
