import io
import zipfile

from pyspark.sql import functions as F

from corpusmith.sources import files, web


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


DOCX = zipped({"word/document.xml": """<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})
XLSX = zipped({
    "xl/workbook.xml": '<workbook><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c></row><row><c r="A2"><v>2.5</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
})
PPTX = zipped({f"ppt/slides/slide{n}.xml": f"<sld><p><r><t>Title {n}</t></r></p><p><r><t>point</t></r></p></sld>" for n in (2, 10, 1)})


def test_office():
    assert files.docx_text(DOCX) == "## Head\n\n**bold** text\n\n- item\n\n| a\\|b | c |\n|---|---|"
    assert files.xlsx_text(XLSX) == "## One\n\n| name |  | 3 |\n|---|---|---|\n| 2.50 | true |  |\n\n## Two\n\n| x |\n|---|"
    assert [line for line in files.pptx_text(PPTX).split("\n") if line.startswith("##")] == ["## Slide 1", "## Slide 2", "## Slide 10"]
    assert files.odf_text(zipped({"content.xml": "<d><h>Head</h><p>a <span>b</span></p><p> </p></d>"})) == "Head\n\na b"


def test_read_texts(spark, tmp_path):
    (tmp_path / "sub/.cache").mkdir(parents=True)
    (tmp_path / "sub/a.md").write_text("# hi")
    (tmp_path / "sub/.cache/b.md").write_text("no")
    (tmp_path / "c.docx").write_bytes(DOCX)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    (tmp_path / "big.txt").write_text("x" * 500)
    out = {r["path"].rpartition("/")[2]: r for r in files.read_texts(spark, str(tmp_path), largest=450 + len(DOCX) // 10**6).collect()}
    assert out["a.md"]["text"] == "# hi" and out["a.md"]["category"] == "markdown" and out["p.png"]["text"] == "[image: p.png]"
    assert "can't be read" in out["bad.docx"]["text"] and out["big.txt"]["text"] == "x" * 500 and out["big.txt"]["sha256"] is None
    listed = files.list_files(spark, str(tmp_path))
    assert {r["rel"] for r in listed.collect()} == {"sub/a.md", "c.docx", "bad.docx", "p.png", "big.txt"}
    tree = files.file_tree(listed).collect()
    assert tree[0]["path"] == "sub" and tree[0]["is_dir"] and tree[0]["files"] == 1


def test_entities_and_names(spark):
    df = spark.createDataFrame([("&amp;lt; &quot;",)], "v string")
    assert df.select(files.decode_entities(F.col("v"))).first()[0] == '< "'
    names = spark.createDataFrame([("a.md", 1), ("A.md", 2), ("b", 1), ("b", 2)], "name string, ord int")
    assert {r["name"] for r in files.numbered_names(names).collect()} == {"a.md", "A-2.md", "b", "b-2"}
    clips = spark.createDataFrame([("Some: Title!", "2024-01-02", 1), ("some title", "2024-01-02", 2), (None, "2024-01-02", 3)], "title string, day string, ord int")
    assert {r["name"] for r in web.clip_names(clips).collect()} == {"some-title-2024-01-02.md", "some-title-2024-01-02-2.md", "untitled-2024-01-02.md"}


def test_conversations(spark, tmp_path):
    df = spark.createDataFrame([(c, t, "user", f"m{t}") for c in (1, 2) for t in range(7)], "conv_id long, turn long, role string, text string")
    files.write_conversations(df, str(tmp_path / "out"), most=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.where("turn < 4").count() == 0


HTML = """<html><head><title>The title</title><script>x</script></head><body><nav>Home <a href="/">x</a></nav><div class="sidebar"><p>Advert text that is long enough to score, really, yes.</p></div>
<div class="content"><h1>Head</h1><p>First paragraph, with <b>bold</b>, commas, and a <a href="http://e.x/y">link</a> that is long enough to count.</p>
<ul><li>one<ul><li>inner</li></ul><li>two</ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table><img src="big.png" alt="pic"><img src="dot.png" width="1"><pre>code  here</pre>
<p>Second paragraph, also long enough, with several, many, commas in it to be the best.</p></div><footer>foot</footer></body></html>"""


def test_articles(spark):
    df = spark.createDataFrame([(1, "https://www.site.org/a", HTML, "x"), (2, None, None, "x"), (3, "bad url", "", "x"), (4, "u", "<p>unclosed <b>bold", "x")], "page_id long, url string, html string, title string")
    out = {r["page_id"]: r for r in web.extract_articles(df).collect()}
    text = out[1]["markdown"]
    assert out[1]["host"] == "site.org" and out[1]["title"] == "The title"
    assert "**bold**" in text and "[link](http://e.x/y)" in text and "- one" in text and "  - inner" in text and "| 1 | x\\|y |" in text and "![pic](big.png)" in text and "```\ncode  here\n```" in text
    assert not any(w in text for w in ("Advert", "Home", "foot", "dot.png"))
    assert out[2]["markdown"] == "" and out[4]["markdown"] == "unclosed **bold**"


def test_merged_results(spark):
    schema = "title string, url string, snippet string, source string"
    a = spark.createDataFrame([("A", "http://X", "s", "one"), ("B", None, "s", "one")], schema)
    b = spark.createDataFrame([("A2", "http://x", "t", "two"), ("C", "", "u", "two")], schema)
    assert [r["title"] for r in web.merge_results([a, b]).orderBy("rank").collect()] == ["A", "B", "C"]
    assert web.merge_results([a, b], most=1).count() == 1
