from pyspark.sql import functions as F

from corpusmith.functions import predicates as P


def check(spark, f, cases):
    df = spark.createDataFrame([*cases.items()], "v string, want boolean")
    assert [r["v"] for r in df.where(~f(F.col("v")).eqNullSafe(F.col("want"))).collect()] == []


def test_predicates(spark):
    check(spark, P.ingestable, {"a/b.MD": True, "a/.hidden.md": False, "a/.cache/b.md": False, "a.exe": False, "noext": False, "": False, None: False})
    check(spark, P.importable, {"notes/a.md": True, "wiki/a.md": False, "x/.git/a": False, "x/settings.json": False, "": False, None: False, "./a.md": True})
    check(spark, P.safe_page_path, {"wiki/a/b.md": True, "wiki/../a.md": False, "/wiki/a.md": False, "raw/a.md": False, "wiki/con.md": False, "wiki/a:b.md": False, "wiki//a.md": False, "wiki\\a.md": True, None: False})
    check(spark, P.valid_page_id, {"page-1_x.y": True, "é数": True, "a b": False, "": False, "x" * 257: False, None: False})
    check(spark, lambda c: P.source_matches(c, F.lit("/p/raw/sources/papers/A.pdf")), {"papers/a.pdf": True, "a.pdf": True, "other/a.pdf": False, "raw/sources/Papers/A.pdf": True, None: False})
    check(spark, lambda c: P.in_language(c, F.lit("Russian")), {"---\ntitle: x\n---\nЭто достаточно длинный русский текст": True, "short": True, "this is a long enough english text": False, "```\nlong english code in a fence only\n```": True, None: True})
