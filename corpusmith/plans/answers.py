"""Queries with functions made for questions and answers, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import answers as A
from corpusmith.functions import language as L
from corpusmith.plans.texts import _language
from corpusmith.session import load


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text is not null")


def text_directions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(L.language_of(F.col("text")).alias("language"))
    return rows.groupBy(A.text_direction(F.col("language")).alias("direction"), A.script_family(F.col("language")).alias("family")).agg(F.count("*").alias("documents"))


def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(A.cut_bytes(F.col("text"), 500)).alias("chars"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that documents name, and whether they are newer than 5.0."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"version (\d+\.\d+(?:\.\d+)?)"), 1))
    rows = _docs(spark, d).select(found.alias("version"))
    return rows.groupBy("version").agg(F.count("*").alias("times")).withColumn("newer", A.newer_version(F.col("version"), F.lit("5.0.0")))


def source_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of a context window as large as each document."""
    n = F.greatest(F.length("text"), F.lit(1)).cast("long") * 100
    return _docs(spark, d).select("doc_id", A.source_budget(n, F.lit(15_000)).alias("budget"), A.answer_tokens(n).cast("long").alias("answer_tokens"))


def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents with wiki links, after the links became markdown: length and hash."""
    text = A.links_as_markdown(F.col("text"))
    return _docs(spark, d).where(F.contains("text", F.lit("[["))).select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("hash"))


def greetings(spark: SparkSession, d: str) -> DataFrame:
    """Texts of items, lines of documents and opening words of their lines that are greetings and nothing else, counted with all others."""
    docs = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    words = docs.select(F.substring_index(F.trim("line"), " ", 1).alias("line")).where("line <> ''")
    lines = docs.unionAll(words).unionAll(load(spark, d, "eval_items").select("text"))
    # the data greet nobody, so each opening word is also tried after a greeting
    lines = lines.unionAll(words.select(F.concat(F.lit("Hello "), F.lower("line"), F.lit("!"))))
    return lines.groupBy(A.is_greeting(F.col("line")).alias("greeting")).agg(F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (text_directions, cut_texts, versions, source_budgets, markdown_links, greetings)}

ORACLE = {
    "text_directions": f"with {_language()} select case when language in ('Arabic', 'Persian', 'Hebrew') then 'rtl' else 'ltr' end as direction, case when language in ('Arabic', 'Persian') then 'arabic' when language in ('Chinese', 'Traditional Chinese', 'Japanese', 'Korean') then 'cjk' when language = 'Hebrew' then 'other' else 'latin' end as family, count(*) as documents from lang_ group by 1, 2",
    "cut_texts": "select doc_id, cast(len(list_filter(range(1, least(500, length(text)) + 1), lambda i: strlen(substr(text, 1, i)) <= 500)) as int) as chars from documents where text is not null",
    "versions": """select version, count(*) as times, any_value([cast(p[1] as int), coalesce(try_cast(p[2] as int), 0), coalesce(try_cast(p[3] as int), 0)] > [5, 0, 0]) as newer
        from (select version, string_split(version, '.') p from (select unnest(regexp_extract_all(text, 'version (\\d+\\.\\d+(?:\\.\\d+)?)', 1)) version from documents)) group by 1""",
    "source_budgets": """select doc_id, least(greatest(n - cast(floor(n * 0.15) as bigint) - least(cast(floor(n * 0.25) as bigint), 15000) - greatest(12000, cast(floor(n * 0.08) as bigint)), 8000), least(300000, greatest(8000, cast(floor(n * 0.6) as bigint)))) as budget,
        cast(case when n >= 512000 then 32768 when n >= 256000 then 24576 when n >= 128000 then 16384 else 8192 end as bigint) as answer_tokens from (select doc_id, greatest(length(text), 1) * 100 n from documents where text is not null)""",
    "greetings": """with l as (select unnest(string_split(text, chr(10))) line from documents where text is not null), w as (select string_split(trim(line), ' ')[1] line from l where trim(line) <> ''),
        a as (select * from l union all select * from w union all select text from eval_items union all select 'Hello ' || lower(line) || '!' from w),
        b as (select lower(trim(regexp_replace(trim(line), '[\\s!！。.?？~,，、;；:：]+$', ''))) g from a)
        select coalesce(length(g) <= 20 and (regexp_full_match(g, '(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y''all| you| folks| everyone)?')
          or regexp_full_match(g, '(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂|早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?')
          or g in ('good morning', 'good afternoon', 'good evening', 'good day', 'good night', 'what''s up', 'whats up', 'wassup', 'whaddup', 'greetings', '在吗', '在嗎', '在不在', '有人吗', '有人嗎', '有人在吗', '有人在嗎',
          'こんにちは', 'こんばんは', 'おはよう', 'おはようございます', 'やあ', 'どうも', 'はじめまして', '안녕', '안녕하세요', '안녕하십니까', 'hola', 'bonjour', 'salut', 'coucou', 'hallo', 'servus', 'hej', 'hejsan', 'ciao', 'saluton', 'ola', 'olá', 'privet', 'привет')), false) as greeting,
          count(*) as lines from b group by 1""",
}
