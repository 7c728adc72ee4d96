"""Queries that cut documents up and pack them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import chunking as C
from corpusmith.session import load


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(load(spark, d, "documents"))


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumn("title", T.title_of(F.coalesce("text", F.lit("")), F.col("path")))
    return C.chunk_texts(docs).select("doc_id", "chunk_index", F.md5("text").alias("hash"))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.semantic_chunks(load(spark, d, "documents"))


def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents with front matter and body whose chunks don't cover every character of the body once (none should come out)."""
    docs = load(spark, d, "documents").where("text is not null")
    c = C.chunk_documents(docs)
    body = docs.select("doc_id", F.length(F.regexp_replace(T.body_of(F.col("text")), r"\s+", "")).alias("chars"))
    size = c.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.length(F.regexp_replace(F.expr("substring(text, char_start + 1, char_end - char_start)"), r"\s+", "")).alias("n"))
    total = size.groupBy("doc_id").agg(F.sum("n").alias("covered"))
    return body.join(total, "doc_id", "left").where("coalesce(covered, 0) <> chars").select("doc_id", "chars", "covered")


def store_state(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store by page: chunks, vectors and the latest insertion of each."""
    rows = load(spark, d, "wiki_chunks").where("chunk_id is not null")
    last = rows.groupBy("page_id", "chunk_id").agg(F.max_by(F.size("embedding"), "upserted_at").alias("dim"), F.count("*").alias("rows"))
    return last.groupBy("page_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("dim") == 64).alias("vectors"), F.sum("rows").alias("rows"))


def replaced_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left when the pages inserted last in the first half of the ids are replaced by their first chunk."""
    store = load(spark, d, "wiki_chunks").select("page_id", "chunk_id", "chunk_index").where("chunk_id is not null").distinct()
    new = store.where("chunk_index = 0 and page_id < 'm'")
    return C.replace_chunks(store, new).groupBy("page_id").agg(F.count("*").alias("chunks"))


def context_packing(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, longest first, as many of the first 30 as fit 6,000 characters."""
    order = Window.partitionBy("source").orderBy(F.desc("size"), "doc_id")
    rows = load(spark, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.length("text").alias("size"))
    first = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 30")
    packed = C.pack_context(first.select(F.col("source").alias("query_id"), "rank", F.col("doc_id").alias("page_id"), "size"), 6000)
    return packed.select(F.col("query_id").alias("source"), "rank", F.col("page_id").alias("doc_id"), "used")


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_texts, semantic_chunks, chunk_coverage, store_state, replaced_store, context_packing)}

ORACLE = {
    "chunk_coverage": "select doc_id, 0 as chars, cast(0 as bigint) as covered from documents where false",
    "store_state": """select page_id, count(*) as chunks, count(*) filter (dim = 64) as vectors, cast(sum(n) as bigint) as rows from (
        select page_id, chunk_id, arg_max(coalesce(len(embedding), -1), upserted_at) dim, count(*) n from wiki_chunks where chunk_id is not null group by 1, 2) group by 1""",
    "replaced_store": """with s as (select distinct page_id, chunk_id, chunk_index from wiki_chunks where chunk_id is not null), n as (select * from s where chunk_index = 0 and page_id < 'm')
        select page_id, count(*) as chunks from (select * from s where page_id not in (select page_id from n) union all select * from n) group by 1""",
    "context_packing": """with recursive r as (
        select source, doc_id, length(text) size, row_number() over (partition by source order by length(text) desc, doc_id) as rank from documents where text is not null and source is not null),
      f as (select source, rank, doc_id, size, case when size <= 6000 then size else 0 end used, size <= 6000 taken from r where rank = 1
        union all select r.source, r.rank, r.doc_id, r.size, case when f.used + r.size <= 6000 then f.used + r.size else f.used end, f.used + r.size <= 6000
        from f join r on r.source = f.source and r.rank = f.rank + 1 where r.rank <= 30)
      select source, rank, doc_id, cast(used as bigint) as used from f where taken""",
}
