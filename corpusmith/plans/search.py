"""Queries on documents and chunk vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import search as S
from corpusmith.session import load

QUERY = "the broken index of the harbor"
TOKENS = T.query_tokens(QUERY)
PHRASE = T.query_phrase(QUERY)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.col("doc_id").alias("page_id"), "path", T.title_of(F.coalesce("text", F.lit("")), F.col("path")).alias("title"), F.col("text").alias("content"))


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: the embedding with the smallest id."""
    row = load(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()
    return [float(x) for x in row[0]["embedding"]]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as chunks: four chunks a page, in the order of their ids."""
    rows = load(spark, d, "embeddings")
    page = F.floor(F.col("vec_id") / 4)
    return rows.select(
        F.col("vec_id").alias("chunk_id"), (F.lit(1_000_002) + page * 5).alias("page_id"), F.pmod("vec_id", F.lit(4)).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"), "embedding",
    )


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    hits = S.keyword_scores(_pages(spark, d), QUERY)
    return S.ranked(hits.select("page_id", "path", "score", "title_match"), "path", 20).select("rank", "page_id", "path", "score", "title_match")


def token_hits(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    hits = F.array(*[F.when(F.contains(F.lower(text), F.lit(t)), F.struct(F.lit(t).alias("token"), T.occurrences(F.lower(text), F.lit(t)).alias("times"))) for t in TOKENS])
    rows = load(spark, d, "documents").select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.groupBy("h.token").agg(F.count("*").alias("documents"), F.sum("h.times").alias("occurrences"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of every document: the place of the phrase, else of the first token that occurs, else the beginning."""
    found = T.snippet(F.col("text"), "broken index", tokens=TOKENS)
    return load(spark, d, "documents").where("text is not null").select("doc_id", found.alias("snippet"))


def _store(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store: the latest row of each chunk."""
    at = F.coalesce(F.col("upserted_at"), F.lit("1970-01-01").cast("timestamp_ntz"))
    row = F.struct("page_id", "chunk_index", "chunk_text", "heading_path", "embedding")
    rows = load(spark, d, "wiki_chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(row, at).alias("r"))
    return rows.select("chunk_id", "r.*")


def _asked(spark: SparkSession, d: str) -> list[float]:
    """A query vector: that of the chunk with the smallest id that has a usable one."""
    row = _store(spark, d).where(S.usable_vector(F.col("embedding"), 64)).orderBy("chunk_id").select("embedding").limit(1).collect()
    return [float(x) for x in row[0]["embedding"]] if row else [0.0] * 64


def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the store nearest to a query vector, with what is shown of each."""
    near = S.nearest_chunks(_store(spark, d), _asked(spark, d), 60)
    shown = T.vector_snippet(F.col("chunk_text"), F.col("heading_path"))
    return near.select("chunk_id", "page_id", F.round("score", 6).alias("score"), shown.alias("snippet"))


def vector_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = S.page_scores(S.nearest_chunks(_store(spark, d), _asked(spark, d), 60))
    return pages.select("page_id", F.round("score", 6).alias("score"), "best_text", "chunks")


def vector_best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The best three chunks of each page that a query vector finds."""
    near = S.nearest_chunks(_store(spark, d), _asked(spark, d), 60)
    return S.best_chunks(near).select("page_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    found = S.hybrid_search(_pages(spark, d), _chunks(spark, d), QUERY, _vector(spark, d))
    return found.select("page_id", F.round("score", 8).alias("score"), "token_rank", "vector_rank")


def vector_only_pages(spark: SparkSession, d: str) -> DataFrame:
    near = S.page_scores(S.nearest_chunks(_chunks(spark, d), _vector(spark, d), 60))
    words = S.keyword_scores(_pages(spark, d), QUERY).select("page_id")
    return near.join(words, "page_id", "left_anti").select("page_id", F.round("score", 6).alias("score"))


def recorded_hits(spark: SparkSession, d: str) -> DataFrame:
    """How far the recorded searches are off: hits, null scores and scores outside (0, 1] of each probe."""
    hits = load(spark, d, "search_hits")
    return hits.groupBy("probe_chunk_id").agg(
        F.count("*").alias("hits"), F.countDistinct("chunk_id").alias("chunks"), F.count_if(F.col("score").isNull()).alias("unscored"),
        F.count_if((F.col("score") <= 0) | (F.col("score") > 1)).alias("off_scale"), F.max("hit_rank").cast("long").alias("last_rank"),
    )


QUERIES = {f.__name__: f for f in (keyword_search, token_hits, snippets, vector_knn, vector_pages, vector_best_chunks, hybrid_rrf, vector_only_pages, recorded_hits)}

_TEXT = "coalesce(text, '')"
_NAME = "list_last(string_split(path, '/'))"
_STEM = f"regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1')"
_FRONT = f"regexp_extract({_TEXT}, '^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)', 1, 's')"
_TITLE = (
    f"case when trim(regexp_extract({_FRONT}, '(?m)^title:[ \\t]*(.*)$', 1)) <> '' "
    f"then regexp_replace(trim(regexp_extract({_FRONT}, '(?m)^title:[ \\t]*(.*)$', 1)), '^[\"''](.*)[\"'']$', '\\1') "
    f"when trim(regexp_extract({_TEXT}, '(?m)^# (.*)$', 1)) <> '' then trim(regexp_extract({_TEXT}, '(?m)^# (.*)$', 1)) "
    f"else replace({_STEM}, '-', ' ') end"
)


def _times(hay: str, needle: str) -> str:
    return f"cast((length({hay}) - length(replace({hay}, '{needle}', ''))) // {len(needle)} as int)"


_IN_TITLE = " + ".join(f"cast(contains(tt, '{t}') as int)" for t in TOKENS)
_IN_TEXT = " + ".join(f"cast(contains(ct, '{t}') as int)" for t in TOKENS)
_WORDS = f"""
words as (
  select page_id, path, cast(200 * a + 50 * b + 20 * c + 5 * e + f as double) as score, (e > 0 or b > 0) as title_match from (
    select page_id, path, cast(stem = '{PHRASE}' as int) a, cast(contains(tt, '{PHRASE}') as int) b, least(10, {_times("ct", PHRASE)}) c, {_IN_TITLE} e, {_IN_TEXT} f
    from (select doc_id page_id, path, lower({_STEM}) stem, lower(concat_ws(' ', coalesce({_TITLE}, ''), {_NAME})) tt, lower({_TEXT}) ct from documents))
  where 200 * a + 50 * b + 20 * c + 5 * e + f > 0)"""
_NEAR = """
q as (select embedding v from embeddings order by vec_id limit 1),
chunk as (
  select vec_id chunk_id, 1000002 + (vec_id // 4) * 5 page_id, cast(vec_id % 4 as int) chunk_index, 'chunk ' || vec_id chunk_text,
    1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, v), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))) score
  from embeddings, q),
near as (select * from chunk order by score desc, chunk_id limit 60),
page as (
  select page_id, top + least(0.3 * (total - top), greatest(0.0, 1 - top)) score, best_text, chunks from (
    select page_id, max(score) top, sum(score) total, count(*) chunks, arg_max(chunk_text, (score, -chunk_index)) best_text from near group by page_id))"""

_STORE = """
last as (select chunk_id, arg_max(struct_pack(p := page_id, i := chunk_index, t := chunk_text, h := heading_path, e := embedding), coalesce(upserted_at, timestamp '1970-01-01')) r from wiki_chunks where chunk_id is not null group by 1),
store as (select chunk_id, r.p page_id, r.i chunk_index, r.t chunk_text, r.h heading_path, r.e::double[] e from last where len(r.e) = 64 and len(list_filter(r.e, lambda x: x is null or not isfinite(x))) = 0),
v as (select e v from store order by chunk_id limit 1),
hit as (select *, 1 / (1 + sqrt(list_sum(list_transform(list_zip(e, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) score from store, v order by score desc, chunk_id limit 60)"""
_ANCHOR = " ".join(f"when contains(l, '{t}') then instr(l, '{t}')" for t in TOKENS)
_ANCHOR_SIZE = " ".join(f"when contains(l, '{t}') then {len(t)}" for t in TOKENS)

ORACLE = {
    "keyword_search": f"with {_WORDS} select row_number() over (order by score desc, path) as rank, * from words qualify rank <= 20",
    "token_hits": " union all ".join(
        f"select '{t}' as token, count(*) as documents, cast(sum({_times('lower(text)', t)}) as bigint) as occurrences from documents where contains(lower(text), '{t}') having count(*) > 0" for t in TOKENS
    ),
    "snippets": f"""
select doc_id, replace(case when s > 1 then '...' else '' end || substr(text, s, e - s) || case when e <= length(text) then '...' else '' end, chr(10), ' ') as snippet
from (select doc_id, text, greatest(a - 80, 1) s, a + n + 80 e from (
  select *, case when contains(l, 'broken index') then instr(l, 'broken index') {_ANCHOR} else 1 end a,
    case when contains(l, 'broken index') then 12 {_ANCHOR_SIZE} else 0 end n from (select doc_id, text, lower(text) l from documents where text is not null)))""",
    "vector_knn": f"""with {_STORE} select chunk_id, page_id, round(score, 6) as score, case when t = '' then '' else case when h <> '' then h || ': ' else '' end || case when length(t) > 160 then substr(t, 1, 160) || '...' else t end end as snippet
from (select *, replace(trim(coalesce(chunk_text, '')), chr(10), ' ') t, trim(coalesce(heading_path, '')) h from hit)""",
    "vector_pages": f"""with {_STORE} select page_id, round(top + least(0.3 * (total - top), greatest(0.0, 1 - top)), 6) as score, best_text, chunks from (
    select page_id, max(score) top, sum(score) total, count(*) chunks, arg_max(chunk_text, (score, -chunk_index)) best_text from hit group by page_id)""",
    "vector_best_chunks": f"with {_STORE} select page_id, row_number() over (partition by page_id order by score desc, chunk_id) as rank, chunk_id, round(score, 6) as score from hit qualify rank <= 3",
    "hybrid_rrf": f"""with {_WORDS}, {_NEAR},
a as (select page_id, row_number() over (order by score desc, path) token_rank from words),
b as (select page_id, row_number() over (order by score desc, page_id) vector_rank from page qualify vector_rank <= 20)
select page_id, round(coalesce(1 / (60 + token_rank), 0) + coalesce(1 / (60 + vector_rank), 0), 8) as score, token_rank, vector_rank
from a full join b using (page_id) order by coalesce(1 / (60 + token_rank), 0) + coalesce(1 / (60 + vector_rank), 0) desc, page_id limit 20""",
    "vector_only_pages": f"with {_WORDS}, {_NEAR} select page_id, round(score, 6) as score from page where page_id not in (select page_id from words)",
    "recorded_hits": """
select probe_chunk_id, count(*) as hits, count(distinct chunk_id) as chunks, count(*) filter (score is null) as unscored,
  count(*) filter (score <= 0 or score > 1) as off_scale, cast(max(hit_rank) as bigint) as last_rank from search_hits group by 1""",
}
