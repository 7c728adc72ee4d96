"""Queries on what merges, deletions and reviews do to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import graph as G
from corpusmith.operators import integrity as I
from corpusmith.session import load


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "wiki_pages").select("page_id", F.explode("sources").alias("s")).select("page_id", F.lower(T.source_identity(F.col("s"))).alias("source")).where("source <> ''")


def delete_fate(spark: SparkSession, d: str) -> DataFrame:
    """Fate of the pages when all clips are deleted."""
    lists = _lists(spark, d)
    return I.delete_fate(lists, lists.where("source like 'clips/%'").select("source"))


def survivor_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that pages keep when all clips are deleted."""
    lists = _lists(spark, d).distinct()
    fate = I.delete_fate(lists, lists.where("source like 'clips/%'").select("source")).where("fate = 'keep'")
    kept = lists.where("source not like 'clips/%'").join(fate.select("page_id"), "page_id", "left_semi")
    return kept.groupBy("page_id").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"))


def stripped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a link to one of a few deleted pages, after the links are gone: length and links left."""
    docs = load(spark, d, "documents").where("text is not null")
    text = I.strip_links(F.col("text"), ["gothebre", "vogano", "drathoro", "bekrile", "lurogru", "zipose"])
    return docs.select("doc_id", F.length("text").alias("before"), F.length(text).cast("int").alias("after"), F.size(T.wiki_links(text)).alias("links")).where("before <> after")


def redirected_links(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text is not null")
    text = I.redirect_links(F.col("text"), {"gothebre": "canonical-page", "vogano": "canonical-page"})
    return docs.select("doc_id", T.occurrences(text, F.lit("[[canonical-page")).alias("links")).where("links > 0")


def _review_items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "merge_candidates").select(
        "type", "title", "description", F.col("sources").alias("pages"), F.col("related").alias("queries"), F.col("slug").alias("source"), F.col("detected_at").alias("ord")
    )


def review_merge(spark: SparkSession, d: str) -> DataFrame:
    """Reported members of duplicate groups as review items, merged by type and title."""
    merged = I.merge_reviews(_review_items(spark, d))
    return merged.select("type", "key", "items", "pages", "queries", "description", "source")


def review_list(spark: SparkSession, d: str) -> DataFrame:
    """The distinct sources and related pages of each merged review, with the order in which they were seen first."""
    rows = I.review_values(_review_items(spark, d))
    return rows.select("type", "key", "field", "value", F.unix_micros(F.col("ord").cast("timestamp")).alias("ord"), "pos")


def review_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Link targets as missing pages: settled once a document bears the name."""
    docs = load(spark, d, "documents").where("text is not null")
    targets = docs.select(F.explode(T.wiki_links(F.col("text"))).alias("l")).select("l.target").distinct()
    items = targets.select(F.col("target").alias("review_id"), F.lit("missing-page").alias("type"), F.col("target").alias("title"), F.array().cast("array<string>").alias("pages"))
    return I.sweep_reviews(items, G.node_ids(docs).toDF("id"))


def open_groups(spark: SparkSession, d: str) -> DataFrame:
    """Reported duplicate groups but for dismissed ones (those of even number)."""
    rows = load(spark, d, "merge_candidates").where("slug is not null").groupBy("group_id").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    left = I.not_dismissed(rows.select("slugs"), rows.where("group_id % 2 = 0").select("slugs"))
    return left.select("key", F.size("slugs").alias("members"))


def page_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of each group the member last reported merged into the one first reported."""
    rows = load(spark, d, "merge_candidates").where("slug is not null")
    empty = F.array().cast("array<string>")
    member = F.struct("detected_at", "slug", F.coalesce("content", F.lit("")).alias("body"), F.coalesce("tags", empty).alias("tags"), F.coalesce("sources", empty).alias("sources"))
    ends = rows.groupBy(F.col("group_id").alias("path")).agg(F.min(member).alias("o"), F.max(member).alias("n"))
    old = ends.select("path", "o.body", "o.tags", "o.sources")
    new = ends.select("path", "n.body", "n.tags", "n.sources")
    return I.merge_pages(old, new, "2025-01-01").select("path", "outcome", F.length("body").alias("chars"))


def cached_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was seen before in another document that is still there."""
    docs = load(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash"), "path")
    cache = docs.where("path is not null").groupBy("hash").agg(F.min("path").alias("p")).select("hash", F.array("p").alias("outputs"))
    known = docs.join(cache, "hash").select(F.col("doc_id").cast("string").alias("source"), "hash", "outputs")
    files = docs.where("path is not null and doc_id % 3 <> 0").select("path")
    return I.cache_hits(known, docs.select(F.col("doc_id").cast("string").alias("source"), "hash"), files)


def source_traces(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the sources of all documents have left traces in."""
    docs = load(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), "path", "text")
    return I.pages_of_source(pages, docs.select("source").distinct()).select("source", F.col("page_id").alias("doc_id"), "way")


def stamped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with front matter after a new day was set in it: the day as read again, and their length."""
    docs = load(spark, d, "documents").where("text is not null")
    new = T.with_scalar(F.col("text"), "updated", F.lit("2026-01-01"))
    rows = docs.where(T.front_matter(F.col("text")) != "").select("doc_id", new.alias("t"))
    return rows.select("doc_id", T.scalar_field(T.front_matter(F.col("t")), "updated").alias("updated"), F.length("t").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (delete_fate, survivor_sources, stripped_texts, redirected_links, review_merge, review_list, review_sweep, open_groups, page_merge, cached_sources, source_traces, stamped_pages)
}

_LISTS = r"lists as (select page_id, source from (select page_id, lower(regexp_replace(trim(replace(s, '\', '/')), '^.*?raw/sources/', '', 'i')) source from (select page_id, unnest(sources) s from wiki_pages)) where source <> '')"
_FATE = "fate as (select page_id, count(distinct source) as before, count(distinct source) filter (source not like 'clips/%') as after from lists group by 1)"
_TITLE = r"lower(trim(regexp_replace(regexp_replace(trim(coalesce(title, ''), ' '), '^(?:missing page|missing-page|duplicate page|possible duplicate|contradiction|suggestion|confirm)\s*[:：-]\s*', '', 'i'), '\s+', ' ', 'g'), ' '))"

_FRONT = "regexp_extract(text, '^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)', {}, 's')"

ORACLE = {
    "stamped_pages": f"""select doc_id, '2026-01-01' as updated,
        cast(length(text) - length(w) + 9 + (case when o <> '' then length(f) - length(o) + 19 else length(f) + 20 end) as int) as chars
        from (select doc_id, text, w, f, regexp_extract(f, '(?m)^updated:.*$') o from (select doc_id, text, {_FRONT.format(0)} w, {_FRONT.format(1)} f from documents where text is not null)) where f <> ''""",
    "source_traces": f"""with s as (select distinct source, lower(list_last(string_split(replace(source, '\\', '/'), '/'))) n from documents where source is not null),
        k as (select source, n, regexp_replace(n, '(.)\\.[^.]*$', '\\1') st from s),
        p as (select doc_id, lower(coalesce(path, '')) path, lower(coalesce(text, '')) text from documents),
        q as (select doc_id, path, regexp_replace(list_last(string_split(replace(path, '\\', '/'), '/')), '(.)\\.[^.]*$', '\\1') st, regexp_extract_all(text, '"([^"\\n]+)"', 1) quoted,
          list_transform(string_split(regexp_extract({_FRONT.format(1)}, '(?m)^sources:[ \\t]*\\[(.*)\\][ \\t]*$', 1), ','), lambda x: list_last(string_split(trim(trim(x), chr(34) || chr(39)), '/'))) listed from p),
        w as (select source, doc_id, 1 r from k join (select doc_id, unnest(listed) x from q) on x = n union all select source, doc_id, 2 from k join q on contains(path, 'sources/') and starts_with(q.st, k.st) and k.st <> ''
          union all select source, doc_id, 3 from k join (select doc_id, unnest(quoted) x from q) on x = n)
        select source, doc_id, ['listed', 'summary', 'quoted'][min(r)] as way from w group by 1, 2""",
    "delete_fate": f"with {_LISTS}, {_FATE} select *, case when after = 0 then 'delete' else 'keep' end as fate from fate where before > after",
    "survivor_sources": f"""with {_LISTS}, {_FATE} select page_id, count(distinct source) as sources, min(source) as first_source from lists
        where source not like 'clips/%' and page_id in (select page_id from fate where before > after and after > 0) group by 1""",
    "redirected_links": """select doc_id, links from (select doc_id, cast((length(t) - length(replace(t, '[[canonical-page', ''))) // 16 as int) as links
        from (select doc_id, regexp_replace(text, '\\[\\[(gothebre|vogano)(\\]\\]|\\|)', '[[canonical-page\\2', 'g') t from documents)) where links > 0""",
    "stripped_texts": r"""select doc_id, before, cast(length(t) as int) as after, cast(len(regexp_extract_all(t, '\[\[([^\]|]+)(?:\|([^\]]*))?\]\]')) as int) as links from (
        select doc_id, cast(length(text) as int) before, regexp_replace(regexp_replace(text, '\[\[(?:gothebre|vogano|drathoro|bekrile|lurogru|zipose)\|([^\]]+)\]\]', '\1', 'g'),
          '\[\[(gothebre|vogano|drathoro|bekrile|lurogru|zipose)\]\]', '\1', 'g') t from documents where text is not null) where length(t) <> before""",
    "review_merge": f"""
with r as (select coalesce(type, 'confirm') as type, {_TITLE} as key, * exclude (type) from merge_candidates),
p as (select type, key, cast(count(distinct v) as int) n from (select type, key, unnest(sources) v from r) where v is not null group by 1, 2),
q as (select type, key, cast(count(distinct v) as int) n from (select type, key, unnest(related) v from r) where v is not null group by 1, 2)
select g.type, g.key, items, coalesce(p.n, 0) as pages, coalesce(q.n, 0) as queries, description, source from (select type, key, count(*) items,
  max(struct_pack(o := detected_at, v := description)) filter (trim(coalesce(description, '')) <> '').v as description,
  max(struct_pack(o := detected_at, v := slug)) filter (slug is not null).v as source from r group by 1, 2) g
left join p on p.type = g.type and p.key = g.key left join q on q.type = g.type and q.key = g.key""",
    "review_list": f"""
with r as (select coalesce(type, 'confirm') as type, {_TITLE} as key, sources, related, detected_at from merge_candidates),
e as (select type, key, 'pages' field, detected_at, unnest(sources) v, unnest(range(len(sources))) pos from r union all select type, key, 'queries', detected_at, unnest(related), unnest(range(len(related))) from r)
select type, key, field, v as value, epoch_us(m.a) as ord, cast(m.p as int) as pos from (select type, key, field, v, min(struct_pack(a := detected_at, p := pos)) m from e where v is not null group by 1, 2, 3, 4)""",
    "review_sweep": r"""
with t as (select distinct trim(l) target from (select unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|([^\]]*))?\]\]', 1)) l from documents)),
n as (select lower(regexp_replace(regexp_replace(list_last(string_split(path, '/')), '(.)\.[^.]*$', '\1'), '-[0-9]+$', '')) id from documents where text is not null and path is not null)
select target as review_id, lower(target) in (select id from n) or replace(lower(target), ' ', '-') in (select id from n) as resolved from t""",
    "open_groups": """
with g as (select group_id, list_sort(list(distinct slug)) slugs, array_to_string(list_sort(list(distinct lower(slug))), '|') as key from merge_candidates where slug is not null group by 1)
select key, any_value(cast(len(slugs) as int)) as members from g where contains(key, '|') and key not in (select key from g where group_id % 2 = 0) group by 1""",
    "cached_sources": """
with d as (select doc_id, text, path from documents where text <> ''), c as (select text, min(path) p from d where path is not null group by 1)
select cast(doc_id as varchar) as source from d join c using (text) where p in (select path from d where doc_id % 3 <> 0)""",
}
