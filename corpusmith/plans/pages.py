"""Queries with functions on pages, their lists, images, files and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import answers as A
from corpusmith.functions import predicates as P
from corpusmith.functions import text as T
from corpusmith.operators import integrity as I
from corpusmith.operators import search as S
from corpusmith.sources import web
from corpusmith.session import load

ORDER = ["overview", "entity", "concept", "source", "query", "synthesis"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text is not null")


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their links turned into images: labelled ones into local, bare ones into remote ones."""
    local = F.regexp_replace("text", r"\[\[([^\]|]+)\|([^\]]*)\]\]", "![$2](media/$1/1.png)")
    return _docs(spark, d).select("doc_id", F.regexp_replace(local, r"\[\[([^\]|]+)\]\]", "![](https://img.example/$1.png)").alias("text")).where(F.contains("text", F.lit("![")))


def image_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Images of each document: distinct addresses, local ones and the first of all."""
    refs, near = T.image_refs(F.col("text")), T.local_images(F.col("text"))
    return _pictured(spark, d).select("doc_id", F.size(refs).alias("images"), F.size(near).alias("local"), F.try_element_at(refs, F.lit(1)).alias("first"))


def image_hits(spark: SparkSession, d: str) -> DataFrame:
    """Images of all documents, each once, those whose caption speaks of notes first."""
    rows = _pictured(spark, d).select(F.col("doc_id").alias("rank"), T.images_of(F.col("text")).alias("images"))
    return S.image_hits(rows, "the notes")


def captioned_images(spark: SparkSession, d: str) -> DataFrame:
    """Documents after each image got its document's first address as its caption."""
    first = T.image_refs(F.col("text"))
    captions = F.create_map(F.try_element_at(first, F.lit(1)), F.lit("Seen [here]"))
    rows = _pictured(spark, d).select("doc_id", T.with_captions(F.col("text"), captions).alias("t"))
    return rows.select("doc_id", F.length("t").alias("chars"), T.occurrences(F.col("t"), F.lit("![Seen here](")).alias("captioned"))


def image_sources(spark: SparkSession, d: str) -> DataFrame:
    """Images named after the sources of pages, in the new way and in the old one, with the documents' sources they come from."""
    files = load(spark, d, "documents").select(F.col("source").alias("path"))
    lists = load(spark, d, "wiki_pages").select(F.explode("sources").alias("s")).where("s is not null").distinct()
    new = lists.select(F.concat(F.lit("wiki/media/"), T.source_slug(T.source_identity(F.col("s"))), F.lit("/img-1.png")).alias("address"))
    old = lists.select(F.concat(F.lit("media/"), T.file_stem(F.col("s")), F.lit("/img-1.png")).alias("address"))
    return I.image_sources(new.union(old).distinct(), files)


def safe_renames(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the sources of pages that may be renamed."""
    lists = load(spark, d, "wiki_pages").select(F.explode("sources").alias("s")).where("s is not null")
    return I.safe_renames(lists.select(T.source_identity(F.col("s")).alias("path")))


def link_keys(spark: SparkSession, d: str) -> DataFrame:
    links = _docs(spark, d).select(F.explode(T.wiki_links(F.col("text"))).alias("l"))
    return links.groupBy("l.target", T.link_key(F.col("l.target")).alias("key")).agg(F.count("*").alias("links"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """The links of each document as an index page, and its first target."""
    links = T.wiki_links(F.col("text"))
    lines = F.transform(links, lambda link: F.concat(F.lit("- [["), link["target"], F.lit("]] see ("), link["target"], F.lit(".md)")))
    rows = _docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("listing"), F.try_element_at(links, F.lit(1))["target"].alias("first"))
    return rows.where("first is not null")


def cleaned_listings(spark: SparkSession, d: str) -> DataFrame:
    """Index pages after the first page listed is gone: characters left, by the key of the link and by any mention of the file."""
    rows = _listings(spark, d)
    by_key = I.clean_listing(F.col("listing"), F.array(T.link_key(F.col("first"))))
    by_name = I.without_lines_of(F.col("listing"), F.array("first"))
    return rows.select("doc_id", F.length("listing").alias("before"), F.length(by_key).alias("by_key"), F.length(by_name).alias("by_name"))


def trimmed_listings(spark: SparkSession, d: str) -> DataFrame:
    """Index pages cut to lines with an o, as many as fit 200 characters."""
    return _listings(spark, d).select("doc_id", F.length(T.trim_listing(F.col("listing"), F.array(F.lit("o")), 200)).alias("chars"))


def deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return I.deleted_keys(load(spark, d, "entities").select("slug", "title"))


def page_source_lists(spark: SparkSession, d: str) -> DataFrame:
    """Source lists of page rows as identities with the page's own path, and the first three tags."""
    rows = load(spark, d, "wiki_pages").where("path is not null")
    own = T.canonical_sources(F.filter("sources", lambda s: s.isNotNull()), F.col("path"))
    return rows.select("page_id", F.array_join(own, "|").alias("sources"), F.array_join(T.first_queries(F.filter("tags", lambda t: t.isNotNull())), "|").alias("first_tags")).distinct()


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles of reported duplicates as file paths that any file system takes."""
    return load(spark, d, "merge_candidates").where("title is not null").select("title", T.safe_path(F.concat(F.lit("wiki/"), F.col("title"))).alias("path")).distinct()


def source_names(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the lists of pages with the documents' sources they mean."""
    name = lambda c: F.lower(T.file_name(T.source_identity(F.col(c))))
    lists = load(spark, d, "wiki_pages").select(F.explode("sources").alias("stored")).where("stored is not null").distinct()
    known = load(spark, d, "documents").select(F.col("source").alias("identity")).where("identity is not null").distinct()
    pairs = lists.withColumn("_n", name("stored")).join(known.withColumn("_n", name("identity")), "_n")
    return pairs.where(P.source_matches(F.col("stored"), F.col("identity"))).select("stored", "identity")


def page_id_checks(spark: SparkSession, d: str) -> DataFrame:
    """Ids and titles that may name a page in the vector store."""
    ids = load(spark, d, "wiki_chunks").select(F.col("page_id").alias("value")).unionAll(load(spark, d, "entities").select("title")).unionAll(load(spark, d, "wiki_pages").select("slug"))
    return ids.groupBy(P.valid_page_id(F.col("value")).alias("valid")).agg(F.count("*").alias("rows"))


def resolved_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources named by pages as files among the documents' sources."""
    refs = load(spark, d, "wiki_pages").select(F.explode("sources").alias("s")).where("s is not null").select(T.source_identity(F.col("s")).alias("reference")).distinct()
    files = load(spark, d, "documents").where("source is not null").select(F.col("source").alias("path")).distinct()
    return I.resolve_files(refs, files)


def numbered_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first three recorded hits of each probe as a numbered block."""
    hits = load(spark, d, "search_hits").where("hit_rank <= 3 and chunk_id is not null")
    once = hits.groupBy("probe_chunk_id", "hit_rank").agg(F.min("chunk_id").alias("chunk_id"))
    found = F.struct("hit_rank", F.col("chunk_id").alias("title"), F.lit("").alias("url"), F.col("hit_rank").cast("string").alias("snippet"))
    return once.groupBy("probe_chunk_id").agg(F.array_sort(F.collect_list(found)).alias("r")).select("probe_chunk_id", A.numbered_context(F.col("r")).alias("block"))


def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """The 30 smallest entities, pages and documents as results of three searches, one list of 20."""
    blank = F.lit("").alias("snippet")
    found = [
        load(spark, d, "entities").select("title", F.lower("slug").alias("url"), blank, F.lit("a").alias("source"), F.col("entity_id").alias("o")).where("url is not null").distinct(),
        load(spark, d, "wiki_pages").select("title", F.lower("slug").alias("url"), blank, F.lit("b").alias("source"), F.col("page_id").alias("o")).where("url is not null").distinct(),
    ]
    lists = [f.orderBy("o", "title", "url").limit(30).select("title", "url", "snippet", "source") for f in found]
    return web.merge_results([lists[1], lists[0]], 50).select("rank", "url", "source")


def clip_names(spark: SparkSession, d: str) -> DataFrame:
    """File names for reported duplicates as clips."""
    rows = load(spark, d, "merge_candidates").where("detected_at is not null").select("title", F.date_format(F.col("detected_at").cast("timestamp"), "yyyy-MM-dd").alias("day"), F.concat_ws(" ", F.col("group_id").cast("string"), "slug", "detected_at").alias("ord"))
    return web.clip_names(rows.dropDuplicates(["ord"])).groupBy("name").agg(F.count("*").alias("clips"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as generated answers: their first line is thinking, and they cite two pages by number."""
    line = F.substring_index("text", "\n", 1)
    text = F.concat(F.lit("<think>"), line, F.lit("</think>"), F.col("text"), F.lit(" ["), F.col("doc_id") % 7, F.lit("] ["), F.col("doc_id") % 3, F.lit("]"))
    return _docs(spark, d).where("text <> ''").select("doc_id", text.alias("text"), F.col("text").alias("raw"))


def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Of each answer the length without thinking, the pages cited, and the reasoning of its line in a stream."""
    delta = F.struct(F.struct(F.col("raw").alias("reasoning_content")).alias("delta"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))))
    cited = A.cited_numbers(F.col("text"), 5)
    return _answers(spark, d).select("doc_id", F.length(A.without_thinking(F.col("text"))).alias("chars"), F.array_join(cited.cast("array<string>"), ",").alias("cited"), F.length(A.reasoning_text(line)).alias("reasoning"))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    """Sources as addresses on hosts named after their folders."""
    folder = F.regexp_extract("source", r"^raw/sources/([^/]+)/", 1)
    url = F.when(F.length(folder) % 2 == 0, F.concat(F.lit("https://www."), folder, F.lit(".example/x"))).otherwise(F.col("source"))
    return load(spark, d, "documents").groupBy(T.host_of(F.coalesce(url, F.lit(""))).alias("host")).agg(F.count("*").alias("documents"))


def entity_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", T.entity_summary(F.col("text"), F.col("path")).alias("s")).where("s is not null")
    return rows.select("doc_id", "s.slug", "s.type", "s.title", "s.description", F.array_join("s.tags", "|").alias("tags"))


def dismissed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of even number are dismissed, then all."""
    rows = load(spark, d, "merge_candidates").where("slug is not null").groupBy("group_id").agg(F.collect_set("slug").alias("slugs"))
    return I.dismiss(rows.where("group_id % 2 = 0").select("slugs"), rows.select("slugs")).select("key", F.array_join("slugs", "|").alias("slugs"))


def first_registered(spark: SparkSession, d: str) -> DataFrame:
    """Slugs with the path of the first of three tables that has them."""
    tables = [load(spark, d, t).where("path is not null").select("slug", "path") for t in ("entities", "wiki_pages", "merge_candidates")]
    return I.first_registered(tables, "slug")


def page_tree(spark: SparkSession, d: str) -> DataFrame:
    return I.page_tree(load(spark, d, "wiki_pages").select("path", "type").distinct(), ORDER)


def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.folder_counts(load(spark, d, "file_change_tasks").select("path"))


def routed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Where the changes of the feed go, and how their paths would be written as pages."""
    rows = load(spark, d, "file_change_tasks")
    page = F.regexp_replace(F.coalesce("path", F.lit("")), "^raw/sources/", "wiki/sources/")
    route, write = P.change_route(F.col("path"), F.col("kind")), P.page_route(page, F.col("kind") != "deleted")
    return rows.groupBy(route.alias("route"), write.alias("write")).agg(F.count("*").alias("changes"))


def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    """Link targets with the same first three letters merged into the smallest: what is written, deleted and backed up."""
    docs = _docs(spark, d).where("path is not null").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace(T.file_stem(F.col("path")), r"-\d+$", "").alias("slug"), "text")
    old = docs.select(F.explode(T.wiki_links(F.col("text"))).alias("l")).select(F.col("l.target").alias("old")).distinct()
    new = old.groupBy(F.substring("old", 1, 3).alias("k")).agg(F.min("old").alias("new"))
    redirects = old.withColumn("k", F.substring("old", 1, 3)).join(new, "k").select("old", "new")
    out = I.merge_groups(docs, redirects)
    return out.select("action", F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        image_addresses, image_hits, captioned_images, image_sources, safe_renames, link_keys, cleaned_listings, trimmed_listings, deleted_keys,
        page_source_lists, safe_names, source_names, page_id_checks, resolved_sources, numbered_hits, merged_results, clip_names, answer_parts,
        hosts, entity_summaries, dismissed_groups, first_registered, page_tree, folder_counts, routed_changes, merged_groups,
    )
}

_L = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
_PICTURED = r"""pic as (select * from (select doc_id, regexp_replace(regexp_replace(text, '\[\[([^\]|]+)\|([^\]]*)\]\]', '![\2](media/\1/1.png)', 'g'), '\[\[([^\]|]+)\]\]', '![](https://img.example/\1.png)', 'g') text
  from documents where text is not null) where contains(text, '!['))"""
_IDENTITY = r"regexp_replace(trim(replace({}, '\', '/')), '^.*?raw/sources/', '', 'i')"
_NAME = r"list_last(string_split(replace({}, '\', '/'), '/'))"
_STEM = r"regexp_replace({}, '(.)\.[^.]*$', '\1')"
_TARGETS = f"regexp_extract_all(text, '{_L}', 1)"
# the slug of a source by its parts (a list of steps) and its hash, over identities of ASCII letters
_SLUGS = f"""ids as (select distinct s, {_IDENTITY.format("s")} i from (select unnest(sources) s from wiki_pages) where s is not null),
steps as (select *, list_filter(list_transform(string_split(regexp_replace(i, '\\.[^/.]+$', ''), '/'), lambda x: trim(x)), lambda x: x <> '') p,
  list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(i, ''), lambda c: unicode(c)::hugeint)), lambda h, u: xor(h, u) * 16777619 % 4294967296) h from ids),
long as (select *, array_to_string(list_transform(p, lambda x: length(url_encode(x)) || '-' || url_encode(x)), '--') w, '--' || lower(to_base(h::bigint, 36)) t from steps),
slugs as (select s, i, case when len(p) = 0 then 'source' when len(p) = 1 then p[1] else
  case when length(w) + length(t) <= 120 then w else regexp_replace(regexp_replace(substr(w, 1, 120 - length(t)), '%[0-9A-F]?$', ''), '-+$', '') end || t end slug from long)"""
_LISTING = f"""li as (select doc_id, t, t[1] f, list_transform(t, lambda x: '- [[' || x || ']] see (' || x || '.md)') l from
  (select doc_id, list_transform({_TARGETS}, lambda x: trim(x)) t from documents where text is not null) where len(t) > 0)"""
_KEY = r"regexp_replace(lower(regexp_replace(list_last(string_split({}, '/')), '\.md$', '', 'i')), '[\s_-]+', '', 'g')"
_FRONT = r"regexp_extract(text, '^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', 1, 's')"
_FIELD = r"regexp_replace(trim(regexp_extract(f, '(?m)^{}:[ \t]*(.*)$', 1)), '^[\x22\x27](.*)[\x22\x27]$', '\1')"
_NO_CASE = "list_transform(list_sort(list_transform(list_distinct(list_transform({0}, lambda x: lower(x))), lambda k: list_position(list_transform({0}, lambda x: lower(x)), k))), lambda n: {0}[n])"

ORACLE = {
    "image_addresses": rf"""with {_PICTURED} select doc_id, cast(len(list_distinct(a)) as int) as images, cast(len(list_distinct(list_filter(a, lambda x: not starts_with(x, 'https:')))) as int) as local, a[1] as first
        from (select doc_id, regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1) a from pic)""",
    "image_hits": rf"""with {_PICTURED}, e as (select doc_id, unnest(a) a, unnest(c) c, unnest(range(len(a))) p from (select doc_id, regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1) a,
          regexp_extract_all(text, '!\[([^\]]*)\]\([^)\s]+[^)]*\)', 1) c from pic)),
        o as (select * from e qualify row_number() over (partition by a order by doc_id, p) = 1)
        select a as address, c as caption, doc_id as rank, cast(p as int) as pos, contains(lower(c), 'notes') as match from o""",
    "captioned_images": rf"""with {_PICTURED}, e as (select doc_id, text, regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1) a, regexp_extract_all(text, '!\[([^\]]*)\]\([^)\s]+[^)]*\)', 1) c from pic),
        n as (select doc_id, length(text) l, list_sum(list_transform(list_zip(a, c), lambda z: case when z[1] = a[1] then 9 - length(z[2]) else 0 end)) g, len(list_filter(a, lambda x: x = a[1])) k from e)
        select doc_id, cast(l + coalesce(g, 0) as int) as chars, cast(coalesce(k, 0) as int) as captioned from n""",
    "image_sources": f"""with {_SLUGS}, a as (select 'wiki/media/' || slug || '/img-1.png' as address, slug k from slugs union select 'media/' || {_STEM.format(_NAME.format("s"))} || '/img-1.png', {_STEM.format(_NAME.format("s"))} from slugs),
        docs as (select distinct source path, {_IDENTITY.format("source")} i from documents where source is not null),
        st as (select *, list_filter(string_split(regexp_replace(i, '\\.[^/.]+$', ''), '/'), lambda x: x <> '') p,
          list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(i, ''), lambda c: unicode(c)::hugeint)), lambda h, u: xor(h, u) * 16777619 % 4294967296) h from docs),
        k as (select path, 0 r, case when len(p) = 1 then p[1] else array_to_string(list_transform(p, lambda x: length(url_encode(x)) || '-' || url_encode(x)), '--') || '--' || lower(to_base(h::bigint, 36)) end k from st
          union all select path, 1, {_STEM.format(_NAME.format("path"))} from st)
        select a.address, min(struct_pack(r := k.r, p := k.path)).p as path from a left join k using (k) group by 1""",
    "safe_renames": f"""with {_SLUGS}, f as (select min(i) path, lower(i) lo from slugs group by 2), n as (select min(path) path, count(*) c from f group by lower({_NAME.format("path")}))
        select distinct path, {_STEM.format(_NAME.format("path"))} as old, slug as new from n join slugs on i = path where c = 1 and contains(path, '/') and {_STEM.format(_NAME.format("path"))} <> slug""",
    "link_keys": f"select target, {_KEY.format('target')} as key, count(*) as links from (select trim(unnest({_TARGETS})) target from documents) group by 1, 2",
    "cleaned_listings": f"""with {_LISTING}, c as (select doc_id, l, list_filter(list_zip(t, l), lambda z: {_KEY.format("z[1]")} <> {_KEY.format("f")}) a,
          list_filter(l, lambda x: not (contains(x, '[[' || f || ']]') or regexp_matches(x, '\\b' || regexp_escape(f) || '\\.md\\b'))) b from li)
        select doc_id, cast(length(array_to_string(l, chr(10))) as int) as before, cast(coalesce(length(array_to_string(list_transform(a, lambda z: z[2]), chr(10))), 0) as int) as by_key,
          cast(coalesce(length(array_to_string(b, chr(10))), 0) as int) as by_name from c""",
    "trimmed_listings": f"""with {_LISTING} select doc_id, cast(greatest(list_reduce(list_prepend(0, list_transform(list_filter(l, lambda x: contains(lower(x), 'o')), lambda x: length(x)::int)),
        lambda a, n: case when a + n + 1 <= 200 then a + n + 1 else a end) - 1, 0) as int) as chars from li""",
    "deleted_keys": f"select distinct {_KEY.format('v')} as key from (select slug v from entities union all select title from entities) where v is not null and {_KEY.format('v')} <> ''",
    "page_source_lists": f"""with r as (select page_id, list_filter(list_append(list_transform(list_filter(coalesce(sources, []), lambda x: x is not null), lambda x: {_IDENTITY.format("x")}), {_IDENTITY.format("path")}), lambda x: trim(x) <> '') s,
          list_filter(coalesce(tags, []), lambda x: x is not null and trim(x) <> '') t from wiki_pages where path is not null)
        select distinct page_id, array_to_string({_NO_CASE.format("s")}, '|') as sources, coalesce(array_to_string(list_slice({_NO_CASE.format("t")}, 1, 3), '|'), '') as first_tags from r""",
    "safe_names": r"""with p as (select distinct title, list_filter(string_split(replace('wiki/' || title, '\', '/'), '/'), lambda x: x not in ('', '.', '..')) p from merge_candidates where title is not null),
        c as (select title, list_transform(p, lambda x: struct_pack(s := x, c := regexp_replace(regexp_replace(trim(x, ' '), '[<>:"|?*\x00-\x1f]+', '_', 'g'), '[. ]+$', ''))) q from p)
        select title, array_to_string(list_transform(q, lambda z: case when z.s = z.c then z.s else (case when z.c = '' then '_' else z.c end) || '-' || substr(md5(z.s), 1, 6) end), '/') as path from c""",
    "source_names": f"""with a as (select distinct s stored, lower({_IDENTITY.format("s")}) x from (select unnest(sources) s from wiki_pages) where s is not null), b as (select distinct source identity, lower({_IDENTITY.format("source")}) y from documents where source is not null)
        select stored, identity from a join b on x = y or (not contains(x, '/') and x = {_NAME.format("y")})""",
    "page_id_checks": r"""select valid, count(*) as rows from (select coalesce(regexp_full_match(v, '[\p{L}\p{N}_.-]+') and strlen(v) <= 256, false) as valid from (select page_id v from wiki_chunks union all select title from entities union all select slug from wiki_pages)) group by 1""",
    "resolved_sources": f"""with r as (select distinct {_IDENTITY.format("s")} as reference from (select unnest(sources) s from wiki_pages) where s is not null), f as (select distinct source path from documents where source is not null),
        c as (select reference, o * 2 + m as k, lower(pre || reference || suf) t from r, (values ('', 0), ('wiki/sources/', 1), ('raw/sources/', 2)) a(pre, o), (values ('', 0), ('.md', 1)) b(suf, m))
        select reference, min(struct_pack(k := case when path is null then 9 else k end, p := path)).p as path from c left join f on lower(path) = t group by 1""",
    "numbered_hits": """with h as (select probe_chunk_id, hit_rank, min(chunk_id) c from search_hits where hit_rank <= 3 and chunk_id is not null group by 1, 2)
        select probe_chunk_id, string_agg('[' || n || '] ' || c || chr(10) || chr(10) || hit_rank, chr(10) || chr(10) order by n) as block from (select *, row_number() over (partition by probe_chunk_id order by hit_rank) n from h) group by 1""",
    "merged_results": """with e as (select title, lower(slug) url, 'a' source, 1 l, entity_id o from entities where slug is not null group by all order by o, title, url limit 30),
        p as (select title, lower(slug) url, 'b' source, 0 l, page_id o from wiki_pages where slug is not null group by all order by o, title, url limit 30),
        u as (select *, trim(lower(url)) k from (select *, row_number() over (order by o, title, url) n from p union all select *, row_number() over (order by o, title, url) from e)),
        b as (select * from u qualify row_number() over (partition by k order by l, n) = 1)
        select cast(row_number() over (order by l, n) as int) as rank, url, source from b qualify row_number() over (order by l, n) <= 50""",
    "clip_names": r"""with r as (select distinct group_id, slug, detected_at, title from merge_candidates where detected_at is not null),
        n as (select regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce(title, 'untitled')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50), '-+$', '') || '-' || strftime(detected_at, '%Y-%m-%d') b from r)
        select b || case when k > 1 then '-' || k else '' end || '.md' as name, count(*) as clips from (select b, row_number() over (partition by b) k from n) group by 1""",
    "answer_parts": r"""select doc_id, cast(length(trim(text || ' [' || (doc_id % 7) || '] [' || (doc_id % 3) || ']', ' ')) as int) as chars,
        array_to_string(list_transform(list_filter(case when doc_id % 7 = doc_id % 3 then [doc_id % 7] else [doc_id % 7, doc_id % 3] end, lambda n: n between 1 and 5), lambda n: cast(n as varchar)), ',') as cited,
        cast(length(text) as int) as reasoning from documents where text <> ''""",
    "hosts": r"select case when length(f) % 2 = 0 then f || '.example' else '' end as host, count(*) as documents from (select regexp_extract(source, '^raw/sources/([^/]+)/', 1) f from documents) group by 1",
    "entity_summaries": rf"""with d as (select doc_id, path, {_FRONT} f, regexp_replace(text, '^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', '', 's') b from documents where text is not null),
        g as (select doc_id, regexp_replace(list_last(string_split(coalesce(path, ''), '/')), '\.md$', '') slug, {_FIELD.format("type")} y, {_FIELD.format("title")} t, {_FIELD.format("description")} ds,
          list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and not starts_with(x, '#') and not starts_with(x, '|'))[1] fl,
          list_filter(list_transform(string_split(regexp_extract(f, '(?m)^tags:[ \t]*\[(.*)\][ \t]*$', 1), ','), lambda x: regexp_replace(trim(x), '^[\x22\x27](.*)[\x22\x27]$', '\1')), lambda x: x <> '') tg from d where f <> '')
        select doc_id, slug, coalesce(nullif(y, ''), 'unknown') as type, coalesce(nullif(t, ''), slug) as title, case when length(x) > 200 then substr(x, 1, 199) || '…' else x end as description, coalesce(array_to_string(tg, '|'), '') as tags
        from (select *, coalesce(nullif(ds, ''), fl) x from g)""",
    "dismissed_groups": """with g as (select group_id, list_sort(list(distinct slug)) s, array_to_string(list_sort(list(distinct lower(slug))), '|') k from merge_candidates where slug is not null group by 1)
        select k as key, min(struct_pack(o := group_id % 2 <> 0, s := array_to_string(s, '|'))).s as slugs from g where contains(k, '|') group by 1""",
    "first_registered": """with u as (select 0 o, slug, path from entities union all select 1, slug, path from wiki_pages union all select 2, slug, path from merge_candidates)
        select slug, path from u where path is not null and coalesce(slug, '') <> '' qualify row_number() over (partition by slug order by o, path) = 1""",
    "page_tree": """with p as (select distinct path, coalesce(type, 'other') as type from wiki_pages)
        select cast(case type when 'overview' then 1 when 'entity' then 2 when 'concept' then 3 when 'source' then 4 when 'query' then 5 when 'synthesis' then 6 else 7 end as int) as position, type, count(*) as pages
        from p where coalesce(regexp_extract(replace(path, '\\', '/'), '[^/]*$'), '') not in ('index.md', 'log.md') group by 1, 2""",
    "folder_counts": r"""with p as (select distinct list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x <> '') p from file_change_tasks where path is not null)
        select folder, count(*) as files from (select unnest(list_transform(range(1, len(p)), lambda n: array_to_string(p[1:n], '/'))) as folder from p where len(list_filter(p, lambda x: starts_with(x, '.'))) = 0) group by 1""",
    "routed_changes": r"""with r as (select kind, replace(coalesce(path, ''), '\', '/') p, list_last(string_split(replace(coalesce(path, ''), '\', '/'), '/')) n, regexp_replace(coalesce(path, ''), '^raw/sources/', 'wiki/sources/') w from file_change_tasks),
        q as (select *, starts_with(p, 'raw/sources/') and lower(regexp_extract(n, '.\.([^.]*)$', 1)) in ('md', 'mdx', 'txt', 'pdf', 'doc', 'docx', 'pptx', 'xlsx', 'odt', 'odp', 'ods', 'xls', 'csv', 'json', 'html', 'htm', 'rtf', 'xml', 'yaml', 'yml')
            and not list_contains(string_split(p, '/'), '.cache') and not starts_with(n, '.') src,
          starts_with(replace(w, '\', '/'), 'wiki/') and len(list_filter(string_split(replace(w, '\', '/'), '/'), lambda x: x in ('', '.', '..') or regexp_matches(x, '[<>:"|?*\x00-\x1f]|[. ]$') or regexp_matches(x, '^(?:con|prn|aux|nul|com\d|lpt\d)(?:\.|$)', 'i'))) = 0 safe,
          starts_with(w, 'wiki/entities/') or starts_with(w, 'wiki/sources/') or contains(w, '/entities/') or contains(w, '/sources/') free from r)
        select case when kind = 'deleted' and src then 'source_deleted' when kind = 'deleted' and starts_with(p, 'wiki/') and ends_with(p, '.md') and n not in ('index.md', 'log.md', 'overview.md') then 'page_deleted'
          when kind in ('created', 'modified') and src then 'ingest' else 'none' end as route,
          case when not safe or not (n = 'log.md' or free or coalesce(kind <> 'deleted', true)) then 'drop' when n = 'log.md' then 'append' when n in ('index.md', 'overview.md') then 'overwrite' else 'merge' end as write, count(*) as changes
        from q group by 1, 2""",
    "merged_groups": rf"""with d as (select doc_id, regexp_replace({_STEM.format(_NAME.format("path"))}, '-[0-9]+$', '') slug, text from documents where text is not null and path is not null),
        t as (select distinct trim(unnest({_TARGETS})) o from d), r as (select * from (select o, min(o) over (partition by substr(o, 1, 3)) n from t) where o <> n),
        g as (select * from d where slug in (select o from r)), s as (select * from d where slug not in (select o from r)),
        x as (select doc_id, unnest(string_split(text, '[[')) p, unnest(range(len(string_split(text, '[[')))) i from s),
        y as (select doc_id, i, case when i > 0 and n is not null then n || substr(p, length(o) + 1) else p end p, n from (select x.*, regexp_extract(p, '^([^\]|]+)(?:\|[^\]]+)?\]\]', 1) k from x) z left join r on o = k and i > 0),
        w as (select doc_id, string_agg(p, '[[' order by i) as text from y group by 1 having count(n) > 0)
        select 'write' as action, doc_id, md5(text) as hash from w union all select 'delete', doc_id, null from g union all select 'backup', doc_id, md5(text) from g union all select 'backup', doc_id, md5(text) from s where doc_id in (select doc_id from w)""",
}
