"""Queries on titles, front matter, paths and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import language as L
from corpusmith.functions import predicates as P
from corpusmith.functions import text as T
from corpusmith.functions.records import parse_front_matter
from corpusmith.session import load
from corpusmith.sources.files import category


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def language_id(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", L.language_of(F.col("text")).alias("language"))


def language_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Detected languages against the stated ones."""
    rows = _docs(spark, d).select(F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)).alias("stated"), L.language_of(F.col("text")).alias("language"))
    return rows.groupBy("stated", "language").agg(F.count("*").alias("documents"))


def doc_titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.title_of(F.col("text"), F.col("path")).alias("title"))


def front_matter_fields(spark: SparkSession, d: str) -> DataFrame:
    front = T.front_matter(F.col("text"))
    rows = _docs(spark, d).withColumn("_f", front).where("_f <> ''")
    return rows.select(
        "doc_id", T.scalar_field(F.col("_f"), "type").alias("type"), T.scalar_field(F.col("_f"), "updated").alias("updated"),
        F.array_join(T.list_field(F.col("_f"), "tags"), "|").alias("tags"),
    )


def body_length(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(T.body_of(F.col("text"))).alias("chars"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _docs(spark, d).where("path is not null").select(
        "doc_id", T.file_name(p).alias("name"), T.file_stem(p).alias("stem"), T.extension(p).alias("extension"),
        T.folder_context(p).alias("folders"), T.page_type(p).alias("type"),
    )


def source_usage(spark: SparkSession, d: str) -> DataFrame:
    """Pages and documents that name each source, by its identity."""
    pages = load(spark, d, "wiki_pages").select("page_id", F.explode("sources").alias("s"))
    named = pages.select(F.lower(T.source_identity(F.col("s"))).alias("source"), "page_id").where("source <> ''").distinct().groupBy("source").agg(F.count("*").alias("pages"))
    docs = _docs(spark, d).select(F.lower(T.source_identity(F.col("source"))).alias("source")).where("source is not null").groupBy("source").agg(F.count("*").alias("documents"))
    out = named.join(docs, "source", "full_outer")
    return out.select("source", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("documents", F.lit(0)).alias("documents"))


def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text names each file."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_-]+(?:\.[a-z0-9]+)*\.(?:md|pdf|docx|csv)"), 0))
    return _docs(spark, d).select("doc_id", F.explode(words).alias("file")).groupBy("file").agg(F.count("*").alias("documents"))


def file_slugs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entities").select("entity_id", T.slug_of(F.coalesce("title", F.lit(""))).alias("slug")).distinct()


def review_titles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "merge_candidates").select(T.review_title(F.concat(F.lit("Missing page:  "), F.coalesce("title", F.lit("")))).alias("title")).groupBy("title").agg(F.count("*").alias("times"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    groups = _docs(spark, d).where("text <> ''").groupBy(F.sha2("text", 256).alias("hash"))
    return groups.agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id")).where("documents > 1")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """How a context window of each length is shared out: 50 % pages, 5 % index, 15 % answer; a page gets 30 % of the pages, at least 5,000."""
    size = F.greatest(F.coalesce(F.col("n_chars"), F.lit(204_800)), F.lit(1))
    pages = F.floor(size * 0.5)
    cap = F.least(pages, F.greatest(F.lit(5000), F.floor(pages * 0.3)))
    return _docs(spark, d).select("doc_id", pages.alias("pages"), F.floor(size * 0.05).alias("index_chars"), F.floor(size * 0.15).alias("answer"), cap.alias("page_cap"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every evaluation item as a query."""
    rows = load(spark, d, "eval_items").select("item_id", F.explode(T.tokens_of(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.countDistinct("item_id").alias("items"))


def tag_union(spark: SparkSession, d: str) -> DataFrame:
    """Tags and sources of each page as one list, each value once whatever its case."""
    both = T.union_ignoring_case(F.col("tags"), F.col("sources"))
    return load(spark, d, "wiki_pages").select("page_id", F.array_join(both, "|").alias("labels")).distinct()


def front_matter_records(spark: SparkSession, d: str) -> DataFrame:
    """Front matter read as YAML: fields and list entries of each document that has any."""
    rows = parse_front_matter(load(spark, d, "documents")).where("fields is not null")
    entries = F.aggregate(F.map_values("fields"), F.lit(0), lambda n, v: n + F.size(v))
    return rows.select("doc_id", F.size("fields").alias("fields"), entries.alias("entries"), F.coalesce(F.try_element_at("fields", F.lit("type"))[0], F.lit("")).alias("type"))


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """What may be done with the paths of the change feed: ingested, imported, written as a page."""
    rows = load(spark, d, "file_change_tasks").where("path is not null").select("path").distinct()
    p = F.col("path")
    return rows.select(P.ingestable(p).alias("ingestable"), P.importable(p).alias("importable"), P.safe_page_path(p).alias("page")).groupBy("ingestable", "importable", "page").agg(F.count("*").alias("paths"))


def source_categories(spark: SparkSession, d: str) -> DataFrame:
    """Sources and paths of the documents by category."""
    docs = load(spark, d, "documents")
    rows = docs.select("source").union(docs.select("path")).toDF("path").where("path is not null").select(category(F.col("path")).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        language_id, language_mismatch, doc_titles, front_matter_fields, body_length, path_parts, source_usage, file_mentions, file_slugs,
        review_titles, exact_duplicates, context_budget, query_tokens, tag_union, front_matter_records, source_categories, safe_paths,
    )
}


# the SQL states the rules itself, as one rule a line, so that it checks those of the code
_SCRIPT_SQL = """
Chinese [\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}]
Japanese [\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF65}-\\x{FF9F}]
Korean [\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]
Arabic [\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]
Hebrew [\\x{0590}-\\x{05FF}\\x{FB1D}-\\x{FB4F}]
Thai [\\x{0E00}-\\x{0E7F}]
Hindi [\\x{0900}-\\x{097F}]
Bengali [\\x{0980}-\\x{09FF}]
Tamil [\\x{0B80}-\\x{0BFF}]
Telugu [\\x{0C00}-\\x{0C7F}]
Kannada [\\x{0C80}-\\x{0CFF}]
Malayalam [\\x{0D00}-\\x{0D7F}]
Gujarati [\\x{0A80}-\\x{0AFF}]
Punjabi [\\x{0A00}-\\x{0A7F}]
Burmese [\\x{1000}-\\x{109F}]
Khmer [\\x{1780}-\\x{17FF}]
Lao [\\x{0E80}-\\x{0EFF}]
Georgian [\\x{10A0}-\\x{10FF}\\x{2D00}-\\x{2D2F}]
Armenian [\\x{0530}-\\x{058F}]
Amharic [\\x{1200}-\\x{137F}]
Tibetan [\\x{0F00}-\\x{0FFF}]
Sinhala [\\x{0D80}-\\x{0DFF}]
Russian [\\x{0400}-\\x{04FF}\\x{0500}-\\x{052F}]
Greek [\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]
"""
_LATIN_SQL = """
Vietnamese ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ -
Turkish ğış (^|A)(bir|ve|için|ile|bu|da|de|değil|ama)(A|$)
Polish ąćęłńóśźż -
Czech ěšžřďťňů -
Romanian ăâîșț (^|A)(este|sau|care|pentru)(A|$)|Bși(A|$)
Hungarian őű -
German - (^|A)(und|der|die|das|ist)(A|$)
French - (^|A)(le|la|les|est|une|des)(A|$)
Portuguese ãõç (^|A)(o|a|os|as|de|do|da|em|um|uma|não|que)(A|$)|BéB
Spanish - (^|A)(el|los|las|del|por)(A|$)
Spanish ñ¿¡ -
Italian - (^|A)(il|della|gli|che)(A|$)|BèB
Dutch - (^|A)(het|een|van|dat)(A|$)
Swedish åäö (^|A)(och|att|det|en|ett|för|med)(A|$)|Bär(A|$)
Norwegian åæø (^|A)(og|er|det|en|et|for|med)(A|$)|(^|A)påB
Danish åæø (^|A)(og|er|det|en|et|til|med|af)(A|$)
Finnish äö (^|A)(ja|on|ei|se|tai|kun|niin)(A|$)|(^|A)ettäB
Indonesian - (^|A)(yang|dari|untuk|dengan|adalah)(A|$)
Swahili - (^|A)(na|ya|wa|ni|kwa|katika|hii|hiyo)(A|$)
"""


def _language() -> str:
    scripts = [line.split(" ") for line in _SCRIPT_SQL.split("\n") if line]
    counts = ", ".join(f"length(regexp_replace(t, '[^{chars[1:]}', '', 'g')) n_{name}" for name, chars in scripts)
    persian = (
        "case when p >= 3 and p > q then 'Persian' else 'Arabic' end"
    )
    out = "case when n_Japanese > 0 and n_Chinese > 0 then 'Japanese' "
    out += " ".join(f"when m >= 2 and n_{name} = m then {persian if name == 'Arabic' else repr(name)}" for name, _ in scripts)
    for line in filter(None, _LATIN_SQL.split("\n")):
        name, letters, words = line.split(" ")
        tests = [f"regexp_matches(l, '[{letters}]')"] if letters != "-" else []
        if words != "-":
            tests.append("regexp_matches(l, '" + words.replace("A", "[^0-9a-z_]").replace("B", "[0-9a-z_]") + "')")
        out += f" when {' and '.join(tests)} then '{name}'"
    score = (
        "3 * length(regexp_replace(t, '[^پچژگ]', '', 'g')) + length(regexp_replace(t, '[^کی]', '', 'g')) + 2 * len(list_filter(['این', 'است', 'که', 'برای', 'های', 'را', 'در', 'به', 'از', 'می', 'یک'], lambda x: contains(s, ' ' || x || ' '))) p, "
        "length(regexp_replace(t, '[^كيةىإأؤئ]', '', 'g')) + 2 * len(list_filter(['ال', 'في', 'من', 'على', 'هذا', 'هذه', 'إلى', 'التي', 'الذي', 'كان'], lambda x: contains(s, ' ' || x || ' '))) q"
    )
    return (
        f"lang_ as (select doc_id, lang, {out} else 'English' end as language from (select *, greatest({', '.join(f'n_{name}' for name, _ in scripts)}) m from "
        f"(select doc_id, lang, lower(t) l, {counts}, {score} from (select doc_id, lang, coalesce(text, '') t, ' ' || regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' s from documents))))"
    )


_NAME = "list_last(string_split(replace(path, '\\', '/'), '/'))"
_STEM = f"regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1')"
_FRONT = "regexp_extract(coalesce(text, ''), '^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)', 1, 's')"


def _scalar(name: str) -> str:
    return f"regexp_replace(trim(regexp_extract({_FRONT}, '(?m)^{name}:[ \\t]*(.*)$', 1)), '^[\"''](.*)[\"'']$', '\\1')"


_FOLDERS = """when contains(path, '/entities/') then 'entity' when contains(path, '/concepts/') then 'concept' when contains(path, '/sources/') then 'source'
        when contains(path, '/queries/') then 'query' when contains(path, '/comparisons/') then 'comparison' when contains(path, '/synthesis/') then 'synthesis'
        when contains(path, '/findings/') then 'finding' when contains(path, '/thesis/') then 'thesis' when contains(path, '/methodology/') then 'methodology'"""
_IDENTITY = "lower(regexp_replace(trim(replace({}, '\\', '/')), '^.*?raw/sources/', '', 'i'))"
_STOP = """'的', '是', '了', '什么', '在', '有', '和', '与', '对', '从', 'the', 'is', 'a', 'an', 'what', 'how', 'are', 'was', 'were', 'do', 'does', 'did', 'be', 'been', 'being',
        'have', 'has', 'had', 'it', 'its', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'this', 'that', 'these', 'those'"""
_SEP = r"[\s!-/:-@\[-`{-~，。！？、；：“”‘’（）·～…]+"

ORACLE = {
    "tag_union": """with r as (select page_id, list_filter(list_concat(coalesce(tags, []), coalesce(sources, [])), lambda x: x is not null and trim(x) <> '') l from wiki_pages),
        k as (select page_id, l, list_transform(l, lambda x: lower(x)) w from r)
        select distinct page_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda n: l[n]), '|'), '') as labels from k""",
    "front_matter_records": f"""select doc_id, cast(len(l) as int) as fields, cast(len(list_filter(l, lambda x: not regexp_matches(x, '^tags:'))) + case when contains(f, 'tags:') then len(string_split(regexp_extract(f, '(?m)^tags:[ \\t]*\\[(.*)\\]', 1), ',')) else 0 end as int) as entries,
        regexp_extract(f, '(?m)^type:[ \\t]*(.*)$', 1) as type from (select doc_id, f, list_filter(string_split(f, chr(10)), lambda x: contains(x, ':')) l from (select doc_id, {_FRONT} f from documents) where f <> '')""",
    "safe_paths": f"""with p as (select distinct path, replace(path, '\\', '/') q from file_change_tasks where path is not null), e as (select *, string_split(q, '/') parts, list_last(string_split(q, '/')) n from p)
        select regexp_extract(lower(n), '.\\.([^.]*)$', 1) in ('md', 'mdx', 'txt', 'pdf', 'doc', 'docx', 'pptx', 'xlsx', 'odt', 'odp', 'ods', 'xls', 'csv', 'json', 'html', 'htm', 'rtf', 'xml', 'yaml', 'yml') and not list_contains(parts, '.cache') and not starts_with(n, '.') as ingestable,
          len(list_filter(parts, lambda x: lower(x) in ('wiki', 'cache', '.cache', '.git', 'node_modules', '.obsidian') or (starts_with(x, '.') and x not in ('.', '..')))) = 0 and regexp_extract(lower(n), '.\\.([^.]*)$', 1) not in ('json', 'yaml', 'yml', 'xml') and n <> '' as importable,
          starts_with(q, 'wiki/') and len(list_filter(parts, lambda x: x in ('', '.', '..') or regexp_matches(x, '[<>:"|?*]|[. ]$'))) = 0 as page, count(*) as paths from e group by 1, 2, 3""",
    "source_categories": """select case when e in ('md', 'mdx') then 'markdown' when e in ('txt', 'rtf', 'log') then 'text' when e = 'pdf' then 'pdf'
        when e in ('json', 'jsonl', 'csv', 'tsv', 'yaml', 'yml', 'ndjson') then 'data' when e in ('mp4', 'webm', 'mov', 'avi', 'mkv', 'flv', 'wmv', 'm4v') then 'video'
        when e in ('mp3', 'wav', 'ogg', 'flac', 'aac', 'm4a', 'wma') then 'audio' when e in ('doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'odt', 'ods', 'odp', 'pages', 'numbers', 'key', 'epub') then 'document'
        when e in ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'ico', 'tiff', 'tif', 'avif', 'heic', 'heif') then 'image'
        when e in ('js', 'jsx', 'ts', 'tsx', 'py', 'rs', 'go', 'java', 'c', 'cpp', 'h', 'hpp', 'rb', 'php', 'swift', 'kt', 'scala', 'sh', 'bash', 'zsh', 'sql', 'r', 'lua', 'css', 'scss', 'less', 'html', 'htm',
          'xml', 'svg', 'vue', 'svelte', 'toml', 'ini', 'cfg', 'conf', 'dockerfile', 'makefile') then 'code' else 'unknown' end as category, count(*) as documents
        from (select lower(list_last(string_split(p, '.'))) e from (select source p from documents union all select path from documents) where p is not null) group by 1""",
    "language_id": f"with {_language()} select doc_id, language from lang_",
    "language_mismatch": f"with {_language()} select lower(substr(coalesce(lang, ''), 1, 2)) as stated, language, count(*) as documents from lang_ group by 1, 2",
    "doc_titles": f"""select doc_id, case when {_scalar("title")} <> '' then {_scalar("title")}
        when trim(regexp_extract(coalesce(text, ''), '(?m)^# (.*)$', 1)) <> '' then trim(regexp_extract(coalesce(text, ''), '(?m)^# (.*)$', 1)) else replace({_STEM}, '-', ' ') end as title from documents""",
    "front_matter_fields": f"""select doc_id, {_scalar("type")} as type, {_scalar("updated")} as updated,
        coalesce(array_to_string(list_filter(list_transform(string_split(regexp_extract({_FRONT}, '(?m)^tags:[ \\t]*\\[(.*)\\][ \\t]*$', 1), ','), lambda v: trim(v)), lambda v: v <> ''), '|'), '') as tags
        from documents where {_FRONT} <> ''""",
    "body_length": "select doc_id, cast(length(regexp_replace(coalesce(text, ''), '^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)', '', 's')) as int) as chars from documents",
    "path_parts": f"""select doc_id, {_NAME} as name, {_STEM} as stem, lower(regexp_extract({_NAME}, '.\\.([^.]*)$', 1)) as extension,
        array_to_string(list_slice(string_split(regexp_replace(replace(path, '\\', '/'), '^.*?raw/sources/', '', 'i'), '/'), 1, -2), ' > ') as folders,
        case {_FOLDERS} when {_NAME} = 'overview.md' then 'overview' else 'other' end as type from documents where path is not null""",
    "source_usage": f"""select source, coalesce(pages, 0) as pages, coalesce(documents, 0) as documents from
        (select {_IDENTITY.format("s")} source, count(distinct page_id) pages from (select page_id, unnest(sources) s from wiki_pages) where {_IDENTITY.format("s")} <> '' group by 1)
        full join (select {_IDENTITY.format("source")} source, count(*) documents from documents where source is not null group by 1) using (source)""",
    "file_mentions": """select file, count(*) as documents from (
        select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+(?:\\.[a-z0-9]+)*\\.(?:md|pdf|docx|csv)')) file from documents) group by 1""",
    "file_slugs": """select distinct entity_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50), '-+$', '') as slug from entities""",
    "review_titles": "select lower(trim(regexp_replace(trim(coalesce(title, ''), ' \t'), '\\s+', ' ', 'g'))) as title, count(*) as times from merge_candidates group by 1",
    "exact_duplicates": "select sha256(text) as hash, count(*) as documents, min(doc_id) as first_doc_id from documents where text <> '' group by 1 having count(*) > 1",
    "context_budget": """select doc_id, p as pages, cast(floor(n * 0.05) as bigint) as index_chars, cast(floor(n * 0.15) as bigint) as answer, least(p, greatest(5000, cast(floor(p * 0.3) as bigint))) as page_cap
        from (select doc_id, n, cast(floor(n * 0.5) as bigint) p from (select doc_id, greatest(coalesce(n_chars, 204800), 1) n from documents))""",
    "query_tokens": f"""with w as (select item_id, unnest(regexp_split_to_array(lower(text), '{_SEP}')) w from eval_items),
        k as (select item_id, w, regexp_matches(w, '[㐀-鿿]') and length(w) > 2 c from w where length(w) > 1 and w not in ({_STOP})),
        t as (select item_id, w token from k
          union select item_id, substr(w, i, 2) from (select item_id, w, unnest(range(1, length(w))) i from k where c)
          union select item_id, x from (select item_id, substr(w, i, 1) x from (select item_id, w, unnest(range(1, length(w) + 1)) i from k where c)) where x not in ({_STOP}))
        select token, count(distinct item_id) as items from t group by 1""",
}
