"""The SQL each query is checked against, where SQL can say it."""

_UNFILLED = (
    "'none', '(none)', 'null', 'todo', 'tbd', 'unknown', 'n/a', 'na', 'nil', 'nan', 'undefined', 'empty', "
    "'s/o', 'k. a.', 'k.a.', 's/d', '无', '無', 'なし', '없음', 'нет'"
)


def _filled(c: str) -> str:
    t = f"trim({c}, ' \t\r\n')"
    return f"coalesce(regexp_matches({t}, '[\\p{{L}}\\p{{N}}\\p{{S}}]') and lower({t}) not in ({_UNFILLED}), false)"


P3_FOUND = f"""
with raw as (
  select distinct group_id, slug, title, description, content, created, tags, sources, related,
         lower(trim(updated, ' \t\r\n')) u, coalesce(lower(trim(confidence, ' \t\r\n')), '') c
  from merge_candidates where group_id is not null and slug is not null),
m as (
  select group_id, slug, length(trim(content, ' \t\r\n')) size,
    {_filled("title")} has_title, {_filled("description")} has_description, {_filled("content")} has_content,
    cast({_filled("title")} as int) + cast({_filled("description")} as int) + cast({_filled("content")} as int) + cast({_filled("created")} as int)
      + cast(coalesce(len(list_filter(tags, lambda x: {_filled("x")})) > 0, false) as int)
      + cast(coalesce(len(list_filter(sources, lambda x: {_filled("x")})) > 0, false) as int)
      + cast(coalesce(len(list_filter(related, lambda x: {_filled("x")})) > 0, false) as int) n,
    case c when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end conf,
    coalesce(try_strptime(substr(replace(u, '/', '-'), 1, 10), ['%Y-%m-%d']), try_strptime(u, ['%Y%m%d', '%d %b %Y', '%b %d, %Y']), timestamp '0001-01-01') as day
  from raw),
ok as (select * from m where group_id in (select group_id from m group by group_id having count(distinct slug) > 1))
select group_id, 'canonical' as field, arg_min(slug, (-n, -epoch(day), -conf, slug)) as slug from ok where n > 0 group by group_id
union all
select group_id, 'title', arg_min(slug, (-conf, -epoch(day), slug)) from ok where has_title group by group_id
union all
select group_id, 'description', arg_min(slug, (-epoch(day), -conf, slug)) from ok where has_description group by group_id
union all
select group_id, 'content', arg_min(slug, (-size, -epoch(day), slug)) from ok where has_content group by group_id
"""


def _sets(table: str, key: str, column: str, value: str) -> str:
    return (
        f"(select id, list_sort(list(distinct v)) vals from (select {key} id, {value} v from "
        f"(select {key}, unnest({column}) x from {table})) where v <> '' group by id having count(distinct v) >= 3)"
    )


_TAG = "lower(trim(x, ' \t\r\n'))"
_SOURCE = f"regexp_replace(replace({_TAG}, '\\', '/'), '^.*raw/sources/', '', 's')"


def _pairs(kind: str, left: str, right: str) -> str:
    """Pairs by exact counts of shared values."""
    return f"""
select '{kind}' as pair_kind, a as id_a, b as id_b from (
  select l.id a, r.id b, count(*) n, any_value(len(l.vals)) na, any_value(len(r.vals)) nb
  from (select id, vals, unnest(vals) v from {left}) l join (select id, vals, unnest(vals) v from {right}) r on l.v = r.v and l.id < r.id
  group by 1, 2) where n >= 0.6 * (na + nb - n) - 1e-9"""


_PAGE_TAGS = _sets("wiki_pages", "page_id", "tags", _TAG)
_PAGE_SOURCES = _sets("wiki_pages", "page_id", "sources", _SOURCE)
_ENTITY_TAGS = _sets("entities", "entity_id", "tags", _TAG)

P4_FOUND = " union all ".join(
    [
        _pairs("page_tags", _PAGE_TAGS, _PAGE_TAGS),
        _pairs("page_sources", _PAGE_SOURCES, _PAGE_SOURCES),
        _pairs("entity_page_tags", _ENTITY_TAGS, _PAGE_TAGS),
    ]
)



def _classes(sets: str) -> str:
    return f"""
with s as (select * from {sets}),
c as (select vals, min(id) class_id from s group by vals),
e as (select class_id, vals, unnest(vals) v from c),
n as (select x.class_id, count(*) links from (
        select l.class_id, r.class_id other, count(*) n, any_value(len(l.vals)) na, any_value(len(r.vals)) nb
        from e l join e r on l.v = r.v and l.class_id <> r.class_id group by 1, 2) x
      where n >= 0.6 * (na + nb - n) - 1e-9 group by 1)
select p.page_id as id, c.class_id, cast(coalesce(n.links, 0) as bigint) as links
from (select distinct page_id from wiki_pages where page_id is not null) p
left join s on s.id = p.page_id left join c on c.vals = s.vals left join n on n.class_id = c.class_id
"""


P1_FOUND = """
with last as (select chunk_id, arg_max(embedding, coalesce(upserted_at, timestamp '1970-01-01')) e from wiki_chunks where chunk_id is not null group by 1),
ok as (select chunk_id, e::double[] e from last where len(e) = 64 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
d as (
  select q.chunk_id probe_chunk_id, o.chunk_id, list_sum(list_transform(list_zip(q.e, o.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) dist
  from ok q join (select distinct chunk_id from probe_chunks) p using (chunk_id) join ok o on o.chunk_id <> q.chunk_id)
select probe_chunk_id, chunk_id from d qualify row_number() over (partition by probe_chunk_id order by dist, chunk_id) <= 10
"""

ORACLE: dict[str, str] = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_tag_classes": _classes(_PAGE_TAGS), "p4_source_classes": _classes(_PAGE_SOURCES)}
