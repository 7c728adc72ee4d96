"""Queries on the link graphs that the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.operators import graph as G
from corpusmith.session import durable, load

_KINDS = ["entity", "concept", "source", "query", "synthesis"]


def _links(spark: SparkSession, d: str) -> DataFrame:
    """A part is linked to the part of the next line of its order."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return lines.select(F.col("l_partkey").alias("src"), nxt.alias("dst")).where("dst is not null")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("node"), kind.alias("type"), F.pmod("p_partkey", F.lit(20)).alias("community"), F.col("p_name").alias("label"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("source")).distinct()


def _counted(spark: SparkSession, d: str) -> DataFrame:
    counts = G.link_counts(_links(spark, d)).select("node", F.col("pairs").alias("links"))
    return _nodes(spark, d).join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(_links(spark, d)).select("a", "b", F.col("links").cast("double").alias("weight"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    seeds = nodes.where("node % 20 = 0").select("node")
    return G.relevance(nodes, G.distinct_edges(_links(spark, d)), _sources(spark, d), seeds)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(_links(spark, d))


def graph_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.link_counts(_links(spark, d))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(G.distinct_edges(_links(spark, d)))


def graph_relevance(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    full = G.fill_related(G.top_related(_scored(spark, d)), nodes, nodes.where("node % 20 = 0"))
    return full.select("seed", "rank", "node", F.round("relevance", 5).alias("relevance"))


def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    hits = _nodes(spark, d).where("node % 20 = 0").select("node")
    return G.expand(_scored(spark, d), hits).select("node", F.round("relevance", 5).alias("relevance"), "seeds")


def community_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return G.cohesion(G.undirected(_links(spark, d)), _nodes(spark, d)).withColumn("cohesion", F.round("cohesion", 8))


def community_leaders(spark: SparkSession, d: str) -> DataFrame:
    counted = _counted(spark, d)
    return G.community_leaders(counted, _nodes(spark, d).select("node", "community"))


def surprising_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.surprising_edges(_weighted(spark, d), _counted(spark, d), least=5)


def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = G.knowledge_gaps(G.undirected(_links(spark, d)), _counted(spark, d))
    return gaps.withColumn("value", F.round("value", 8))


def top_surprises(spark: SparkSession, d: str) -> DataFrame:
    return G.top_surprises(_weighted(spark, d), _counted(spark, d))


def top_gaps(spark: SparkSession, d: str) -> DataFrame:
    return G.top_gaps(G.undirected(_links(spark, d)), _counted(spark, d)).withColumn("value", F.round("value", 8))


def shown_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the first 200 nodes that a listing shows."""
    return G.shown_graph(_nodes(spark, d), G.undirected(_links(spark, d)), "1", "concept")[1]


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.page_graph(load(spark, d, "documents"))


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Pages as nodes, with their links counted."""
    nodes, links = _pages(spark, d)
    counts = G.link_counts(links)
    return nodes.join(counts, "node", "left").select("node", "type", "path", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_edges(_pages(spark, d)[1])


def page_related(spark: SparkSession, d: str) -> DataFrame:
    """The five pages most relevant to a twentieth of the pages, against all pages; lists are filled up by type."""
    nodes, links = _pages(spark, d)
    seeds = nodes.where(F.pmod(F.xxhash64("node"), F.lit(20)) == 0)
    sources = load(spark, d, "documents").where("path is not null and source is not null").select(F.regexp_replace(T.file_stem(F.col("path")), r"-\d+$", "").alias("node"), "source")
    scored = G.relevance(nodes, G.distinct_edges(links), sources, seeds)
    return G.fill_related(G.top_related(scored), nodes, seeds).select("seed", "rank", "node", F.round("relevance", 5).alias("relevance"))


def _grouped_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Undirected edges of the page graph and its nodes with the communities found in it; a page without links is one of its own."""
    nodes, links = _pages(spark, d)
    edges = durable(G.undirected(links))
    found = G.communities(edges.select("a", "b", F.col("links").cast("double").alias("weight")))
    counts = G.link_counts(links).select("node", F.col("pairs").alias("links"))
    full = nodes.join(found, "node", "left").join(counts, "node", "left")
    return edges, durable(full.select("node", "label", "type", F.coalesce("community", "node").alias("community"), F.coalesce("links", F.lit(0)).alias("links")))


def page_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the page graph with cohesion and the page linked best, largest first."""
    edges, nodes = _grouped_pages(spark, d)
    leaders = G.community_leaders(nodes, nodes.select("node", "community"), 1).select("community", F.col("node").alias("leader"))
    return G.cohesion(edges, nodes).join(leaders, "community").select("community", "nodes", "inner_edges", F.round("cohesion", 8).alias("cohesion"), "leader")


def page_insights(spark: SparkSession, d: str) -> DataFrame:
    """What stands out in the page graph: the most surprising links and the gaps that are shown."""
    edges, nodes = _grouped_pages(spark, d)
    weighted = edges.select("a", "b", F.col("links").cast("double").alias("weight"))
    surprises = G.top_surprises(weighted, nodes).select(F.lit("surprise").alias("gap"), F.concat_ws(" - ", "a", "b").alias("id"), F.col("surprise").cast("double").alias("value"))
    return surprises.unionByName(G.top_gaps(edges, nodes))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    nodes = G.search_nodes(_nodes(spark, d), "1 concept")
    return G.induced(nodes, G.undirected(_links(spark, d)))


def graph_filter(spark: SparkSession, d: str) -> DataFrame:
    """Edges left when sources, queries, isolated and over-linked nodes are hidden."""
    shown = _counted(spark, d).where("type not in ('source', 'query') and links between 1 and 40")
    return G.induced(shown, G.undirected(_links(spark, d)))


def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(_weighted(spark, d))


def _doc_links(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.wiki_links(F.col("text"))).alias("position", "_l")).select("doc_id", "position", "_l.target", "_l.label")


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return _doc_links(spark, d)


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Link targets resolved to the documents that bear the name."""
    found = G.resolve_links(_doc_links(spark, d).select("doc_id", "target"), G.node_ids(load(spark, d, "documents")))
    return found.groupBy("target").agg(F.first("node_id").alias("node_id"), F.count("*").alias("links"))


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Links without a document of that name: one row per occurrence."""
    known = G.node_ids(load(spark, d, "documents")).select(F.lower("node_id").alias("_k")).distinct()
    links = _doc_links(spark, d).withColumn("_k", F.lower(F.element_at(F.split("target", "/"), -1)))
    return links.join(known, "_k", "left_anti").select("doc_id", "position", "target")


def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    """Wiki documents that no link names; a document's link to itself counts."""
    docs = load(spark, d, "documents").where("page_type = 'wiki'")
    named = docs.select("doc_id", F.lower(F.regexp_replace(T.file_stem(F.col("path")), r"-\d+$", "")).alias("_k"))
    linked = _doc_links(spark, d).select(F.lower("target").alias("_k")).distinct()
    return named.join(linked, "_k", "left_anti").select("doc_id")


def no_outlinks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("page_type = 'wiki'")
    return docs.where(F.size(T.wiki_links(F.coalesce("text", F.lit("")))) == 0).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_link_counts, graph_degrees, graph_relevance, graph_expand, community_cohesion, community_leaders, surprising_edges,
        knowledge_gaps, graph_search, graph_filter, graph_communities, top_surprises, top_gaps, shown_graph,
        page_nodes, page_edges, page_related, page_communities, page_insights, link_extract, link_targets, broken_links, orphan_pages, no_outlinks,
    )
}

_LINKS = """
links as (select * from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) dst from lineitem) where dst is not null),
und as (select least(src, dst) a, greatest(src, dst) b, count(*) links from links where src <> dst group by 1, 2),
edge as (select distinct src, dst from links where src <> dst),
node as (select p_partkey node, ['entity', 'concept', 'source', 'query', 'synthesis'][p_partkey % 5 + 1] as type, p_partkey % 20 community, p_name label from part),
pairs as (select node, count(*) links from (select a node from und union all select b from und) group by 1),
counted as (select n.*, coalesce(p.links, 0) links from node n left join pairs p using (node)),
nb as (select src node, dst neighbor from edge union select dst, src from edge),
deg as (select node, cast(sum(o) as bigint) out_degree, cast(sum(i) as bigint) in_degree from (select src node, 1 o, 0 i from edge union all select dst, 0, 1 from edge) group by 1),
coh as (
  select community, nodes, coalesce(inner_edges, 0) inner_edges, coalesce(inner_edges, 0) / greatest(nodes * (nodes - 1) / 2, 1) cohesion
  from (select community, count(*) nodes from node group by 1) left join
    (select x.community, count(*) inner_edges from und join node x on und.a = x.node join node y on und.b = y.node where x.community = y.community group by 1) using (community))
"""
_AFFINITY = "case t || '/' || u " + " ".join(f"when '{a}/{b}' then {v}" for (a, b), v in G.AFFINITY.items()) + " else 0.5 end"
_SCORED = f"""
src as (select distinct l_partkey node, l_suppkey source from lineitem),
seed as (select node seed from node where node % 20 = 0),
part_ as (
  select seed, dst node, 3.0::double p from seed join edge on seed = src union all select seed, src, 3.0 from seed join edge on seed = dst
  union all select s.node, o.node, 4.0 * count(*) from src s join src o using (source) where s.node in (select seed from seed) group by 1, 2
  union all select x.node, y.neighbor, sum(1.5 / ln(greatest(out_degree + in_degree, 2)::double)) from nb x join nb y on x.neighbor = y.node join deg on deg.node = x.neighbor
    where x.node in (select seed from seed) group by 1, 2),
scored as (
  select seed, node, signal + {_AFFINITY} relevance from (
    select p.seed, p.node, sum(p.p) signal, any_value(a.type) t, any_value(b.type) u from part_ p join node a on a.node = p.seed join node b on b.node = p.node
    where p.seed <> p.node group by 1, 2)),
top as (select *, row_number() over (partition by seed order by round(relevance, 9) desc, node) as rank from scored)
"""
_FILLED = f"""
short as (select seed from seed where seed not in (select seed from top where rank = 5)),
fresh as (select seed, node, relevance from (
  select s.seed, n.node, {_AFFINITY} relevance from (select seed, type t from short join node on node = seed) s join (select node, type u, row_number() over (partition by type order by node) k from node) n on n.k <= 10 and n.node <> s.seed)
  where (seed, node) not in (select (seed, node) from top where rank <= 5)),
filled as (select seed, node, relevance, row_number() over (partition by seed order by late, round(relevance, 9) desc, node) as rank from (
  select seed, node, relevance, 0 late from top where rank <= 5 union all select *, 1 from fresh))
"""
_SURPRISE = """select a, b, surprise from (
        select a, b, cast(case when x.community <> y.community then 3 else 0 end + case when x.type || '/' || y.type in ('source/concept', 'concept/source', 'source/synthesis', 'synthesis/source', 'query/entity', 'entity/query') then 2 when x.type <> y.type then 1 else 0 end
          + case when least(x.links, y.links) <= 2 and greatest(x.links, y.links) >= (select max(links) from counted) / 2 then 2 else 0 end
          + case when und.links < 2 then 1 else 0 end as int) surprise from und join counted x on und.a = x.node join counted y on und.b = y.node)"""
_DISTANT = ", ".join(f"'{a}/{b}'" for a, b in G.DISTANT)
_DOC_LINKS = r"""
ext as (
  select doc_id, cast(generate_subscripts(m, 1) - 1 as int) as position, unnest(m) link
  from (select doc_id, regexp_extract_all(text, '\[\[([^\]|]+)(?:\|([^\]]*))?\]\]') m from documents where text is not null)),
dl as (
  select doc_id, position, trim(regexp_extract(link, '\[\[([^\]|]+)(?:\|([^\]]*))?\]\]', 1)) as target, trim(regexp_extract(link, '\[\[([^\]|]+)(?:\|([^\]]*))?\]\]', 2)) as label from ext),
name as (select doc_id, page_type, regexp_replace(regexp_replace(list_last(string_split(path, '/')), '(.)\.[^.]*$', '\1'), '-[0-9]+$', '') n from documents)
"""

_PAGE_EDGES = r"""
cand as (
  select target, n, least(case when n = target then 0 else 9 end,
    case when lower(target) in (n, lower(n), regexp_replace(lower(n), '\s+', '-', 'g')) then 1 else 9 end,
    case when regexp_replace(lower(target), '\s+', '-', 'g') in (n, lower(n), regexp_replace(lower(n), '\s+', '-', 'g')) then 2 else 9 end) r
  from (select distinct target from dl), (select distinct n from name where n is not null)),
plink as (select name.n src, b.node_id dst from dl join name using (doc_id) join (select target, arg_min(n, (r, n)) node_id from cand where r < 9 group by 1) b using (target) where name.n is not null and name.n <> b.node_id)
"""

ORACLE = {
    "graph_edges": f"with {_LINKS} select * from und",
    "graph_link_counts": f"""with {_LINKS} select node, e.links, p.links as pairs from (
        select node, count(*) links from (select src node from links where src <> dst union all select dst from links where src <> dst) group by 1) e join pairs p using (node)""",
    "graph_degrees": f"with {_LINKS} select node, out_degree, in_degree, out_degree + in_degree as degree, neighbors from deg join (select node, count(*) neighbors from nb group by 1) using (node)",
    "graph_relevance": f"with {_LINKS}, {_SCORED}, {_FILLED} select seed, rank, node, round(relevance, 5) as relevance from filled where rank <= 5",
    "graph_expand": f"with {_LINKS}, {_SCORED} select node, round(max(relevance), 5) as relevance, count(*) as seeds from (select *, row_number() over (partition by seed order by round(relevance, 9) desc, node) k from scored where relevance >= 2) where k <= 3 and node not in (select seed from seed) group by 1",
    "community_cohesion": f"with {_LINKS} select community, nodes, inner_edges, round(cohesion, 8) as cohesion from coh",
    "community_leaders": f"with {_LINKS} select community, row_number() over (partition by community order by links desc, node) as rank, node, links from counted qualify rank <= 5",
    "surprising_edges": f"""with {_LINKS} select a, b, surprise from (
        select a, b, cast(case when x.community <> y.community then 3 else 0 end + case when x.type || '/' || y.type in ({_DISTANT}) then 2 when x.type <> y.type then 1 else 0 end
          + case when least(x.links, y.links) <= 2 and greatest(x.links, y.links) >= (select max(links) from counted) / 2 then 2 else 0 end
          + case when und.links < 2 then 1 else 0 end as int) surprise from und join counted x on und.a = x.node join counted y on und.b = y.node) where surprise >= 5""",
    "knowledge_gaps": f"""with {_LINKS}
        select 'isolated' as gap, node as id, cast(links as double) as value from counted where links <= 1
        union all select 'sparse', community, round(cohesion, 8) from coh where nodes >= 3 and cohesion < 0.15
        union all select 'bridge', nb.node, cast(count(distinct community) as double) from nb join node n on n.node = nb.neighbor group by 2 having count(distinct community) >= 3""",
    "top_surprises": f"with {_LINKS} {_SURPRISE} where surprise >= 3 order by surprise desc, a, b limit 5",
    "top_gaps": f"""with {_LINKS}, g as (
        select * from (select 'isolated' as gap, node as id, cast(links as double) as value, 0 o, 0.0 v from counted where links <= 1 order by node limit 5)
        union all select * from (select 'sparse', community, round(cohesion, 8), 1, cohesion from coh where nodes >= 3 and cohesion < 0.15 order by cohesion, community limit 8)
        union all select * from (select 'bridge', nb.node, cast(count(distinct community) as double), 2, -count(distinct community) from nb join node n on n.node = nb.neighbor group by 2 having count(distinct community) >= 3 order by 5, 2 limit 3))
        select gap, id, value from g order by o, v, id limit 8""",
    "shown_graph": f"with {_LINKS}, hit as (select node from node where contains(lower(concat_ws(' ', node, label)), '1') and type = 'concept' order by node limit 200) select * from und where a in (select node from hit) and b in (select node from hit)",
    "page_edges": f"with {_DOC_LINKS}, {_PAGE_EDGES} select distinct src, dst from plink",
    "page_nodes": f"""with {_DOC_LINKS}, {_PAGE_EDGES},
        page as (select n as node, arg_min(struct_pack(k := kind, p := path), doc_id) s from (
          select name.doc_id, n, path, case when trim(regexp_extract(f, '(?m)^type:[ \\t]*(.*)$', 1)) <> '' then lower(regexp_replace(trim(regexp_extract(f, '(?m)^type:[ \\t]*(.*)$', 1)), '^["''](.*)["'']$', '\\1'))
            when contains(q, '/entities/') then 'entity' when contains(q, '/concepts/') then 'concept' when contains(q, '/sources/') then 'source' when contains(q, '/queries/') then 'query' when contains(q, '/comparisons/') then 'comparison'
            when contains(q, '/synthesis/') then 'synthesis' when contains(q, '/findings/') then 'finding' when contains(q, '/thesis/') then 'thesis' when contains(q, '/methodology/') then 'methodology'
            when list_last(string_split(q, '/')) = 'overview.md' then 'overview' else 'other' end kind
          from name join (select doc_id, path, '/' || path q, regexp_extract(coalesce(text, ''), '^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)', 1, 's') f from documents) using (doc_id) where n is not null) group by 1),
        every as (select node, count(*) c from (select src node from plink union all select dst from plink) group by 1),
        pair as (select node, count(*) c from (select least(src, dst) node, greatest(src, dst) o from plink union select greatest(src, dst), least(src, dst) from plink) group by 1)
        select node, s.k as type, s.p as path, coalesce(every.c, 0) as links, coalesce(pair.c, 0) as pairs from page left join every using (node) left join pair using (node)""",
    "graph_search": f"""with {_LINKS}, hit as (select node from node where contains(lower(concat_ws(' ', label, node, type)), '1') and contains(lower(concat_ws(' ', label, node, type)), 'concept'))
        select * from und where a in (select node from hit) and b in (select node from hit)""",
    "graph_filter": f"with {_LINKS}, hit as (select node from counted where type not in ('source', 'query') and links between 1 and 40) select * from und where a in (select node from hit) and b in (select node from hit)",
    "link_extract": f"with {_DOC_LINKS} select doc_id, position, target, coalesce(label, '') as label from dl",
    "link_targets": f"""with {_DOC_LINKS}, c as (
        select target, n, least(case when n = target then 0 else 9 end,
          case when lower(target) in (n, lower(n), regexp_replace(lower(n), '\\s+', '-', 'g')) then 1 else 9 end,
          case when regexp_replace(lower(target), '\\s+', '-', 'g') in (n, lower(n), regexp_replace(lower(n), '\\s+', '-', 'g')) then 2 else 9 end) r
        from (select distinct target from dl), (select distinct n from name where n is not null))
        select target, node_id, links from (select target, count(*) links from dl group by 1) left join (select target, arg_min(n, (r, n)) node_id from c where r < 9 group by 1) using (target)""",
    "broken_links": f"with {_DOC_LINKS} select doc_id, position, target from dl where lower(list_last(string_split(target, '/'))) not in (select lower(n) from name where n is not null)",
    "orphan_pages": f"with {_DOC_LINKS} select doc_id from name where page_type = 'wiki' and (n is null or lower(n) not in (select lower(target) from dl))",
    "no_outlinks": f"with {_DOC_LINKS} select doc_id from documents where page_type = 'wiki' and doc_id not in (select doc_id from dl)",
}
