"""Link graph: edges, degrees, relevance, expansion, communities and what stands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.session import durable, written

# How well two page types go together; 0.5 for types not listed.
AFFINITY = {
    ("entity", "entity"): 0.8, ("entity", "concept"): 1.2, ("entity", "source"): 1.0, ("entity", "query"): 0.8, ("entity", "synthesis"): 1.0,
    ("concept", "entity"): 1.2, ("concept", "concept"): 0.8, ("concept", "source"): 1.0, ("concept", "query"): 1.0, ("concept", "synthesis"): 1.2,
    ("source", "entity"): 1.0, ("source", "concept"): 1.0, ("source", "source"): 0.5, ("source", "query"): 0.8, ("source", "synthesis"): 1.0,
    ("query", "entity"): 0.8, ("query", "concept"): 1.0, ("query", "source"): 0.8, ("query", "query"): 0.5, ("query", "synthesis"): 1.0,
    ("synthesis", "entity"): 1.0, ("synthesis", "concept"): 1.2, ("synthesis", "source"): 1.0, ("synthesis", "query"): 1.0, ("synthesis", "synthesis"): 0.8,
}
# Pairs of types that seldom meet.
DISTANT = [("source", "concept"), ("concept", "source"), ("source", "synthesis"), ("synthesis", "source"), ("query", "entity"), ("entity", "query")]


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolve link targets to nodes: links with node_id added (null where nothing fits).

    links: (target, ...), nodes: (node_id string). An exact id goes first, then
    ids that equal the target in lower case, with hyphens for spaces, or both;
    among equals the smallest id. Each target is looked up once however often
    it is linked, so a hot target doesn't skew the join.
    """
    targets = links.select("target").where("target is not null").distinct()
    low, hyphened = F.lower("target"), F.regexp_replace(F.lower("target"), r"\s+", "-")
    wanted = targets.select("target", F.posexplode(F.array(F.col("target"), low, hyphened)).alias("rank", "key"))
    ids = nodes.select(F.col("node_id")).where("node_id is not null").distinct()
    known = ids.select("node_id", F.explode(F.array_distinct(F.array(F.col("node_id"), F.lower("node_id"), F.regexp_replace(F.lower("node_id"), r"\s+", "-")))).alias("key"))
    best = wanted.join(known, "key").groupBy("target").agg(F.min(F.struct("rank", "node_id"))["node_id"].alias("node_id"))
    return links.join(best, "target", "left")


def distinct_edges(links: DataFrame) -> DataFrame:
    """Distinct directed edges (src, dst) without self links and nulls."""
    return links.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def undirected(links: DataFrame) -> DataFrame:
    """Distinct undirected edges (a, b), a < b, with how often they are linked."""
    kept = links.where("src is not null and dst is not null and src <> dst")
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("links"))


def link_counts(links: DataFrame) -> DataFrame:
    """Links of each node (node, links, pairs): every occurrence in or out, and distinct undirected pairs."""
    kept = links.where("src is not null and dst is not null and src <> dst")
    ends = kept.select(F.explode(F.array("src", "dst")).alias("node"))
    every = ends.groupBy("node").agg(F.count("*").alias("links"))
    pairs = undirected(links).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    return every.join(pairs, "node")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree, neighbors) of distinct edges; a reciprocal pair counts twice in degree, once in neighbors."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    ends = neighbors(edges).groupBy("node").agg(F.count("*").alias("neighbors"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = out.join(into, "node", "full_outer").join(ends, "node")
    return both.select("node", zero("out_degree").alias("out_degree"), zero("in_degree").alias("in_degree"), (zero("out_degree") + zero("in_degree")).alias("degree"), "neighbors")


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct (node, neighbor) in either direction."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src")).distinct()


def affinity(a: Column, b: Column) -> Column:
    """Affinity of two page types."""
    table = F.create_map(*[F.lit(x) for (s, t), v in AFFINITY.items() for x in (f"{s}/{t}", v)])
    return F.coalesce(table[F.concat_ws("/", a, b)], F.lit(0.5))


def relevance(nodes: DataFrame, edges: DataFrame, sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Relevance of each seed to the nodes it shares anything with: (seed, node, relevance).

    nodes: (node, type), edges: distinct (src, dst), sources: (node, source),
    seeds: (node). 3 for a link in either direction, 4 for each source the
    seed shares with the node's list (a source the node lists twice counts
    twice), 1.5 / ln(max(degree, 2)) for each common neighbour, plus the
    affinity of the types. Pairs that share nothing have their affinity alone,
    at most 1.2, and aren't generated (fill_related adds them where a list is short). A node without a type has ``other``.
    """
    wanted = seeds.select(F.col("node").alias("seed")).distinct()
    direct = wanted.join(edges, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node")).unionAll(
        wanted.join(edges, F.col("seed") == F.col("dst")).select("seed", F.col("src").alias("node"))
    )
    direct = direct.withColumn("part", F.lit(3.0))
    # of the seed its distinct sources, of the node every entry of its list, counted before the join
    mine = wanted.join(sources.withColumnRenamed("node", "seed"), "seed").select("seed", "source").distinct()
    theirs = sources.groupBy("node", "source").agg(F.count("*").alias("n"))
    shared = mine.join(theirs, "source").select("seed", "node", (F.col("n") * 4.0).alias("part"))
    weight = degrees(edges).select(F.col("node").alias("via"), (1.5 / F.log(F.greatest("degree", F.lit(2)).cast("double"))).alias("w"))
    near = neighbors(edges)
    first = wanted.join(near.select(F.col("node").alias("seed"), F.col("neighbor").alias("via")), "seed").join(weight, "via")
    second = near.select(F.col("node").alias("via"), F.col("neighbor").alias("node"))
    common = first.join(second, "via").select("seed", "node", F.col("w").alias("part"))
    # one aggregate over all parts; rounded, so that equal pairs tie in whatever order they were summed
    total = direct.unionByName(shared).unionByName(common).where("seed <> node").groupBy("seed", "node").agg(F.round(F.sum("part"), 9).alias("signal"))
    # nodes carry the number of their role and seeds the affinities of theirs to all, so a pair costs one look into an array
    roles = [*sorted({a for a, _ in AFFINITY}), "other"]
    known = nodes.select("node", F.array_position(F.array(*map(F.lit, roles)), _role(F.coalesce("type", F.lit("other")))).cast("int").alias("_role"))
    table = F.array(*[F.array(*[F.lit(AFFINITY.get((mine, other), 0.5)) for other in roles]) for mine in roles])
    own = known.select(F.col("node").alias("seed"), F.element_at(table, F.col("_role")).alias("_own"))
    typed = total.join(known, "node", "left").join(own, "seed", "left")
    fits = F.coalesce(F.element_at("_own", F.col("_role")), F.lit(0.5))
    return typed.select("seed", "node", (F.col("signal") + fits).alias("relevance"))


def top_related(scored: DataFrame, most: int = 5, least: float = 0.0) -> DataFrame:
    """The most relevant nodes of each seed with their rank; ties go to the smaller node."""
    order = Window.partitionBy("seed").orderBy(F.desc("relevance"), "node")
    return scored.where(F.col("relevance") >= least).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def _role(kind: Column) -> Column:
    """The types that AFFINITY tells apart; all others are ``other``."""
    return F.when(kind.isin(sorted({a for a, _ in AFFINITY})), kind).otherwise("other")


def fill_related(top: DataFrame, nodes: DataFrame, seeds: DataFrame, most: int = 5) -> DataFrame:
    """top_related with lists of fewer than ``most`` filled up by nodes that share nothing but have an affinity: the best, then smallest ones.

    Of each of the six roles only the 2 * most smallest nodes can come in, as a
    seed has fewer than ``most`` nodes to leave out; so short lists meet at
    most 12 * most nodes.
    """
    typed = nodes.select("node", _role(F.coalesce("type", F.lit("other"))).alias("role"))
    few = typed.withColumn("_n", F.row_number().over(Window.partitionBy("role").orderBy("node"))).where(F.col("_n") <= 2 * most).drop("_n")
    roles = F.array(*[F.lit(r) for r in [*sorted({a for a, _ in AFFINITY}), "other"]])
    have = top.groupBy("seed").agg(F.count("*").alias("_have"))
    short = seeds.select(F.col("node").alias("seed")).distinct().join(have, "seed", "left").where(F.coalesce("_have", F.lit(0)) < most)
    mine = short.join(typed.select(F.col("node").alias("seed"), F.col("role").alias("own")), "seed").select("seed", "own", F.explode(roles).alias("role"))
    # at most 12 * most rows
    new = mine.join(F.broadcast(few), "role").where("node <> seed").join(top.select("seed", "node"), ["seed", "node"], "left_anti")
    new = new.select("seed", "node", affinity(F.col("own"), F.col("role")).alias("relevance"))
    both = top.select("seed", "node", "relevance", F.lit(0).alias("_late")).unionByName(new.withColumn("_late", F.lit(1)))
    order = Window.partitionBy("seed").orderBy("_late", F.desc("relevance"), "node")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).drop("_late")


def expand(scored: DataFrame, hits: DataFrame, most: int = 3, least: float = 2.0) -> DataFrame:
    """One-hop expansion of hits (node): nodes among the top of any hit that aren't hits, with their best relevance."""
    near = top_related(scored, most, least).join(hits.select("node"), "node", "left_anti")
    return near.groupBy("node").agg(F.max("relevance").alias("relevance"), F.min("rank").alias("best_rank"), F.count("*").alias("seeds"))


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, nodes, inner_edges, cohesion) for undirected edges (a, b) and membership (node, community).

    Cohesion is inner edges over possible ones; a single node has denominator 1.
    """
    m = membership.select("node", "community")
    ends = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_edges"))
    sizes = m.groupBy("community").agg(F.count("*").alias("nodes"))
    pairs = F.greatest(F.col("nodes") * (F.col("nodes") - 1) / 2, F.lit(1.0))
    return sizes.join(inner, "community", "left").select(
        "community", "nodes", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), (F.coalesce("inner_edges", F.lit(0)) / pairs).alias("cohesion")
    )


def community_leaders(counts: DataFrame, membership: DataFrame, most: int = 5) -> DataFrame:
    """Best-linked nodes of each community: (community, rank, node, links)."""
    order = Window.partitionBy("community").orderBy(F.desc("links"), "node")
    rows = membership.join(counts.select("node", "links"), "node").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where(F.col("rank") <= most).select("community", "rank", "node", "links")


def surprising_edges(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Edges that connect what seldom meets: (a, b, surprise).

    edges: (a, b, weight), nodes: (node, type, community, links). 3 across
    communities, 2 for distant types or 1 for other unequal ones, 2 from the
    rim to a hub (at most 2 links against half the most), 1 for a weight
    between 0 and 2. From ``least`` on an edge comes out.
    """
    top = nodes.agg(F.max("links").alias("_top"))
    end = lambda side: nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("type", "community", "links")])
    rows = edges.join(end("a"), "a").join(end("b"), "b").join(F.broadcast(top))  # top is one row
    distant = F.concat_ws("/", "type_a", "type_b").isin(["/".join(p) for p in DISTANT])
    kinds = F.when(distant, 2).when(F.col("type_a") != F.col("type_b"), 1).otherwise(0)
    rim = (F.least("links_a", "links_b") <= 2) & (F.greatest("links_a", "links_b") >= F.greatest("_top", F.lit(1)) / 2)
    weak = (F.col("weight") > 0) & (F.col("weight") < 2)
    score = F.when(F.col("community_a") != F.col("community_b"), 3).otherwise(0) + kinds + F.when(rim, 2).otherwise(0) + F.when(weak, 1).otherwise(0)
    return rows.select("a", "b", score.cast("int").alias("surprise")).where(F.col("surprise") >= least)


def knowledge_gaps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What the graph lacks: (gap, id, value) of isolated nodes, sparse communities and bridges.

    nodes: (node, community, links). Isolated: at most one link. Sparse: at
    least 3 nodes and cohesion under 0.15. Bridge: neighbours in at least 3
    communities.
    """
    isolated = nodes.where("links <= 1").select(F.lit("isolated").alias("gap"), F.col("node").alias("id"), F.col("links").cast("double").alias("value"))
    sparse = cohesion(edges, nodes).where("nodes >= 3 and cohesion < 0.15").select(F.lit("sparse").alias("gap"), F.col("community").cast(nodes.schema["node"].dataType).alias("id"), F.col("cohesion").alias("value"))
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    near = both.join(nodes.select(F.col("node").alias("other"), "community"), "other").groupBy("node").agg(F.countDistinct("community").alias("n"))
    bridges = near.where("n >= 3").select(F.lit("bridge").alias("gap"), F.col("node").alias("id"), F.col("n").cast("double").alias("value"))
    return isolated.unionByName(sparse).unionByName(bridges)


# Pages that link to everything.
STRUCTURAL = ["index", "log", "overview"]


def top_surprises(edges: DataFrame, nodes: DataFrame, most: int = 5, least: int = 3) -> DataFrame:
    """The most surprising edges without those of structural pages: (a, b, surprise); ties in the order of the ends."""
    shown = edges.where(~F.col("a").cast("string").isin(STRUCTURAL) & ~F.col("b").cast("string").isin(STRUCTURAL))
    return surprising_edges(shown, nodes, least).orderBy(F.desc("surprise"), "a", "b").limit(most)


def top_gaps(edges: DataFrame, nodes: DataFrame, isolated: int = 5, bridges: int = 3, most: int = 8) -> DataFrame:
    """What of the gaps is shown: (gap, id, value) of at most so many isolated nodes and bridges (most communities first), ``most`` in all.

    Structural pages and overviews are left out. Isolated nodes come first,
    then sparse communities, then bridges; ties by id.
    """
    plain = ~F.col("node").cast("string").isin(STRUCTURAL) & (F.coalesce("type", F.lit("other")) != "overview")
    rows = knowledge_gaps(edges, nodes)
    hidden = nodes.where(~plain).select(F.col("node").alias("id"))
    kept = rows.where("gap = 'sparse'").unionByName(rows.where("gap <> 'sparse'").join(hidden, "id", "left_anti").select(*rows.columns))
    # each kind's few are a top-k of their own, so that nothing is sorted as a whole
    parts = [
        kept.where("gap = 'isolated'").orderBy("id").limit(isolated).withColumn("_o", F.lit(0)),
        kept.where("gap = 'sparse'").orderBy("value", "id").limit(most).withColumn("_o", F.lit(1)),
        kept.where("gap = 'bridge'").orderBy(F.desc("value"), "id").limit(bridges).withColumn("_o", F.lit(2)),
    ]
    value = F.when(F.col("_o") == 2, -F.col("value")).when(F.col("_o") == 1, F.col("value")).otherwise(0.0)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("_o", value, "id").limit(most).drop("_o")


def shown_graph(nodes: DataFrame, edges: DataFrame, query: str = "", kind: str = "", limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes that contain the query in id or label and have the type (if any is given), the first ``limit`` (1 to 1,000) by id, and the edges among those."""
    hit = F.contains(F.lower(F.concat_ws(" ", F.col("node").cast("string"), F.col("label"))), F.lit(query.lower()))
    kept = nodes.where(hit & (F.col("type") == kind if kind else F.lit(True))).orderBy("node").limit(min(max(limit, 1), 1000))
    return kept, induced(kept, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b, ...) both ends of which are among nodes (node)."""
    kept = nodes.select("node").distinct()
    return edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi")


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes all words of the query occur in: in label, id, type or path, whatever their case."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("label", "node", "type", "path") if c in nodes.columns]))
    keep = F.lit(True)
    for word in query.lower().split():
        keep = keep & F.contains(hay, F.lit(word))
    return nodes.where(keep)


def _move(edges: DataFrame, nodes: DataFrame, total: float, settled: float, most_rounds: int) -> tuple[DataFrame, float]:
    """Labels (node, community) of one level and their modularity; see communities. edges: both directions, nodes: (node, k, own)."""
    labels = nodes.select("node", "k", "own", F.col("node").alias("community"))
    best, kept, still = -2.0, labels, 0
    for step in range(most_rounds):
        sums = labels.groupBy("community").agg(F.sum("k").alias("total"))
        links = edges.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("into"))
        here = labels.select("node", "k", F.col("community").alias("at"))
        options = links.join(sums, "community").join(here, "node")
        own = F.col("community") == F.col("at")
        rest = F.col("total") - F.when(own, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("into") - F.col("k") * rest / total, 9)
        allowed = (F.col("community") <= F.col("at")) if step % 2 == 0 else (F.col("community") >= F.col("at"))
        # staying costs nothing where there is no link to the own community
        stay = F.max(F.when(own, gain)).alias("stay")
        go = F.min(F.when(allowed & ~own & (gain > 0), F.struct((-gain).alias("gain"), "community"))).alias("go")
        chosen = options.groupBy("node").agg(stay, go, F.max(F.when(own, F.col("into"))).alias("inside"))
        moved = labels.join(chosen, "node", "left").select(
            "node", "k", "own", F.col("community").alias("old"), (F.col("own") + F.coalesce("inside", F.lit(0.0))).alias("inside"),
            F.when(-F.col("go.gain") > F.coalesce("stay", F.lit(0.0)), F.col("go.community")).otherwise(F.col("community")).alias("community"),
        )
        moved = written(moved)
        share = moved.groupBy("old").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"))
        value = share.agg(F.sum("inside") / total - F.sum((F.col("k") / total) * (F.col("k") / total))).first()[0]
        if value > best + settled:
            best, kept, still = value, moved.select("node", F.col("old").alias("community")), 0
        else:
            still += 1
        if still == 2:  # neither direction gains any more
            return kept, best
        labels = moved.select("node", "k", "own", "community")
    raise RuntimeError(f"modularity still grows after {most_rounds} rounds")


def communities(edges: DataFrame, settled: float = 3e-3, most_rounds: int = 200) -> DataFrame:
    """Communities of weighted undirected edges (a, b, weight): (node, community).

    In rounds nodes move, all at once, to the neighbouring community with the
    greatest gain in modularity (ties to the smaller one); to keep neighbours
    from swapping, only to smaller labels in even rounds and to larger ones in
    odd ones. When two rounds in a row gain less than ``settled``, the
    communities become nodes and move in turn, until that gains nothing either.
    It is an error if a level takes more than ``most_rounds``. The same edges
    give the same communities. Everything is joins and aggregates; no list of
    nodes or edges is gathered in one place, and one number a round reaches the
    driver. No edges give no rows.
    """
    kept = edges.where("a is not null and b is not null and a <> b and weight > 0")
    both = durable(kept.select("a", "b", "weight").union(kept.select("b", "a", "weight")).toDF("node", "other", "w").groupBy("node", "other").agg(F.sum("w").alias("w")))
    nodes = both.groupBy("node").agg(F.sum("w").alias("k")).withColumn("own", F.lit(0.0))
    names = nodes.select("node", F.col("node").alias("community"))
    total = both.agg(F.sum("w")).first()[0]
    best = -2.0
    while total:
        labels, value = _move(both, nodes, total, settled, most_rounds)
        if value < best + settled:
            break
        best = value
        names = written(names.withColumnRenamed("community", "_c").join(labels.withColumnRenamed("node", "_c"), "_c").select("node", "community"))
        end = lambda side, name: labels.select(F.col("node").alias(side), F.col("community").alias(name))  # noqa: B023, E731
        merged = written(both.join(end("node", "x"), "node").join(end("other", "y"), "other").groupBy("x", "y").agg(F.sum("w").alias("w")))
        inner = merged.where("x = y").select(F.col("x").alias("community"), "w")
        nodes = written(
            nodes.join(labels, "node").groupBy("community").agg(F.sum("k").alias("k"), F.sum("own").alias("_own"))
            .join(inner, "community", "left").select(F.col("community").alias("node"), "k", (F.col("_own") + F.coalesce("w", F.lit(0.0))).alias("own"))
        )
        both = merged.where("x <> y").toDF("node", "other", "w")
    return names


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row (modularity) of undirected weighted edges (a, b, weight) under a membership."""
    m = membership.select("node", "community")
    ends = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    parts = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", F.col("cb").alias("d")), F.struct(F.col("cb").alias("c"), "weight", F.col("ca").alias("d")))).alias("s"))
    sums = parts.groupBy("s.c").agg(F.sum("s.weight").alias("k"), F.sum(F.when(F.col("s.c") == F.col("s.d"), F.col("s.weight")).otherwise(0.0)).alias("inside"))
    return sums.agg((F.sum("inside") / F.sum("k") - F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("modularity"))


def node_ids(documents: DataFrame) -> DataFrame:
    """Nodes of a link graph from documents: the name part of the file stem, smallest first on a tie."""
    return documents.select(F.regexp_replace(T.file_stem(F.col("path")), r"-\d+$", "").alias("node_id"))


def page_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The link graph of pages from their own texts: nodes (node, label, type, path, sources) and links (src, dst), one row a link.

    documents: (doc_id, text, path). A page is named by its file; of several
    documents of one name the smallest doc_id describes it, and the links of
    all count. The type is that of the front matter, else of the folder. Links
    to no page and to the page itself are left out; null texts link nowhere,
    documents without a path are no pages.
    """
    text = F.coalesce("text", F.lit(""))
    front = T.front_matter(text)
    stated = T.scalar_field(front, "type")
    named = F.regexp_replace(T.file_stem(F.col("path")), r"-\d+$", "")
    kind = F.when(stated != "", F.lower(stated)).otherwise(T.page_type(F.concat(F.lit("/"), F.col("path"))))
    pages = documents.where("path is not null").select(
        named.alias("node"), "doc_id", T.title_of(text, F.col("path")).alias("label"), kind.alias("type"), "path",
        T.list_field(front, "sources").alias("sources"), F.transform(T.wiki_links(text), lambda link: link["target"]).alias("targets"),
    )
    nodes = pages.groupBy("node").agg(F.min_by(F.struct("label", "type", "path", "sources"), "doc_id").alias("p")).select("node", "p.*")
    links = pages.select(F.col("node").alias("src"), F.explode("targets").alias("target"))
    found = resolve_links(links, nodes.select(F.col("node").alias("node_id")))
    return nodes, found.where("node_id is not null and node_id <> src").select("src", F.col("node_id").alias("dst"))
