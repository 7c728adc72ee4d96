"""Keyword scoring, vector scoring and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T
from corpusmith.session import durable

RRF = 60


def keyword_scores(pages: DataFrame, query: str) -> DataFrame:
    """Pages that match a query: page_id, path, score, title_match.

    pages: (page_id, path, title, content). Null titles, paths and contents count
    as empty. 200 if the file stem is the phrase, 50 if title or file name hold it,
    20 for each of at most 10 occurrences in the content, 5 for each token in
    title or file name, 1 for each token in the content. A page without any of
    these doesn't come out; neither does any page for an empty query.
    """
    phrase = T.query_phrase(query)
    tokens = T.query_tokens(query) or ([query.strip().lower()] if query.strip() else [])
    path = F.coalesce("path", F.lit(""))
    title = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), T.file_name(path)))
    content = F.lower(F.coalesce("content", F.lit("")))
    text = pages.select("page_id", "path", F.lower(T.file_stem(path)).alias("_stem"), title.alias("_title"), content.alias("_content"))
    has = bool(phrase)
    parts = {
        "_exact": (F.col("_stem") == phrase).cast("int") if has else F.lit(0),
        "_named": F.contains(F.col("_title"), F.lit(phrase)).cast("int") if has else F.lit(0),
        "_times": F.least(F.lit(10), T.occurrences(F.col("_content"), F.lit(phrase))) if has else F.lit(0),
        "_in_title": T.tokens_contained(F.col("_title"), tokens),
        "_in_content": T.tokens_contained(F.col("_content"), tokens),
    }
    scored = text.withColumns(parts)
    score = 200 * F.col("_exact") + 50 * F.col("_named") + 20 * F.col("_times") + 5 * F.col("_in_title") + F.col("_in_content")
    return scored.select(
        "page_id", "path", score.cast("double").alias("score"), ((F.col("_in_title") > 0) | (F.col("_named") > 0)).alias("title_match")
    ).where("score > 0")


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal vector, in double precision."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def usable_vector(vector: Column, dim: int) -> Column:
    """Whether a vector has dim finite values."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def nearest_chunks(chunks: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """The chunks nearest to a query vector by a full scan: chunk columns, distance, score = 1 / (1 + distance).

    Unusable vectors never match; ties go to the smaller chunk_id. Kept as a
    top-k, which Spark takes per partition before merging.
    """
    near = chunks.where(usable_vector(F.col("embedding"), len(query))).withColumn("distance", F.sqrt(squared_distance(F.col("embedding"), query)))
    return near.withColumn("score", 1 / (1 + F.col("distance"))).drop("embedding").orderBy("distance", "chunk_id").limit(limit)


def page_scores(chunks: DataFrame) -> DataFrame:
    """Score of a page from its chunks: the best one plus a tail of at most what is left to 1.

    chunks: (page_id, chunk_index, chunk_text, score). Returns page_id, score,
    best_text (of the best chunk; ties by smaller index) and chunks.
    """
    grouped = chunks.groupBy("page_id").agg(
        F.max("score").alias("_top"), F.sum("score").alias("_all"), F.count("*").alias("chunks"),
        F.max_by("chunk_text", F.struct("score", -F.col("chunk_index"))).alias("best_text"),
    )
    tail = F.least(0.3 * (F.col("_all") - F.col("_top")), F.greatest(F.lit(0.0), 1 - F.col("_top")))
    return grouped.select("page_id", (F.col("_top") + tail).alias("score"), "best_text", "chunks")


def best_chunks(chunks: DataFrame, most: int = 3) -> DataFrame:
    """The best few chunks of each page with their rank: (page_id, rank, chunk_id, ...). Ties go to the smaller chunk_id."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def ranked(hits: DataFrame, key: str, most: int) -> DataFrame:
    """1-based rank by descending score, then key.

    One query's hits are ranked, so there is nothing to partition by: only the
    ``most`` best are, after a top-k that Spark takes per partition.
    """
    hits = hits.orderBy(F.desc("score"), key).limit(most)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def fuse(by_token: DataFrame, by_vector: DataFrame, key: str = "page_id") -> DataFrame:
    """Reciprocal-rank fusion: key, score, token_rank, vector_rank (null where a list lacks the page)."""
    a = by_token.select(key, F.col("rank").alias("token_rank"))
    b = by_vector.select(key, F.col("rank").alias("vector_rank"))
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", share("token_rank") + share("vector_rank"))


def ranks_of(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact rank (by descending score, then path) of a few pages among all hits: (page_id, rank).

    hits: (page_id, path, score), wanted: (page_id), at most a result list long.
    No list of all hits is sorted in one place: hits with a higher score are
    counted by a histogram of scores (keyword scores have few values), those
    with the same score and a smaller path by a join on the score.
    """
    few = F.broadcast(hits.join(F.broadcast(wanted.select("page_id")), "page_id", "left_semi").select(F.col("page_id").alias("_id"), F.col("path").alias("_p"), F.col("score").alias("_s")))
    steps = hits.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    levels = steps.select(F.col("score").alias("_s"), F.coalesce(above, F.lit(0)).alias("_above"))
    before = hits.join(few, (F.col("score") == F.col("_s")) & (F.col("path") < F.col("_p"))).groupBy("_id").agg(F.count("*").alias("_same"))
    out = few.join(levels, "_s").join(before, "_id", "left")
    return out.select(F.col("_id").alias("page_id"), (F.col("_above") + F.coalesce("_same", F.lit(0)) + 1).cast("long").alias("rank"))


def hybrid_search(pages: DataFrame, chunks: DataFrame, query: str, vector: Sequence[float] | None, limit: int = 20) -> DataFrame:
    """Keyword and vector search fused: page_id, score, token_rank, vector_rank.

    Chunks are fetched over the limit (three times at least ten) and blended to
    pages, of which the best ``max(limit, 10)`` are ranked. Without a vector,
    or without vector hits, pages have their keyword scores. limit is kept
    between 1 and 50.
    """
    limit = min(max(limit, 1), 50)
    hits = keyword_scores(pages, query).select("page_id", "path", "score")
    if vector is not None:
        hits = durable(hits)  # scored once, looked at for the first ranks, the histogram and the exact ranks
    first = ranked(hits, "path", limit)
    if vector is None:
        out = first.select("page_id", "score", F.col("rank").alias("token_rank"), F.lit(None).cast("long").alias("vector_rank"))
        return out.orderBy(F.desc("score"), "page_id").limit(limit)
    wanted = max(limit, 10)
    near = ranked(page_scores(nearest_chunks(chunks, vector, max(3 * wanted, 30))), "page_id", wanted)
    # a page that no vector found needs a place among the first to come out; of the others the exact rank is looked up
    rest = ranks_of(hits, near.join(first.select("page_id"), "page_id", "left_anti"))
    words = first.select("page_id", "rank").unionByName(rest)
    return fuse(words, near).orderBy(F.desc("score"), "page_id").limit(limit)


def image_hits(results: DataFrame, query: str) -> DataFrame:
    """Images of search results, each address once: (address, caption, rank, pos, match), to be shown matches first, then by rank and pos.

    results: (rank, images array of address and caption), as from
    functions.text.images_of. An image counts where it is seen first; match says
    whether its caption holds a token of the query (or the query, if it has none).
    """
    words = T.query_tokens(query) or [query.strip().lower()]
    rows = results.select("rank", F.posexplode("images").alias("pos", "i"))
    first = rows.groupBy("i.address").agg(F.min(F.struct("rank", "pos", "i.caption")).alias("m")).select("address", "m.caption", "m.rank", "m.pos")
    return first.withColumn("match", T.tokens_contained(F.coalesce("caption", F.lit("")), words) > 0)
