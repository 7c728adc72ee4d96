"""Registered queries of the training-data operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import leakage, names, neighbors, packing, sentences, setjoin, survivorship
from corpusmith.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "wiki_chunks")
    probes = load(spark, d, "probe_chunks").select(F.col("chunk_id").alias("id"))
    rows = chunks.select(F.col("chunk_id").alias("id"), "embedding")
    found = neighbors.nearest(neighbors.current_vectors(chunks), probes, fit_on=rows)
    return found.select(F.col("query_id").alias("probe_chunk_id"), F.col("id").alias("chunk_id"))


def p1_dense(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of a twentieth of all vectors instead of a few probes."""
    chunks = load(spark, d, "wiki_chunks")
    rows = chunks.select(F.col("chunk_id").alias("id"), "embedding")
    found = neighbors.nearest(neighbors.current_vectors(chunks), F.pmod(F.xxhash64("id"), F.lit(20)) == 0, fit_on=rows)
    return found.select("query_id", "id", F.round("distance", 5).alias("distance"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.representatives_by_field(load(spark, d, "merge_candidates"))


def p3_multi_value_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.multi_value_truth(load(spark, d, "merge_candidates"))


def _page_sets(spark: SparkSession, d: str, column: str) -> DataFrame:
    vals = setjoin.normal_values(F.col(column), source_paths=column == "sources")
    return load(spark, d, "wiki_pages").select(F.col("page_id").alias("id"), vals.alias("vals"))


def _entity_tags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entities").select(F.col("entity_id").alias("id"), setjoin.normal_values(F.col("tags")).alias("vals"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "page_tags": ("tags", _page_sets(spark, d, "tags")),
        "page_sources": ("sources", _page_sets(spark, d, "sources")),
        "entity_tags": ("tags", _entity_tags(spark, d)),
    }
    joins = {"page_tags": ("page_tags", "page_tags"), "page_sources": ("page_sources", "page_sources"), "entity_page_tags": ("entity_tags", "page_tags")}
    return setjoin.similar_pairs(tables, joins).select("pair_kind", "id_a", "id_b")


def p4_tag_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_classes(_page_sets(spark, d, "tags"))


def p4_source_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_classes(_page_sets(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(load(spark, d, "entities"))


def p5_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(load(spark, d, "entities"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"), load(spark, d, "context_windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return found.select("item_id", "doc_id")


def p7_leak_spans(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return found.select("item_id", "doc_id", F.round("covered", 4).alias("covered"), F.posexplode("spans").alias("span", "_s")).select(
        "item_id", "doc_id", "covered", "span", F.col("_s.start").alias("char_start"), F.col("_s.end").alias("char_end")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(load(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_dense, p3_found, p3_multi_value_truth, p4_found, p4_tag_classes, p4_source_classes, p5_found, p5_name_groups, p6_pack, p7_found, p7_leak_spans, p8_found)
}
