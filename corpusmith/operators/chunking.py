"""Documents to chunks and generated answers to rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import markdown as M

_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def explode_text(df: DataFrame, key: str, text: str, parse: Callable[[str], list[dict]], schema: dict[str, str]) -> DataFrame:
    """The rows that a parser makes of each text: key and the columns of schema.

    Null texts give no rows. parse sees one text at a time and returns dicts
    with the columns of schema.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow = [pa.field(c, _TYPES[t]) for c, t in schema.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], {c: [] for c in schema}
            for i, value in enumerate(batch.column(1).to_pylist()):
                for row in parse(value):
                    at.append(i)
                    for c in schema:
                        columns[c].append(row[c])
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch([keys, *[pa.array(columns[f.name], f.type) for f in arrow]], schema=pa.schema([pa.field(key, keys.type), *arrow]))

    out = ", ".join([f"{key} {kind}", *(f"{c} {t}" for c, t in schema.items())])
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, out)


def chunk_documents(documents: DataFrame, options: M.Options = M.Options()) -> DataFrame:
    """Chunks of each document (doc_id, text): chunk_index, heading_path, char_start, char_end, overlap_start, oversized."""
    schema = {"chunk_index": "int", "heading_path": "string", "char_start": "int", "char_end": "int", "overlap_start": "int", "oversized": "boolean"}
    return explode_text(documents, "doc_id", "text", lambda text: M.chunks(text, options), schema)


def chunk_texts(documents: DataFrame, options: M.Options = M.Options()) -> DataFrame:
    """What is embedded of each chunk: (doc_id, chunk_index, text), with title, heading path and the chunk joined by blank lines.

    documents: (doc_id, title, text).
    """

    def parse(text: str) -> list[dict]:
        return [c | {"body": text[c["overlap_start"] : c["char_end"]].strip()} for c in M.chunks(text, options)]

    rows = explode_text(documents, "doc_id", "text", parse, {"chunk_index": "int", "heading_path": "string", "body": "string"})
    parts = F.filter(F.array("title", "heading_path", "body"), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    return rows.join(documents.select("doc_id", "title"), "doc_id").select("doc_id", "chunk_index", F.array_join(parts, "\n\n").alias("text"))


def semantic_chunks(documents: DataFrame, target: int = 4000, overlap: int = 400) -> DataFrame:
    schema = {"chunk_index": "int", "char_start": "int", "char_end": "int", "overlap_start": "int"}
    return explode_text(documents, "doc_id", "text", lambda text: M.semantic_chunks(text, target, overlap), schema)


def parse_files(answers: DataFrame, key: str = "id") -> DataFrame:
    """File blocks of generated answers (key, text)."""
    return explode_text(answers, key, "text", M.file_blocks, {"path": "string", "content": "string", "warning": "string"})


def parse_reviews(answers: DataFrame, key: str = "id") -> DataFrame:
    """Review blocks of generated answers (key, text)."""
    schema = {"type": "string", "title": "string", "description": "string", "options": "array<string>", "pages": "array<string>", "queries": "array<string>"}
    return explode_text(answers, key, "text", M.review_blocks, schema)


def replace_chunks(store: DataFrame, new: DataFrame) -> DataFrame:
    """A chunk store after pages were embedded again: all chunks of a page in ``new`` replace its old ones.

    Both have the same columns, page_id among them. An empty ``new`` changes
    nothing. Only the distinct page ids of ``new`` are joined.
    """
    return store.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new)


def stale_pages(pages: DataFrame, store: DataFrame) -> DataFrame:
    """Pages (page_id, hash, ...) that aren't in the store (page_id, hash) with the same hash."""
    return pages.join(store.select("page_id", "hash").distinct(), ["page_id", "hash"], "left_anti")


def pack_context(candidates: DataFrame, budget: int) -> DataFrame:
    """Pages that fit a context: (query_id, rank, page_id, used), taken in order, one that doesn't fit skipped.

    candidates: (query_id, rank, page_id, size), at most a few dozen a query
    (what a search returns). Skipping makes this an ordered fold, which a
    running sum can't express; it runs over each query's sorted list.
    """
    rows = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page_id", "size"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<rank:bigint,page_id:bigint,used:bigint>>)").alias("taken"))

    def take(acc, c):
        used = acc["used"] + c["size"]
        row = F.struct(c["rank"].cast("long").alias("rank"), c["page_id"].cast("long").alias("page_id"), used.cast("long").alias("used"))
        return F.when(used <= budget, F.struct(used.cast("long").alias("used"), F.concat(acc["taken"], F.array(row)).alias("taken"))).otherwise(acc)

    return rows.select("query_id", F.explode(F.aggregate("c", start, take)["taken"]).alias("t")).select("query_id", "t.*")
