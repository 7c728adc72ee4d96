"""All similar pairs between set-valued records."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.session import durable

ROWS = 4
MISS = 5e-5  # how likely a pair right at the threshold is missed


def normal_values(values: Column, source_paths: bool = False) -> Column:
    """The set of a list's values: trimmed, lower-cased, once each, sorted, without nulls and blanks.

    source_paths: values are paths, compared with ``/`` for ``\\`` and from
    after ``raw/sources/`` on.
    """

    def one(value: Column) -> Column:
        value = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
        if source_paths:
            value = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"(?s)^.*raw/sources/", "")
        return value

    clean = F.transform(F.filter(values, lambda v: v.isNotNull()), one)
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: v != "")))


def _bands(rows: int, bands: int):
    """Vectorised minwise signatures: the hashed set to one bucket key per band, which tells the bands apart as well."""
    rng = np.random.default_rng(20240511)
    mul = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)

    @F.pandas_udf("array<long>")
    def bands_of(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        if not len(sizes) or not sizes.sum():
            return pd.Series([np.empty(0, np.int64)] * len(sizes))
        flat = np.concatenate(hashes.to_numpy()).view(np.uint64)
        # every set is non-empty here: the caller keeps sets of a least size
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        keys = np.zeros((len(sizes), bands), np.uint64)
        for i in range(rows * bands):
            mixed = flat * mul[i] + add[i]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            low = np.minimum.reduceat(mixed, starts)
            keys[:, i // rows] = (keys[:, i // rows] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * (i // rows) + 1)
        return pd.Series(list(keys.view(np.int64)))

    return bands_of


def similar_sets(
    sets: DataFrame,
    threshold: float = 0.6,
    rows: int = ROWS,
    miss: float = MISS,
    hot: int = 200,
    wanted: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Pairs of distinct sets with Jaccard similarity >= threshold: (set_a, set_b, jaccard), set_a < set_b.

    sets: (set_id long, vals array<string>, side int), one row a distinct set;
    side is a bit mask of the tables it occurs in. wanted: pairs of bits; a
    pair of sets is made only if its sides have such bits. By default all are.

    Minwise signatures are cut into as many bands of ``rows`` as keep the
    chance to miss a pair at the threshold under ``miss`` (72 bands at 0.6;
    pairs above it are missed far more seldom). Sets that share a bucket of any
    band are candidates. Entries are brought together by bucket once; as a set
    has one entry a band, no bucket holds more than one in so many bands of all
    entries. Buckets of at most ``hot`` sets make their pairs there; of a larger
    one the entries are passed on, and meet only if they share one of their
    ``n - ceil(threshold * n) + 1`` rarest values, as every pair above the
    threshold does. So no pair is lost and no bucket makes all its pairs.
    Candidates are made distinct, then verified on their whole sets, whose
    values are compared by 64-bit hashes.
    """
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    hashed = sets.select("set_id", "side", F.size("vals").alias("n"), F.transform("vals", lambda v: F.xxhash64(v)).alias("h"))
    banded = hashed.select("set_id", "side", "n", F.explode(_bands(rows, bands)("h")).alias("bucket"))
    gathered = banded.select("bucket", "set_id", "n", "side").repartition("bucket").sortWithinPartitions("bucket", "set_id")
    made = durable(gathered.mapInArrow(_bucket_pairs(threshold, hot, wanted), "set_a long, set_b long, n int, side int, bucket long"))
    small = made.where("bucket is null").select("set_a", "set_b")

    # in large buckets, rarest values first, over the values of all sets
    busy = made.where("bucket is not null").select(F.col("set_a").alias("set_id"), "n", "side", "bucket")
    values = hashed.select("set_id", F.explode("h").alias("token"))
    rarity = values.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("df", "token"))
    prefix = values.join(busy.select("set_id").distinct(), "set_id", "left_semi").join(rarity, "token").withColumn("rank", rank)
    size = F.col("n")
    entries = busy.join(prefix.select("set_id", "rank", "token"), "set_id").where(F.col("rank") <= size - F.ceil(F.lit(threshold) * size - 1e-9) + 1)
    a, b = entries.alias("a"), entries.alias("b")
    near = (F.col("a.set_id") < F.col("b.set_id")) & (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9)
    if wanted:
        has = lambda side, bit: F.col(side).bitwiseAND(F.lit(bit)) > 0
        near = near & reduce(Column.__or__, [has("a.side", x) & has("b.side", y) for pair in wanted for x, y in {pair, pair[::-1]}])
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.token") == F.col("b.token"))
    large = a.join(b, same & near).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))
    pairs = small.unionByName(large).distinct()

    left = hashed.select(F.col("set_id").alias("set_a"), F.col("h").alias("h_a"))
    right = hashed.select(F.col("set_id").alias("set_b"), F.col("h").alias("h_b"))
    both = pairs.join(left, "set_a").join(right, "set_b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    jaccard = common / (F.size("h_a") + F.size("h_b") - common)
    return both.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold - 1e-12).select("set_a", "set_b", "jaccard")


def _bucket_pairs(threshold: float, hot: int, wanted: Sequence[tuple[int, int]] | None):
    """Entries (bucket, set_id, n, side), sorted by bucket, as the pairs of small buckets (bucket null) and the entries of large ones (set_b null)."""
    masks = [way for pair in wanted or [] for way in {pair, pair[::-1]}]

    def pairs_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket, ids, n, side = columns
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        size = np.diff(np.r_[begin, len(bucket)])
        left = np.repeat(size, size) - 1 - (np.arange(len(bucket)) - np.repeat(begin, size))  # entries after each in its bucket
        large = np.repeat(size > hot, size)
        left[large] = 0
        first = np.repeat(np.arange(len(bucket)), left)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)
        keep = np.minimum(n[first], n[second]) >= threshold * np.maximum(n[first], n[second]) - 1e-9
        if masks:
            keep &= np.any([(side[first] & x > 0) & (side[second] & y > 0) for x, y in masks], axis=0)
        # a pair that meets in several bands of these entries comes out once
        pair = np.unique(np.stack([ids[first[keep]], ids[second[keep]]]), axis=1)
        at = np.flatnonzero(large)
        none = lambda count, kind: pa.nulls(count, kind)
        m, k = pair.shape[1], len(at)
        columns = [
            pa.array(np.r_[pair[0], ids[at]]),
            pa.concat_arrays([pa.array(pair[1]), none(k, pa.int64())]),
            pa.concat_arrays([none(m, pa.int32()), pa.array(n[at])]),
            pa.concat_arrays([none(m, pa.int32()), pa.array(side[at])]),
            pa.concat_arrays([none(m, pa.int64()), pa.array(bucket[at])]),
        ]
        return pa.record_batch(columns, names=["set_a", "set_b", "n", "side", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        passing = None  # the large bucket that the stream is inside of
        for batch in batches:
            columns = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            last = columns[0][-1] if len(columns[0]) else None
            begin = int(np.searchsorted(columns[0], last, side="left")) if last is not None else 0
            if len(columns[0]) - begin > hot or (last is not None and last == passing):
                # of a large bucket nothing needs to be kept back
                end = int(np.searchsorted(columns[0], passing, side="right")) if passing is not None else 0
                end = min(end, begin)
                yield _entries([np.r_[c[:end], c[begin:]] for c in columns])
                yield pairs_of([c[end:begin] for c in columns])
                passing, rest = last, [c[:0] for c in columns]
                continue
            if passing is not None:
                end = int(np.searchsorted(columns[0], passing, side="right"))
                yield _entries([c[:end] for c in columns])
                columns, begin, passing = [c[end:] for c in columns], begin - end, None
            yield pairs_of([c[:begin] for c in columns])
            rest = [c[begin:] for c in columns]
        yield pairs_of(rest)

    return run


def _entries(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Entries of a large bucket as they are."""
    bucket, ids, n, side = (pa.array(c) for c in columns)
    return pa.record_batch([ids, pa.nulls(len(ids), pa.int64()), n, side, bucket], names=["set_a", "set_b", "n", "side", "bucket"])


def similar_pairs(tables: dict[str, tuple[str, DataFrame]], joins: dict[str, tuple[str, str]], threshold: float = 0.6, least: int = 3) -> DataFrame:
    """All pairs of records with similar sets, for several joins at once: (pair_kind, id_a, id_b, jaccard), id_a < id_b.

    tables: name -> (domain, records (id long, vals array<string>)), with sets
    made by normal_values; only sets of one domain are compared. joins:
    pair_kind -> (name, name) of the tables to pair, the same name twice for
    pairs within a table. Repeated rows of a record count once, an id never
    pairs with itself. Records with a null id, a null list or fewer than
    ``least`` values pair with nothing.

    The sets of all tables are joined in one go, equal ones once; they are
    written out as pairs of records at the end, because each is asked for.
    """
    bits = {name: 1 << i for i, name in enumerate(tables)}

    def in_domain(domain: str) -> Column:
        return F.transform("vals", lambda v: F.concat(F.lit(f"{domain}|"), v))

    parts = [
        df.where(F.col("id").isNotNull() & (F.size("vals") >= least)).select(
            F.col("id").cast("long").alias("id"), in_domain(domain).alias("vals"), F.lit(bits[name]).alias("side")
        )
        for name, (domain, df) in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("set_id", F.xxhash64("vals"))
    sets = durable(rows.groupBy("set_id").agg(F.first("vals").alias("vals"), F.bit_or("side").alias("side")))
    members = durable(rows.select("set_id", "id", "side").distinct())
    found = similar_sets(sets, threshold, wanted=[(bits[x], bits[y]) for x, y in joins.values()])
    equal = sets.select(F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"), F.lit(1.0).alias("jaccard"))
    one = members.select(F.col("set_id").alias("set_a"), F.col("id").alias("x"), F.col("side").alias("sx"))
    two = members.select(F.col("set_id").alias("set_b"), F.col("id").alias("y"), F.col("side").alias("sy"))
    pairs = found.unionByName(equal).join(one, "set_a").join(two, "set_b").where(F.col("x") != F.col("y"))
    kinds = F.filter(
        F.array(*[
            F.when(((F.col("sx") == bits[x]) & (F.col("sy") == bits[y])) | ((F.col("sx") == bits[y]) & (F.col("sy") == bits[x])), F.lit(kind))
            for kind, (x, y) in joins.items()
        ]),
        lambda k: k.isNotNull(),
    )
    out = pairs.select(F.explode(kinds).alias("pair_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")
    return out.groupBy("pair_kind", "id_a", "id_b").agg(F.max("jaccard").alias("jaccard"))


def similar_records(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.6, least: int = 3) -> DataFrame:
    """similar_pairs within one table, or between two: (id_a, id_b, jaccard), id_a < id_b."""
    tables = {"left": ("", left)} | ({} if right is None else {"right": ("", right)})
    return similar_pairs(tables, {"": ("left", "left" if right is None else "right")}, threshold, least).drop("pair_kind")


def similar_classes(records: DataFrame, threshold: float = 0.6, least: int = 3) -> DataFrame:
    """One row a record: (id, class_id, links), where equal sets share a class.

    class_id is the smallest id with that set; links counts the other classes
    with a similar set. Copies aren't written out as pairs. Records that are
    left out of similar_records come with a null class_id and no links.
    """
    rows = records.where(F.col("id").isNotNull()).groupBy("id").agg(F.first("vals").alias("vals"))
    rows = rows.withColumn("set_id", F.when(F.size("vals") >= least, F.xxhash64("vals")))
    sets = durable(
        rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("vals").alias("vals"), F.min(F.lit(1)).alias("side"), F.min("id").alias("class_id"))
    )
    found = similar_sets(sets.drop("class_id"), threshold)
    ends = found.select(F.col("set_a").alias("set_id")).unionByName(found.select(F.col("set_b").alias("set_id")))
    links = ends.groupBy("set_id").agg(F.count("*").alias("links"))
    return (
        rows.select("id", "set_id").join(sets.select("set_id", "class_id"), "set_id", "left").join(links, "set_id", "left")
        .select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
