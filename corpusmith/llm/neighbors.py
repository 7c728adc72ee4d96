"""Most similar vectors: a small-world graph per shard, shard results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.llm.hnsw import Graph

SHARD = 4096  # vectors a shard is meant to hold
LARGEST = 65_536  # and at most, where the collection has outgrown the centres
SAMPLE = 131_072  # rows the centres are fitted on, at most
MOST_CENTRES = 16_384
MOST_TASKS = 4096


def _means(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of a bounded sample."""
    rng = np.random.default_rng(11)
    count = min(count, len(sample))
    centres = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2.0 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres.astype(np.float32)


class Centres:
    """Centres of shards in two levels, so that many of them are looked through as fast as few."""

    def __init__(self, sample: np.ndarray, count: int):
        self.coarse = _means(sample, math.isqrt(count) if count > 256 else 1)
        near = self._cells(sample, 1)[:, 0]
        parts = []
        for c in range(len(self.coarse)):
            own = sample[near == c]
            parts.append(_means(own, max(1, round(count * len(own) / len(sample)))) if len(own) else self.coarse[c : c + 1])
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.fine = np.concatenate(parts)
        self.norms = (self.fine**2).sum(1)

    def __len__(self) -> int:
        return len(self.fine)

    def _cells(self, x: np.ndarray, want: int) -> np.ndarray:
        want = min(want, len(self.coarse))
        d = (self.coarse**2).sum(1) - 2.0 * x @ self.coarse.T
        return np.argpartition(d, want - 1, axis=1)[:, :want]

    def nearest(self, x: np.ndarray, want: int, cells: int = 8) -> np.ndarray:
        """The nearest ``want`` centres of each row, nearest first, within its nearest cells; -1 where those hold fewer."""
        best_d = np.full((len(x), want), np.inf, np.float32)
        best = np.full((len(x), want), -1, np.int64)
        chosen = self._cells(x, cells)
        for c in np.unique(chosen):
            rows = np.flatnonzero((chosen == c).any(1))
            ids = np.arange(self.begin[c], self.begin[c + 1])
            d = np.hstack([best_d[rows], self.norms[ids] - 2.0 * x[rows] @ self.fine[ids].T])
            i = np.hstack([best[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
            keep = np.argpartition(d, want - 1, axis=1)[:, :want]
            best_d[rows], best[rows] = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)
        return np.take_along_axis(best, np.argsort(best_d, axis=1), 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def _vector_keys(x: np.ndarray) -> np.ndarray:
    """A 63-bit key per vector; equal vectors have equal keys."""
    rng = np.random.default_rng(5)
    bits = (x + np.float32(0)).view(np.uint32).astype(np.uint64)
    key = bits @ (rng.integers(1, 2**63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(1)).astype(np.int64)


def _plan_shards(vectors: DataFrame, dim: int, shard: int) -> tuple[Centres, np.ndarray]:
    """Centres and the number of slices of each, from the row count and at most SAMPLE rows."""
    total = vectors.count()
    count = int(np.clip(-(-total // shard), 1, MOST_CENTRES))
    share = min(1.0, max(SAMPLE // 8, 8 * count) / max(total, 1))
    picked = vectors.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    table = picked.select("embedding").limit(SAMPLE).toArrow()
    sample = np.concatenate([np.empty((0, dim), np.float32)] + [_matrix(c, dim) for c in table.column(0).chunks])
    sample = sample[np.isfinite(sample).all(1)]
    if not len(sample):
        return Centres(np.zeros((1, dim), np.float32), 1), np.ones(1, np.int64)
    centres = Centres(sample, min(count, len(sample)))
    near = centres.nearest(sample, 1)[:, 0]
    sizes = np.bincount(near, minlength=len(centres)) / len(sample) * total
    most = 1.5 * shard if count < MOST_CENTRES else max(1.5 * total / count, LARGEST)
    return centres, np.maximum(1, np.ceil(sizes / most)).astype(np.int64)


def _few_copies(key: np.ndarray, ids: pa.Array, most: int) -> np.ndarray:
    """Rows of a batch without those that have ``most`` equal vectors with smaller ids before them."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, int)
    size = np.diff(np.r_[begin, len(key)])
    keep = np.ones(len(key), bool)
    for b, n in zip(begin[size > most].tolist(), size[size > most].tolist(), strict=True):
        rows = order[b : b + n]
        by_id = np.argsort(np.asarray(ids.take(pa.array(rows)).to_pylist(), object), kind="stable")
        keep[rows[by_id[most:]]] = False
    return np.flatnonzero(keep)


def nearest(
    vectors: DataFrame,
    queries: DataFrame | Column | None = None,
    k: int = 10,
    dim: int = 64,
    probes: int = 10,
    width: int = 64,
    shard: int = SHARD,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """The k nearest other rows of each query by Euclidean distance: (query_id, id, distance, score).

    vectors: (id, embedding), one row an id. A row belongs to the collection if
    its embedding has exactly ``dim`` finite values; null, short, long and
    non-finite ones neither come out nor are queried. queries: (id) of rows of
    the collection, or a condition on id; by default every row is a query.
    score is 1 / (1 + distance). Ties go to the smallest id. Empty input gives
    no rows.

    The collection is cut into shards of about ``shard`` vectors around centres
    fitted on at most SAMPLE rows (of ``fit_on``, by default of the vectors);
    there are as many centres as that takes, up to MOST_CENTRES, beyond which
    shards grow to LARGEST; shards that would be larger are sliced by the
    vector's hash, and all slices are searched. Every vector is indexed in one
    shard. Each shard builds a small-world graph over its distinct vectors by
    insertion and answers the queries whose ``probes`` nearest centres include
    it with a beam of ``width``; shard answers are merged per query. What a
    query costs thus doesn't grow with the collection but by the logarithm of
    the shards' size. Of equal vectors k + 1 rows (smallest ids) are indexed,
    which is all that k neighbours can use; of those in one batch the surplus
    is dropped before the shuffle, so a vector that a third of the rows share
    doesn't fill a task.
    """
    centres, slices = _plan_shards(vectors if fit_on is None else fit_on, dim, shard)
    probes = min(probes, len(centres))
    usable = vectors.where(F.col("id").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    if queries is None:
        rows = usable.withColumn("asked", F.lit(True))
    elif isinstance(queries, Column):
        rows = usable.withColumn("asked", F.coalesce(queries, F.lit(False)))
    else:
        asked = queries.where(F.col("id").isNotNull()).select("id", F.lit(True).alias("asked")).distinct()
        rows = usable.join(asked, "id", "left")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = np.concatenate([[0], np.cumsum(slices)])
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            ok = np.isfinite(x).all(1)
            keep = np.flatnonzero(ok)
            if not len(keep):
                continue
            x, batch = x[keep], batch.take(pa.array(keep))
            key = _vector_keys(x)
            want = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) == True)  # noqa: E712
            kept = _few_copies(key, batch.column(0), k + 1)
            home = centres.nearest(x[kept], 1, 2)[:, 0]
            parts = [(kept, offsets[home] + key[kept] % slices[home], key[kept], False)]
            if len(want):
                near = centres.nearest(x[want], probes)
                row, centre = np.repeat(want, probes)[near.ravel() >= 0], near.ravel()[near.ravel() >= 0]
                each = slices[centre]
                row, centre = np.repeat(row, each), np.repeat(centre, each)
                slot = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                parts.append((row, offsets[centre] + slot, key[row], True))
            for at, part, own, is_query in parts:
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(part.astype(np.int32)), pa.array(own), pa.array(np.full(len(at), is_query))],
                    names=["id", "embedding", "part", "own", "is_query"],
                )

    placed = rows.mapInArrow(place, "id string, embedding array<float>, part int, own long, is_query boolean")
    # one shuffle brings a shard together; more tasks than shards, so that few have two
    placed = placed.repartition(int(min(4 * slices.sum(), MOST_TASKS)), "part")
    # a question is never a copy of another one: its id is part of its key
    copies = Window.partitionBy("part", "own", F.when(F.col("is_query"), F.col("id"))).orderBy("id")
    placed = placed.withColumn("_rank", F.row_number().over(copies)).where(F.col("_rank") <= k + 1).drop("_rank")

    def answer(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names, asked = group.column("id"), group.column("is_query").to_numpy()
        x = np.concatenate([_matrix(c, dim) for c in group.column("embedding").chunks])
        keys = group.column("own").to_numpy()
        inside, ask = np.flatnonzero(~asked), np.flatnonzero(asked)
        empty = pa.table({"query_id": pa.array([], pa.string()), "id": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
        if not len(inside) or not len(ask):
            return empty
        order = inside[np.argsort(keys[inside], kind="stable")]
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        counts = np.diff(np.r_[heads, len(order)])
        nodes, _ = Graph(x[order[heads]]).search(x[ask], k + 1, width)
        q = np.repeat(np.arange(len(ask)), nodes.shape[1])
        node = nodes.ravel()
        q, node = q[node >= 0], node[node >= 0]
        each = counts[node]
        slot = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        q, member = np.repeat(q, each), order[np.repeat(heads[node], each) + slot]
        distance = np.sqrt(((x[ask[q]].astype(np.float64) - x[member]) ** 2).sum(1))
        ids = np.asarray(names.to_pylist(), object)
        other = ids[ask[q]] != ids[member]
        q, member, distance = q[other], member[other], distance[other]
        order = np.lexsort((distance, q))
        q, member, distance = q[order], member[order], distance[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) if len(q) else q
        # all rows at the k-th distance stay; the merge decides between them by id
        last = np.full(len(ask), np.inf)
        last[q[rank == k - 1]] = distance[rank == k - 1]
        keep = distance <= last[q]
        return pa.table({"query_id": pa.array(ids[ask[q[keep]]], pa.string()), "id": pa.array(ids[member[keep]], pa.string()), "distance": distance[keep]})

    found = placed.groupBy("part").applyInArrow(answer, "query_id string, id string, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    top = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    return top.select("query_id", "id", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def current_vectors(chunks: DataFrame) -> DataFrame:
    """The vector of each chunk: that of its row with the greatest upserted_at (nulls first); (id, embedding)."""
    at = F.coalesce(F.col("upserted_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = chunks.where(F.col("chunk_id").isNotNull())
    return rows.groupBy(F.col("chunk_id").alias("id")).agg(F.max_by("embedding", at).alias("embedding"))
