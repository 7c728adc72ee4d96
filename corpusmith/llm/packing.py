"""Filling fixed-capacity containers with texts measured in tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the public tokenizers lie, and how the chosen one cuts text before merging.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 4096
MOST_WINDOWS = 1000
MOST_BYTES = 64 * 2**20
ATTENTION = 0.9


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Length of every text in tokens: (doc_id, tokens). Null texts have none; every row is kept.

    tokenizer: a file of ranks (base64 token and number a line) that the driver
    can read; it is checked to be of at most MOST_BYTES and travels with the
    job. Special tokens in a text count as ordinary text.
    """
    if os.path.getsize(tokenizer) > MOST_BYTES:
        raise ValueError(f"a tokenizer of more than {MOST_BYTES} bytes")
    with open(tokenizer, "rb") as file:
        shipped = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, shipped.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, tokens long")


def best_fit(
    sizes: np.ndarray, capacity: int, most_items: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.2, 0.1), attention: float = ATTENTION
) -> np.ndarray:
    """Container of each item by vector best-fit, largest items first.

    An item takes tokens, one place and its squared length (what attention over
    it costs) of a container that has ``capacity`` tokens, ``most_items``
    places and ``attention`` * capacity ** 2 of attention. Below 1 the last one
    binds where an item nearly fills a container, and the more the lower it is;
    an item that alone costs more than that has a container to itself. Among
    the open containers that have room for an item in every respect the one is
    chosen whose weighted residual after the item has the least norm
    (``norm``), or whose residual has the greatest weighted dot product with
    the item per residual (``dot``); if there is none, a new one opens. Sizes
    must not exceed the capacity.
    """
    limit = np.array([capacity, most_items, attention * float(capacity) ** 2])
    w = np.array(weights)
    order = np.argsort(-sizes, kind="stable")
    smallest = float(sizes.min(initial=capacity))
    out = np.empty(len(sizes), np.int64)
    # residuals as shares of the limits, of the containers that are still open
    left = np.empty((len(sizes) + 1, 3))
    name = np.empty(len(sizes) + 1, np.int64)
    opened = used = 0
    for item in order.tolist():
        size = float(sizes[item])
        need = np.minimum(np.array([size, 1.0, size * size]) / limit, 1.0)
        room = left[:opened]
        after = room - need
        fits = np.flatnonzero((after >= -1e-12).all(1))
        if len(fits):
            if rule == "dot":
                score = -(room[fits] * need * w).sum(1) / np.maximum((room[fits] ** 2 * w).sum(1), 1e-12)
            else:
                score = (after[fits] ** 2 * w).sum(1)
            at = int(fits[np.argmin(score)])
            left[at] = after[at]
        else:
            at = opened
            left[at], name[at] = 1.0 - need, used
            opened, used = opened + 1, used + 1
        out[item] = name[at]
        # a container too full for even the smallest item closes
        if left[at, 0] * capacity < smallest - 1e-9 or left[at, 1] * most_items < 1 - 1e-9 or left[at, 2] * limit[2] < smallest**2 - 1e-9:
            opened -= 1
            left[at], name[at] = left[opened], name[opened]
    return out


def pack(documents: DataFrame, windows: DataFrame, tokens_per_item: int = 16, group: int = GROUP, rule: str = "norm", tokenizer: str = TOKENIZER, attention: float = ATTENTION) -> DataFrame:
    """Texts in containers of each capacity: (window_id, container_id, doc_id, token_start, token_end).

    documents: (doc_id, text), windows: (window_id, capacity_tokens); other
    columns are ignored. Every text with a token is placed in each window, once
    and whole, unless it alone exceeds the capacity: then it fills containers
    of its own and only its rest is packed with others. Null and empty texts
    have nothing to place and don't come out; nor do windows whose id or
    capacity is null or below 1. Repeated rows are placed as often as they
    occur. container_id is unique across windows.

    Only lengths are shuffled. Items are packed by best_fit in groups of about
    ``group`` by a hash of the document, so that no task holds more; the space
    lost to grouping is less than one container a group. A container has
    places for capacity / ``tokens_per_item`` items and an attention budget of
    ``attention`` times its squared capacity (see best_fit).
    """
    kept = windows.where((F.col("window_id").isNotNull()) & (F.col("capacity_tokens") >= 1)).select("window_id", "capacity_tokens").distinct()
    counts = token_counts(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)), tokenizer).where("tokens > 0")
    groups = max(1, -(-documents.count() // group))
    part = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(groups)).cast("int")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        window, number, capacity = (int(pdf[c].iloc[0]) for c in ("window_id", "part", "capacity_tokens"))
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable")
        doc, tokens = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy()
        whole = np.where(tokens > capacity, tokens // capacity, 0)
        start = whole * capacity
        rest = np.flatnonzero(tokens > start)
        containers = best_fit(tokens[rest] - start[rest], capacity, max(1, capacity // tokens_per_item), rule, attention=attention)
        full = np.repeat(np.arange(len(doc)), whole)
        piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        own = containers.max(initial=-1) + 1 + np.arange(len(full))
        return pd.DataFrame(
            {
                "window_id": window,
                "container_id": (window * groups + number) * 2**32 + np.r_[containers, own],
                "doc_id": np.r_[doc[rest], doc[full]],
                "token_start": np.r_[start[rest], piece * capacity],
                "token_end": np.r_[tokens[rest], (piece + 1) * capacity],
            }
        )

    # the windows are settings, one a purpose; their number is checked before they become part of the plan
    listed = kept.orderBy("window_id", "capacity_tokens").limit(MOST_WINDOWS + 1).collect()
    if len(listed) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    if not listed:
        listed = [{"window_id": None, "capacity_tokens": None}]
    choices = F.array(*[F.struct(F.lit(r["window_id"]).cast("long").alias("window_id"), F.lit(r["capacity_tokens"]).cast("long").alias("capacity_tokens")) for r in listed])
    each = counts.select("doc_id", "tokens", part.alias("part"), F.explode(choices).alias("_w")).select("doc_id", "tokens", "part", "_w.*").where("window_id is not null")
    return each.groupBy("window_id", "part").applyInPandas(fill, "window_id long, container_id long, doc_id long, token_start long, token_end long")
