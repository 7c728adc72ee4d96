import random

import numpy as np
import pytest

from corpusmith.llm import packing as P


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_limit(rule):
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 60, 900), np.full(40, 256), rng.integers(1, 3, 400)])
    out = P.best_fit(sizes, 256, 10, rule)
    for c in range(out.max() + 1):
        inside = sizes[out == c]
        assert 0 < len(inside) <= 10 and inside.sum() <= 256 and (inside.astype(float) ** 2).sum() <= 256**2
    assert out.max() + 1 <= (40 + 1300 / 10) * 1.25  # forty full ones, ten places for each of the others


def test_best_fit_small():
    assert list(P.best_fit(np.array([], int), 8, 4)) == []
    assert list(P.best_fit(np.array([8]), 8, 4)) == [0]
    assert P.best_fit(np.array([5, 3, 4, 4]), 8, 4).max() == 1


def test_pack_places_everything_once(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "δέλτα", "数据"]) for _ in range(rnd.randint(0, 90))) for _ in range(120)]
    rows = [(i, t, "w") for i, t in enumerate(texts)] + [(1000, None, "n"), (1001, "", "e"), (1002, "<|endoftext|> word", "s"), (None, "lost", "x"), (1003, "word " * 5000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window_id string")
    windows = spark.createDataFrame([(1, 64, "a"), (2, 512, "b"), (None, 9, "c"), (3, None, "d"), (4, 0, "e"), (1, 64, "a")], "window_id long, capacity_tokens long, purpose string")
    out = P.pack(docs, windows, group=50).toPandas()
    counts = {r["doc_id"]: r["tokens"] for r in P.token_counts(docs).where("tokens > 0 and doc_id is not null").collect()}
    assert set(out.window_id) == {1, 2}
    assert out.groupby("container_id").window_id.nunique().eq(1).all()
    for window, capacity in ((1, 64), (2, 512)):
        part = out[out.window_id == window]
        assert set(part.doc_id) == set(counts)
        for doc, pieces in part.groupby("doc_id"):
            spans = sorted(zip(pieces.token_start, pieces.token_end))
            assert spans[0][0] == 0 and spans[-1][1] == counts[doc] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == -(-counts[doc] // capacity)
        used = (part.token_end - part.token_start).groupby(part.container_id).sum()
        assert used.max() <= capacity and used.sum() / (len(used) * capacity) > 0.85


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    windows = spark.createDataFrame([(1, 64)], "window_id long, capacity_tokens long")
    assert P.pack(docs, windows).count() == 0
    assert P.pack(spark.createDataFrame([(1, "text")], "doc_id long, text string"), windows.limit(0)).count() == 0


def test_attention_binds():
    """95 tokens of 100 cost 0.9025 of the square: with a budget of 0.9 nothing joins them, with one of 1 the small items do."""
    sizes = np.array([95, 5, 4])
    assert P.best_fit(sizes, 100, 10, attention=0.9).tolist() == [0, 1, 1]
    assert P.best_fit(sizes, 100, 10, attention=1.0).tolist() == [0, 0, 1]
    # two halves fit by tokens; a budget below half the square parts them
    assert len(set(P.best_fit(np.array([50, 50]), 100, 10, attention=0.4).tolist())) == 2
    assert len(set(P.best_fit(np.array([50, 50]), 100, 10, attention=0.5).tolist())) == 1


@pytest.mark.parametrize("attention", [0.2, 0.5, 0.9])
def test_attention_is_never_exceeded(attention):
    sizes = np.random.default_rng(3).integers(1, 101, 400)
    bins = P.best_fit(sizes, 100, 40, attention=attention)
    cost = np.bincount(bins, sizes.astype(float) ** 2)
    alone = np.bincount(bins) == 1
    assert ((cost <= attention * 100**2 + 1e-6) | alone).all()
    assert (np.bincount(bins, sizes) <= 100).all()
