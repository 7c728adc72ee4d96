import random

import numpy as np
import pytest

from corpusmith.llm import leakage as L
from corpusmith.llm.fmindex import Bits, Index, suffix_order


def naive(symbols, pattern):
    return sorted(i for i in range(len(symbols)) if list(symbols[i : i + len(pattern)]) == list(pattern))


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    """Counts and positions equal a scan, repeated documents and runs of one symbol included."""
    rng = np.random.default_rng(seed)
    most = int(rng.integers(1, 9))
    docs = [rng.integers(1, most + 1, rng.integers(0, 60)) for _ in range(8)]
    docs += [docs[0], docs[0], np.ones(40, int)]
    symbols = np.concatenate([np.r_[d, 0] for d in docs]).astype(np.int64)
    index = Index(symbols, most)
    for size in (1, 2, 4):
        patterns = rng.integers(1, most + 1, (30, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.locate(np.arange(a, b))) == naive(symbols, p)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        s = np.r_[rng.integers(1, 3, n - 1) + 1, 0].astype(np.int64)
        assert list(suffix_order(s, 2)) == sorted(range(n), key=lambda i: list(s[i:]))


def test_bits():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, 1000)
    b = Bits(bits)
    at = np.arange(1001)
    assert (b.rank(at) == np.r_[0, np.cumsum(bits)]).all() and (b.get(at[:-1]) == bits).all()


WORDS = [f"{a}{b}" for a in "brem klon traf gosh wend pilt".split() for b in "ar ent ish old us ime".split()]


def sentence(rnd, n=12):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus():
    rnd = random.Random(7)
    line = "Read the passage and answer the question below."
    items = [(i, line + "\n" + " ".join(sentence(rnd) for _ in range(5))) for i in range(6)]
    body = {i: t.split("\n", 1)[1].split(". ") for i, t in items}
    noise = lambda: " ".join(sentence(rnd) for _ in range(6))
    edited = " ".join(w if k % 11 else "**changed**" for k, w in enumerate(items[1][1].split("\n")[1].split()))
    shuffled = items[2][1].split("\n")[1].split()
    rnd.shuffle(shuffled)
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in items[5][1].split("\n")[1])
    docs = {
        1: noise() + "\n\n" + items[0][1].split("\n")[1] + "\n" + noise(),  # whole
        2: noise() + " " + edited,  # small edits and markup
        3: " ".join(shuffled),  # other order
        4: line + "\n" + noise(),  # shared instruction
        5: noise() + " " + body[3][1] + ". " + noise(),  # one sentence of five
        6: noise() + "\n" + (body[4][0] + ".\n" + body[4][1].replace(" ", "\n") + ". " + body[4][2]).upper() + " " + noise(),  # three of five
        7: wide.replace(" w", " ​w"),  # character variants
    }
    return items, docs


@pytest.mark.parametrize(("shard", "pass_chars"), [(20, 10**7), (100, 900), (1_000_000, 10**7)])
def test_cases(spark, shard, pass_chars):
    items, docs = corpus()
    d = spark.createDataFrame([*docs.items(), (8, None), (9, ""), (None, docs[1]), (1, docs[1])], "doc_id long, text string").repartition(2)
    i = spark.createDataFrame([(a, b, "x") for a, b in items] + [(50, None, "x"), (51, "", "x"), (None, "a", "x"), (0, items[0][1], "x")], "item_id long, text string, doc_id string")
    out = L.leaked_passages(d, i, shard_tokens=shard, block_items=4, pass_chars=pass_chars).collect()
    assert {(r["item_id"], r["doc_id"]) for r in out} - {(0, None)} == {(0, 1), (1, 2), (4, 6), (5, 7)}
    whole = next(r for r in out if r["doc_id"] == 1)
    text = docs[1]
    assert " ".join(text[s["start"] : s["end"]] for s in whole["spans"]).rstrip(".") == items[0][1].split("\n")[1].rstrip(".")


def test_unspaced_script(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("数据链接页面标题更新删除重复快照索引来源") for _ in range(n))
    item = text(90)
    docs = [(1, text(200) + item[20:70] + text(100)), (2, text(300)), (3, text(50) + item[10:25] + text(50))]
    out = L.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["item_id"], r["doc_id"]) for r in out] == [(1, 1)] and abs(out[0]["covered"] - 50 / 90) < 0.05


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert L.leaked_passages(docs, items).count() == 0
    assert L.leaked_passages(spark.createDataFrame([(1, "some text")], docs.schema), items).count() == 0


def test_nothing_is_lost_before_joining():
    """Whatever _passages accepts passes the vectorised test before it."""
    rnd = np.random.default_rng(5)
    pairs, kept_all = 0, 0
    for _ in range(300):
        n = int(rnd.integers(1, 12))
        p = np.sort(rnd.integers(0, 80, n))
        a = np.clip(p + rnd.integers(-3, 4, n), 0, None)
        size = rnd.integers(4, 12, n)
        pair, need = np.zeros(n, int), np.full(n, 20.0)
        keep = L._worth_joining(pair, a, a + size, p, p + size, 9, 6, need)
        rows = list(zip(a.tolist(), (a + size).tolist(), p.tolist(), (p + size).tolist(), strict=True))
        covered = lambda parts: sum(len(set(range(x, y))) for x, y, _, _ in parts)
        whole = L._passages(rows, 9, 6)
        if len(set().union(*(range(x, y) for x, y, _, _ in whole))) >= 20:
            pairs += 1
            some = L._passages([rows[i] for i in keep], 9, 6)
            kept_all += sorted(some) == sorted(whole)
    assert pairs > 50 and kept_all == pairs


def test_first_lines_are_shared_whatever_their_spelling(spark):
    rnd = random.Random(5)
    line, other = "Answer the following question carefully, please, in one word.", "ANSWER the following question *carefully*, please -- in one word"
    items = [(1, line + "\n" + sentence(rnd, 8)), (2, other + "\n" + sentence(rnd, 8))]
    docs = [(1, line + " " + sentence(rnd, 30))]
    out = L.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert out.count() == 0
