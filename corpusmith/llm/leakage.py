"""Passages of evaluation items inside a training corpus."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.fmindex import Index

SHARD_TOKENS = 1_000_000
BLOCK_ITEMS = 5_000
PASS_CHARS = 16_000_000
# size of the alphabet that tokens are hashed to in an index; hits are compared by 64-bit hashes
ALPHABET = 65_535

# scripts without spaces count by character, all others by word
_UNSPACED = "\u2e80-\u9fff\u0e00-\u0e7f\uf900-\ufaff"
_MARKS = "\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0966-\u0dff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|(?:[^\W_{_UNSPACED}]|[{_MARKS}])+")
_HIDDEN = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_ONE = re.compile(rf"[{_UNSPACED}]")


def normal_token(token: str) -> str:
    """A token without letter case, accents and width variants."""
    parts = unicodedata.normalize("NFKD", token)
    return "".join(c for c in parts if not unicodedata.combining(c)).casefold()


def tokens(text: str) -> list[str]:
    return [normal_token(t) for t in _TOKEN.findall(_HIDDEN.sub("", text))]


def token_hash(token: str) -> int:
    """A 63-bit hash of a normal token, the same in every process."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return hashes % ALPHABET + 1


class Query:
    """A block of items (item_id, text, whether others share its first line) made ready for search: phrases and where each stands."""

    def __init__(self, rows: list[tuple[int, str, bool]], words: int, chars: int):
        self.ids = [i for i, _, _ in rows]
        self.length, self.by_char = [], []
        sequences = []
        known: dict[str, int] = {}
        for _, text, shared in rows:
            own = tokens(text)
            skip = len(tokens(text.lstrip().partition("\n")[0])) if shared else 0
            sequences.append(np.array([known.get(t) or known.setdefault(t, token_hash(t)) for t in own[skip:]], np.int64))
            self.length.append(len(own))
            self.by_char.append(sum(bool(_ONE.match(t)) for t in own) * 2 > len(own))
        self.hashes = np.concatenate([np.empty(0, np.int64), *sequences])
        self.begin = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        self.size = {False: words, True: chars}
        self.patterns: dict[int, np.ndarray] = {}
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind, size in self.size.items():
            found = [
                (np.lib.stride_tricks.sliding_window_view(_symbols(s), size), i) for i, s in enumerate(sequences) if self.by_char[i] == kind and len(s) >= size
            ]
            if not found:
                continue
            grams = np.concatenate([g for g, _ in found])
            item = np.concatenate([np.full(len(g), i) for g, i in found])
            at = np.concatenate([np.arange(len(g)) for g, _ in found])
            unique, inverse = np.unique(grams, axis=0, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            begin = np.searchsorted(inverse[order], np.arange(len(unique) + 1))
            self.patterns[size] = unique
            self.places[size] = (begin, item[order], at[order])


class Shard:
    """FM-indexes over the tokens of some documents. Pieces of a text that is longer than an index overlap by a phrase, so nothing is lost."""

    def __init__(self, hashes: list[np.ndarray], most: int, longest: int):
        sizes = np.array([len(x) + 1 for x in hashes])
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.hashes = np.full(self.begins[-1], -1, np.int64)
        for x, b in zip(hashes, self.begins, strict=False):
            self.hashes[b : b + len(x)] = x
        symbols = np.where(self.hashes < 0, 0, _symbols(self.hashes))
        count = max(1, -(-len(symbols) // (2 * most)))
        cuts = [len(symbols) * i // count for i in range(count + 1)]
        self.pieces = [(x, y - x, Index(np.r_[symbols[x : y + longest - 1], 0], ALPHABET)) for x, y in zip(cuts, cuts[1:], strict=False)]


def _hits(shard: Shard, query: Query, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the shard: (position, item, offset in the item)."""
    out = []
    begin, items, offsets = query.places[size]
    for first, own, index in shard.pieces:
        low, high = index.search(query.patterns[size])
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        position = index.locate(rows)
        which, position = which[position < own], position[position < own] + first
        each = (begin[1:] - begin[:-1])[which]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[which], each)
        position, item, offset = np.repeat(position, each), items[place], offsets[place]
        # tokens of one symbol may differ
        same = np.ones(len(position), bool)
        for i in range(size):
            same &= shard.hashes[position + i] == query.hashes[query.begin[item] + offset + i]
        out.append((position[same], item[same], offset[same]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _segments(doc: np.ndarray, position: np.ndarray, item: np.ndarray, offset: np.ndarray, size: int, slack: int) -> tuple[np.ndarray, ...]:
    """Hits of one item in one document that follow each other at the same shift, joined: (item, doc, from, to, first position, last)."""
    shift = position - offset
    order = np.lexsort((offset, shift, doc, item))
    item, doc, shift, offset, position = item[order], doc[order], shift[order], offset[order], position[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1]) | (offset[1:] - offset[:-1] > size + slack)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(new)] - 1
    return item[begin], doc[begin], offset[begin], offset[end] + size, position[begin], position[end] + size


def _worth_joining(pair: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, least: int, slack: int, need: np.ndarray) -> np.ndarray:
    """Segments of pairs that can reach what is needed, sorted by pair and place; loses none that _passages would accept.

    Where a document has more than ``slack`` tokens between segments nothing is
    joined across; what stands between two such gaps covers at most its
    segments and ``slack`` for each joint.
    """
    order = np.lexsort((a, p, pair))
    pair, a, b, p, q = pair[order], a[order], b[order], p[order], q[order]
    new = np.r_[True, pair[1:] != pair[:-1]]
    _, code = np.unique(pair, return_inverse=True)
    far = code.astype(np.int64) * (int(q.max(initial=0)) + slack + 2)
    upto = np.maximum.accumulate(q + far)
    new[1:] |= p[1:] + far[1:] > upto[:-1] + slack
    cluster = np.cumsum(new) - 1
    reach = np.bincount(cluster, b - a) + slack * (np.bincount(cluster) - 1)
    good = (reach >= least)[cluster]
    total = np.bincount(code[new], np.where(reach >= least, reach, 0))
    return order[good & (total[code] >= need[order])]


def _passages(parts: list[tuple[int, int, int, int]], least: int, slack: int) -> list[tuple[int, int, int, int]]:
    """Segments joined across small edits; those of at least ``least`` tokens. Each is (from, to, first, last)."""
    parts = sorted(parts, key=lambda p: (p[2], p[0]))
    joined: list[list[int]] = []
    for a, b, p, q in parts:
        for other in reversed(joined):
            step, move = a - other[1], p - other[3]
            if -least < step <= slack and -least < move <= slack and abs(step - move) <= 3 and a >= other[0]:
                other[1], other[3] = max(other[1], b), max(other[3], q)
                break
        else:
            joined.append([a, b, p, q])
    return [tuple(j) for j in joined if j[1] - j[0] >= least]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    share: float = 0.32,
    words: int = 4,
    chars: int = 8,
    passage_words: int = 9,
    passage_chars: int = 20,
    slack: int = 6,
    shard_tokens: int = SHARD_TOKENS,
    block_items: int = BLOCK_ITEMS,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """Documents that hold passages of evaluation items: (item_id, doc_id, covered, spans).

    documents: (doc_id, text), items: (item_id, text); other columns are
    ignored, null and empty texts never match, repeated rows count once.
    covered is the share of the item's tokens (words; characters in scripts
    without spaces) that stand in the document in passages of at least
    ``passage_words`` words or ``passage_chars`` characters; a pair comes out
    from ``share`` on. The default is a little under a third, because tokens at
    the edges of an edit are counted as changed. spans are the merged stretches
    of the document (start, end in code points) to remove.

    Tokens compare without letter case, accents, width variants and invisible
    characters, and markup and line layout don't count. An item's first line
    isn't searched if other items share it: it is an instruction.

    Each task cuts its documents into shards of about ``shard_tokens`` and
    indexes each once: an FM-index over hashed tokens, with a wavelet tree for
    ranks and sampled suffix positions. All phrases of ``words`` words
    (``chars`` characters) of the items are searched backwards at once and
    located; hits are compared by full hashes and joined to passages in the
    shard, so that only pairs leave the task. A text longer than two shards is
    indexed in pieces that overlap by a phrase.

    Items are the query set. They are broadcast, at most about ``pass_chars``
    characters of them at once (more take another pass over the corpus), and
    searched in blocks of ``block_items``, all in the same indexes.
    """
    rows = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = rows.groupBy("item_id").agg(F.min("text").alias("text")).withColumn("line", F.pandas_udf(_first_line, "string")("text"))
    shared = rows.where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line", F.lit(True).alias("shared"))
    rows = rows.join(shared, "line", "left").select("item_id", "text", F.coalesce("shared", F.lit(False)).alias("shared"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_chars))
    texts = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id long, doc_id long, covered double, spans array<struct<start:int,end:int>>"
    out = None
    for number in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id").collect()
        listed = [(r["item_id"], r["text"], r["shared"]) for r in part]
        sent = documents.sparkSession.sparkContext.broadcast([listed[i : i + block_items] for i in range(0, len(listed), block_items)])
        found = texts.mapInArrow(_searcher(sent, share, words, chars, passage_words, passage_chars, slack, shard_tokens), schema)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["item_id", "doc_id"])


def _first_line(text: pd.Series) -> pd.Series:
    """The tokens of an item's first line if more follows, else nothing."""

    def key(value: str) -> str:
        first, _, rest = value.lstrip().partition("\n")
        return " ".join(tokens(first)) if rest.strip() else ""

    return text.map(key)


def _searcher(sent, share, words, chars, passage_words, passage_chars, slack, shard_tokens):
    """The search of the items sent as a function over batches of documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query(block, words, chars) for block in sent.value]
        known: dict[str, int] = {}
        docs: list[tuple[int, str]] = []
        hashes: list[np.ndarray] = []
        total = 0

        def number(token: str) -> int:
            n = known[token] = token_hash(normal_token(token))
            return n

        def flush() -> Iterator[pa.RecordBatch]:
            if any(q.patterns for q in queries):
                shard = Shard(hashes, shard_tokens, max(words, chars))
                for query in queries:
                    yield _search_shard(query, shard, docs, share, {False: passage_words, True: passage_chars}, slack)
            docs.clear()
            hashes.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clean = _HIDDEN.sub("", text)
                get = known.get
                found = [n if (n := get(t)) is not None else number(t) for t in _TOKEN.findall(clean)]
                if len(known) > 1_000_000:
                    known.clear()
                docs.append((doc, text))
                hashes.append(np.array(found, np.int64))
                total += len(found)
                if total >= shard_tokens:
                    yield from flush()
                    total = 0
        if docs:
            yield from flush()

    return search


def _search_shard(query: Query, shard: Shard, docs: list[tuple[int, str]], share: float, least: dict[bool, int], slack: int) -> pa.RecordBatch:
    schema = pa.schema(
        [("item_id", pa.int64()), ("doc_id", pa.int64()), ("covered", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )
    begins = shard.begins
    out: list[tuple[int, int, float, list]] = []
    for kind, size in query.size.items():
        if size not in query.patterns:
            continue
        position, item, offset = _hits(shard, query, size)
        if not len(position):
            continue
        doc = np.searchsorted(begins, position, side="right") - 1
        item, doc, a, b, p, q = _segments(doc, position, item, offset, size, 2)
        pair = item * len(docs) + doc
        keep = _worth_joining(pair, a, b, p, q, least[kind], slack, share * np.array(query.length)[item])
        groups: dict[int, list] = defaultdict(list)
        for g, *segment in zip(pair[keep].tolist(), a[keep].tolist(), b[keep].tolist(), p[keep].tolist(), q[keep].tolist(), strict=True):
            groups[g].append(segment)
        for g, segments in groups.items():
            i, d = divmod(g, len(docs))
            passages = _passages(segments, least[kind], slack)
            covered = np.zeros(query.length[i] + 1, bool)
            for x, y, _, _ in passages:
                covered[x:y] = True
            part = covered.sum() / query.length[i]
            if part >= share:
                out.append((query.ids[i], d, float(part), [(int(x - begins[d]), int(y - begins[d])) for _, _, x, y in passages]))
    spans = []
    for _, d, _, passages in out:
        spans.append(_character_spans(docs[d][1], passages))
    arrays = [[o[0] for o in out], [docs[o[1]][0] for o in out], [o[2] for o in out], spans]
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


def _character_spans(text: str, passages: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Token stretches as merged stretches of the text, in code points."""
    clean = _HIDDEN.sub("", text)
    places = [m.span() for m in _TOKEN.finditer(clean)]
    if len(clean) != len(text):
        visible = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
        places = [(visible[s], visible[e - 1] + 1) for s, e in places]
    merged: list[list[int]] = []
    for first, last in sorted(passages):
        start, end = places[first][0], places[last - 1][1]
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [{"start": s, "end": e} for s, e in merged]
