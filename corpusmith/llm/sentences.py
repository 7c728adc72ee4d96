"""Sentence units of texts in many languages and scripts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.session import durable

FREQUENT = 3e-5  # share of all contexts from which on a next word is told apart, the same at every size
ROUNDS = 4

# --- layout: which stretches of a text are running text ---------------------------------

_MARK = re.compile(r"[ \t]*(?:(?:#{1,6}|[-*+•]|>)[ \t]+|>|(\d{1,3})[.)][ \t]+)")
_RULE = re.compile(r"[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$")
_FRONT = re.compile(r"\s*---[ \t]*\n(?:.*\n)*?---[ \t]*(?:\n|$)")


# Marks that end a line before a numbered item.
_LINE_END = ".!?…。！？؟।።፧;”»」』）)។៕။།༎"


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches of running text: paragraphs, headings, list items and quotes without their markers."""
    out: list[tuple[int, int]] = []
    start = -1
    front = _FRONT.match(text) if "---" in text[:200] else None
    at = front.end() if front else 0
    fenced, number, n = False, -1, len(text)
    while at < n:
        end = text.find("\n", at)
        if end < 0:
            end = n
        line = text[at:end]
        lead = line.lstrip()
        first = lead[:1]
        cut = False  # whether the line ends the stretch before it without being text
        begin = at
        if first in "`~" and lead[:3] in ("```", "~~~"):
            fenced, cut = not fenced, True
        elif fenced or not first or first == "|" or (first in "-=*_" and _RULE.match(line)):
            cut = True
        if cut:
            if start >= 0:
                out.append((start, at))
            start, number = -1, -1
        elif first in "#-*+•>0123456789" and (m := _MARK.match(line)):
            count = int(m.group(1)) if m.group(1) else -1
            # a number may open a wrapped line; it is a list marker only where a list can begin or go on
            if count < 0 or start < 0 or count == 1 or 0 < number < count or text[at - 2 : at - 1] in _LINE_END:
                if start >= 0:
                    out.append((start, at))
                begin = at + m.end()
                while m := _MARK.match(line, begin - at):
                    begin = at + m.end()
                start, number = begin, count
                if first == "#":
                    out.append((begin, end))
                    start = -1
        elif start < 0:
            start = begin
        at = end + 1
    if start >= 0:
        out.append((start, n))
    return out


# --- gaps: where a sentence may end -----------------------------------------------------

# Sentence-final marks, and the brackets and quotes around speech.
_FINAL = ".!?…。！？؟।።፧;;។៕။།༎"
_WIDE = "。！？।።፧។៕။།༎"
_OPEN, _CLOSE = "“„«「『（(《", "”»」』）)》“"
_EVENT = re.compile(rf"[{_FINAL}]+(?: །+)*|[“„«”»「」『』（）()《》]|(?<=[฀-໿])[ \n]+(?=[฀-໿])")
_AFTER = re.compile(r"[\"'*_`”»」』）)》’“\]]*(?:[   ](?=»)»)?[*_`]*")
_MAY_CLOSE = set("\"'*_`”»」』）)》’“] \u00a0\u202f")
_INVISIBLE = "\u200b\ufeff"
_NEXT = re.compile(r"[\"'“„«「『（(《\[*_`¿¡…\-]*\s?([^\W_]*)")


def _shape(word: str) -> str:
    if not word:
        return "x"
    c = word[0]
    return "d" if c.isdigit() else "U" if c.isupper() or c.istitle() else "l" if c.islower() else "c"


def _class(word: str, most: int) -> str:
    """A word itself if short, else its class, so that names don't fill the model."""
    bare = word.strip("\"'“”„«»()[]*_`（）「」…")
    if bare.isdigit():
        return "#" if len(bare) < 3 else "##"
    if len(bare) == 1 and bare.isupper():
        return "A"
    return bare.casefold() if len(bare) <= most else "~" + ("#" if bare[-1:].isdigit() else _shape(bare))


def gaps(text: str, begin: int, end: int) -> list[tuple[int, tuple[str, str, str, str]]]:
    """Places in one stretch where a sentence may end, with what the model looks at.

    Each is (position after closing marks, (word before last, last word with
    its mark, next word, shape of the next word)). Places that can't be an end
    (inside speech within a sentence, inside a number or a name) are left out.
    """
    out = []
    stack: list[tuple[str, bool]] = []
    fresh = True  # nothing but opening marks since the last possible end
    last = begin
    for m in _EVENT.finditer(text, begin, end):
        s, e = m.span()
        mark = text[s:e]
        if mark == "." and e < end and text[e].isalnum():
            last, fresh = e, False
            continue  # inside a number, a version or a file name
        if fresh and text[last:s].strip(" \n *_`\"'¿¡…[-"):
            fresh = False
        last = e
        if len(mark) == 1 and mark in _OPEN and not (mark == "“" and stack and stack[-1][0] == "„"):
            stack.append((mark, not fresh))
            continue
        if len(mark) == 1 and mark in _CLOSE:
            if stack:
                stack.pop()
            continue
        thai = mark[0] in " \n"
        if not thai:
            if mark[0] == ";" and not ("Ͱ" <= text[s - 1 : s] <= "Ͽ"):
                continue
            if mark[0] in "…." and (s == begin or text[s - 1].isspace()):
                continue  # an ellipsis that opens or interrupts
        elif fresh:
            continue
        after = _AFTER.match(text, e, end).end() if not thai and text[e : e + 1] in _MAY_CLOSE else e
        inner = [mid for _, mid in stack]
        closed = sum(c in _CLOSE for c in text[e:after]) if after > e else 0
        if closed:
            inner = inner[: max(0, len(inner) - closed)]
        if any(inner):
            continue  # speech or an aside within a sentence goes on
        mid_closed = closed > 0 and any(mid for _, mid in stack)
        to = after
        while to < end and (text[to].isspace() or text[to] in _INVISIBLE):
            to += 1
        if to >= end:
            continue  # the end of the stretch is an end anyway
        wide = mark[0] in _WIDE or (mark[0] == "…" and "⺀" <= text[s - 1] <= "鿿") or (to == after and text[to] > "⺀" and mark[0] not in ".;")
        if to == after and not wide and not thai:
            continue
        nxt = _NEXT.match(text, to, end)
        word = nxt.group(1)
        shape = _shape(word)
        if text.startswith("[[", to):
            word, shape = "", "w"  # a link may stand for any word, whatever its case
        if mid_closed and shape not in "Uwd":
            continue  # quoted speech that the sentence continues after
        if thai:
            a, w, n, shape = "th", "ไ" + text[max(begin, s - 2) : s], text[to : to + 3], "t"
        else:
            if mark == ".":
                before = text[max(begin, s - 40) : s].rsplit(None, 2)
                a, w = _class(before[-2], 4) if len(before) > 1 else "", before[-1] if before else ""
                w = _class(w, 6 if "." not in w else 9) + "."
            else:
                a, w = "", "." if mark.strip(".") == "" else "!" if mark[0] in "!?" else mark[0]
                if w == ".":
                    w = "..."
            if mid_closed:
                w += ")"
            n = word.casefold() if 0 < len(word) <= 8 and shape not in "d" else ""
        out.append((after, (a, w, n, shape)))
        fresh = True
    return out


def _ends(text: str, begin: int, end: int) -> tuple[tuple[str, str, str, str], tuple[str, str, str, str]]:
    """What a stretch says for certain: how its last sentence ends and its first begins."""
    nxt = _NEXT.match(text, begin, end)
    word = nxt.group(1)
    if "฀" <= text[begin : begin + 1] <= "໿":
        first = ("", "^", text[begin : begin + 3], "t")
    else:
        shape = _shape(word)
        if text.startswith("[[", begin):
            word, shape = "", "w"
        first = ("", "^", word.casefold() if 0 < len(word) <= 8 and shape != "d" else "", shape)
    tail = text[max(begin, end - 60) : end].rstrip(" \n\"'”»)]’」』）*_`")
    if tail.endswith(".") and not tail.endswith(".."):
        parts = tail[:-1].split()
        w = parts[-1] if parts else ""
        a = _class(parts[-2], 4) if len(parts) > 1 else ""
        return (a, _class(w, 6 if "." not in w else 9) + ".", "$", "$"), first
    mark = tail[-1:]
    if "฀" <= mark <= "໿":
        return ("th", "ไ" + tail[-2:], "$", "$"), first
    w = "..." if mark == "." else "!" if mark and mark in "!?" else mark if mark and mark in _FINAL else "-"
    return ("", w, "$", "$"), first


# --- the hidden-event model -------------------------------------------------------------


def _spaced(w: str) -> bool:
    """Whether a history is that of a space in a script that ends sentences by spaces."""
    return w[:1] == "ไ" and not w.endswith(".")


class Model:
    """Probabilities of a boundary event between two words, by interpolated n-gram counts.

    The event follows the history (word before last, last word); the next word
    follows either the boundary or the last word. ``seen`` are counts by
    (word before last, last word, next word, shape): ``$`` marks the end of a
    stretch, a certain boundary, and ``^`` its beginning.

    How often a history ends a sentence is told by the ends of stretches: of
    boundaries a share ``at_end`` (that of clear marks) falls there, so a word
    that ended n stretches ended n / at_end sentences. What follows a boundary
    and what follows none is found by expectation-maximisation, with that
    share held fixed. Spaces in Thai and Lao are judged in the same way, by what
    stands before stretch ends and before spaces. Clear marks before anything but a small letter are ends.
    """

    def __init__(self, seen: dict[tuple[str, str, str, str], int], rounds: int = ROUNDS):
        words: Counter = Counter()
        for (_, _, nxt, shape), c in seen.items():
            words[shape, nxt] += c
        # names that follow are told apart only if they are frequent
        bound = FREQUENT * sum(words.values())
        self.frequent = {k for k, c in words.items() if c >= bound or k[1] == "$"}
        merged: Counter = Counter()
        for (a, w, nxt, shape), c in seen.items():
            merged[a, w, nxt if (shape, nxt) in self.frequent else "", shape] += c
        seen = merged
        thai = thai_end = 0
        self.ended: Counter = Counter()
        self.total: Counter = Counter()
        clear_end = clear = 1.0
        for (a, w, nxt, shape), c in seen.items():
            if w == "^":
                continue
            for k in ((a, w), w):
                self.total[k] += c
                if nxt == "$":
                    self.ended[k] += c
            if _spaced(w):
                thai += c
                thai_end += c * (nxt == "$")
            if w[0] == "~" and shape != "l":
                clear += c
                clear_end += c * (nxt == "$")
        self.at_end = clear_end / clear
        self.thai = min(1.0, (thai_end / self.at_end + 20 * 0.97) / (thai + 20))
        keys = [k for k in seen if k[1] != "^" and k[2] != "$"]
        n = np.array([seen[k] for k in keys], float)
        post = np.array([0.01 if k[3] == "l" else self.boundary(k[0], k[1]) for k in keys])
        sure = np.array([k[3] != "l" and not _spaced(k[1]) and (k[1][0] == "~" or k[1] == "..." or not k[1].endswith(".")) for k in keys], bool)
        for _ in range(rounds):
            start: Counter = Counter()
            inside: Counter = Counter()
            for (_, w, nxt, shape), c in seen.items():
                if w == "^":
                    for k in ("", shape, (shape, nxt)):
                        start[k] += c
            for (_, w, nxt, shape), c, p in zip(keys, n, post, strict=True):
                for k in ("", shape, (shape, nxt), (w, ""), (w, shape), (w, shape, nxt)):
                    start[k] += c * p
                rest = c * (1 - p)
                for k in ("", shape, (shape, nxt), (w, ""), (w, shape), (w, shape, nxt)):
                    inside[k] += rest
            self.after, self.inside = start, inside
            post = np.where(sure, post, np.array([self.one(*k) for k in keys]))

    def boundary(self, a: str, w: str) -> float:
        """Share of boundaries after this history, among all places after it."""
        if _spaced(w):
            return min((self.ended[w] / self.at_end + 6 * self.thai) / (self.total[w] + 6), 0.995)
        if not w.endswith(".") or w == "...":
            return 0.97
        # the longer a word, the more it takes to show that its full stop abbreviates
        size = 9 if w[0] == "~" else len(w) - 1
        base, weight = (0.97, 20) if size > 4 else (0.85, 6) if size == 4 else (0.3 if w == "A." else 0.75, 3)
        one = min(1.0, (self.ended[w] / self.at_end + weight * base) / (self.total[w] + weight))
        both = (self.ended[a, w] / self.at_end + 6 * one) / (self.total[a, w] + 6)
        return min(both, 0.995)

    def odds(self, a: str, w: str, nxt: str, shape: str) -> float:
        """Boundary against none, for the word that follows."""

        if (shape, nxt) not in self.frequent:
            nxt = ""

        def given(seen: Counter) -> float:
            whole = (seen[shape] + 0.5) / (seen[""] + 4)
            word = (seen[shape, nxt] + 0.5) / (seen[shape] + 20)
            # a space between letters of such a script is followed by nothing else
            kind = 1.0 if shape == "t" else (seen[w, shape] + 3 * whole) / (seen[w, ""] + 3)
            return kind * (seen[w, shape, nxt] + 3 * word) / (seen[w, shape] + 3)

        return given(self.after) / max(given(self.inside), 1e-12)

    def one(self, a: str, w: str, nxt: str, shape: str) -> float:
        """Posterior of a boundary where the gaps beside this one are certain."""
        p = min(max(self.boundary(a, w), 1e-4), 1 - 1e-4)
        o = p / (1 - p) * self.odds(a, w, nxt, shape)
        return o / (1 + o)

    def chain(self, keys: list[tuple[str, str, str, str]]) -> list[float]:
        """Posteriors of gaps with one word between each and the next, by forward and backward sums.

        A boundary before a word takes the place of the word before it in the history.
        """
        trans = []
        for a, w, nxt, shape in keys:
            o = self.odds(a, w, nxt, shape)
            rows = []
            for h in (a, "^"):
                p = min(max(self.boundary(h, w), 1e-4), 1 - 1e-4)
                rows.append((1 - p, p * o))
            trans.append(rows)
        return _posteriors(trans)


def _posteriors(trans: list[list[tuple[float, float]]]) -> list[float]:
    """Posteriors of neighbouring gaps; each has the weights of (none, boundary) after none and after a boundary."""
    forward = [trans[0][0]]
    for t in trans[1:]:
        f0, f1 = forward[-1]
        z = f0 + f1
        forward.append(((f0 * t[0][0] + f1 * t[1][0]) / z, (f0 * t[0][1] + f1 * t[1][1]) / z))
    b0 = b1 = 1.0
    out = []
    for i in range(len(trans) - 1, -1, -1):
        x0, x1 = forward[i][0] * b0, forward[i][1] * b1
        out.append(x1 / (x0 + x1))
        t = trans[i]
        b0, b1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    return out[::-1]


def _linked(text: str, before: int, at: int) -> bool:
    """Whether one word stands between two gaps."""
    return at - before < 24 and len(text[before:at].split()) == 1


def units(text: str, model: Model, memo: dict, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Sentence units of one text as (start, end), end exclusive, without white space at either end."""
    out = []
    for begin, end in blocks(text):
        found = gaps(text, begin, end)
        cuts = []
        i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and _linked(text, found[j - 1][0], found[j][0]):
                j += 1
            if j == i + 1:
                at, key = found[i]
                p = memo.get(key)
                if p is None:
                    p = memo[key] = model.one(*key)
                if p >= threshold:
                    cuts.append(at)
            else:
                cuts += [found[i + k][0] for k, p in enumerate(model.chain([key for _, key in found[i:j]])) if p >= threshold]
            i = j
        for s, e in zip([begin, *cuts], [*cuts, end], strict=True):
            piece = text[s:e].rstrip()
            bare = piece.lstrip()
            if bare and (bare[0].isalnum() or any(map(str.isalnum, bare))):
                out.append((s + len(piece) - len(bare), s + len(piece)))
    return out


# --- stretches without any mark: an event after every word --------------------------------

LEAST_WORDS = 30  # a stretch without marks is one unit up to this length; two characters count as a word where words aren't spaced
SLOTS = 2**20
_SIGN = re.compile(rf"[{_FINAL}]")
_ALONE = "\u2e80-\u9fff\uf900-\ufaff"
_TOKEN = re.compile(rf"[{_ALONE}][^\w\s]*|[^\s{_ALONE}]+")
_CLEAR = re.compile(r"[!?…。！？؟।።፧;။།༎។៕]|[^\W\d_]{5}\.$")


def words_of(text: str, begin: int, end: int) -> list[tuple[int, str]]:
    """Words of a stretch (characters where words aren't spaced): (end, word in lower case without marks around it)."""
    return [(m.end(), m.group().strip("\"'“”„«»()[]*_`（）「」…,.:;!?").casefold()) for m in _TOKEN.finditer(text, begin, end)]


def word_gaps(text: str, begin: int, end: int) -> list[tuple[int, tuple[str, str, str, str]]]:
    """An event after every word of a stretch that has no sentence mark at all and is long; of any other none.

    Thai and Lao have events at their spaces instead.
    """
    if end - begin < LEAST_WORDS or _SIGN.search(text, begin, end) or any("\u0e00" <= c <= "\u0eff" for c in text[begin : begin + 40]):
        return []
    words = words_of(text, begin, end)
    if sum(0.5 if len(w) == 1 and w > "\u2e7f" else 1 for _, w in words) < LEAST_WORDS:
        return []
    return [(e, ("", "·" + w, n, "u")) for (e, w), (_, n) in zip(words, words[1:], strict=False)]


def _word_counts(documents: DataFrame, slots: np.ndarray) -> DataFrame:
    """What marked text says of words: (kind, w, n, times).

    Kinds: s starts (n), e ends by a clear mark (w), z ends of stretches (w), m
    full stops that may abbreviate (w), c words (w), b pairs within a sentence
    (w, n), t all words, x and y clear marks within and at the end of
    stretches. Only words whose slot is asked for are told apart (a filter of
    fixed size: it lets too many pass, never too few).
    """
    flags = np.zeros(SLOTS, bool)
    flags[slots] = True
    sent = documents.sparkSession.sparkContext.broadcast(np.packbits(flags).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        told: dict[str, tuple[str, int]] = {}
        seen: Counter = Counter()

        def tell(raw: str) -> tuple[str, int]:
            """The word if it is asked for, and what is behind it: 0 no word at all, 1 no mark, 2 a full stop, 3 a clear mark."""
            word = raw.strip("\"'“”„«»()[]*_`（）「」…,.:;!?").casefold()
            bare = raw.rstrip("\"'”»)]*_`")
            says = 0 if not word else 3 if _CLEAR.search(bare) else 2 if bare.endswith(".") else 1
            out = told[raw] = (word if word and wanted[_slot(word)] else "", says)
            return out

        def flush() -> pa.RecordBatch:
            rows = [(*k, c) for k, c in seen.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            seen.clear()
            told.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["kind", "w", "n", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for begin, end in blocks(text):
                    if not _SIGN.search(text, begin, end):
                        continue
                    before, total, clear, dotted = None, 0, False, False
                    for raw in _TOKEN.findall(text, begin, end):
                        word, says = told.get(raw) or tell(raw)
                        if not says:
                            continue
                        # what the mark behind the word before it says is counted once it is known not to be the last
                        if clear:
                            seen["e", before, ""] += 1
                            seen["x", "", ""] += 1
                            before = None
                        elif dotted and total:
                            seen["m", before, ""] += 1
                            before = ""
                        total += 1
                        if word:
                            seen["c", word, ""] += 1
                            if before:
                                seen["b", before, word] += 1
                        if before is None:
                            seen["s", "", word] += 1
                        before, clear, dotted = word, says == 3, says == 2
                    if total:
                        seen["z", before, ""] += 1
                        seen["y", "", ""] += clear
                    seen["t", "", ""] += total
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    rows = documents.where(F.length("text") > 0).select("text").mapInArrow(count, "kind string, w string, n string, times long")
    return rows.groupBy("kind", "w", "n").agg(F.sum("times").alias("times"))


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS


def word_odds(gaps_: DataFrame, documents: DataFrame) -> DataFrame:
    """Figures of the events after words: (key, p, p_start, odds), from what marked text of the same corpus says.

    gaps_: (key, w, n), distinct. p is the chance of a boundary after the word
    (how often it ends sentences among all times it occurs), p_start that right
    after another boundary; odds are the chance of the next word at a start
    against that after this word within a sentence, each interpolated with how
    frequent the word is. Without marked text only the average length counts.
    """
    cut = gaps_.select("key", F.expr("substring(w, 2)").alias("w"), "n")
    both = cut.select(F.col("w").alias("x")).union(cut.select("n"))
    # a word's slot is that of its hash: at most SLOTS numbers come to the driver
    slots = both.select(F.pmod(F.crc32(F.encode("x", "UTF-8")), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    counts = durable(_word_counts(documents, slots))
    of = lambda kind, *keys: counts.where(F.col("kind") == kind).select(*keys, F.col("times").cast("double").alias(kind))
    sums = {r["kind"]: float(r["n"]) for r in counts.where("kind in ('s', 't', 'x', 'y', 'm')").groupBy("kind").agg(F.sum("times").alias("n")).collect()}
    within = (sums.get("x", 0.0) + 1) / (sums.get("y", 0.0) + 1)  # ends within stretches for each at the end of one
    starts, total = sums.get("s", 0.0) + 1, sums.get("t", 0.0) + 15
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    about = (
        cut.join(of("c", "w"), "w", "left").join(of("e", "w"), "w", "left").join(of("z", "w"), "w", "left").join(of("m", "w"), "w", "left").join(of("b", "w", "n"), ["w", "n"], "left")
        .join(of("s", "n").where("n <> ''"), "n", "left").join(of("c", F.col("w").alias("n")).withColumnRenamed("c", "cn"), "n", "left")
    )
    common = (zero("c") + 0.5) / (total + 1)
    common_n = (zero("cn") + 0.5) / (total + 1)
    rate = starts / total
    # of the full stops that may abbreviate as many are ends as the ends of stretches with the word let expect
    ends = zero("e") + zero("z") + F.least(zero("m"), zero("z") * within)
    p = (ends + 10 * rate) / (zero("c") + 10)
    start = (zero("s") + 10 * common_n) / (starts + 10)
    inside = (zero("b") + 5 * common_n) / (F.greatest(zero("c") - ends, F.lit(0.0)) + 5)
    p = F.greatest(F.lit(1e-4), F.least(F.lit(0.97), p))
    return about.select("key", p.alias("p"), (p * 0.05).alias("p_start"), (start / inside).alias("odds"))


# --- the same model over a whole corpus, as tables --------------------------------------

_PIECES = "row long, doc_id long, seq int, head string, key string, linked boolean, char_start int, char_end int, filled boolean"


def _pieces(documents: DataFrame) -> DataFrame:
    """Every text cut at all its gaps: one row a piece, with the context (a, w, n, shape) of the gap at its end as one string.

    ``head`` is filled where a stretch begins; the key of its last piece is
    that of a certain end. ``linked``: one word lies between the gap and the
    one before it. char_start and char_end leave out white space.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["row", "doc_id", "seq", "head", "key", "linked", "char_start", "char_end", "filled"]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seq, text = 0, text.replace("\0", "\1")  # it separates the parts of a key
                for begin, end in blocks(text):
                    found = gaps(text, begin, end) or word_gaps(text, begin, end)
                    tail, first = _ends(text, begin, end)
                    head, s, link = "\0".join(first), begin, False
                    for e, key in (*found, (end, tail)):
                        if s > begin and key is not tail:
                            link = key[3] == "u" or _linked(text, s, e)
                        piece = text[s:e].rstrip()
                        bare = piece.lstrip()
                        filled = bool(bare) and (bare[0].isalnum() or any(map(str.isalnum, bare)))
                        out.append((row, doc, seq, head, "\0".join(key), link and key is not tail, s + len(piece) - len(bare), s + len(piece) if bare else -1, filled))
                        head, s, seq = None, e, seq + 1
                if len(out) > 50_000:
                    yield flush()
        yield flush()

    texts = documents.where(F.length("text") > 0).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(cut, _PIECES)


def _counts(pieces: DataFrame) -> DataFrame:
    """Counts of what stands around possible and certain sentence ends, over all pieces: (key, a, w, n, shape, times)."""
    each = pieces.groupBy("key").agg(F.count("*").alias("times")).unionByName(
        pieces.where("head is not null").groupBy(F.col("head").alias("key")).agg(F.count("*").alias("times"))
    )
    part = F.split("key", "\0")
    return each.groupBy("key").agg(F.sum("times").alias("times")).select("key", *[part[i].alias(c) for i, c in enumerate(("a", "w", "n", "shape"))], "times")


def boundary_counts(documents: DataFrame) -> DataFrame:
    """Counts of what stands around possible and certain sentence ends, over all documents: (a, w, n, shape, times)."""
    return _counts(_pieces(documents)).drop("key")


def train(documents: DataFrame) -> Model:
    """The hidden-event model of a corpus whose contexts fit the driver: all of them are collected. sentences() needs no such model."""
    rows = boundary_counts(documents).toArrow()
    columns = [rows.column(c).to_pylist() for c in ("a", "w", "n", "shape")]
    return Model(dict(zip(zip(*columns, strict=True), rows.column("times").to_pylist(), strict=True)))


def context_odds(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """What Model says of every distinct context, computed in tables: (key, p, p_start, odds).

    counts: (key, a, w, n, shape, times). p is the boundary's prior after the
    history, p_start that after a boundary, odds those of the word that
    follows. Every context counts, however rare and however many there are;
    nothing but sums by shape (seven) and over all passes through the driver.
    """
    bound = FREQUENT * (counts.agg(F.sum("times")).first()[0] or 0)
    words = counts.groupBy("shape", "n").agg((F.sum("times") >= bound).alias("frequent"))
    told = counts.join(words, ["shape", "n"]).withColumn("n", F.when(F.col("frequent") | (F.col("n") == "$"), F.col("n")).otherwise("")).drop("frequent")
    inner = told.where("w <> '^'")
    count, ended = F.sum("times"), F.sum(F.when(F.col("n") == "$", F.col("times")).otherwise(0))
    spaced = F.col("w").startswith("ไ") & ~F.col("w").endswith(".")
    sums = {r["spaced"]: r for r in inner.where(spaced | F.expr("w like '~%' and shape <> 'l'")).groupBy(spaced.alias("spaced")).agg(count.alias("all"), ended.alias("end")).collect()}
    clear, thai = ((sums[k]["end"], sums[k]["all"]) if k in sums else (0, 0) for k in (False, True))
    at_end = (1.0 + clear[0]) / (1.0 + clear[1])
    rate = min(1.0, (thai[0] / at_end + 20 * 0.97) / (thai[1] + 20))

    by_both = inner.groupBy("a", "w").agg(count.alias("total"), ended.alias("ended"))
    by_word = by_both.groupBy("w").agg(
        F.sum("total").alias("total_w"),
        F.sum("ended").alias("ended_w"),
        F.sum(F.when(F.col("a") == "^", F.col("total")).otherwise(0)).alias("total_s"),
        F.sum(F.when(F.col("a") == "^", F.col("ended")).otherwise(0)).alias("ended_s"),
    )
    size = F.when(F.col("w").startswith("~"), 9).otherwise(F.length("w") - 1)
    base = F.when(size > 4, 0.97).when(size == 4, 0.85).when(F.col("w") == "A.", 0.3).otherwise(0.75)
    weight = F.when(size > 4, 20).when(size == 4, 6).otherwise(3)
    one = F.least(F.lit(1.0), (F.col("ended_w") / at_end + weight * base) / (F.col("total_w") + weight))

    def boundary(total: str, ended: str) -> Column:
        plain = F.col("w").endswith(".") & (F.col("w") != "...")
        both = F.least(F.lit(0.995), (F.col(ended) / at_end + 6 * one) / (F.col(total) + 6))
        gap = F.least(F.lit(0.995), (F.col("ended_w") / at_end + 6 * rate) / (F.col("total_w") + 6))
        return F.when(spaced, gap).when(plain, both).otherwise(0.97)

    priors = by_both.join(by_word, "w").select(
        "a", "w", boundary("total", "ended").alias("p"), boundary("total_s", "ended_s").alias("p_start")
    )
    sure = (F.col("shape") != "l") & ~spaced & (F.col("w").startswith("~") | (F.col("w") == "...") | ~F.col("w").endswith("."))
    contexts = durable(
        told.where("w <> '^' and n <> '$'").join(priors, ["a", "w"]).select("key", "w", "n", "shape", "p", "p_start", sure.alias("sure"), "times")
    )
    heads = durable(told.where("w = '^'").groupBy("shape", "n").agg(F.sum("times").cast("double").alias("x")))
    # a posterior depends on the history by its prior alone: one row a (w, shape, n), with how often each prior occurs
    clipped = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("p")))
    first = F.when(F.col("shape") == "l", 0.01).otherwise(F.col("p"))
    table = durable(
        contexts.groupBy("w", "shape", "n", "sure", (clipped / (1 - clipped)).alias("prior"), first.alias("first"))
        .agg(F.sum("times").cast("double").alias("times"))
        .groupBy("w", "shape", "n", "sure")
        .agg(F.collect_list(F.struct("prior", "first", "times")).alias("parts"), F.sum("times").alias("c"))
    )

    def odds(x: float, y: float, word: str, kind: str, own: str, of: str) -> Column:
        """One of the two likelihoods of Model.odds; x and y are sums by shape and over all."""
        whole = (x + 0.5) / (y + 4)
        follows = (F.col(word) + 0.5) / (x + 20)
        share = F.when(F.col("shape") == "t", 1.0).otherwise((F.col(kind) + 3 * whole) / (F.col(of) + 3))
        return share * (F.col(own) + 3 * follows) / (F.col(kind) + 3)

    if table.isEmpty():
        return contexts.select("key", "p", "p_start", F.lit(1.0).alias("odds"))
    for step in range(rounds):
        if step == 0:
            post = lambda s: s["first"]
        else:
            post = lambda s: F.when(F.col("sure"), s["first"]).otherwise(s["prior"] * F.col("odds") / (1 + s["prior"] * F.col("odds")))
        start = F.aggregate("parts", F.lit(0.0), lambda acc, s: acc + s["times"] * post(s))  # noqa: B023
        own = table.withColumn("x3", start).withColumn("i3", F.col("c") - F.col("x3"))
        kinds = own.groupBy("w", "shape").agg(F.sum("x3").alias("x2"), F.sum("i3").alias("i2"))
        histories = kinds.groupBy("w").agg(F.sum("x2").alias("x1"), F.sum("i2").alias("i1"))
        nexts = (
            own.select("shape", "n", F.col("x3").alias("x"), F.col("i3").alias("i"))
            .unionByName(heads.withColumn("i", F.lit(0.0)))
            .groupBy("shape", "n").agg(F.sum("x").alias("xn"), F.sum("i").alias("in"))
        )
        shapes = {r["shape"]: (r["x"], r["i"]) for r in nexts.groupBy("shape").agg(F.sum("xn").alias("x"), F.sum("in").alias("i")).collect()}
        all_x, all_i = (sum(v[at] for v in shapes.values()) for at in (0, 1))
        sums = F.create_map(*[c for k, v in shapes.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
        x, i = sums[F.col("shape")][0], sums[F.col("shape")][1]
        ratio = odds(x, F.lit(all_x), "xn", "x2", "x3", "x1") / F.greatest(odds(i, F.lit(all_i), "in", "i2", "i3", "i1"), F.lit(1e-12))
        table = durable(
            own.join(kinds, ["w", "shape"]).join(histories, "w").join(nexts, ["shape", "n"]).select("w", "shape", "n", "sure", "parts", "c", ratio.alias("odds"))
        )
    return contexts.join(table.select("w", "shape", "n", "odds"), ["w", "shape", "n"]).select("key", "p", "p_start", "odds")


def _decide(threshold: float = 0.5):
    """Pieces with their gaps' figures, sorted by (row, seq), as the units they form."""

    def close(t: pa.Table) -> pa.RecordBatch:
        get = lambda c: t.column(c).to_numpy()
        last, linked = get("last").astype(bool), get("linked").astype(bool)
        # the gap that ends a stretch has no figures
        p, p_start = np.clip(get("p"), 1e-4, 1 - 1e-4), np.clip(get("p_start"), 1e-4, 1 - 1e-4)
        odds = get("odds")
        with np.errstate(invalid="ignore"):
            whole = p / (1 - p) * odds
            cut = last | (whole / (1 + whole) >= threshold)
        ends = np.flatnonzero(linked & ~np.r_[linked[1:], False])
        begins = np.flatnonzero(~linked & np.r_[linked[1:], False])
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            trans = [[(1 - x, x * o) for x in (float(p[k]), float(p_start[k]))] for k in range(b, e + 1) for o in (float(odds[k]),)]
            cut[b : e + 1] = np.array(_posteriors(trans)) >= threshold
        at = np.flatnonzero(np.r_[True, cut[:-1]]) if len(cut) else np.empty(0, int)
        s, e = get("char_start").astype(np.int64), get("char_end").astype(np.int64)
        s = np.where(e < 0, 2**31 - 1, s)
        if len(at):
            s, e, filled = np.minimum.reduceat(s, at), np.maximum.reduceat(e, at), np.logical_or.reduceat(get("filled").astype(bool), at)
            keep = np.flatnonzero(filled)
            s, e, ids = s[keep], e[keep], t.column("doc_id").take(pa.array(at[keep])).combine_chunks()
        else:
            ids = pa.array([], pa.int64())
        return pa.record_batch([ids, pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "char_start", "char_end"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            ended = np.flatnonzero(batch.column(batch.schema.get_field_index("last")).to_numpy(zero_copy_only=False))
            if not len(ended):
                rest.append(batch)
                continue
            upto = int(ended[-1]) + 1
            yield close(pa.Table.from_batches([*rest, batch.slice(0, upto)]))
            rest = [batch.slice(upto)] if upto < batch.num_rows else []

    return decide


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per sentence unit of every document: (doc_id, char_start, char_end), offsets in code points.

    documents: (doc_id, text); further columns are ignored. Null and empty
    texts give no rows; a repeated row gives its units again. Front matter,
    fenced code, rules and table lines give no units; headings, list items and
    quotes start one after their marker.

    Where sentences end is decided by a hidden-event n-gram model: candidates
    are sentence-final marks with what closes after them, and spaces in scripts
    that have no such marks; a boundary event is scored against none given the
    words before and after, with forward and backward sums over candidates that
    are one word apart. The model is trained on the same corpus without labels,
    from the ends and beginnings of paragraphs, headings and list items. It
    stays in tables: texts are read once and cut at every candidate, counted
    contexts of any number are judged by context_odds and joined to the
    candidates. A stretch without any mark has an event after every word
    (character, where words aren't spaced) once it is longer than LEAST_WORDS;
    these are judged by word_odds, with forward and backward sums over the
    whole stretch; only if there are such stretches are the texts read again.
    A model that is given instead travels as a broadcast and judges marks only.
    """
    if model is None:
        pieces = durable(_pieces(documents))
        counts = durable(_counts(pieces))
        figures = context_odds(counts.where("shape <> 'u'"))
        unmarked = counts.where("shape = 'u'").select("key", "w", "n")
        if not unmarked.isEmpty():
            figures = figures.unionByName(word_odds(unmarked, documents))
        judged = pieces.join(figures, "key", "left").select(
            "row", "seq", "doc_id", F.col("key").endswith("\0$\0$").alias("last"), "linked", "char_start", "char_end", "filled", "p", "p_start", "odds"
        )
        ordered = judged.repartition("row").sortWithinPartitions("row", "seq")
        return ordered.mapInArrow(_decide(), "doc_id long, char_start int, char_end int")

    shared = documents.sparkSession.sparkContext.broadcast(model.__dict__)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        own = Model.__new__(Model)
        own.__dict__.update(shared.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = units(text, own, memo)
                ids += [doc] * len(found)
                starts += [s for s, _ in found]
                ends += [e for _, e in found]
            if len(memo) > 500_000:
                memo.clear()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "char_start", "char_end"])

    texts = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(split, "doc_id long, char_start int, char_end int")
