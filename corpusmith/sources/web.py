"""Web pages to articles in markdown, and results of different searches in one form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as T

# Elements without article text, elements that never close, and words in class or id that speak for or against a block.
_DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button", "template"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"comment|sidebar|\bad\b|advert|banner|promo|related|share|social|footer|menu|popup|widget|cookie", re.I)
_BLOCKS = {"p", "div", "section", "article", "main", "td", "pre", "blockquote", "li", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html", "tr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def nodes(self) -> Iterator[_Node]:
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.nodes()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("html", {}, None)
        self.title = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            if tag == "title":
                self.title = " ".join(node.text().split())
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _weight(node: _Node) -> int:
    names = node.attrs.get("class", "") + " " + node.attrs.get("id", "")
    return 25 * bool(_GOOD.search(names)) - 25 * bool(_BAD.search(names))


def _prune(node: _Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or (c.tag not in _DROPPED and c.tag != "head" and not (c.tag not in ("body", "article", "main") and _weight(c) < 0))]
    for c in node.children:
        if not isinstance(c, str):
            _prune(c)


def _links_share(node: _Node) -> float:
    """Share of the text that is in links; links within the page count little."""
    size = len(node.text().strip())
    return sum(len(a.text().strip()) * (0.3 if a.attrs.get("href", "").startswith("#") else 1.0) for a in node.nodes() if a.tag == "a") / size if size else 0.0


def main_block(root: _Node) -> _Node:
    """The element that holds the article: paragraphs speak for the elements around them by length and commas, links against."""
    scores: dict[int, float] = {}
    seen: dict[int, _Node] = {}
    for p in root.nodes():
        if p.tag not in ("p", "pre", "td", "blockquote", "section", "h2", "h3"):
            continue
        said = p.text().strip()
        if len(said) < 25:
            continue
        points = 1 + said.count(",") + said.count("，") + min(3, len(said) // 100)
        node, share = p.parent, 1.0
        for level in range(3):
            if node is None:
                break
            if id(node) not in scores:
                base = {"div": 5, "article": 10, "main": 10, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "form": -3}.get(node.tag, 0)
                scores[id(node)], seen[id(node)] = base + _weight(node), node
            scores[id(node)] += points * share
            node, share = node.parent, 1 / (2 * (level + 1))
    if not scores:
        return root
    return seen[max(scores, key=lambda k: scores[k] * (1 - _links_share(seen[k])))]


def _markdown(node: _Node, depth: int = 0) -> str:
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        tag = c.tag
        if tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n---\n\n")
        elif tag == "img":
            small = any(v.isdigit() and int(v) < 32 for v in (c.attrs.get("width", ""), c.attrs.get("height", "")))
            if c.attrs.get("src") and not small and not c.attrs["src"].startswith("data:"):
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        elif tag == "pre":
            out.append(f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n")
        elif tag == "table":
            rows = [[" ".join(cell.text().split()).replace("|", "\\|") for cell in row.children if not isinstance(cell, str) and cell.tag in ("td", "th")] for row in c.nodes() if row.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n\n" + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) + "\n\n")
        elif tag in ("ul", "ol"):
            items = [i for i in c.children if not isinstance(i, str) and i.tag == "li"]
            lines = ["  " * depth + (f"{n + 1}. " if tag == "ol" else "- ") + _markdown(i, depth + 1).strip() for n, i in enumerate(items)]
            out.append(("\n" if depth else "\n\n") + "\n".join(lines) + ("" if depth else "\n\n"))
        else:
            inner = _markdown(c, depth)
            said = inner.strip()
            if tag in ("strong", "b"):
                inner = f"**{said}**" if said else ""
            elif tag in ("em", "i"):
                inner = f"*{said}*" if said else ""
            elif tag == "code":
                inner = f"`{said}`" if said else ""
            elif tag == "a":
                href = c.attrs.get("href", "")
                inner = f"[{said}]({href})" if said and href and not href.startswith("javascript:") else inner
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                inner = f"\n\n{'#' * int(tag[1])} {said}\n\n" if said else ""
            elif tag == "blockquote":
                inner = "\n\n" + "\n".join("> " + line for line in said.split("\n")) + "\n\n"
            elif tag in _BLOCKS:
                inner = f"\n\n{said}\n\n" if said else ""
            out.append(inner)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*(?=\n|$)", "\n", "".join(out)))


def article(html: str) -> tuple[str, str]:
    """(title, markdown) of a page's main content, at most of the whole page if no block stands out."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _prune(builder.root)
    heading = next((" ".join(n.text().split()) for n in builder.root.nodes() if n.tag == "h1"), "")
    return builder.title or heading, _markdown(main_block(builder.root)).strip()


def extract_articles(pages: DataFrame) -> DataFrame:
    """Articles of web pages (page_id, url, html): (page_id, host, title, markdown). Null pages give empty articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article(h) if h else ("", "") for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], pa.string())], names=["page_id", "host", "title", "markdown"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", T.host_of(F.coalesce("url", F.lit(""))).alias("host"), "html")
    return rows.mapInArrow(run, f"page_id {kind}, host string, title string, markdown string")


def clip_names(clips: DataFrame) -> DataFrame:
    """File names of clips (title, day, ord): slug of at most 50 characters and the day, numbered where they collide."""
    base = F.concat_ws("-", T.slug_of(F.coalesce("title", F.lit("untitled"))), "day")
    n = F.row_number().over(Window.partitionBy("_base").orderBy("ord"))
    return clips.withColumn("_base", base).withColumn("name", F.concat("_base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md"))).drop("_base")


def merge_results(results: list[DataFrame], most: int | None = 20) -> DataFrame:
    """Results of several searches (title, url, snippet, source) as one list, the first of each address kept: (rank, ...)."""
    numbered = [r.select("title", "url", "snippet", "source", F.lit(i).alias("_list"), F.monotonically_increasing_id().alias("_ord")) for i, r in enumerate(results)]
    rows = reduce(DataFrame.unionByName, numbered)
    key = F.lower(F.when(F.coalesce(F.trim("url"), F.lit("")) != "", F.trim("url")).otherwise(F.concat_ws("|", "source", "title", "snippet")))
    best = rows.groupBy(key.alias("_key")).agg(F.min(F.struct("_list", "_ord", "title", "url", "snippet", "source")).alias("r"))
    out = best.select("r.*").orderBy("_list", "_ord")
    out = out.limit(most) if most else out
    rank = F.row_number().over(Window.orderBy("_list", "_ord"))  # at most a result list long
    return out.select(rank.alias("rank"), "title", "url", "snippet", "source")
