"""Front matter as records and repair of generated pages, one text at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINKS = re.compile(r"^([ \t]*[\w-]+:[ \t]*)((?:\[\[[^\]]*\]\][ \t]*,?[ \t]*)+)$", re.M)


def fenced(text: str) -> tuple[str, str] | None:
    """(front matter, body); the opening fence may stand within the first six lines. Null if there is none."""
    lines = text.split("\n")
    for i, line in enumerate(lines[:6]):
        if line.strip() == "---":
            for j in range(i + 1, len(lines)):
                if lines[j].strip() == "---":
                    return "\n".join(lines[i + 1 : j]), "\n".join(lines[j + 1 :])
            return None
    return None


def front_record(text: str) -> dict[str, list[str]] | None:
    """Front matter as lists of strings; nested values as JSON. Bare link lists are repaired once; null if it can't be read."""
    import yaml

    found = fenced(text)
    if not found:
        return None
    front = found[0]
    for attempt in (front, _LINKS.sub(lambda m: m.group(1) + "[" + ", ".join(f'"{x}"' for x in re.findall(r"\[\[[^\]]*\]\]", m.group(2))) + "]", front)):
        try:
            record = yaml.load(attempt, Loader=yaml.BaseLoader)
        except yaml.YAMLError:
            continue
        if isinstance(record, dict):
            say = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
            return {str(k): [say(x) for x in v] if isinstance(v, list) else [say(v)] for k, v in record.items()}
    return None


def sanitize(text: str) -> str:
    """A generated page without a code fence around it, with its front matter opened and without a stray key before it."""
    text = re.sub(r"^\s*```(?:markdown|md|yaml)?[ \t]*\n(.*)\n```\s*$", r"\1", text, flags=re.S)
    text = re.sub(r"^\s*frontmatter:[ \t]*\n(?=---)", "", text, flags=re.I)
    if not text.lstrip().startswith("---") and re.match(r"\s*(?:[\w-]+:.*\n)+---[ \t]*(?:\n|$)", text):
        text = "---\n" + text.lstrip()
    return _LINKS.sub(lambda m: m.group(1) + "[" + ", ".join(f'"{x}"' for x in re.findall(r"\[\[[^\]]*\]\]", m.group(2))) + "]", text)


def link_first_mentions(text: str, terms: list[tuple[str, str]]) -> str:
    """Link the first unlinked mention of each (term, target), once a target; front matter and existing links stay."""
    found = fenced(text)
    body = found[1] if found else text
    head = text[: len(text) - len(body)]
    done = {t for _, t in terms if f"[[{t}]]" in body or f"[[{t}|" in body}
    for term, target in terms:
        if target in done or not term:
            continue
        linked = [m.span() for m in re.finditer(r"\[\[.*?\]\]|\[[^\]]*\]\([^)]*\)|`[^`]*`", body)]
        at = body.find(term)
        while at >= 0 and any(s <= at < e for s, e in linked):
            at = body.find(term, at + 1)
        if at >= 0:
            link = f"[[{term}]]" if term == target else f"[[{target}|{term}]]"
            body = body[:at] + link + body[at + len(term) :]
            done.add(target)
    return head + body


def fnv64(text: str) -> str:
    """64-bit FNV-1a over UTF-16 units as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def parse_front_matter(documents: DataFrame) -> DataFrame:
    """(doc_id, fields map<string,array<string>>) of documents (doc_id, text); null fields where there is none or it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.list_(pa.string()))
        for batch in batches:
            found = [front_record(t) if t else None for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([list(f.items()) if f is not None else None for f in found], kind)], names=["doc_id", "fields"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fields map<string,array<string>>")
