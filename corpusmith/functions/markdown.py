"""Table functions over markdown: one text in, several rows out.

Each is a small parser of one text, run in Arrow batches by the operators that
need it; nothing here knows about other rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_FRONT = re.compile(r"---[ \t]*\n(?:.*\n)*?---[ \t]*(?:\n|$)")
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*)")
_FENCE = re.compile(r"[ \t]*(```|~~~)")


@dataclass(frozen=True)
class Options:
    """Sizes in characters: what a chunk aims at, may have at most, is merged below, and repeats of the one before."""

    target: int = 1000
    most: int = 1500
    least: int = 200
    overlap: int = 200


def front_end(text: str) -> int:
    """Where the body begins."""
    found = _FRONT.match(text)
    return found.end() if found else 0


def _lines(text: str, begin: int):
    """(start, end, inside a fence) of each line; end is after the line break."""
    at, fence = begin, ""
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        mark = _FENCE.match(text, at, end)
        inside = bool(fence)
        if mark:
            if not fence:
                fence = mark.group(1)
            elif mark.group(1) == fence:
                fence = ""
        yield at, end, inside or bool(mark)
        at = end


def sections(text: str) -> list[tuple[str, int, int]]:
    """(heading path, start, end) of the stretches between headings; headings in fences don't count."""
    out: list[tuple[str, int, int]] = []
    path: list[str] = []
    shown, start = "", front_end(text)
    for at, end, fenced in _lines(text, start):
        found = None if fenced else _HEADING.match(text, at, end)
        if found:
            if text[start:at].strip():
                out.append((shown, start, at))
            level = len(found.group(1))
            path = [*path[: level - 1], *[""] * (level - 1 - len(path)), f"{found.group(1)} {found.group(2).strip()}"]
            shown, start = " > ".join(p for p in path if p), at
    if text[start:].strip():
        out.append((shown, start, len(text)))
    return out


def _atoms(text: str, begin: int, end: int) -> list[tuple[int, int, bool]]:
    """Fences, tables and paragraphs of a section as (start, end, may be cut); blank lines go to the atom before them."""
    out: list[tuple[int, int, bool]] = []
    kind, start = "", begin
    for at, stop, fenced in _lines(text[:end], begin):
        line = text[at:stop].strip()
        now = "fence" if fenced else "table" if line.startswith("|") else "text" if line else "blank"
        if now != kind and now != "blank" and at > start:
            out.append((start, at, kind == "text"))
            start = at
        elif kind == "blank" and at > start:
            out.append((start, at, True))
            start = at
        kind = kind if now == "blank" and kind in ("fence", "table") else now
    if start < end:
        out.append((start, end, kind in ("text", "blank")))
    return out


_CUTS = [re.compile(r"\n+"), re.compile(r"(?<=[.!?。！？])\s*"), re.compile(r"(?<=[,;，；、])\s*"), re.compile(r"\s+")]


def _cut(text: str, begin: int, end: int, target: int, level: int = 0) -> list[tuple[int, int]]:
    """A long paragraph in pieces of at most target characters, at the coarsest separator that serves; every character once."""
    if end - begin <= target:
        return [(begin, end)]
    if level == len(_CUTS):
        return [(i, min(i + target, end)) for i in range(begin, end, target)]
    marks = [m.end() for m in _CUTS[level].finditer(text, begin, end) if begin < m.end() < end]
    pieces = [p for s, e in zip([begin, *marks], [*marks, end], strict=True) for p in _cut(text, s, e, target, level + 1)]
    return pack(pieces, target)


def pack(pieces: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """Neighbouring pieces joined while they fit."""
    out: list[tuple[int, int]] = []
    for s, e in pieces:
        if out and e - out[-1][0] <= target:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def chunks(text: str, options: Options = Options()) -> list[dict]:
    """Chunks of a document for embedding.

    The body is cut at headings outside fences; a section of at most the target
    is one chunk, others are packed from paragraphs, fences and tables, of which
    only paragraphs are cut. Chunks under the least size join the one before if
    the two stay under the most. Each character of a section is in one chunk;
    each chunk but a section's first also repeats the end of the one before.
    """
    out: list[dict] = []
    for path, begin, end in sections(text):
        pieces = []
        for s, e, soft in _atoms(text, begin, end) if end - begin > options.target else [(begin, end, False)]:
            pieces += _cut(text, s, e, options.target) if soft else [(s, e)]
        packed = pack(pieces, options.target)
        joined: list[tuple[int, int]] = []
        for s, e in packed:
            small = e - s < options.least or (joined and joined[-1][1] - joined[-1][0] < options.least)
            if joined and small and e - joined[-1][0] <= options.most:
                joined[-1] = (joined[-1][0], e)
            else:
                joined.append((s, e))
        for i, (s, e) in enumerate(joined):
            lead = max(joined[i - 1][0], s - options.overlap) if i else s
            out.append({"chunk_index": len(out), "heading_path": path, "char_start": s, "char_end": e, "overlap_start": lead, "oversized": e - s > options.most})
    return out


def semantic_chunks(text: str, target: int = 4000, overlap: int = 400) -> list[dict]:
    """Blocks between headings and blank lines packed to a target, with the overlap kept apart: (chunk_index, char_start, char_end, overlap_start)."""
    blocks: list[tuple[int, int]] = []
    for _, begin, end in sections(text):
        for s, e, soft in _atoms(text, begin, end):
            blocks += _cut(text, s, e, target) if soft else [(s, e)]
    return [{"chunk_index": i, "char_start": s, "char_end": e, "overlap_start": max(0, s - overlap) if i else s} for i, (s, e) in enumerate(pack(blocks, target))]


_FILE = re.compile(r"---[ \t]*FILE:[ \t]*(.*?)[ \t]*---[ \t]*$")
_END = re.compile(r"---[ \t]*END FILE[ \t]*---[ \t]*$")


def file_blocks(text: str) -> list[dict]:
    """Files in a generated answer: (path, content, warning).

    A block runs from ``---FILE: path---`` to ``---END FILE---``; marks inside
    code fences are content. A block that isn't closed is kept with a warning,
    one without a path has only the warning.
    """
    out: list[dict] = []
    path: str | None = None
    body: list[str] = []
    for at, end, fenced in _lines(text, 0):
        line = text[at:end].rstrip("\n")
        opened = None if fenced else _FILE.match(line)
        closed = not fenced and _END.match(line)
        if path is not None and (opened or closed):
            out.append({"path": path or None, "content": "\n".join(body) if path else None, "warning": ("" if path else "no path") if closed else "not closed"})
            path, body = None, []
        if opened:
            path = opened.group(1)
        elif path is not None and not closed:
            body.append(line)
    if path is not None:
        out.append({"path": path or None, "content": "\n".join(body) if path else None, "warning": "not closed" if path else "no path"})
    return out


_REVIEW = re.compile(r"(?ms)^---[ \t]*REVIEW:[ \t]*([\w-]+)[ \t]*\|[ \t]*(.*?)[ \t]*---[ \t]*$(.*?)^---[ \t]*END REVIEW[ \t]*---[ \t]*$")
# The types of review items.
REVIEW_TYPES = ["contradiction", "duplicate", "missing-page", "suggestion", "confirm"]


def review_blocks(text: str) -> list[dict]:
    """Review items in a generated answer: (type, title, description, options, pages, queries); an unknown type is ``confirm``."""
    out = []
    for kind, title, body in _REVIEW.findall(text):
        fields = {"OPTIONS": ("|", []), "PAGES": (",", []), "SEARCH": ("|", [])}
        said = []
        for line in body.strip().split("\n"):
            name, colon, rest = line.partition(":")
            if colon and name.strip() in fields:
                mark, into = fields[name.strip()]
                into += [v.strip() for v in rest.split(mark) if v.strip()]
            else:
                said.append(line)
        kind = kind.lower()
        out.append(
            {
                "type": kind if kind in REVIEW_TYPES else "confirm", "title": title, "description": "\n".join(said).strip(),
                "options": fields["OPTIONS"][1], "pages": fields["PAGES"][1], "queries": fields["SEARCH"][1],
            }
        )
    return out


def first_json(text: str) -> str | None:
    """The first balanced JSON object of a text; braces in strings don't count. Null if there is none."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None
