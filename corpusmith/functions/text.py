"""String functions of the knowledge base as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the query tokenizer besides white space and ASCII punctuation.
CJK_MARKS = "，。！？、；：“”‘’（）·～…"
# Words a query doesn't search for.
STOP_WORDS = [
    "的", "是", "了", "什么", "在", "有", "和", "与", "对", "从",
    "the", "is", "a", "an", "what", "how", "are", "was", "were", "do", "does", "did", "be", "been", "being",
    "have", "has", "had", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "this", "that", "these", "those",
]
_ASCII = r"!-/:-@\[-`{-~"
SEPARATORS = rf"[\s{_ASCII}{CJK_MARKS}]+"
IDEOGRAPH = r"[㐀-鿿]"


def query_tokens(query: str) -> list[str]:
    """Tokens of one query: separated, stop words dropped, long ideographic runs as bigrams, characters and themselves."""
    out: set[str] = set()
    for token in re.split(SEPARATORS, query.lower()):
        if len(token) < 2 or token in STOP_WORDS:
            continue
        if re.search(IDEOGRAPH, token) and len(token) > 2:
            out.update(token[i : i + 2] for i in range(len(token) - 1))
            out.update(c for c in token if c not in STOP_WORDS)
        out.add(token)
    return sorted(out)


def query_phrase(query: str) -> str:
    """The query as one phrase: lower case, separators at either end dropped."""
    return re.sub(rf"^{SEPARATORS}|{SEPARATORS}$", "", query.lower())


def tokens_of(text: Column) -> Column:
    """query_tokens for a column of queries: sorted and distinct."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))

    def expand(word: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(word))
        pairs = F.transform(F.slice(at, 1, F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
        singles = F.filter(F.transform(at, lambda i: F.substring(word, i, F.lit(1))), lambda c: ~c.isin(STOP_WORDS))
        return F.when(word.rlike(IDEOGRAPH) & (F.length(word) > 2), F.concat(pairs, singles, F.array(word))).otherwise(F.array(word))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, expand))))


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    gone = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(gone / F.length(needle))).otherwise(0).cast("int")


def tokens_contained(text: Column, tokens: Sequence[str]) -> Column:
    """How many tokens the text contains as substrings, whatever their case."""
    return sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in tokens), F.lit(0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot isn't one."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def folder_context(path: Column) -> Column:
    """Folders below ``raw/sources`` as a trail."""
    inner = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?i)^.*?raw/sources/", ""), "/")
    return F.array_join(F.slice(inner, F.lit(1), F.size(inner) - 1), " > ")


def source_identity(path: Column) -> Column:
    """A source reference without everything through ``raw/sources/``, ``/`` for ``\\``."""
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?i)^.*?raw/sources/", "")


# The folders that tell a page's type, in the order they are tried.
PAGE_FOLDERS = {
    "entities": "entity", "concepts": "concept", "sources": "source", "queries": "query", "comparisons": "comparison",
    "synthesis": "synthesis", "findings": "finding", "thesis": "thesis", "methodology": "methodology",
}


def page_type(path: Column) -> Column:
    """Type of a wiki page by its folder, else ``other``."""
    out = None
    for folder, kind in PAGE_FOLDERS.items():
        hit = F.contains(path, F.lit(f"/{folder}/"))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(file_name(path) == "overview.md", "overview").otherwise("other")


def link_key(target: Column) -> Column:
    """Key under which a link target is compared: leaf, no ``.md``, lower case, no spaces, hyphens or underscores."""
    leaf = F.element_at(F.split(target, "/"), -1)
    return F.regexp_replace(F.lower(F.regexp_replace(leaf, r"(?i)\.md$", "")), r"[\s_-]+", "")


def slug_of(text: Column, most: int = 50) -> Column:
    """Lower-case slug of letters, digits and single hyphens."""
    hyphens = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(hyphens, "^-+|-+$", ""), 1, most), "-+$", "")


def source_slug(identity: Column, most: int = 120) -> Column:
    """Name of the summary page of a source, of at most ``most`` characters.

    A source without folders has its stem, null or an empty one ``source``. Of a path each part is
    percent-encoded and stands after its length; a hash of the whole identity
    (32-bit FNV-1a over UTF-16 units, in base 36) keeps shortened names apart.
    """
    steps = F.transform(F.split(F.regexp_replace(identity, r"\.[^/.]+$", ""), "/"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    steps = F.filter(steps, lambda s: s != "")

    def sized(step: Column) -> Column:
        # a form encodes spaces as + and leaves * alone
        safe = F.replace(F.replace(F.replace(F.url_encode(step), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.concat_ws("-", F.length(safe).cast("string"), safe)

    units = F.transform(F.regexp_extract_all(F.hex(F.encode(identity, "UTF-16BE")), F.lit("(.{4})"), 1), lambda u: F.conv(u, 16, 10).cast("long"))
    code = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: h.bitwiseXOR(u) * 16777619 % 4294967296)  # fixed values of the hash
    tail = F.concat(F.lit("--"), F.lower(F.conv(code.cast("string"), 10, 36)))
    whole = F.array_join(F.transform(steps, sized), "--")
    short = F.regexp_replace(F.regexp_replace(F.substring(whole, F.lit(1), F.lit(most) - F.length(tail)), "%[0-9A-F]?$", ""), "-+$", "")
    path = F.when(F.length(whole) + F.length(tail) <= most, whole).otherwise(F.coalesce(F.nullif(short, F.lit("")), F.lit("source")))
    return F.when(F.size(steps) > 1, F.concat(path, tail)).otherwise(F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit("source")))


def host_of(url: Column) -> Column:
    """Host of a URL without ``www.``; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), F.lit(""))


FRONT = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"


def front_matter(text: Column) -> Column:
    """The lines between the fences at the very start of a text, else empty."""
    return F.regexp_extract(text, FRONT, 1)


def body_of(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def scalar_field(front: Column, name: str) -> Column:
    """A scalar of the front matter without its quotes; empty if absent."""
    raw = F.trim(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.regexp_replace(raw, r"""^["'](.*)["']$""", "$1")


def with_scalar(text: Column, name: str, value: Column) -> Column:
    """A page with a scalar of its front matter set: its line replaced, or one added at the end. Without front matter the text stays."""
    front = front_matter(text)
    line = F.concat(F.lit(f"{name}: "), value)
    lines = F.split(front, "\n")
    has = F.exists(lines, lambda row: row.startswith(f"{name}:"))
    new = F.when(has, F.transform(lines, lambda row: F.when(row.startswith(f"{name}:"), line).otherwise(row))).otherwise(F.concat(lines, F.array(line)))
    return F.when(front != "", F.concat(F.lit("---\n"), F.array_join(new, "\n"), F.lit("\n---\n"), body_of(text))).otherwise(text)


def with_list(text: Column, name: str, values: Column) -> Column:
    """A page with a list of its front matter set on one line, where it stood before (inline or as a block), else at the end. Without front matter the text stays."""
    line = F.concat(F.lit(f"{name}: ["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    front = front_matter(text)
    parts = F.split(F.concat(front, F.lit("\n")), rf"(?m)^{name}:.*\n(?:[ \t]*-[ \t].*\n)*", 2)
    new = F.when(F.size(parts) > 1, F.concat(parts[0], line, F.lit("\n"), F.try_element_at(parts, F.lit(2)))).otherwise(F.concat(parts[0], line, F.lit("\n")))
    return F.when(front != "", F.concat(F.lit("---\n"), new, F.lit("---\n"), body_of(text))).otherwise(text)


def list_field(front: Column, name: str) -> Column:
    """A list of the front matter, inline or as a block; empty if absent."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t].*(?:\n|$))+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]+", ""), "\n"))
    clean = F.transform(items, lambda v: F.regexp_replace(F.trim(v), r"""^["'](.*)["']$""", "$1"))
    return F.filter(clean, lambda v: v != "")


def title_of(text: Column, path: Column) -> Column:
    """Title in the front matter, else the first heading, else the file name with spaces for hyphens."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))
    named = scalar_field(front_matter(text), "title")
    return F.when(named != "", named).when(heading != "", heading).otherwise(F.replace(file_stem(path), F.lit("-"), F.lit(" ")))


def snippet(text: Column, phrase: str, around: int = 80, tokens: Sequence[str] = ()) -> Column:
    """The stretch around the first match, dots where it is cut, on one line.

    Matched is the phrase, else the first of the tokens that occurs; without
    any match it is the beginning of the text.
    """
    low = F.lower(text)
    places = [(F.instr(low, t.lower()), len(t)) for t in [phrase, *tokens] if t]
    at, size = F.lit(1), F.lit(0)
    for place, length in reversed(places):
        at, size = F.when(place > 0, place).otherwise(at), F.when(place > 0, length).otherwise(size)
    start = F.greatest(at - around, F.lit(1))
    end = at + size + around
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    return F.replace(cut, F.lit("\n"), F.lit(" "))


def vector_snippet(text: Column, heading: Column, around: int = 80) -> Column:
    """The beginning of a chunk on one line after its heading path; empty for an empty chunk. Null counts as empty."""
    line = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(line) > 2 * around, F.concat(F.substring(line, 1, 2 * around), F.lit("..."))).otherwise(line)
    bare = F.trim(F.coalesce(heading, F.lit("")))
    return F.when((line == "") | (bare == ""), short).otherwise(F.concat(bare, F.lit(": "), short))


LINK = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"


def wiki_links(text: Column) -> Column:
    """Links ``[[target]]`` and ``[[target|label]]`` in order, as structs of trimmed target and label."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(LINK), 0),
        lambda m: F.struct(F.trim(F.regexp_extract(m, LINK, 1)).alias("target"), F.trim(F.regexp_extract(m, LINK, 2)).alias("label")),
    )


def image_refs(text: Column) -> Column:
    """Distinct addresses of embedded images, first seen first, without white space."""
    marks = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)
    embeds = F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|]+)"), 1)
    return F.array_distinct(F.filter(F.concat(marks, embeds), lambda u: ~u.rlike(r"\s")))


def images_of(text: Column) -> Column:
    """Embedded images in order, as structs of address and caption, those with white space in the address left out."""
    marks = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)\s]+[^)]*\)"), 0)
    return F.transform(
        marks, lambda m: F.struct(F.regexp_extract(m, r"\]\(([^)\s]+)", 1).alias("address"), F.regexp_extract(m, r"^!\[([^\]]*)\]", 1).alias("caption"))
    )


def local_images(text: Column) -> Column:
    """image_refs without remote and data addresses."""
    return F.filter(image_refs(text), lambda u: ~u.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"))


def review_title(title: Column) -> Column:
    """Review title without its prefix, lower case, single spaces."""
    bare = F.regexp_replace(F.trim(title), r"(?i)^(?:missing page|missing-page|duplicate page|possible duplicate|contradiction|suggestion|confirm)\s*[:：-]\s*", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def glob_pattern(glob: str) -> str:
    """A file glob (``*``, ``?``) as an anchored, case-insensitive pattern."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def union_ignoring_case(old: Column, new: Column) -> Column:
    """Both lists in order, each value once whatever its case; the first casing wins."""
    both = F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), lambda v: F.trim(v) != "")
    keep = lambda seen, v: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen).otherwise(F.concat(seen, F.array(v)))
    return F.aggregate(both, F.array().cast("array<string>"), keep)


def safe_path(path: Column) -> Column:
    """A relative path fit for any file system; a segment that had to change carries a short hash of what it was."""

    def segment(s: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.trim(s), r'[<>:"|?*\x00-\x1f]+', "_"), r"[. ]+$", "")
        clean = F.when(clean.rlike(r"(?i)^(?:con|prn|aux|nul|com\d|lpt\d)(?:\..*)?$"), F.concat(F.lit("_"), clean)).otherwise(clean)
        return F.when(clean == s, s).otherwise(F.concat(F.when(clean == "", "_").otherwise(clean), F.lit("-"), F.substring(F.md5(s), 1, 6)))

    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.transform(parts, segment), "/")


def canonical_sources(sources: Column, own: Column) -> Column:
    """A page's source list as identities, with the source it was made from appended, each once."""
    known = F.transform(F.coalesce(sources, F.array().cast("array<string>")), source_identity)
    return union_ignoring_case(known, F.array(source_identity(own)))


def first_queries(queries: Column, most: int = 3) -> Column:
    """The first few queries, each once whatever its case."""
    return F.slice(union_ignoring_case(queries, F.array().cast("array<string>")), 1, most)


def trim_listing(text: Column, tokens: Column, budget: int) -> Column:
    """Headings and lines with any of the tokens, in order, as long as they fit; one that doesn't is left out and the next tried."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.startswith("#") | F.exists(tokens, lambda t: F.contains(F.lower(line), t)))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + 1
        return F.when(used <= budget, F.struct(used.alias("used"), F.concat(acc["kept"], F.array(line)).alias("kept"))).otherwise(acc)

    return F.array_join(F.aggregate(lines, start, take)["kept"], "\n")


def with_captions(text: Column, captions: Column) -> Column:
    """Embedded images with their alternative text replaced by a caption (map of address to caption), brackets and breaks removed from it."""
    pattern = r"!\[([^\]]*)\]\(([^)\s]+)([^)]*)\)"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}|(?:(?!!\[[^\]]*\]\().)+|!\["), 0)

    def shown(part: Column) -> Column:
        address = F.regexp_extract(part, pattern, 2)
        caption = F.trim(F.regexp_replace(F.try_element_at(captions, address), r"[\[\]\s]+", " "))
        return F.when(part.rlike(r"^!\[") & (F.coalesce(caption, F.lit("")) != ""), F.concat(F.lit("!["), caption, F.lit("]("), address, F.regexp_extract(part, pattern, 3), F.lit(")"))).otherwise(part)

    return F.array_join(F.transform(parts, shown), "")


def entity_summary(text: Column, path: Column, most: int = 200) -> Column:
    """What a page says of itself: a struct of slug, type, title, description and tags; null without front matter.

    A page without a type is ``unknown``, one without a title has its slug. The
    description is the first line of the body that is neither heading nor table
    if the front matter has none, null if there is none either; what is longer
    than ``most`` ends in an ellipsis.
    """
    front = front_matter(text)
    slug = F.regexp_replace(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1), r"\.md$", "")
    or_else = lambda name, other: F.coalesce(F.nullif(scalar_field(front, name), F.lit("")), other)
    lines = F.filter(F.transform(F.split(body_of(text), "\n"), lambda line: F.trim(line)), lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("|"))
    said = or_else("description", F.try_element_at(lines, F.lit(1)))
    short = F.when(F.length(said) > most, F.concat(F.substring(said, 1, most - 1), F.lit("…"))).otherwise(said)
    fields = {"slug": slug, "type": or_else("type", F.lit("unknown")), "title": or_else("title", slug), "description": short, "tags": list_field(front, "tags")}
    return F.when(front != "", F.struct(*[c.alias(n) for n, c in fields.items()]))
