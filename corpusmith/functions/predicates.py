"""Predicates on paths, ids and pages, as column expressions; none is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmith.functions import language as L
from corpusmith.functions import text as T

# Extensions that can be ingested, folders an import leaves out, and data files that may hold settings.
INGESTABLE = [
    "md", "mdx", "txt", "pdf", "doc", "docx", "pptx", "xlsx", "odt", "odp", "ods", "xls", "csv", "json", "html", "htm", "rtf", "xml", "yaml", "yml",
]
SKIPPED_FOLDERS = ["wiki", "cache", ".cache", ".git", "node_modules", ".obsidian"]
STRUCTURAL_FILES = ["index.md", "log.md", "overview.md"]
SETTINGS = ["json", "yaml", "yml", "xml"]


def _parts(path: Column) -> Column:
    return F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")


def ingestable(path: Column) -> Column:
    """Whether a source can be ingested: a known extension, no dotfile, not in a cache folder."""
    parts = _parts(path)
    return T.extension(F.coalesce(path, F.lit(""))).isin(INGESTABLE) & ~F.array_contains(parts, ".cache") & ~T.file_name(F.coalesce(path, F.lit(""))).startswith(".")


def importable(path: Column) -> Column:
    """Whether a scheduled import takes a file: outside internal folders, visible, and no settings file."""
    parts = F.transform(_parts(path), lambda p: F.lower(p))
    hidden = F.exists(parts, lambda p: p.isin(SKIPPED_FOLDERS) | (p.startswith(".") & ~p.isin(".", "..")))
    return ~hidden & ~T.extension(F.coalesce(path, F.lit(""))).isin(SETTINGS) & (F.element_at(parts, -1) != "")


def safe_page_path(path: Column) -> Column:
    """Whether a generated page may be written: relative, under ``wiki/``, no ``..``, nothing a file system refuses."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    bad = lambda p: p.isin("", ".", "..") | p.rlike(r'[<>:"|?*\x00-\x1f]|[. ]$|(?i)^(?:con|prn|aux|nul|com\d|lpt\d)(?:\.|$)')
    return plain.startswith("wiki/") & ~F.exists(F.split(plain, "/"), bad)


def valid_page_id(value: Column) -> Column:
    """1 to 256 bytes of letters, digits and ``-_.``"""
    value = F.coalesce(value, F.lit(""))
    return value.rlike(r"^[\p{L}\p{N}_.-]+$") & (F.octet_length(value) <= 256)


def source_matches(stored: Column, identity: Column) -> Column:
    """Whether a stored source name means this source: the same identity, or the same file name if the stored one has no folder."""
    a, b = F.lower(T.source_identity(stored)), F.lower(T.source_identity(identity))
    return F.coalesce((a == b) | (~F.contains(a, F.lit("/")) & (a == T.file_name(b))), F.lit(False))


def in_language(text: Column, language: Column, most: int = 1500) -> Column:
    """Whether a page's prose is in the language wanted, judged on its first characters without front matter, code and formulas; short prose passes."""
    prose = F.regexp_replace(F.regexp_replace(T.body_of(F.coalesce(text, F.lit(""))), r"(?s)```.*?(?:```|$)|`[^`\n]*`", " "), r"(?s)\$\$.*?\$\$|\$[^$\n]+\$", " ")
    sample = F.substring(F.trim(prose), 1, most)
    return (F.length(sample) < 20) | (L.language_of(sample) == F.coalesce(language, F.lit("")))


def change_route(path: Column, kind: Column) -> Column:
    """Where a change of a file goes: ``ingest`` (a source came or changed), ``source_deleted``, ``page_deleted`` or ``none``."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    source = plain.startswith("raw/sources/") & ingestable(plain)
    gone = F.coalesce(kind, F.lit("")) == "deleted"
    page = plain.startswith("wiki/") & plain.endswith(".md") & ~T.file_name(plain).isin(STRUCTURAL_FILES)
    came = F.coalesce(kind, F.lit("")).isin("created", "modified")
    return F.when(gone & source, "source_deleted").when(gone & page, "page_deleted").when(came & source, "ingest").otherwise("none")


def page_route(path: Column, fits: Column) -> Column:
    """How a generated page is written: ``append`` (log), ``overwrite`` (listings), ``merge``, or ``drop`` if its path isn't safe or its language doesn't fit.

    fits says whether the language is the wanted one; logs, entities and
    sources may hold any.
    """
    name = T.file_name(F.coalesce(path, F.lit("")))
    free = path.startswith("wiki/entities/") | path.startswith("wiki/sources/") | F.contains(path, F.lit("/entities/")) | F.contains(path, F.lit("/sources/"))
    refused = ~safe_page_path(path) | ~((name == "log.md") | F.coalesce(free, F.lit(False)) | F.coalesce(fits, F.lit(True)))
    return F.when(refused, "drop").when(name == "log.md", "append").when(name.isin("index.md", "overview.md"), "overwrite").otherwise("merge")
