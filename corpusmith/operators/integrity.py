"""What deletions, merges and reviews leave behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.functions import text as T


def delete_fate(lists: DataFrame, deleted: DataFrame) -> DataFrame:
    """What happens to pages when sources are deleted: (page_id, before, after, fate).

    lists: (page_id, source), one row an entry; deleted: (source). Sources
    compare in lower case. Pages none of whose sources are deleted don't come
    out; a page left without sources has fate ``delete``, the others ``keep``.
    """
    gone = deleted.select(F.lower("source").alias("_k")).distinct().withColumn("_gone", F.lit(1))
    rows = lists.where("source is not null").select("page_id", F.lower("source").alias("_k")).distinct().join(gone, "_k", "left")
    counted = rows.groupBy("page_id").agg(F.count("*").alias("before"), F.count_if(F.col("_gone").isNull()).alias("after"))
    return counted.where("before > after").withColumn("fate", F.when(F.col("after") == 0, "delete").otherwise("keep"))


def strip_links(text: Column, keys: Sequence[str]) -> Column:
    """A text with links to deleted pages replaced by what they display.

    keys are link keys (functions.text.link_key) of a few deleted pages; for
    many, join the exploded links instead.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(?:(?!\[\[).)+|\[\[[^\]]*\]\]|\[\["), 0)

    def shown(part: Column) -> Column:
        target, label = F.trim(F.regexp_extract(part, T.LINK, 1)), F.trim(F.regexp_extract(part, T.LINK, 2))
        dead = part.rlike(r"^\[\[") & (target != "") & T.link_key(target).isin(list(keys))
        return F.when(dead, F.when(label != "", label).otherwise(target)).otherwise(part)

    return F.array_join(F.transform(parts, shown), "")


def redirect_links(text: Column, redirects: dict[str, str]) -> Column:
    """A text with links to merged pages pointed at the page they merged into; labels stay."""
    for old, new in redirects.items():
        text = F.replace(F.replace(text, F.lit(f"[[{old}]]"), F.lit(f"[[{new}]]")), F.lit(f"[[{old}|"), F.lit(f"[[{new}|"))
    return text


def clean_listing(text: Column, keys: Column) -> Column:
    """An index page without the list lines whose first link is to a deleted page; keys: their link keys (array)."""
    dead = lambda line: line.rlike(r"^\s*[-*]\s") & F.coalesce(F.array_contains(keys, T.link_key(F.trim(F.regexp_extract(line, T.LINK, 1)))), F.lit(False))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~dead(line)), "\n")


def _reviews(items: DataFrame) -> DataFrame:
    return items.withColumn("key", T.review_title(F.coalesce("title", F.lit("")))).withColumn("type", F.coalesce("type", F.lit("confirm")))


def review_values(items: DataFrame) -> DataFrame:
    """Pages and queries of merged review items: (type, key, field, value, ord, pos), each value once, where it was seen first.

    items: as for merge_reviews. Rows instead of lists, as a title that very
    many items share (such as none at all) has no bound; ordered by ord and pos
    they are the united list.
    """
    rows = _reviews(items)
    each = [rows.select("type", "key", "ord", F.lit(c).alias("field"), F.posexplode(c).alias("pos", "value")) for c in ("pages", "queries")]
    once = each[0].unionByName(each[1]).where("value is not null").groupBy("type", "key", "field", "value").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return once.select("type", "key", "field", "value", "at.ord", "at.pos")


def merge_reviews(items: DataFrame) -> DataFrame:
    """Pending review items merged by type and normalized title: (type, key, items, description, source, pages, queries).

    items: (type, title, description, pages array, queries array, source, ord).
    Description and source are the latest that say anything, pages and queries
    the numbers of distinct ones; review_values has them one by one.
    """
    said = F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.struct("ord", "description"))
    merged = _reviews(items).groupBy("type", "key").agg(
        F.count("*").alias("items"), F.max(said)["description"].alias("description"),
        F.max(F.when(F.col("source").isNotNull(), F.struct("ord", "source")))["source"].alias("source"),
    )
    count = lambda field: F.count_if(F.col("field") == field).cast("int").alias(field)
    sizes = review_values(items).groupBy("type", "key").agg(count("pages"), count("queries"))
    known = merged.join(sizes, ["type", "key"], "left")
    return known.fillna(0, ["pages", "queries"])


def sweep_reviews(items: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Which pending reviews have been settled: (review_id, resolved).

    items: (review_id, type, title, pages array), page_ids: (id). A missing
    page is settled once a page has the name in the title, or any of the stems
    of the affected pages (so a review that lists the page it was found on is
    settled at once); a duplicate once one of its pages is gone. Others stay.
    """
    ids = page_ids.select(F.lower("id").alias("_k")).distinct()
    title = T.review_title(F.coalesce("title", F.lit("")))
    stems = F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.lower(T.file_stem(p)))
    names = F.array_distinct(F.concat(F.array(title, F.regexp_replace(title, r"\s+", "-")), stems))
    missing = items.where("type = 'missing-page'").select("review_id", F.explode(names).alias("_k")).join(ids, "_k", "left_semi").select("review_id").distinct()
    pages = items.where("type = 'duplicate'").select("review_id", F.explode(stems).alias("_k"))
    gone = pages.join(ids, "_k", "left_anti").select("review_id").distinct()
    settled = missing.unionByName(gone).distinct().withColumn("_r", F.lit(True))
    return items.select("review_id").join(settled, "review_id", "left").select("review_id", F.coalesce("_r", F.lit(False)).alias("resolved"))


def not_dismissed(groups: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Duplicate groups that weren't dismissed: (key, slugs) of those with two distinct slugs.

    groups: (slugs array), dismissed: (slugs array). Groups compare as sets of
    lower-cased slugs.
    """
    key = F.array_join(F.array_sort(F.array_distinct(F.transform("slugs", lambda s: F.lower(s)))), "|")
    seen = dismissed.select(key.alias("key")).distinct()
    size = F.size(F.array_distinct(F.transform("slugs", lambda s: F.lower(s))))
    return groups.withColumn("key", key).where(size >= 2).join(seen, "key", "left_anti").dropDuplicates(["key"]).select("key", "slugs")


def merge_pages(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Incoming pages merged with those on disk: (path, content, outcome).

    Both: (path, body, tags, sources). New paths are ``created``, equal pages
    ``same``; where only the lists differ they are united (``lists``); where
    the bodies differ the incoming body wins if it has at least 70 % of the
    longer one's length (``updated``), else it is kept as is with united lists
    and a backup is due (``rejected``).
    """
    o = old.select("path", *[F.col(c).alias(f"old_{c}") for c in ("body", "tags", "sources")])
    rows = new.join(o, "path", "left")
    united = {c: T.union_ignoring_case(F.col(f"old_{c}"), F.col(c)) for c in ("tags", "sources")}
    same_body = F.trim("body") == F.trim("old_body")
    same_lists = F.col("old_tags").eqNullSafe(united["tags"]) & F.col("old_sources").eqNullSafe(united["sources"])
    long_enough = F.length("body") >= 0.7 * F.greatest(F.length("body"), F.length("old_body"))
    outcome = (
        F.when(F.col("old_body").isNull(), "created").when(same_body & same_lists, "same").when(same_body, "lists").when(long_enough, "updated").otherwise("rejected")
    )
    return rows.select("path", "body", united["tags"].alias("tags"), united["sources"].alias("sources"), outcome.alias("outcome"), F.lit(today).alias("updated"))


def cache_hits(cache: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that needn't be ingested again: (source) with the same hash and every recorded output still there.

    cache: (source, hash, outputs array), sources: (source, hash), files: (path).
    """
    equal = sources.join(cache, ["source", "hash"])
    missing = equal.select("source", F.explode("outputs").alias("path")).join(files.select("path"), "path", "left_anti").select("source").distinct()
    return equal.join(missing, "source", "left_anti").select("source").distinct()


def deleted_keys(pages: DataFrame) -> DataFrame:
    """Link keys of deleted pages (slug, title): those of slugs and of titles, each once."""
    both = pages.select(F.explode(F.array("slug", "title")).alias("k")).where("k is not null")
    return both.select(T.link_key(F.col("k")).alias("key")).where("key <> ''").distinct()


def resolve_files(references: DataFrame, files: DataFrame, folders: Sequence[str] = ("", "wiki/sources/", "raw/sources/")) -> DataFrame:
    """References (reference) to files (path): the first of the folders in which the file exists; null path if none does.

    With and without ``.md``, whatever the case; among equals the smallest path.
    """
    tries = [F.concat(F.lit(f), F.col("reference"), F.lit(e)) for f in folders for e in ("", ".md")]
    wanted = references.select("reference").distinct().select("reference", F.posexplode(F.array(*tries)).alias("rank", "_p"))
    known = files.select("path", F.lower("path").alias("_k")).distinct()
    best = wanted.join(known, F.lower("_p") == F.col("_k")).groupBy("reference").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    return references.join(best, "reference", "left")


def pages_of_source(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages that a source has left traces in: (source, page_id, way), the first way that holds.

    pages: (page_id, path, text), sources: (source), a path or file name. Ways:
    ``listed`` in the front matter's sources, ``summary`` (a page in the folder
    ``sources`` whose stem begins with the source's stem), ``quoted`` (the file
    name in quotes anywhere). Names compare in lower case. Each way is an
    equi-join on what the pages hold: entries, beginnings of stems, quotations.
    """
    name = F.lower(T.file_name(F.col("source")))
    wanted = sources.where("source is not null").select("source", name.alias("name"), F.lower(T.file_stem(F.col("source"))).alias("stem")).distinct()
    text = F.coalesce("text", F.lit(""))
    low, path = F.lower(text), F.lower(F.coalesce("path", F.lit("")))
    listed = F.transform(T.list_field(T.front_matter(low), "sources"), T.file_name)
    stem = T.file_stem(path)
    begins = F.when(F.contains(path, F.lit("sources/")), F.transform(F.sequence(F.lit(1), F.length(stem)), lambda n: F.substring(stem, F.lit(1), n)))
    quoted = F.array_distinct(F.regexp_extract_all(low, F.lit(r'"([^"\n]+)"'), 1))

    def way(keys: Column, on: str, rank: int) -> DataFrame:
        keyed = pages.select("page_id", F.explode(F.array_distinct(keys)).alias(on)).where(F.col(on) != "")
        return keyed.join(wanted.select("source", on), on).select("source", "page_id", F.lit(rank).alias("r"))

    found = way(listed, "name", 1).unionByName(way(begins, "stem", 2)).unionByName(way(quoted, "name", 3))
    best = found.groupBy("source", "page_id").agg(F.min("r").alias("r"))
    return best.select("source", "page_id", F.element_at(F.array(F.lit("listed"), F.lit("summary"), F.lit("quoted")), F.col("r")).alias("way"))


def without_lines_of(text: Column, slugs: Column) -> Column:
    """An index page without the lines that name one of the slugs (array): as a link, with or without a label, or as a file."""

    def names(line: Column, slug: Column) -> Column:
        plain = F.concat(F.lit(r"\Q"), F.replace(slug, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        forms = [r"\[\[", plain, r"(?:\|[^\]]*)?\]\]|\((?:[^)]*/)?", plain, r"\.md\)|\b", plain, r"\.md\b"]
        return F.rlike(line, F.concat(*[f if isinstance(f, Column) else F.lit(f) for f in forms]))

    kept = F.filter(F.split(text, "\n"), lambda line: ~F.exists(slugs, lambda s: F.coalesce((s != "") & names(line, s), F.lit(False))))
    return F.array_join(kept, "\n")


def rewrite_links(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Pages with links to merged pages pointed at what they merged into: (path, text) of the pages that change.

    pages: (path, text), paths distinct; redirects: (old, new), one row an old
    slug. Labels stay. The front matter's ``related`` list is rewritten too and
    then holds each value once, whatever its case. Links are exploded and
    joined, so the plan doesn't grow with the redirects, and what is gathered
    are the links of one page. Null texts have no links.
    """
    parts = F.split(F.col("text"), r"\[\[")
    link = r"^([^\]|]+)(?:\|[^\]]+)?\]\]"
    related = T.list_field(T.front_matter(F.col("text")), "related")
    targets = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_extract(p, link, 1))
    named = pages.select("path", F.explode(F.array_distinct(F.concat(targets, related))).alias("old"))
    moved = named.join(redirects.where("old <> new"), "old").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_to"))

    def pointed(part: Column, i: Column) -> Column:
        target = F.regexp_extract(part, link, 1)
        new = F.try_element_at(F.col("_to"), target)
        return F.when((i > 0) & new.isNotNull(), F.concat(new, F.substring(part, F.length(target) + 1, F.length(part)))).otherwise(part)

    text = F.array_join(F.transform(parts, pointed), "[[")
    new = T.union_ignoring_case(F.transform(related, lambda r: F.coalesce(F.try_element_at(F.col("_to"), r), r)), F.array().cast("array<string>"))
    rows = pages.join(moved, "path").select("path", text.alias("text"), related.alias("_old"), new.alias("_new"))
    return rows.select("path", F.when(F.col("_old") != F.col("_new"), T.with_list(F.col("text"), "related", F.col("_new"))).otherwise(F.col("text")).alias("text"))


def merge_groups(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """What merging pages into others writes: (action, path, text).

    pages: (path, slug, text), redirects: (old, new). Pages of an old slug are
    to ``delete``, other pages that name one to ``write`` with their links
    pointed at the new one; of both, ``backup`` holds what they were.
    """
    gone = pages.join(redirects.where("old <> new").select(F.col("old").alias("slug")).distinct(), "slug", "left_semi")
    stay = pages.join(gone.select("path"), "path", "left_anti")
    write = rewrite_links(stay.select("path", "text"), redirects)
    before = gone.select("path", "text").unionByName(stay.join(write.select("path"), "path", "left_semi").select("path", "text"))
    say = lambda df, action: df.select(F.lit(action).alias("action"), "path", "text")
    return say(write, "write").unionByName(say(gone.withColumn("text", F.lit(None).cast("string")), "delete")).unionByName(say(before, "backup"))


def dismiss(dismissed: DataFrame, groups: DataFrame) -> DataFrame:
    """Dismissed groups with more added: (key, slugs), each set of lower-cased slugs once, those of fewer than two slugs left out."""
    lower = F.array_sort(F.array_distinct(F.transform("slugs", lambda s: F.lower(s))))
    rows = dismissed.select("slugs", F.lit(0).alias("o")).unionByName(groups.select("slugs", F.lit(1).alias("o")))
    keyed = rows.select(F.array_join(lower, "|").alias("key"), F.struct("o", F.array_sort("slugs").alias("slugs")).alias("s")).where(F.size(lower) >= 2)
    return keyed.groupBy("key").agg(F.min("s")["slugs"].alias("slugs"))


def image_sources(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images (address) with the file they were taken from; null path if none fits.

    files: (path). The folder below ``media`` is the slug of the source
    (functions.text.source_slug), or in old collections its stem; the slug goes
    first, then the smallest path.
    """
    folder = F.regexp_extract(F.replace("address", F.lit("\\"), F.lit("/")), r"(?:^|/)media/([^/]+)/", 1)
    wanted = images.select("address").distinct().select("address", folder.alias("_k")).where("_k <> ''")
    known = files.where("path is not null").select("path").distinct()
    keys = known.select("path", F.posexplode(F.array(T.source_slug(T.source_identity(F.col("path"))), T.file_stem(F.col("path")))).alias("rank", "_k"))
    best = wanted.join(keys, "_k").groupBy("address").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    return images.join(best, "address", "left")


def safe_renames(files: DataFrame) -> DataFrame:
    """Old summary pages that may be renamed: (path, old, new) of files in folders whose name no other file has.

    files: (path). Old summaries bear the stem, new ones source_slug. Names and
    paths compare in lower case; spellings of one path count once.
    """
    low = F.lower("path")
    rows = files.where("path is not null").groupBy(low.alias("_k")).agg(F.min("path").alias("path"))
    only = rows.groupBy(F.lower(T.file_name(F.col("path"))).alias("_n")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    identity = T.source_identity(F.col("path"))
    return only.where(F.contains(identity, F.lit("/"))).select("path", T.file_stem(F.col("path")).alias("old"), T.source_slug(identity).alias("new")).where("old <> new")


def first_registered(registries: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several registries (the same columns, key among them), of each key that of the first registry that has it; ties by the smallest row."""
    rows = [r.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_registry", F.lit(i)) for i, r in enumerate(registries)]
    rest = [c for c in registries[0].columns if c != key]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy(key).agg(F.min(F.struct("_registry", *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def folder_counts(files: DataFrame) -> DataFrame:
    """Visible files in and below each folder: (folder, files) for files (path); a path with a part that begins with a dot is hidden."""
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    rows = files.where("path is not null").select(F.array_join(parts, "/").alias("p"), parts.alias("parts")).distinct()
    shown = rows.where((F.size("parts") > 1) & ~F.exists("parts", lambda p: p.startswith(".")))
    depth = F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n")
    return shown.select("parts", depth).groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("folder")).agg(F.count("*").alias("files"))


def page_tree(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Pages by type in the order given, other types after it: (position, type, pages); index and log are no pages of the tree.

    pages: (path, type); a null type is ``other``. Types that aren't in the order share
    the last position.
    """
    kinds = F.coalesce("type", F.lit("other"))
    at = F.array_position(F.array(*[F.lit(o) for o in order]), kinds)
    rows = pages.where(~F.coalesce(T.file_name(F.col("path")), F.lit("")).isin("index.md", "log.md"))
    return rows.groupBy(F.when(at > 0, at).otherwise(len(order) + 1).cast("int").alias("position"), kinds.alias("type")).agg(F.count("*").alias("pages"))
