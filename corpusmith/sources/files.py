"""Project files as DataFrames: listing, text extraction by type, and sinks that replace by key."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions import text as T

# The category of each extension.
CATEGORIES = {
    "markdown": ["md", "mdx"],
    "text": ["txt", "rtf", "log"],
    "code": [
        "js", "jsx", "ts", "tsx", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "sql", "r", "lua",
        "css", "scss", "less", "html", "htm", "xml", "svg", "vue", "svelte", "toml", "ini", "cfg", "conf", "dockerfile", "makefile",
    ],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "tiff", "tif", "avif", "heic", "heif"],
    "video": ["mp4", "webm", "mov", "avi", "mkv", "flv", "wmv", "m4v"],
    "audio": ["mp3", "wav", "ogg", "flac", "aac", "m4a", "wma"],
    "pdf": ["pdf"],
    "document": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "pages", "numbers", "key", "epub"],
    "data": ["json", "jsonl", "csv", "tsv", "yaml", "yml", "ndjson"],
}
_CATEGORY = {e: c for c, es in CATEGORIES.items() for e in es}


def category(path: Column) -> Column:
    """Category of a file by what follows its last dot (the whole path where there is none), ``unknown`` for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("unknown"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: (path, rel, name, size, modified); hidden files and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    out = files.select("path", rel.alias("rel"), T.file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(~F.exists(F.split("rel", "/"), lambda p: p.startswith(".")))


def file_tree(files: DataFrame, most_depth: int = 30) -> DataFrame:
    """Folders and files of a listing (rel), folders first: (path, is_dir, depth, files)."""
    parts = F.split("rel", "/")
    deep = files.where(F.size(parts) <= most_depth)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = deep.where(F.size(parts) > 1).select(F.explode(above).alias("path")).groupBy("path").agg(F.count("*").alias("files")).withColumn("is_dir", F.lit(True))
    leaves = deep.select(F.col("rel").alias("path"), F.lit(1).cast("long").alias("files"), F.lit(False).alias("is_dir"))
    return folders.unionByName(leaves).select("path", "is_dir", F.size(F.split("path", "/")).alias("depth"), "files").orderBy(F.desc("is_dir"), "path")


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def table_rows(rows: list[list[str]]) -> str:
    """Rows as a markdown table, the first one its head; pipes escaped, short rows filled."""
    rows = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def docx_text(data: bytes) -> str:
    """Headings, lists, emphasis and tables of a word-processor document as markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _xml(archive, "word/document.xml")

    def runs(node: ElementTree.Element) -> str:
        out = []
        for run in (n for n in node.iter() if _local(n.tag) == "r"):
            said = "".join(n.text or "" if _local(n.tag) == "t" else "\t" if _local(n.tag) == "tab" else "\n" if _local(n.tag) == "br" else "" for n in run)
            style = {_local(n.tag) for p in run if _local(p.tag) == "rPr" for n in p if _attr(n, "val") not in ("0", "false")}
            if said.strip():
                said = f"**{said}**" if "b" in style else said
                said = f"*{said}*" if "i" in style else said
            out.append(said)
        return "".join(out)

    lines = []
    for node in next(n for n in root.iter() if _local(n.tag) == "body"):
        if _local(node.tag) == "tbl":
            rows = [[" ".join(filter(None, (runs(p).strip() for p in cell.iter() if _local(p.tag) == "p"))) for cell in row if _local(cell.tag) == "tc"] for row in node if _local(row.tag) == "tr"]
            lines.append(table_rows(rows))
        elif _local(node.tag) == "p":
            said = runs(node).strip()
            props = [n for p in node if _local(p.tag) == "pPr" for n in p.iter()]
            style = next((_attr(n, "val") for n in props if _local(n.tag) == "pStyle"), "")
            level = re.match(r"(?i)heading\s*(\d)", style)
            if said and (level or style.lower() == "title"):
                said = "#" * min(6, int(level.group(1)) if level else 1) + " " + said.replace("**", "")
            elif said and any(_local(n.tag) == "numPr" for n in props):
                said = "- " + said
            lines.append(said)
    return "\n\n".join(filter(None, lines))


def pptx_text(data: bytes) -> str:
    """Slides in numerical order: a heading, the first paragraph bold, the others as bullets."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = sorted((int(m.group(1)), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides:
            root = _xml(archive, name)
            said = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for p in root.iter() if _local(p.tag) == "p"]
            said = [s for s in said if s]
            out.append("\n".join([f"## Slide {number}", "", *([f"**{said[0]}**"] if said else []), *[f"- {s}" for s in said[1:]]]).rstrip())
    return "\n\n".join(out)


def xlsx_text(data: bytes) -> str:
    """Every sheet as a markdown table; whole numbers without a point, others with two decimals; sheet names if there are several."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _xml(archive, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in shared] if shared is not None else []
        book = _xml(archive, "xl/workbook.xml")
        names = [_attr(n, "name") for n in book.iter() if _local(n.tag) == "sheet"] if book is not None else []
        sheets = sorted((int(m.group(1)), n) for n in archive.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        out = []
        for i, (_, name) in enumerate(sheets):
            rows = []
            for row in (n for n in _xml(archive, name).iter() if _local(n.tag) == "row"):
                cells: list[str] = []
                for cell in (c for c in row if _local(c.tag) == "c"):
                    ref = re.match(r"[A-Z]+", cell.get("r", ""))
                    column = 0
                    for letter in ref.group() if ref else "":
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells)) if ref else []
                    value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) in ("v", "t"))
                    kind = cell.get("t", "n")
                    if kind == "s" and value.isdigit():
                        value = strings[int(value)] if int(value) < len(strings) else ""
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    elif kind == "n" and value:
                        number = float(value)
                        value = str(int(number)) if number == int(number) else f"{number:.2f}"
                    cells.append(value)
                rows.append(cells)
            table = table_rows(rows)
            if table:
                out.append(f"## {names[i] if i < len(names) else f'Sheet {i + 1}'}\n\n{table}" if len(sheets) > 1 else table)
    return "\n\n".join(out)


def odf_text(data: bytes) -> str:
    """Text of an open document: its non-empty lines, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _xml(archive, "content.xml")
    lines = ["".join(p.itertext()).strip() for p in root.iter() if _local(p.tag) in ("p", "h")]
    return "\n\n".join(filter(None, lines))


# Entities decoded in this order, so that ``&amp;lt;`` becomes ``<``.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " ")]


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def extract_one(path: str, data: bytes) -> str:
    """Text of one file by its extension; a placeholder for what has none."""
    name = path.rpartition("/")[2]
    ext = name.rpartition(".")[2].lower()
    readers = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "odt": odf_text, "odp": odf_text, "ods": odf_text}
    if ext in readers:
        try:
            return readers[ext](data)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as problem:
            return f"[{name}: can't be read ({type(problem).__name__})]"
    if _CATEGORY.get(ext) in ("image", "video", "audio") or ext in ("pdf", "doc", "ppt", "xls"):
        return f"[{_CATEGORY[ext]}: {name}]"
    return data.decode("utf-8", "replace")


def read_texts(spark: SparkSession, root: str, largest: int = 32 * 2**20) -> DataFrame:
    """Text of every file below a folder: (path, category, sha256, text).

    Files over ``largest`` bytes have no hash, as change detection doesn't hash
    them, but their text. Hidden files are left out. A file that can't be
    parsed gives a placeholder that says so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    shown = files.where(~T.file_name(F.col("path")).startswith("."))
    hashed = F.when(F.col("length") <= largest, F.sha2("content", 256))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_one(p, d or b"") for p, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "sha256", "text"])

    read = shown.select("path", hashed.alias("sha256"), "content").mapInArrow(extract, "path string, sha256 string, text string")
    return read.select("path", category(F.col("path")).alias("category"), "sha256", "text")


def write_conversations(messages: DataFrame, folder: str, most: int = 100) -> None:
    """The last ``most`` messages of each conversation, one partition a conversation. messages: (conv_id, turn, role, text)."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("_k", last).where(F.col("_k") <= most).drop("_k")
    kept.write.mode("overwrite").partitionBy("conv_id").parquet(folder)


def numbered_names(files: DataFrame) -> DataFrame:
    """Free names for new files (name, ord): the first keeps its name, later ones get ``-2``, ``-3`` before the extension."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("ord"))
    stem, ext = T.file_stem(F.col("name")), F.regexp_extract("name", r".(\.[^.]*)$", 1)
    return files.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext))).drop("_n")
