"""Text extraction from binary files, by extension, inside the executors.

``register`` adds extractors; each takes bytes and gives (text, needs_ocr). Errors become a message in the row.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.paths import IMAGES, extension_of
from foliant.session import ship

SLIDES, SHEETS, PAGES, CHARS = 200, 100, 200, 1_000_000
SCHEMA = "path string, extracted_text string, text_source string, needs_ocr boolean, error string"


def rtf_plain(x: Column) -> Column:
    """RTF without its control words and braces; paragraphs become line ends."""
    out = F.replace(x, F.lit(r"\par"), F.lit("\n"))
    for pattern in (r"\\[a-zA-Z]+-?\d+ ?", r"\\[a-zA-Z]+ ?", "[{}]"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def _rtf(data: bytes) -> str:
    text = data.decode("utf-8", "replace").replace(r"\par", "\n")
    for pattern in (r"\\[a-zA-Z]+-?\d+ ?", r"\\[a-zA-Z]+ ?", "[{}]"):
        text = re.sub(pattern, "", text)
    return text.strip(" ")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _docx(data: bytes) -> str:
    out: list[str] = []

    def walk(e) -> None:
        name = _local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br"):
            out.append("\t" if name == "tab" else "\n")
        for child in e:
            walk(child)
        if name == "p":
            out.append("\n")

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        walk(ElementTree.fromstring(z.read("word/document.xml")))
    return "".join(out)


def _pptx(data: bytes) -> str:
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        for k in range(1, SLIDES + 1):
            if (name := f"ppt/slides/slide{k}.xml") not in names:
                break
            for e in ElementTree.fromstring(z.read(name)).iter():
                if _local(e.tag) == "p":
                    out.append("\n")
                elif _local(e.tag) == "t":
                    out.append((e.text or "") + " ")
            out.append("\n")
    return "".join(out)


def _xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in read("xl/sharedStrings.xml") if _local(si.tag) == "si"]
        sheets: list[tuple[str, str]] = []
        if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
            target = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")}
            for s in read("xl/workbook.xml").iter():
                if _local(s.tag) == "sheet":
                    rid = next((v for k, v in s.attrib.items() if _local(k) == "id" and k != "id"), None)
                    if rid in target:
                        sheets.append((s.get("name", ""), "xl/" + target[rid]))
        sheets = sheets or [(f"Sheet{k}", f"xl/worksheets/sheet{k}.xml") for k in range(1, SHEETS + 1)]
        out: list[str] = []
        for title, part in sheets:
            if part not in names:
                continue
            out.append(f"--- {title} ---\n")
            row_no = None
            for c in read(part).iter():
                if _local(c.tag) != "c":
                    continue
                no = re.sub(r"\D", "", c.get("r", ""))
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)] if int(value) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                if not value:
                    continue
                if row_no is not None and no != row_no:
                    out.append("\n")
                row_no = no
                out.append(value + "\t")
            out.append("\n")
    return "".join(out)


def docx_paragraphs(data: bytes) -> str:
    """The non-blank paragraphs of a document, with a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("no word/document.xml")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for p in root.iter() if _local(p.tag) == "p")
    return "\n\n".join(x for x in lines if x)


def pptx_slides(data: bytes) -> str:
    """Slides with text, each under its number; they are numbered in the order of their names as text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml"))
        if not names:
            raise ValueError("no slides")
        for k, name in enumerate(names, 1):
            root = ElementTree.fromstring(z.read(name))
            lines = [x for p in root.iter() if _local(p.tag) == "p" if (x := "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip())]
            if lines:
                out.append(f"[Slide {k}]\n" + "\n".join(lines))
    return "\n\n".join(out)


#: Another rule for the same formats, for ``extract(found, known=PARAGRAPHS)``.
PARAGRAPHS: dict[str, Callable[[bytes], str | tuple[str, bool]]] = {"docx": docx_paragraphs, "pptx": pptx_slides}


def page_records(pages: list[str | None]) -> list[tuple[int, int, str]]:
    """(page, characters, text) of a document's pages, counted from 1."""
    return [(k, len(p or ""), p or "") for k, p in enumerate(pages, 1)]


def table_records(pages: list[list[list[list[str | None]]]]) -> list[tuple[int, int, int, int, list[list[str]]]]:
    """(page, table, rows, columns, cells) of the tables on each page; empty tables are left out, cells are trimmed."""
    out = []
    for page, tables in enumerate(pages, 1):
        for k, rows in enumerate(tables):
            if rows:
                cells = [[(c or "").strip() for c in r] for r in rows]
                out.append((page, k, len(cells), len(cells[0]), cells))
    return out


def pages_text(pages: list[str]) -> tuple[str, bool]:
    """Text of a document's pages, up to PAGES pages and about CHARS characters, and whether most pages are blank."""
    out, size, blank, seen = [], 0, 0, 0
    for p in pages[:PAGES]:
        seen += 1
        blank += not p.strip()
        out.append(p)
        size += len(p)
        if size > CHARS:
            break
    return "\n".join(out), bool(seen) and blank * 2 > seen


def _pdf(data: bytes) -> tuple[str, bool]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF parser is installed") from e
    return pages_text([p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages[:PAGES]])


EXTRACTORS: dict[str, Callable[[bytes], str | tuple[str, bool]]] = {"rtf": _rtf, "docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "xlsm": _xlsx, "pdf": _pdf}
EXTRACTORS |= {e: lambda data: data.decode("utf-8", "replace") for e in ("txt", "csv", "md", "log")}


def register(extensions: list[str], extractor: Callable[[bytes], str | tuple[str, bool]]) -> None:
    for e in extensions:
        EXTRACTORS[e.lower()] = extractor


def extract_one(extension: str, data: bytes, known: dict | None = None) -> tuple[str, str, bool, str]:
    """(text, source, needs OCR, error) of one file."""
    extension, known = extension.lower(), EXTRACTORS if known is None else known
    if extension in IMAGES:
        return "", "ocr", True, ""
    if extension not in known:
        return "", "native", False, f"No extractor for {extension}"
    try:
        got = known[extension](data)
    except Exception as e:
        return "", "native", extension == "pdf", str(e)
    text, ocr = got if isinstance(got, tuple) else (got, False)
    return text, "native", ocr, ""


def records(found: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows (path and ``schema``) that ``parse`` gives for each binary file (path, content), such as a PDF's pages or tables."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]]
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, c in zip(b["path"], b["content"]) for r in parse(bytes(c))], columns=names)

    return found.select("path", "content").mapInPandas(run, f"path string, {schema}")


def extract(found: DataFrame, known: dict[str, Callable[[bytes], str | tuple[str, bool]]] | None = None) -> DataFrame:
    """Texts of binary files (path, content); extractors registered on the driver go along, ``known`` ones come first."""
    ship(found.sparkSession)
    known = {**EXTRACTORS, **(known or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *extract_one(e, bytes(c), known)) for p, e, c in zip(b["path"], b["extension"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "extracted_text", "text_source", "needs_ocr", "error"])

    return found.select("path", extension_of(F.col("path")).alias("extension"), "content").mapInPandas(run, SCHEMA)


def _walk(spark: SparkSession, roots: list[str], excludes: list[str], follow: bool) -> list[str]:
    """Folders below roots that are neither hidden nor excluded, each once; links to folders are followed or left."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out, todo, seen = [], [normal(r) for r in roots], set()
    skip = [normal(e).lower().rstrip("/") + "/" for e in excludes]
    while todo:
        folder = todo.pop()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        own = normal(path.toString())
        local = os.path.realpath(own) if own.startswith("/") and fs.getScheme() == "file" else own
        if local in seen or any((own.lower() + "/").startswith(s) for s in skip) or not fs.exists(path):
            continue
        seen.add(local)
        out.append(own)
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            link = own.startswith("/") and os.path.islink(os.path.join(own, name))
            if s.isDirectory() and not name.startswith(".") and (follow or not link):
                todo.append(s.getPath().toString())
    return out


def normal(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub("^file:/*", "/", path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def listing(spark: SparkSession, roots: list[str], excludes: list[str] = (), follow_links: bool = True) -> DataFrame:
    """(path, size, modified_date, error) of the files below roots, whatever their names but for hidden ones.

    The driver walks the folders; files of local or mounted folders are listed by tasks, those of other file systems by
    the driver through Hadoop. A folder that can't be listed and a file that can't be read give a row with an error.
    """
    ship(spark)
    folders = _walk(spark, list(roots), list(excludes), follow_links)
    schema = "path string, size long, modified_date long, error string"
    remote = [f for f in folders if not f.startswith("/")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for folder in b["folder"]:
                try:
                    entries = list(os.scandir(folder))
                except OSError as e:
                    rows.append((folder, None, None, str(e)))
                    continue
                for e in entries:
                    if e.name.startswith(".") or not e.is_file(follow_symlinks=follow_links):
                        continue
                    try:
                        st = e.stat()
                        error = "" if os.access(e.path, os.R_OK) else "not readable"
                        rows.append((e.path, st.st_size, int(st.st_mtime), error))
                    except OSError as x:
                        rows.append((e.path, None, None, str(x)))
            yield pd.DataFrame(rows, columns=["path", "size", "modified_date", "error"])

    local = [(f,) for f in folders if f.startswith("/")]
    out = spark.createDataFrame(local, "folder string").repartition(max(1, min(len(local), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, schema)
    if remote:
        jvm, conf, rows = spark._jvm, spark._jsc.hadoopConfiguration(), []
        for folder in remote:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            rows += [(s.getPath().toString(), s.getLen(), s.getModificationTime() // 1000, "") for s in path.getFileSystem(conf).listStatus(path) if s.isFile() and not s.getPath().getName().startswith(".")]
        out = out.unionByName(spark.createDataFrame(rows, schema))
    return out


def scan(spark: SparkSession, roots: list[str], excludes: list[str] = (), follow_links: bool = True, limit: int | None = None) -> DataFrame:
    """Files below roots, not hidden and not below an excluded folder, with their metadata; contents aren't read.

    ``limit`` stops after so many files. Unreadable files are left out; ``scan_counts`` counts them.
    """
    from foliant.functions.paths import initial_ocr_status, is_under_any

    found = listing(spark, roots, excludes, follow_links).where("error = ''")
    name = F.element_at(F.split("path", "/"), -1)
    kept = found.where(~F.startswith(name, F.lit(".")) & ~is_under_any(F.col("path"), list(excludes)))
    rows = kept.select("path", name.alias("filename"), extension_of(F.col("path")).alias("extension"), "size", "modified_date")
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumns({"indexing_status": F.lit("metadata_only"), "ocr_status": initial_ocr_status(F.col("extension"))})


def scan_counts(spark: SparkSession, roots: list[str], excludes: list[str] = ()) -> DataFrame:
    """One row: files scanned and errors."""
    return listing(spark, roots, excludes).agg(F.count_if(F.col("error") == "").alias("scanned"), F.count_if(F.col("error") != "").alias("errors"))


def contents(spark: SparkSession, roots: list[str], excludes: list[str] = ()) -> DataFrame:
    """(path, content) of the files that ``scan`` finds; on other than local or mounted file systems without those whose
    names begin with an underscore, which Spark's reader leaves out."""
    near = [r for r in roots if normal(r).startswith("/")]
    far = [r for r in roots if not normal(r).startswith("/")]
    out = read(scan(spark, near, excludes).select("path"))
    return out.unionByName(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(far).select("path", "content")) if far else out


def read(found: DataFrame) -> DataFrame:
    """(path, content) of local files (path), read where the task runs; a file that is gone by then is left out."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:  # one file at a time
                try:
                    with open(p, "rb") as f:
                        yield pd.DataFrame({"path": [p], "content": [f.read()]})
                except OSError:
                    continue

    return found.select("path").mapInPandas(run, "path string, content binary")


def hashed(spark: SparkSession, found: DataFrame, cap: int | None = None) -> DataFrame:
    """(path, hash): SHA-256 of files, or of their first ``cap`` bytes rounded up to 64 KiB, read piece by piece."""
    import hashlib

    most = None if cap is None else -(-cap // 65536) * 65536

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                h, left = hashlib.sha256(), most
                try:
                    with open(p, "rb") as f:
                        while data := f.read(1 << 20 if left is None else min(1 << 20, left)):
                            h.update(data)
                            left = None if left is None else left - len(data)
                except OSError:
                    rows.append((p, ""))
                    continue
                rows.append((p, h.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "hash"])

    return found.select("path").mapInPandas(run, "path string, hash string")


def head(found: DataFrame, n: int) -> DataFrame:
    return found.select("path", F.substring("content", 1, n).alias("head"))


def content_hash(found: DataFrame, cap: int | None = None) -> DataFrame:
    """SHA-256 of contents, or of their first ``cap`` bytes rounded up to 64 KiB."""
    data = F.col("content") if cap is None else F.substring("content", 1, -(-cap // 65536) * 65536)
    return found.select("path", F.sha2(data, 256).alias("hash"))
