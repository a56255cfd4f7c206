"""Word packages as tables: bytes of .docx files to paragraphs, tables and images, and such rows to bytes.

A package is a zip of XML parts. The body is read as a stream of elements, each let go once it is read, so a package needs
its bytes and its rows. What can't be read (no zip, no body, broken XML) is a row with an error and empty arrays. Paragraphs and
tables are those of the body; text of nested tables counts to the cell it lies in; images are inline ones anywhere.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.functions import text as t
from lectern.operators import audit
from lectern.sources.files import HELD, read_files, write_files
from lectern.sources.shared import folder

# Namespaces, parts and media types of the format.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
DC = "http://purl.org/dc/elements/1.1/"
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
BODY, STYLES, PROPERTIES = "word/document.xml", "word/styles.xml", "docProps/core.xml"
TYPES = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{BODY}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/{STYLES}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/{PROPERTIES}" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'
RELATIONS = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{BODY}"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="{PROPERTIES}"/></Relationships>'
#: Bytes of packages whose rows leave a task at once; rows take several times that.
READ = 1 << 20
#: Characters that XML 1.0 can't hold.
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")

PARTS = "lang string, title string, paras array<struct<style: string, text: string>>, tables array<struct<has_header: boolean, cells: array<array<string>>>>, alts array<string>, error string"


def _q(name: str, space: str = W) -> str:
    return f"{{{space}}}{name}"


def _xml(text: str | None) -> str:
    return escape(_ILLEGAL.sub("�", text or ""))


def pack(lang: str | None, title: str | None, paras, tables, alts) -> bytes:
    """paras: (style, text); tables: (has_header, rows of cells); alts: alternative texts of inline images."""
    run = lambda x: f'<w:r><w:t xml:space="preserve">{_xml(x)}</w:t></w:r>'
    styles = sorted({s for s, _ in paras} - {"Normal"})
    ids = {s: f"S{i}" for i, s in enumerate(styles)}
    body = [f'<w:p>{"" if s == "Normal" else f"<w:pPr><w:pStyle w:val={quoteattr(ids[s])}/></w:pPr>"}{run(x)}</w:p>' for s, x in paras]
    for header, rows in tables:
        lines = (f'<w:tr>{"<w:trPr><w:tblHeader/></w:trPr>" if header and not i else ""}{"".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row)}</w:tr>' for i, row in enumerate(rows))
        body.append(f"<w:tbl>{''.join(lines)}</w:tbl>")
    body += [f'<w:p><w:r><w:drawing><wp:inline><wp:docPr id="{i}" name="i{i}" descr={quoteattr(_ILLEGAL.sub(chr(0xFFFD), a or ""))}/></wp:inline></w:drawing></w:r></w:p>' for i, a in enumerate(alts, 1)]
    defined = ['<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>', *(f'<w:style w:type="paragraph" w:styleId="{ids[s]}"><w:name w:val={quoteattr(s.replace("Heading", "heading", 1) if re.fullmatch("Heading [1-9]", s) else s)}/></w:style>' for s in styles)]
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    parts = {
        "[Content_Types].xml": TYPES, "_rels/.rels": RELATIONS,
        BODY: f'{head}<w:document xmlns:w="{W}" xmlns:wp="{WP}"><w:body>{"".join(body)}</w:body></w:document>',
        STYLES: f'{head}<w:styles xmlns:w="{W}">{"".join(defined)}</w:styles>',
        PROPERTIES: f'{head}<cp:coreProperties xmlns:cp="{CORE}" xmlns:dc="{DC}"><dc:title>{_xml(title)}</dc:title><dc:language>{_xml(lang)}</dc:language></cp:coreProperties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _style_names(z: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and that of the default one; a built-in heading's name is in capitals."""
    names, default = {}, "Normal"
    if STYLES in z.namelist():
        with z.open(STYLES) as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag == _q("style"):
                    found = e.find(_q("name"))
                    name = e.get(_q("styleId"), "") if found is None else found.get(_q("val"), "")
                    name = name.capitalize() if re.fullmatch("heading [1-9]", name) else name
                    names[e.get(_q("styleId"), "")] = name
                    if e.get(_q("default")) == "1" and e.get(_q("type")) == "paragraph":
                        default = name
                    e.clear()
    return names, default


def unpack(content: bytes) -> dict:
    paras, tables, alts, about = [], [], [], {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, default = _style_names(z)
        if PROPERTIES in z.namelist():
            with z.open(PROPERTIES) as part:
                about = {e.tag: e.text for _, e in ElementTree.iterparse(part)}
        depth, at, texts, style = 0, [], [], None
        with z.open(BODY) as part:
            for event, e in ElementTree.iterparse(part, ("start", "end")):
                if event == "start":
                    if e.tag == _q("tbl"):
                        depth += 1
                        if depth == 1:
                            tables.append([False, []])
                    elif depth == 1 and e.tag == _q("tr"):
                        tables[-1][1].append([])
                    elif depth == 1 and e.tag == _q("tc"):
                        at = []
                    elif e.tag == _q("p"):
                        texts, style = [], default
                    continue
                if e.tag == _q("t"):
                    texts.append(e.text or "")
                elif e.tag in (_q("tab"), _q("br")) and depth + len(texts):
                    texts.append("\t" if e.tag == _q("tab") else "\n")
                elif e.tag == _q("pStyle"):
                    style = names.get(e.get(_q("val"), ""), default)
                elif e.tag == _q("tblHeader") and depth == 1:
                    tables[-1][0] = True
                elif e.tag == _q("inline", WP):
                    found = e.find(_q("docPr", WP))
                    alts.append("" if found is None else found.get("descr", ""))
                elif e.tag == _q("p") and depth:
                    at.append("".join(texts))
                elif e.tag == _q("p"):
                    if texts or e.find(f".//{_q('drawing')}") is None:
                        paras.append((style, "".join(texts)))
                elif e.tag == _q("tc") and depth == 1:
                    tables[-1][1][-1].append("\n".join(at))
                elif e.tag == _q("tbl"):
                    depth -= 1
                if e.tag in (_q("p"), _q("tc"), _q("tr"), _q("tbl")) and not (e.tag == _q("p") and depth):
                    e.clear()
    return {"lang": about.get(_q("language", DC)), "title": about.get(_q("title", DC)), "paras": paras, "tables": tables, "alts": alts, "error": None}


def packages(parts: DataFrame) -> DataFrame:
    """doc_id, lang, title, paras, tables (has_header, cells), alts -> doc_id, content. What leaves a task at once is about HELD
    bytes, or one package."""
    kind = parts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, size = 0, [], 0
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("lang", "title", "paras", "tables", "alts")}
                held.append(pack(r["lang"], r["title"], [(p["style"], p["text"]) for p in r["paras"] or []], [(x["has_header"], x["cells"]) for x in r["tables"] or []], r["alts"] or []))
                size += len(held[-1])
                if size > HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(held)), pa.array(held, pa.binary())], names=["doc_id", "content"])
                    begin, held, size = i + 1, [], 0

    return parts.select("doc_id", "lang", "title", "paras", "tables", "alts").mapInArrow(run, f"doc_id {kind.simpleString()}, content binary")


def read_packages(files: DataFrame) -> DataFrame:
    """name, content -> name, lang, title, paras, tables, alts, error; a row for each file, whatever it holds. Rows leave once
    their files' bytes are over READ, so a task holds what a few packages unfold to."""
    schema = to_arrow_schema(StructType.fromDDL(f"name string, {PARTS}"))

    def row(name: str, content: bytes | None) -> dict:
        try:
            x = unpack(content or b"")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zipfile.zlib.error, NotImplementedError) as e:
            x = {"lang": None, "title": None, "paras": [], "tables": [], "alts": [], "error": type(e).__name__}
        return {"name": name, **x, "paras": [{"style": a, "text": b} for a, b in x["paras"]], "tables": [{"has_header": a, "cells": b} for a, b in x["tables"]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                held.append(row(batch.column("name")[i].as_py(), content))
                size += len(content or b"")
                if size > READ or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0

    return files.select("name", "content").mapInArrow(run, f"name string, {PARTS}")


# ---- queries: documents of the audit as packages, written and read back ----


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their texts, what is read back from their packages, with doc_id)."""
    docs, lineitem, pages = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "lineitem", "pages"))
    parts = audit.document_parts(docs, lineitem, pages)
    tables = F.transform("tables", lambda x: F.struct(x["has_header"].alias("has_header"), F.array(F.array(x["cell"])).alias("cells")))
    made = packages(parts.select("doc_id", "lang", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "paras", tables.alias("tables"), "alts"))
    at = folder(spark, "packages")
    write_files(made.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), "content"), at)
    found = read_packages(read_files(spark, at))
    return docs.select("doc_id", "text"), found.withColumn("doc_id", F.regexp_extract("name", r"^(-?\d+)\.docx$", 1).cast("bigint"))


def package_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, i, style, text of the body paragraphs of all packages."""
    return _scan(spark, sf_dir)[1].select("doc_id", "title", F.posexplode("paras").alias("i", "p")).select("doc_id", "title", "i", "p.style", "p.text")


def package_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_images, n_without_alt, i, has_header, cell: tables of all packages, with counts of their images."""
    found = _scan(spark, sf_dir)[1]
    bare = F.size(F.filter("alts", lambda x: F.btrim(x, F.lit(t.SPACES)) == ""))
    rows = found.select("doc_id", F.size("alts").alias("n_images"), bare.alias("n_without_alt"), F.posexplode("tables").alias("i", "x"))
    return rows.select("doc_id", "n_images", "n_without_alt", "i", "x.has_header", F.array_join(F.flatten("x.cells"), " ").alias("cell"))


def package_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of packages as they are read from their bytes, against the documents' texts."""
    docs, found = _scan(spark, sf_dir)
    tables = F.transform("tables", lambda x: F.struct(x["has_header"].alias("has_header"), F.array_join(F.flatten(x["cells"]), " ").alias("cell")))
    read = found.select("doc_id", "lang", "paras", tables.alias("tables"), "alts")
    # the planner knows the size of the lists of names alone: without the hint it would send all packages to the driver
    return audit.report_of(read.hint("merge").join(docs.hint("merge"), "doc_id"))
