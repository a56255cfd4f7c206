"""Tagged PDF files as tables: rows of pages, structure elements and outline entries to bytes, and bytes back to rows.

A document's text meets its page sizes in a join; its file is then made from that row alone: pages, elements and outline by the
rules of operators/elements.py and operators/structure.py, marks by sources/tagging.py, and `pack` numbers the objects and lays
them out. Tests hold these to the forms over tables. The scan reads the table of objects that a file's end names, and from it the document's facts, its
pages in order, and what the slots of each page's marks are. A file's bytes and one page are held at once. What can't be read
is a last row with an error, after the pages before it. Files whose objects lie in compressed streams are such rows: writers
of version 1.5 may make them.

Nulls: no title is an empty one, no language none; sizes default to a letter's. A document without pages has no file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from lectern.functions import scalars as s
from lectern.functions import text as t
from lectern.functions.scalars import decoded
from lectern.operators import elements, pages, structure
from lectern.sources import content, tagging
from lectern.sources.content import _CONSTANTS, _TOKENS, StreamError, literal
from lectern.sources.files import HELD, read_files, write_files
from lectern.sources.shared import folder

FACTS = "title string, lang string, marked boolean, n_pages int, n_elements int, n_outline int, outline_count int"
SCANNED = f"name string, page int, w double, h double, content binary, slots array<string>, {FACTS}, error string"
#: The metadata that says a file is accessible, and how its title is shown.
XMP = '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdfuaid="http://www.aiim.org/pdfua/ns/id/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">{}</rdf:li></rdf:Alt></dc:title><pdfuaid:part>1</pdfuaid:part></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
#: Pages that a document's numbers leave room for, in the SQL.
ROOM = 1024


def _string(x: str | None) -> bytes:
    return b"<FEFF" + (x or "").encode("utf-16-be", "replace").hex().encode() + b">"


def pack(title: str | None, lang: str | None, leaves: list, outline: list, count: int) -> bytes:
    """leaves: pages (w, h in points, content, marks: (mcid, tag) in order); outline: entries (ord, text, page, parent, prev,
    next, first, last: places of others by ord); count: the outline's count as its root has it."""
    objects: list[bytes] = []

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, head: bytes = b"") -> int:
        packed = zlib.compress(data)
        return put(b"<<%b /Filter /FlateDecode /Length %d>>\nstream\n%b\nendstream" % (head, len(packed), packed))

    root, tree, font = put(b""), put(b""), put(b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>")
    about = stream(XMP.format(escape(title or "")).encode("utf-8", "replace"))
    info = put(b"<</Title " + _string(title) + b">>")
    struct, document, parents, marks = put(b""), put(b""), put(b""), put(b"")
    kids, tags, slots = [], [], []
    for k, leaf in enumerate(leaves):
        body = stream(bytes(leaf["content"] or b""), b"/Kind /Page")
        page = put(b"<</Type /Page /Parent %d 0 R /MediaBox [0 0 %g %g] /Resources <</Font <</F1 %d 0 R>>>> /Contents %d 0 R /StructParents %d /Tabs /S>>" % (tree, leaf["w"], leaf["h"], font, body, k))
        own = {m["mcid"]: put(b"<</Type /StructElem /S /%b /P %d 0 R /Pg %d 0 R /K %d>>" % (m["tag"].encode(), document, page, m["mcid"])) for m in leaf["marks"]}
        slots.append(b"%d [%b]" % (k, b" ".join(b"%d 0 R" % own[i] if i in own else b"null" for i in range(max(own, default=-1) + 1))))
        kids.append(page)
        tags += own.values()
    refs = lambda xs: b" ".join(b"%d 0 R" % x for x in xs)
    entries = {e["ord"]: put(b"") for e in outline}
    for e in outline:
        links = b" ".join(b"/%b %d 0 R" % (name, entries[e[key]]) for name, key in ((b"Prev", "prev"), (b"Next", "next"), (b"First", "first"), (b"Last", "last")) if e[key] is not None)
        objects[entries[e["ord"]] - 1] = b"<</Title %b /Parent %d 0 R %b /Dest [%d 0 R /Fit]>>" % (_string(e["text"]), entries[e["parent"]] if e["parent"] is not None else marks, links, kids[e["page"] - 1])
    top = [entries[e["ord"]] for e in outline if e["parent"] is None]
    objects[marks - 1] = b"<</Type /Outlines" + (b" /First %d 0 R /Last %d 0 R /Count %d" % (top[0], top[-1], count) if top else b"") + b">>"
    objects[struct - 1] = b"<</Type /StructTreeRoot /K [%d 0 R] /ParentTree %d 0 R /ParentTreeNextKey %d>>" % (document, parents, len(leaves))
    objects[document - 1] = b"<</Type /StructElem /S /Document /P %d 0 R /K [%b]>>" % (struct, refs(tags))
    objects[parents - 1] = b"<</Nums [%b]>>" % b" ".join(slots)
    objects[tree - 1] = b"<</Type /Pages /Kids [%b] /Count %d>>" % (refs(kids), len(kids))
    language = b" /Lang " + _string(lang) if lang else b""
    objects[root - 1] = b"<</Type /Catalog /Pages %d 0 R /Metadata %d 0 R /MarkInfo <</Marked true>> /ViewerPreferences <</DisplayDocTitle true>> /StructTreeRoot %d 0 R /Outlines %d 0 R%b>>" % (tree, about, struct, marks, language)
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    out += b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<</Size %d /Root %d 0 R /Info %d 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, root, info, len(out))
    return bytes(out)


#: A token of a file's objects: those of streams, and references.
_TOKEN = re.compile(rb"(?P<ref>\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])[\x00\t\n\x0c\r ]*+|" + _TOKENS)
_HEAD = re.compile(rb"\s*\d+\s+\d+\s+obj")


class Ref(int):
    """An object's number."""


def value(data: bytes, at: int) -> tuple[object, int]:
    """The value that begins at a place, and where it ends. Names are texts with a slash, strings are bytes."""
    stack: list[list] = [[]]
    while True:
        if not (m := _TOKEN.match(data, at)):
            raise StreamError(f"no value at {at}")
        at, kind, token = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "ref":
            stack[-1].append(Ref(token))
        elif kind == "number":
            stack[-1].append(float(token) if b"." in token else int(token))
        elif kind == "name":
            stack[-1].append("/" + token.decode("latin-1"))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", token).decode()
            stack[-1].append(bytes.fromhex(digits + "0" * (len(digits) % 2)))
        elif kind == "text":
            found, at = literal(data, at)
            stack[-1].append(found)
        elif token in (b"[", b"<<"):
            stack.append([])
        elif kind == "mark":
            if len(stack) == 1:
                raise StreamError(f"no value at {at}")
            own = stack.pop()
            stack[-1].append(own if token == b"]" else dict(zip(own[::2], own[1::2], strict=False)))
        elif token in _CONSTANTS:
            stack[-1].append(_CONSTANTS[token][1])
        elif kind == "word":
            raise StreamError(f"no value at {at}")
        if len(stack) == 1 and stack[0]:
            return stack[0][0], at


class File:
    """Objects of a file, read as they are asked for. Of a changed file the newest table's entry of an object counts."""

    def __init__(self, data: bytes):
        self.data, self.at, self.trailer = data, {}, {}
        ends = re.findall(rb"startxref\s+(\d+)", data[-2048:])
        place, seen = int(ends[-1]) if ends else None, set()
        while place is not None and place not in seen:
            seen.add(place)
            place = self._table(place)
        if "/Root" not in self.trailer:
            raise StreamError("no table of objects")

    def _table(self, place: int) -> int | None:
        head = re.compile(rb"\s*xref\s+").match(self.data, place)
        if not head:
            raise StreamError("no table of objects")
        place = head.end()
        while part := re.compile(rb"(\d+) (\d+)\s+").match(self.data, place):
            first, n, place = int(part[1]), int(part[2]), part.end()
            for k in range(n):
                entry = self.data[place + 20 * k : place + 20 * k + 18]
                if entry[17:18] == b"n":
                    self.at.setdefault(first + k, int(entry[:10]))
            place += 20 * n
        if not (word := re.compile(rb"trailer\s*").match(self.data, place)):
            raise StreamError("no table of objects")
        found = value(self.data, word.end())[0]
        self.trailer = {**found, **self.trailer}
        return found.get("/Prev")

    def object(self, x):
        """What a reference stands for, or the value itself; an object that isn't there is null."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            head = _HEAD.match(self.data, self.at.get(int(x), len(self.data)))
            x = value(self.data, head.end())[0] if head else None
        raise StreamError("references without an end")

    def stream(self, x: Ref) -> bytes:
        """The decoded bytes of a stream object."""
        head = _HEAD.match(self.data, self.at.get(int(x), len(self.data)))
        if not head:
            return b""
        about, at = value(self.data, head.end())
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        if not begin or not isinstance(about, dict):
            raise StreamError("no stream")
        raw = self.data[begin.end() : begin.end() + int(self.object(about.get("/Length")) or 0)]
        filters = self.object(about.get("/Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "/FlateDecode":
                raise StreamError(f"filter {name}")
            raw = zlib.decompress(raw)
        return raw

    def leaves(self) -> Iterator[dict]:
        """Pages in order, with the size that they inherit."""
        waiting, seen = [(self.object(self.trailer["/Root"])["/Pages"], None)], set()
        while waiting:
            ref, box = waiting.pop()
            node = self.object(ref)
            if not isinstance(node, dict) or int(ref) in seen:
                raise StreamError("pages that aren't a tree")
            seen.add(int(ref))
            box = self.object(node.get("/MediaBox")) or box
            if "/Kids" in node:
                waiting += [(k, box) for k in reversed(self.object(node["/Kids"]))]
            else:
                yield node | {"/MediaBox": box}


def _number_tree(file: File, root) -> dict[int, list]:
    out, waiting = {}, [root]
    while waiting:
        node = file.object(waiting.pop()) or {}
        waiting += file.object(node.get("/Kids")) or []
        nums = file.object(node.get("/Nums")) or []
        out |= dict(zip(nums[::2], nums[1::2], strict=False))
    return out


def scan(data: bytes) -> Iterator[dict]:
    """A row for each page: page (1 on), w, h in inches, content, slots (tags by mark), and the file's facts."""
    file = File(data)
    root = file.object(file.trailer["/Root"])
    struct, outline = file.object(root.get("/StructTreeRoot")) or {}, file.object(root.get("/Outlines")) or {}
    parents = _number_tree(file, struct.get("/ParentTree"))
    text = lambda x: None if x is None else decoded(x)
    tags = lambda x: [(file.object(e) or {}).get("/S", "/")[1:] or None for e in file.object(x) or []]
    entries, waiting = set(), [outline.get("/First")]
    while waiting:
        if (ref := waiting.pop()) is not None and int(ref) not in entries:
            entries.add(int(ref))
            node = file.object(ref) or {}
            waiting += [node.get("/First"), node.get("/Next")]
    found = list(file.leaves())
    facts = {"title": text((file.object(file.trailer.get("/Info")) or {}).get("/Title")), "lang": text(file.object(root.get("/Lang"))), "marked": bool((file.object(root.get("/MarkInfo")) or {}).get("/Marked")), "n_pages": len(found), "n_elements": sum(len([e for e in file.object(x) or [] if e is not None]) for x in parents.values()), "n_outline": len(entries), "outline_count": outline.get("/Count", 0)}
    for k, node in enumerate(found, 1):
        x0, y0, x1, y1 = (float(x) for x in node["/MediaBox"] or (0, 0, 612, 792))
        parts = node.get("/Contents")
        parts = [parts] if isinstance(parts, Ref) and not isinstance(file.object(parts), list) else file.object(parts) or []
        yield {"page": k, "w": abs(x1 - x0) / 72, "h": abs(y1 - y0) / 72, "content": b"\n".join(file.stream(p) for p in parts), "slots": tags(parents.get(node.get("/StructParents"))), **facts, "error": None}


def _scanned(files: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of each file (name, content), in batches of about HELD bytes: the last value of a row is its weight."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for *row, weight in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""):
                    held.append(row)
                    size += weight + 256
                    if size > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("name", "content").mapInArrow(run, schema)


def _pages_of(name: str, data: bytes) -> Iterator[tuple[dict, str | None]]:
    """(row, error): see scan; what can't be read is a last row of nothing but an error."""
    try:
        for row in scan(data):
            yield row, None
    except (StreamError, zlib.error, KeyError, ValueError, TypeError, AttributeError) as e:
        yield {}, str(e) if isinstance(e, StreamError) else "broken file"


def read_pages(files: DataFrame) -> DataFrame:
    """name, content of files -> SCANNED: a row for each page, or one with an error."""
    names = [x.split()[0] for x in SCANNED.split(", ")][1:-1]

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for row, error in _pages_of(name, data):
            yield name, *[row.get(c) for c in names], error, len(row.get("content", b""))

    return _scanned(files, rows, SCANNED)


def read_elements(files: DataFrame) -> DataFrame:
    """name, page, mcid, tag, text of the marks of all pages that show text: what follows a mark's beginning, or a beginning
    without a number, up to any mark's end. The tag is that of the mark's slot."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for row, error in _pages_of(name, data):
            for mcid, text in shown_by_mark(row["content"]).items() if error is None else ():
                yield name, row["page"], mcid, row["slots"][mcid] if mcid < len(row["slots"]) else None, text, len(text)

    return _scanned(files, rows, "name string, page int, mcid int, tag string, text string")


def shown_by_mark(data: bytes) -> dict[int, str]:
    """Text by mark's number, of what a stream shows up to its end or first fault."""
    mcid, out = -1, {}
    try:
        for op, operands in content.instructions(data):
            if op == "BDC":
                about = operands[1][1] if len(operands) > 1 and operands[1][0] == "dict" else {}
                mcid = int(about["/MCID"]) if re.fullmatch(r"[+-]?\d+", str(about.get("/MCID"))) else mcid
            elif op in ("BMC", "EMC"):
                mcid = -1
            elif mcid >= 0 and op in ("Tj", "TJ"):
                out.setdefault(mcid, []).append(tagging.shown_by(op, operands) or "")
    except StreamError:
        pass
    return {k: "".join(v) for k, v in out.items()}


# ---- queries: documents as tagged files, written and read back ----


def _quoted(x: str) -> str:
    """As content._quoted, of one text."""
    if re.fullmatch(r"[\x20-\x7E\t]*", x):
        return "(" + re.sub(r"([\\()])", r"\\\1", x).replace("\t", "\\t") + ")"
    return f"<FEFF{x.encode('utf-16-be').hex().upper()}>"


def linked(heads: list[tuple[int, int, str, int]]) -> tuple[list[dict], int]:
    """Headings (ord, level, text, page) in order -> the entries that pack takes, and the root's count: children and
    grandchildren. Links are those of structure.outline_links, made along one document's headings."""
    entries, above, last = [], [], {}
    for ord_, level, text, page in heads:
        above = [a for a in above if a[0] < level]
        parent = above[-1][1] if above else None
        before = last.get(parent and parent["ord"])
        e = {"ord": ord_, "text": text, "page": page, "parent": parent and parent["ord"], "prev": before and before["ord"], "next": None, "first": None, "last": None}
        if before:
            before["next"] = ord_
        if parent:
            parent["first"], parent["last"] = ord_ if parent["first"] is None else parent["first"], ord_
        last[e["parent"]] = e
        above.append((level, e))
        entries.append(e)
    tops = {e["ord"] for e in entries if e["parent"] is None}
    return entries, sum(e["parent"] is None or e["parent"] in tops for e in entries)


def file_of(text: str | None, title: str, lang: str, sizes: list[dict]) -> bytes | None:
    """The tagged file of a document's text, None without pages. title: that of a text without headings."""
    lines = elements.parts_of(text)[0]
    leaves, heads, by_page = [], [], {x["page"]: x for x in sizes}
    for k, begin in enumerate(range(0, min(len(lines), s.MAX_PAGES * pages.LINES_A_PAGE), pages.LINES_A_PAGE), 1):
        own = lines[begin : begin + pages.LINES_A_PAGE]
        _, found, paragraphs = elements.parts_of("\n".join(own))
        tagged_ = [*((f"H{level}", x) for level, x in found), *(("P", x) for x in paragraphs)]
        stream = "".join(["0.5 w\n", *(f"BT /F1 11 Tf 1 0 0 1 72 {720 - 30 * i} Tm\n{_quoted(x)} Tj ET\n" for i, x in enumerate(own))]).encode()
        data, marks = tagging.tagged_page(stream, [(tag, list(dict.fromkeys(x.lower().split()))) for tag, x in tagged_])
        size = by_page.get(k, {"w": s.DEFAULT_WIDTH, "h": s.DEFAULT_HEIGHT})
        leaves.append({"w": size["w"] * 72, "h": size["h"] * 72, "content": data, "marks": [{"mcid": m, "tag": tag} for m, tag in marks]})
        heads += [(k * 8 + i, level, x, k) for i, (level, x) in enumerate(found)]
    if not leaves:
        return None
    own_title = next((x for _, _, x, page in heads if page == 1), title)
    return pack(own_title, lang, leaves, *linked(heads))


def tagged(docs: DataFrame, lineitem: DataFrame) -> DataFrame:
    """doc_id, content: a tagged file of each document that has pages, at most MAX_PAGES of them. Lines are text blocks, matched
    with the elements that the text rules find on their page; headings are the outline; sizes are those of pages.page_sizes,
    titles and languages those of pages.titled_documents. Texts are shuffled once, to meet their sizes; a file is then made
    from its row alone, page by page."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("en-US")).alias("lang")
    named = docs.where("doc_id is not null").select("doc_id", "text", F.concat_ws("_", part("source"), part("lang"), part("doc_id")).alias("stem"), lang)
    found = named.join(pages.sizes_by_document(lineitem), "doc_id", "left")
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for k in range(batch.num_rows):
                text, stem, lang, sizes = (batch.column(c)[k].as_py() for c in ("text", "stem", "lang", "sizes"))
                made = file_of(text, s.stem_title(stem), lang, sizes or [])
                if made is not None:
                    ids.append(k)
                    held.append(made)
                    size += len(made)
                if ids and (size > HELD or k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())).cast(kind), pa.array(held, pa.binary())], names=["doc_id", "content"])
                    ids, held, size = [], [], 0

    return found.select("doc_id", "text", "stem", "lang", "sizes").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, content of the files of all documents, as they are read back."""
    docs, lineitem = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "lineitem"))
    at = folder(spark, "files")
    write_files(tagged(docs, lineitem).select(F.concat(F.col("doc_id").cast("string"), F.lit(s.PDF_END)).alias("name"), "content"), at)
    return read_files(spark, at)


def _doc() -> Column:
    """A document's number by its file's name."""
    return F.regexp_extract("name", r"^(-?\d+)_", 1).cast("bigint").alias("doc_id")


def tagged_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, w, h, slots, and the file's facts, of the pages of all files."""
    found = read_pages(_files(spark, sf_dir))
    return found.select(_doc(), "page", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), F.array_join("slots", ",").alias("slots"), "title", "lang", "marked", "n_pages", "n_elements", "n_outline", "outline_count", "error")


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, mcid, tag, text: structure elements of all files: the tag by the mark's slot, the text by its place in the
    page's stream."""
    return read_elements(_files(spark, sf_dir)).select(_doc(), "page", "mcid", "tag", "text")


_D = f"""{pages._PT.replace("with l as", "with recursive l as", 1)}, k as (select doc_id * {ROOM} + page as doc_id, string_split(text, chr(10)) as ls from pt where page <= {s.MAX_PAGES}), kh as (select doc_id, ls, {elements._H} as hs from k),
d as (select doc_id, ls, hs, list_transform(ls, lambda x: {t.sql_tokens("x")}) as bs, list_concat(list_transform(hs, lambda h: {t.sql_tokens("h.text")}), list_transform({elements._P}, lambda p: {t.sql_tokens("p")})) as es from kh),
"""
_E = structure.SQL["block_element_match"].replace(structure._M, _D).replace(" select doc_id, x.block as block, x.element as element, x.mcid as mcid from f", ", se as (select d.doc_id // %d as doc_id, (d.doc_id %% %d)::int as page, f.x.mcid as mcid, case when f.x.element < len(hs) then 'H' || hs[f.x.element + 1].level else 'P' end as tag, ls[f.x.block + 1] as text from f join d using (doc_id))" % (ROOM, ROOM))
_HS = f"select doc_id // {ROOM} as doc, (doc_id % {ROOM}) * 8 + j as ord, h.level as level from (select doc_id, unnest(range(0, len(hs))) as j, unnest(hs) as h from kh)"
SQL = {
    "tagged_files": f"{_E} select * from se",
    "tagged_file_pages": f"""{_E}, {pages._PS}, td as ({pages.SQL["titled_documents"]}), sl as (select doc_id, page, string_agg(tag, ',' order by mcid) as slots from se group by all), h0 as ({_HS}),
oc as ({structure.SQL["outline_counts"].replace(structure._H, "with h as (select * from h0)")}), pg as (select doc_id // {ROOM} as doc_id, (doc_id % {ROOM})::int as page from k)
select doc_id, page, round(coalesce(w, 8.5), 6) as w, round(coalesce(h, 11.0), 6) as h, coalesce(slots, '') as slots, title, language as lang, true as marked, (count(*) over (partition by doc_id))::int as n_pages, coalesce(ne, 0)::int as n_elements, coalesce(descendants, 0)::int as n_outline, coalesce(count_written, 0)::int as outline_count, null::varchar as error
from pg left join ps using (doc_id, page) left join sl using (doc_id, page) join td using (doc_id) left join (select doc_id, count(*) as ne from se group by 1) using (doc_id) left join oc on oc.doc = doc_id""",
}
