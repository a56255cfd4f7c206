"""Pages of documents: text layers and sizes, extracted tables, analysis, match texts, tagged content streams.

The tables at hand hold no pages, so they stand in by shape: twenty lines of a document are a page, an order's lines are the
rows of a table and the sizes of a document's pages, a user's events are a page's instructions. Plans join on the document
(or page) and order within it; nothing orders all rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.functions import text as t

from . import elements, structure

LINES_A_PAGE, HINT_CHARS, TERMS = 20, 2000, 12
#: Fixed value: the fill of header cells.
HEADER_FILL = "D9E1F2"
#: Operators that show text, and where their operands hold it: the only one, all, the only one, the third.
SHOW = ("Tj", "TJ", "'", '"')


# ---- text layers and sizes ----


def page_text(docs: DataFrame) -> DataFrame:
    """doc_id, page (1 on), text: the text layer."""
    lines = docs.select("doc_id", t.lines(F.col("text")).alias("lines"))
    n = F.ceil(F.size("lines") / LINES_A_PAGE).cast("int")
    pages = F.transform(F.sequence(F.lit(1), n), lambda p: F.array_join(F.slice("lines", (p - 1) * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))
    return elements.in_order(lines, ["doc_id"], F.when(n > 0, pages), "i", "text").select("doc_id", (F.col("i") + 1).alias("page"), "text")


def page_sizes(lineitem: DataFrame) -> DataFrame:
    """doc_id, page, w, h in inches, of those pages that have a size."""
    points = lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page")).agg(F.max("l_quantity").alias("q"))
    return points.select("doc_id", "page", (F.when(F.col("q") < 25, 612).otherwise(792) / 72.0).alias("w"), F.lit(792 / 72.0).alias("h"))


def sizes_by_document(lineitem: DataFrame) -> DataFrame:
    """doc_id, sizes (page, w, h): page_sizes with a row for each document; lines meet once, by document."""
    sizes = page_sizes(lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey"))
    return sizes.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("page", "w", "h")).alias("sizes"))


def page_inputs(docs: DataFrame, lineitem: DataFrame) -> DataFrame:
    """doc_id, page, hint, w, h, orientation: what an analyzer is given of each page, at most MAX_PAGES of a document. Pages
    without a text layer (every fifth document has none) get an empty hint, pages without a size the default one."""
    n = F.least(F.greatest(F.ceil(F.col("n_chars") / 800), F.lit(1)), F.lit(s.MAX_PAGES)).cast("int")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    layer = page_text(docs.where("doc_id % 5 <> 0"))
    at = pages.join(layer, ["doc_id", "page"], "left").join(page_sizes(lineitem), ["doc_id", "page"], "left")
    w, h = F.coalesce("w", F.lit(s.DEFAULT_WIDTH)), F.coalesce("h", F.lit(s.DEFAULT_HEIGHT))
    return at.select("doc_id", "page", F.left(F.coalesce("text", F.lit("")), F.lit(HINT_CHARS)).alias("hint"), w.alias("w"), h.alias("h"), s.orientation(w, h).alias("orientation"))


def sized_pages(docs: DataFrame, lineitem: DataFrame) -> DataFrame:
    """doc_id, page, n_chars, w: pages that both the analysis and the file have, by position; what either has beyond goes."""
    both = page_text(docs).join(page_sizes(lineitem), ["doc_id", "page"])
    return both.select("doc_id", "page", F.length("text").alias("n_chars"), "w")


def page_rows(docs: DataFrame, lineitem: DataFrame) -> DataFrame:
    """doc_id, page, kind (page_break or section), w, h, orientation: what a writer puts after a page that has elements and
    isn't the last: a break, and a section where both pages have sizes that differ. Pages without elements get neither."""
    text = page_text(docs)
    last = Window.partitionBy("doc_id")
    at = text.withColumn("n", F.max("page").over(last)).where("page < n")
    here, there = page_sizes(lineitem), page_sizes(lineitem).select("doc_id", (F.col("page") - 1).alias("page"), F.col("w").alias("next_w"), F.col("h").alias("next_h"))
    at = at.where((F.col("doc_id") + F.col("page")) % 7 != 0)  # these have no elements
    sized = at.join(here, ["doc_id", "page"], "left").join(there, ["doc_id", "page"], "left")
    differ = (F.abs(F.col("next_w") - F.col("w")) > s.SIZE_STEP) | (F.abs(F.col("next_h") - F.col("h")) > s.SIZE_STEP)
    kinds = F.when(F.coalesce(differ, F.lit(False)), F.array(F.lit("page_break"), F.lit("section"))).otherwise(F.array(F.lit("page_break")))
    rows = sized.select("doc_id", "page", F.explode(kinds).alias("kind"), F.col("next_w").alias("w"), F.col("next_h").alias("h"))
    section = F.col("kind") == "section"
    return rows.select("doc_id", "page", "kind", F.when(section, F.col("w")).alias("w"), F.when(section, F.col("h")).alias("h"), F.when(section, s.orientation(F.col("w"), F.col("h"))).alias("orientation"))


# ---- tables ----


def extracted_tables(lineitem: DataFrame) -> DataFrame:
    """doc_id, rows (row, is_header, cells): cells trimmed, missing ones empty; the first extracted row is the header; rows
    of blank cells go, and tables of such rows alone."""
    cells = F.array(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linestatus") == "F", F.lit(" F\t")), F.when(F.col("l_quantity") > 25, F.col("l_partkey").cast("string")))
    rows = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells")))).alias("raw"))
    clean = F.transform("raw", lambda r, i: F.struct(i.alias("row"), (i == 0).alias("is_header"), F.transform(r["cells"], lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(t.SPACES))).alias("cells")))
    kept = rows.select("doc_id", F.filter(clean, lambda r: F.exists(r["cells"], lambda c: c != "")).alias("rows"))
    return kept.where(F.size("rows") > 0)


def page_tables(lineitem: DataFrame) -> DataFrame:
    """doc_id, row, is_header, fill, cells of all extracted tables."""
    return elements.in_order(extracted_tables(lineitem), ["doc_id"], "rows", "i", "r").select("doc_id", "r.row", "r.is_header", F.when(F.col("r.is_header"), HEADER_FILL).alias("fill"), F.array_join("r.cells", "|").alias("cells"))


def column_widths(lineitem: DataFrame) -> DataFrame:
    """doc_id, col, width in inches: given widths (sums of a row's numbers, all zero for some) shared out over the page."""
    given = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(*[F.sum(F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(F.col(c))).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    widths = F.array("l_quantity", "l_discount", "l_tax")
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + x)
    total = F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0))
    share = F.transform(widths, lambda x: F.round((s.DEFAULT_WIDTH - s.MARGINS) * x / total, 6))
    return elements.in_order(given, ["doc_id"], share, "col", "width")


def analyzer_elements(docs: DataFrame, lineitem: DataFrame) -> DataFrame:
    """doc_id, ord, type, level, text, rows: the text rules' elements in order: headings, tables, paragraphs. Lines of a
    table may come back as paragraphs, as they are in the text too."""
    found = elements.parts(docs).join(extracted_tables(lineitem), "doc_id", "left")
    none, word = F.lit(None).cast("int"), F.lit(None).cast("string")
    full = lambda e: F.struct(e["type"].alias("type"), e["level"].alias("level"), e["text"].alias("text"), word.alias("rows"))
    table = F.struct(F.lit("table").alias("type"), none.alias("level"), word.alias("text"), F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], "|")), "\n").alias("rows"))
    tables = F.when(F.col("rows").isNotNull(), F.array(table)).otherwise(F.slice(F.array(table), 1, 0))
    every = found.select("doc_id", F.concat(F.transform("heads", full), tables, F.transform("paragraphs", full)).alias("elements"))
    return elements.in_order(every, ["doc_id"], "elements", "ord", "e").select("doc_id", "ord", "e.type", "e.level", "e.text", "e.rows")


def match_texts(docs: DataFrame) -> DataFrame:
    """doc_id, ord, type, match: the lower-cased text that an element is matched by: of a table its first row's cells, of a
    list its first three items, else its text. Lines stand in for elements, their kind by line number."""
    rows = elements.text_lines(docs)
    k = F.col("line_no") % 4
    kind = F.when(k == 0, "table").when(k == 1, "list").when(k == 2, "heading").otherwise("paragraph")
    table = F.transform(F.split("line", r"\. "), lambda r: F.split(r, " "))
    text = F.when(k == 0, F.array_join(table[0], " ")).when(k == 1, F.array_join(F.slice(F.split("line", ", "), 1, 3), " ")).otherwise(F.col("line"))
    return rows.select("doc_id", F.col("line_no").alias("ord"), kind.alias("type"), F.btrim(F.lower(text), F.lit(t.SPACES)).alias("match"))


# ---- documents ----


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, title (the given one, else that of the file's stem), language, part and display flag as written, and the
    paths of the outputs."""
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_final"))
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Given "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "")
    title = F.coalesce(F.nullif(given, F.lit("")), s.file_title(F.concat(F.lit("/in/"), stem, F.lit(".pdf"))))
    docx = F.concat(F.lit("/out/"), stem, F.lit(s.DOCX_END))
    return docs.select("doc_id", title.alias("title"), F.lit("en-US").alias("language"), F.lit("1").alias("part"), F.lit(True).alias("display_title"), docx.alias("docx"), F.replace(docx, F.lit(".docx"), F.lit(s.PDF_END)).alias("pdf"))


def titled_documents(docs: DataFrame) -> DataFrame:
    """doc_id, title, language, docx, pdf: a document's own title is its first heading; without one it is named for its file
    (source, language and id). The language is the declared one, else the default. Outputs are named for the file too."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stem = F.concat_ws("_", part("source"), part("lang"), part("doc_id"))
    own = elements.parts(docs.select(F.struct("doc_id", stem.alias("stem"), "lang").alias("doc_id"), "text"))
    given = F.get("heads", F.lit(0))["text"]
    found = own.select("doc_id.*", F.coalesce(F.nullif(given, F.lit("")), s.file_title(F.concat(F.lit("/in/"), F.col("doc_id.stem"), F.lit(".pdf")))).alias("title"))
    docx = F.concat(F.lit("/out/"), F.col("stem"), F.lit(s.DOCX_END))
    return found.select("doc_id", "title", F.coalesce(F.nullif("lang", F.lit("")), F.lit("en-US")).alias("language"), docx.alias("docx"), F.replace(docx, F.lit(".docx"), F.lit(s.PDF_END)).alias("pdf"))


def outline_entries(docs: DataFrame) -> DataFrame:
    """doc_id, idx (0 on), level, text: headings with a text, in order, levels 1 to 6 (1 if unknown)."""
    heads = elements.parts(docs).select("doc_id", F.transform("heads", lambda h: F.struct(F.when(F.length(h["text"]) % 3 != 0, h["level"] * 4).alias("level"), F.when(F.length(h["text"]) % 5 == 0, " ").otherwise(h["text"]).alias("text"))).alias("heads"))
    named = F.filter(F.transform("heads", lambda h: F.struct(s.level(h["level"]).alias("level"), F.btrim(h["text"], F.lit(t.SPACES)).alias("text"))), lambda h: h["text"] != "")
    return elements.in_order(heads, ["doc_id"], named, "idx", "h").select("doc_id", "idx", "h.level", "h.text")


def document_outline(docs: DataFrame) -> DataFrame:
    """The outline's links (see structure.outline_links) of every document, by its own headings."""
    return structure.outline_links(outline_entries(docs).select(F.col("doc_id").alias("doc"), F.col("idx").alias("ord"), "level"))


# ---- tagged content streams ----


def shown(op: Column, operands: Column) -> Column:
    """Text that an instruction shows, null if it shows none."""
    return F.when(op.isin("Tj", "'"), F.get(operands, F.lit(0))).when(op == "TJ", F.array_join(operands, "")).when((op == '"') & (F.size(operands) >= 3), F.get(operands, F.lit(2)))


def instructions(events: DataFrame) -> DataFrame:
    """page, i, op, operands, text (what is shown): a user's events as a page's instructions."""
    click = F.element_at(F.array(*map(F.lit, SHOW)), (F.col("event_id") % 4 + 1).cast("int"))
    op = F.when(F.col("event_type") == "signup", "BT").when(F.col("event_type") == "purchase", "ET").when(F.col("event_type") == "error", "Do").when(F.col("event_type") == "click", click).otherwise("q")
    word, other = F.concat(F.lit(" w"), (F.col("event_id") % TERMS).cast("string"), F.lit(" ")), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))
    operands = F.when(op == "TJ", F.array(word, other)).when(op == '"', F.array(F.lit("1"), F.lit("2"), word)).when(op.isin("Tj", "'"), F.array(word)).otherwise(F.expr("cast(array() as array<string>)"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("page"), (F.row_number().over(w) - 1).alias("i"), op.alias("op"), operands.alias("operands"), shown(op, operands).alias("text"))


def page_structure(events: DataFrame) -> DataFrame:
    """page, elements (tag, tokens) of the pages that have any: four elements of three words each."""
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.col("page") + k, F.lit(TERMS)).cast("string"))
    made = [F.struct(s.tag(F.lit(kind), F.lit(level)).alias("tag"), t.tokens(F.concat_ws(" ", word(3 * j), word(3 * j + 1), word(3 * j + 2))).alias("tokens")) for j, (kind, level) in enumerate((("heading", 2), ("paragraph", None), ("table", None), ("list", None)))]
    return events.select(F.col("user_id").alias("page")).distinct().where("page % 7 <> 0").select("page", F.array(*made).alias("elements"))


def assign(pages: DataFrame, every: bool = False) -> DataFrame:
    """page, blocks (block, type, tokens, in order), elements (tag, tokens) -> page, block, tag, mcid. An image takes the next
    id as a figure; a text block takes an element (see structure.greedy) and the next id, or neither. every: blocks with first
    and last -> page, first, last, tag, mcid of all of them, those that take neither with nulls, as all do if elements are null."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                blocks, made = batch.column("blocks")[i].as_py(), batch.column("elements")[i].as_py()
                own = [] if made is None else structure.greedy([None if b["type"] == "image" else b["tokens"] for b in blocks], [e["tokens"] for e in made])
                taken = {b: ("Figure" if e < 0 else made[e]["tag"], k) for k, (b, e) in enumerate(own)}
                keep = range(len(blocks)) if every else taken
                rows += [i] * len(keep)
                found += [(*(blocks[b][c] for c in place), *taken.get(b, (None, None))) for b in keep]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((*[pa.int64() if every else pa.int32()] * len(place), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(rows, pa.int64())), *columns], ["page", *place, "tag", "mcid"])

    place, kind = (("first", "last"), "bigint") if every else (("block",), "int")
    return pages.select("page", "blocks", "elements").mapInArrow(match, f"page {pages.schema['page'].dataType.simpleString()}, {', '.join(f'{c} {kind}' for c in place)}, tag string, mcid int")


def assignments(events: DataFrame) -> DataFrame:
    """page, block, tag, mcid: assign() over the blocks of the pages that have elements."""
    blocks = structure.content_blocks(instructions(events))
    by_page = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block", "type", t.tokens(F.col("text")).alias("tokens")))).alias("blocks"))
    return assign(by_page.join(page_structure(events), "page"))


def struct_elements(events: DataFrame) -> DataFrame:
    """page, mcid, tag, written (grouping tags as their leaf tags), max_mcid: the structure elements of all pages."""
    w = Window.partitionBy("page")
    return assignments(events).select("page", "mcid", "tag", s.writable_tag(F.col("tag")).alias("written"), F.max("mcid").over(w).alias("max_mcid"))


def tagged_stream(events: DataFrame) -> DataFrame:
    """page, pos, kind, tag, mcid, i: the stream rewritten with markers that carry tag and id where a block has an element;
    all else is an artifact."""
    instr = instructions(events)
    blocks = structure.content_blocks(instr).select("page", "block", "first", "last").join(assignments(events), ["page", "block"], "left")
    spans = blocks.select("page", "first", "last", F.coalesce("tag", F.lit("Artifact")).alias("tag"), "mcid")
    spans = spans.unionByName(structure.artifact_islands(instr).select("page", "first", "last", F.lit("Artifact").alias("tag"), F.lit(None).cast("int").alias("mcid")))
    return structure.marked(instr, spans)


_LS = f"with l as (select doc_id, n_chars, {t.sql_lines('text')} as ls from documents)"
_PT = f"{_LS}, pt as (select doc_id, p::int as page, array_to_string(ls[(p - 1) * {LINES_A_PAGE} + 1:p * {LINES_A_PAGE}], chr(10)) as text from (select doc_id, ls, unnest(range(1, ceil(len(ls) / {LINES_A_PAGE})::int + 1)) as p from l))"
_PS = "ps as (select l_orderkey as doc_id, l_linenumber::int as page, case when max(l_quantity) < 25 then 612 else 792 end / 72.0::double as w, 11.0::double as h from lineitem group by 1, 2)"
_TR = f"""tr as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N', l_linestatus = 'F', l_quantity > 25) - 1 as row,
  [case when l_returnflag <> 'N' then l_returnflag else '' end, case when l_linestatus = 'F' then 'F' else '' end, case when l_quantity > 25 then l_partkey::varchar else '' end] as cells from lineitem),
tk as (select doc_id, row, array_to_string(cells, '|') as cells from tr where array_to_string(cells, '') <> '')"""
_HEADS = elements._H
_INSTR = f"""i as (select user_id as page, row_number() over (partition by user_id order by ts, event_id) - 1 as i,
  case event_type when 'signup' then 'BT' when 'purchase' then 'ET' when 'error' then 'Do' when 'click' then 'T' else 'q' end as op,
  case when event_type = 'click' then ' w' || event_id % {TERMS} || ' ' || case when event_id % 4 = 1 then 'v' || event_id % 5 else '' end end as text from events),
p as (select *, max(case when op = 'BT' then i end) over w as bt, max(case when op = 'ET' then i end) over w as et from i window w as (partition by page order by i rows between unbounded preceding and 1 preceding)),
q as (select *, bt is not null and (et is null or bt > et) as inside from p),
t as (select page, bt as first, trim(string_agg(text, '' order by i)) as text from q where inside and op = 'T' group by all),
e as (select page, case when op = 'ET' then 'text' else 'image' end as type, case when op = 'ET' then bt else i end as first, i as last from q where (op = 'ET' and inside) or (op = 'Do' and not inside)),
b as (select page, (row_number() over (partition by page order by first) - 1)::int as block, type, first, last, coalesce(text, '') as text from e left join t using (page, first)),
bs as (select page, list({{'block': block, 'type': type, 'tokens': {t.sql_tokens('text')}}} order by block) as bs from b group by page),
el as (select distinct user_id as page, list_transform([0, 3, 6, 9], lambda j: list_distinct(['w' || (user_id + j) % {TERMS}, 'w' || (user_id + j + 1) % {TERMS}, 'w' || (user_id + j + 2) % {TERMS}])) as es from events where user_id % 7 <> 0),
m as (select page, 1 as k, []::int[] as used, []::struct(block int, tag varchar, mcid int)[] as out, bs, es from bs join el using (page)
union all select page, k + 1, case when bs[k].type = 'text' and best.score > 0.2 then list_append(used, best.e) else used end,
  case when bs[k].type = 'image' then list_append(out, {{'block': bs[k].block, 'tag': 'Figure', 'mcid': len(out)::int}}) when best.score > 0.2 then list_append(out, {{'block': bs[k].block, 'tag': ['H2', 'P', 'Table', 'L'][best.e + 1], 'mcid': len(out)::int}}) else out end, bs, es
from m, lateral (select coalesce(list_reduce(list_transform(es, lambda x, j: {{'score': case when len(bs[k].tokens) = 0 or list_contains(used, (j - 1)::int) then -1.0::double else len(list_intersect(bs[k].tokens, x)) / greatest(len(bs[k].tokens), len(x)) end, 'e': (j - 1)::int}}), lambda a, c: case when c.score > a.score then c else a end), {{'score': -1.0::double, 'e': -1}}) as best) where k <= len(bs)),
f as (select page, unnest(out) as x from m where k = len(bs) + 1), g as (select page, x.block as block, x.tag as tag, x.mcid as mcid from f)"""
SQL = {
    "page_text": f"{_PT} select * from pt",
    "page_inputs": f"""{_PT}, {_PS}, n as (select doc_id, unnest(range(1, least(greatest(ceil(n_chars / 800)::int, 1), 500) + 1))::int as page from l)
select doc_id, page, left(coalesce(text, ''), {HINT_CHARS}) as hint, coalesce(w, 8.5) as w, coalesce(h, 11.0) as h, case when coalesce(w, 8.5) > coalesce(h, 11.0) then 'LANDSCAPE' else 'PORTRAIT' end as orientation
from n left join (select * from pt where doc_id % 5 <> 0) using (doc_id, page) left join ps using (doc_id, page)""",
    "page_rows": f"""{_PT}, {_PS}, a as (select doc_id, page from (select *, max(page) over (partition by doc_id) as n from pt) where page < n and (doc_id + page) % 7 <> 0),
z as (select a.doc_id, a.page, x.w as w, y.w as nw, y.h as nh from a left join ps x on x.doc_id = a.doc_id and x.page = a.page left join ps y on y.doc_id = a.doc_id and y.page = a.page + 1)
select doc_id, page, 'page_break' as kind, null::double as w, null::double as h, null::varchar as orientation from z
union all select doc_id, page, 'section', nw, nh, case when nw > nh then 'LANDSCAPE' else 'PORTRAIT' end from z where abs(nw - w) > 0.1""",
    "sized_pages": f"{_PT}, {_PS} select doc_id, page, length(text) as n_chars, w from pt join ps using (doc_id, page)",
    "page_tables": f"with {_TR} select doc_id, row, row = 0 as is_header, case when row = 0 then '{HEADER_FILL}' end as fill, cells from tk",
    "column_widths": "with g as (select l_orderkey as doc_id, [sum(case when l_orderkey % 4 = 0 then 0 else l_quantity end), sum(case when l_orderkey % 4 = 0 then 0 else l_discount end), sum(case when l_orderkey % 4 = 0 then 0 else l_tax end)] as ws from lineitem group by 1) select doc_id, unnest([0, 1, 2]) as col, unnest(list_transform(ws, lambda w: round(7.0::double * w / case when list_sum(ws) = 0 then 1 else list_sum(ws) end, 6))) as width from g",
    "analyzer_elements": f"""{_LS}, {_TR}, ex as (select doc_id, ls, {_HEADS} as hs from l), tt as (select doc_id, string_agg(cells, chr(10) order by row) as rows from tk group by doc_id),
x as (select doc_id, list_concat(list_transform(hs, lambda h: {{'type': 'heading', 'level': h.level, 'text': h.text, 'rows': null::varchar}}), case when rows is null then [] else [{{'type': 'table', 'level': null::int, 'text': null::varchar, 'rows': rows}}] end,
  list_transform({elements._P}, lambda p: {{'type': 'paragraph', 'level': null::int, 'text': p, 'rows': null::varchar}})) as es from ex left join tt using (doc_id)),
u as (select doc_id, unnest(range(0, len(es))) as ord, unnest(es) as s from x) select doc_id, ord, s.type as type, s.level as level, s.text as text, s.rows as rows from u""",
    "match_texts": f"""{_LS}, u as (select doc_id, unnest(range(0, len(ls))) as ord, unnest(ls) as line from l)
select doc_id, ord, ['table', 'list', 'heading', 'paragraph'][ord % 4 + 1] as type, {t.sql_strip("lower(case ord % 4 when 0 then string_split(line, '. ')[1] when 1 then array_to_string(string_split(line, ', ')[1:3], ' ') else line end)")} as match from u""",
    "document_metadata": "select doc_id, case when doc_id % 3 = 0 then 'Given ' || doc_id else 'Doc ' || doc_id || ' Final' end as title, 'en-US' as language, '1' as part, true as display_title, '/out/doc_' || doc_id || '_final_accessible.docx' as docx, '/out/doc_' || doc_id || '_final_accessible_ada.pdf' as pdf from documents",
    "titled_documents": f"""with d as (select doc_id, coalesce(source, '') || '_' || coalesce(lang, '') || '_' || coalesce(doc_id::varchar, '') as stem, lang, {t.sql_lines("text")} as ls from documents),
h as (select doc_id, stem, lang, {_HEADS} as hs from d)
select doc_id, coalesce(nullif(hs[1].text, ''), array_to_string(list_transform(regexp_extract_all(replace(stem, '_', ' '), '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '')) as title, coalesce(nullif(lang, ''), 'en-US') as language,
  '/out/' || stem || '_accessible.docx' as docx, replace('/out/' || stem || '_accessible.docx', '.docx', '_ada.pdf') as pdf from h""",
    "outline_entries": f"{_LS}, ex as (select doc_id, {_HEADS} as hs from l), n as (select doc_id, list_filter(hs, lambda h: length(h.text) % 5 <> 0) as hs from ex), u as (select doc_id, unnest(range(0, len(hs))) as idx, unnest(hs) as h from n) select doc_id, idx, case when length(h.text) % 3 <> 0 then least(6, h.level * 4) else 1 end as level, h.text as text from u",
    "struct_elements": f"with recursive {_INSTR} select page, mcid, tag, case tag when 'Table' then 'Caption' when 'L' then 'P' else tag end as written, max(mcid) over (partition by page) as max_mcid from g",
    "tagged_stream": f"""with recursive {_INSTR}, a as (select i.page, i.i, max(b.last) as last from i left join b on b.page = i.page and i.i between b.first and b.last group by all),
r as (select *, i - row_number() over (partition by page order by i) as run from a where last is null), z as (select page, min(i) as first, max(i) as last from r group by page, run),
s as (select page, first, last, coalesce(tag, 'Artifact') as tag, mcid from b left join g using (page, block) union all select page, first, last, 'Artifact', null from z),
v as (select page, first as i, 0 as step, 'open' as kind, tag, mcid from s union all select page, i, 1, 'body', null, null from i union all select page, last, 2, 'close', null, null from s)
select page, row_number() over (partition by page order by i, step) - 1 as pos, kind, tag, mcid, i from v""",
}
SQL["document_outline"] = structure.SQL["outline_links"].replace(structure._H, f"with h as (select doc_id as doc, idx as ord, level from ({SQL['outline_entries']}) q)")
