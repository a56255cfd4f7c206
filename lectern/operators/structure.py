"""Order-dependent structure: heading outlines, instruction blocks, element matching, page geometry, table grids.

Order within a document (page, user) is a window over that document's own rows; nothing orders all rows in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.functions import text as t

# ---- outlines: headings (doc, ord, level) ----


def headings(part: DataFrame) -> DataFrame:
    """Parts as headings of a brand's document (a stand-in of the right shape)."""
    return part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 6 + 1).cast("int").alias("level"), F.col("p_name").alias("text"))


def heading_hierarchy_issues(heads: DataFrame) -> DataFrame:
    """doc, seq, severity, message: outlines that don't begin at level 1, and skipped levels."""
    w = Window.partitionBy("doc").orderBy("ord")
    at = heads.withColumn("prev", F.lag("level").over(w))
    n = lambda c: F.col(c).cast("string")
    start = F.when(F.col("prev").isNull() & (F.col("level") != 1), F.struct(F.lit("warning").alias("severity"), F.concat(F.lit("Document does not start with Heading 1 (starts at H"), n("level"), F.lit(")")).alias("message")))
    skip = F.when(F.col("level") > F.col("prev") + 1, F.struct(F.lit("error").alias("severity"), F.concat(F.lit("Skipped heading level: H"), n("prev"), F.lit(" → H"), n("level"), F.lit(" (missing H"), (F.col("prev") + 1).cast("string"), F.lit(")")).alias("message")))
    return at.select("doc", F.col("ord").alias("seq"), F.coalesce(start, skip).alias("i")).where("i is not null").select("doc", "seq", "i.severity", "i.message")


def outline_parents(heads: DataFrame) -> DataFrame:
    """doc, ord, level, parent: the nearest heading before of a smaller level (null at the root)."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(w) for k in range(1, 6)]
    parent = F.greatest(*[F.when(F.col("level") > k, x) for k, x in enumerate(last, 1)])
    return heads.select("doc", "ord", "level", parent.alias("parent"))


def outline_links(heads: DataFrame) -> DataFrame:
    """For each heading its siblings, first and last child and number of children."""
    nodes = outline_parents(heads)
    w = Window.partitionBy("doc", "parent").orderBy("ord")
    linked = nodes.select("*", F.lag("ord").over(w).alias("prev"), F.lead("ord").over(w).alias("next"))
    kids = nodes.where("parent is not null").groupBy("doc", F.col("parent").alias("ord")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n_children"))
    return linked.join(kids, ["doc", "ord"], "left").select("doc", "ord", "parent", "prev", "next", "first", "last", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def outline_counts(heads: DataFrame) -> DataFrame:
    """Root counts of each document: as written (children and grandchildren), and all headings."""
    nodes = outline_parents(heads)
    up = nodes.select("doc", F.col("ord").alias("parent"), F.col("parent").isNull().alias("parent_is_top"))
    joined = nodes.join(up, ["doc", "parent"], "left")
    return joined.groupBy("doc").agg(F.count_if(F.col("parent").isNull() | F.coalesce("parent_is_top", F.lit(False))).alias("count_written"), F.count("*").alias("descendants"))


# ---- instruction streams: (page, i, op, text) ----


def instructions(events: DataFrame) -> DataFrame:
    """A user's events as a page's instructions: signup begins text, purchase ends it, an error is an image; others show
    their event number as text (a stand-in of the right shape)."""
    op = F.when(F.col("event_type") == "signup", "BT").when(F.col("event_type") == "purchase", "ET").when(F.col("event_type") == "error", "Do").when(F.col("event_type") == "view", "BMC").otherwise("Tj")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("page"), (F.row_number().over(w) - 1).alias("i"), op.alias("op"), F.col("event_id").cast("string").alias("text"))


def strip_marked_content(instr: DataFrame) -> DataFrame:
    """Without marked-content operators, numbered anew."""
    w = Window.partitionBy("page").orderBy("i")
    return instr.where(~F.col("op").isin("BMC", "BDC", "EMC", "MP", "DP")).select("page", (F.row_number().over(w) - 1).alias("i"), "op", "text")


def _placed(instr: DataFrame) -> DataFrame:
    w = Window.partitionBy("page").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = instr.select("*", F.max(F.when(F.col("op") == "BT", F.col("i"))).over(w).alias("bt"), F.max(F.when(F.col("op") == "ET", F.col("i"))).over(w).alias("et"))
    return at.withColumn("inside", F.col("bt").isNotNull() & (F.col("et").isNull() | (F.col("bt") > F.col("et"))))


def content_blocks(instr: DataFrame) -> DataFrame:
    """page, block, type, first, last, text: text from the last begin to the next end, and images outside of text. The text
    is what its showing operators show, in order, stripped. All is by page: instructions are shuffled once. An image is a group
    of its own row."""
    row = Window.partitionBy("page").orderBy("i")
    at = _placed(instr).withColumn("image", F.when(~F.col("inside"), F.row_number().over(row))).where("inside or op = 'Do'")
    shown = F.collect_list(F.when(F.col("inside") & F.col("op").isin("Tj", "TJ", "'", '"'), F.struct("i", "text")))
    whole = F.btrim(F.array_join(F.transform(F.array_sort(shown), lambda x: x["text"]), ""), F.lit(t.SPACES))
    found = at.groupBy("page", F.when(F.col("inside"), F.col("bt")).otherwise(F.col("i")).alias("first"), "image").agg(F.max(F.when(~F.col("inside") | (F.col("op") == "ET"), F.col("i"))).alias("last"), whole.alias("text"))
    w = Window.partitionBy("page").orderBy("first")
    text = F.when(F.col("page").isNotNull(), F.col("text")).otherwise(F.lit(""))  # instructions of no page have no text
    return found.where("last is not null").select("page", (F.row_number().over(w) - 1).alias("block"), F.when(F.col("image").isNull(), "text").otherwise("image").alias("type"), "first", "last", text.alias("text"))


def artifact_islands(instr: DataFrame) -> DataFrame:
    """page, first, last, n: runs of instructions outside all blocks (see content_blocks): a begin of text opens a block if an end
    is the next of its kind. Instructions of no page are in no block. All is by page: instructions are shuffled once."""
    w = Window.partitionBy("page").orderBy("i")
    following = F.expr("lead(case when op in ('BT', 'ET') then struct(op, i) end) ignore nulls over (partition by page order by i)")
    at = _placed(instr.select("page", "i", "op")).withColumn("next", following)
    last = F.when((F.col("op") == "BT") & (F.col("next.op") == "ET"), F.col("next.i")).when((F.col("op") == "Do") & ~F.col("inside"), F.col("i"))
    at = at.withColumn("until", F.last(F.when(F.col("page").isNotNull(), last), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("out", F.col("until").isNull() | (F.col("until") < F.col("i")))
    at = at.withColumn("run", F.sum(F.when(F.col("out"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.where("out").groupBy("page", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).drop("run")


# ---- matching of text blocks to elements ----


_SENTENCE_END = re.compile(r"[.\n] ?")


def blocks_and_elements(docs: DataFrame) -> DataFrame:
    """Lines as blocks, sentences as elements (a stand-in of the right shape): arrays of token sets for each document."""
    blocks = F.transform(F.split("text", "\n"), t.tokens)
    elements = F.transform(F.split("text", _SENTENCE_END.pattern), t.tokens)
    return docs.select("doc_id", blocks.alias("blocks"), elements.alias("elements"))


def greedy(blocks: list[list[str] | None], elements: list[list[str]], least: float = s.MATCH_SCORE) -> list[tuple[int, int]]:
    """(block, element) of blocks in order: each takes the unused element of the greatest overlap over the larger token
    count, the earliest of equals, if above `least`. Token sets; None: a block that takes an id but no element (-1).
    Elements are found by their tokens, so a block costs what its tokens' lists hold, and one look at all scores."""
    where: dict[str, list[int]] = {}
    for j, tokens in enumerate(elements):
        for w in tokens:
            where.setdefault(w, []).append(j)
    size, free, out = np.array([len(e) for e in elements], float), np.ones(len(elements), bool), []
    for i, tokens in enumerate(blocks):
        if tokens is None:
            out.append((i, -1))
            continue
        hits = [j for w in tokens for j in where.get(w, ())]
        if hits:
            score = np.bincount(hits, minlength=len(elements)) / np.maximum(size, len(tokens)) * free
            best = int(score.argmax())
            if score[best] > least:
                out.append((i, best))
                free[best] = False
    return out


def block_element_match(docs: DataFrame) -> DataFrame:
    """doc_id, block, element, mcid: greedy() over each document's blocks. What a block may take depends on all before it,
    so a document is one step of Python, a row of a batch at a time; no shuffle."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                own = greedy(batch.column("blocks")[i].as_py() or [], batch.column("elements")[i].as_py() or [])
                rows += [i] * len(own)
                found += [(b, e, k) for k, (b, e) in enumerate(own)]
            columns = [pa.array([f[k] for f in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", "block", "element", "mcid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks_and_elements(docs).mapInArrow(match, f"doc_id {kind}, block int, element int, mcid int")


def best(blocks: list[list[str]], elements: list[list[str]], least: float = s.MATCH_SCORE) -> Iterator[tuple[int, int, float]]:
    """(block, element, score) of each block: greedy() where elements may be shared. A block costs what its tokens' lists hold."""
    where: dict[str, list[int]] = {}
    for j, tokens in enumerate(elements):
        for w in tokens:
            where.setdefault(w, []).append(j)
    where = {w: np.array(found, np.int64) for w, found in where.items()}
    size, n = np.array([len(e) for e in elements], float), len(elements)
    for i, tokens in enumerate(blocks):
        hits = [where[w] for w in tokens if w in where]
        if not hits:
            continue
        every = np.concatenate(hits)
        found, count = np.unique(every, return_counts=True) if len(every) < n else (None, np.bincount(every, minlength=n))
        score = count / np.maximum(size if found is None else size[found], len(tokens))
        k = int(score.argmax())
        if score[k] > least:
            yield i, k if found is None else int(found[k]), float(score[k])


def best_match(docs: DataFrame) -> DataFrame:
    """doc_id, block, element, score: the best element of each block, elements may be shared; best() over each document, a row
    of a batch at a time. Nothing is shuffled: tokens and pairs stay where the text is. Blocks and elements are those of
    blocks_and_elements, cut in the same task."""
    tokens = lambda x: list(dict.fromkeys(x.lower().split()))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if text is None or not batch.column("doc_id")[i].is_valid:
                    continue
                if found := list(best([tokens(x) for x in text.split("\n")], [tokens(x) for x in _SENTENCE_END.split(text)])):
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(found), pa.int64())), *columns], ["doc_id", "block", "element", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(match, f"doc_id {kind}, block int, element int, score double")
    return found.withColumn("score", F.round("score", 9))


def parent_tree(docs: DataFrame, bucket: int = 65536) -> DataFrame:
    """doc_id, tree_idx (dense over documents that have matches), n_slots, slots: elements in the order of their ids. The
    dense index is a count of earlier buckets plus a rank within the bucket. Buckets are equal ranges of ids, as many as
    `bucket` documents each would make, however sparse the ids are: no task orders all documents."""
    least, most, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, -(-((most or 0) - (least or 0) + 1) // max(1, -(-n // bucket))))
    slots = block_element_match(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mcid", "element"))).alias("x"))
    slots = slots.withColumn("bucket", F.floor((F.col("doc_id") - F.lit(least or 0)) / width))
    before = slots.groupBy("bucket").count()
    before = before.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1
    return slots.withColumn("rank", rank).join(before, "bucket").select("doc_id", (F.col("earlier") + F.col("rank")).alias("tree_idx"), F.size("x").alias("n_slots"), F.array_join(F.transform("x", lambda y: y["element"].cast("string")), ",").alias("slots"))


# ---- page geometry and tables ----


def page_size_breaks(lineitem: DataFrame) -> DataFrame:
    """Lines of an order as pages (a stand-in): where the next page's size differs by more than a tenth of an inch."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "w")
    width = F.coalesce(F.when(F.col("l_quantity") < 25, 612).otherwise(792) / 72.0, F.lit(s.DEFAULT_WIDTH))
    sized = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", width.alias("w"), F.lit(792 / 72.0).alias("h"))
    nxt = sized.select("*", F.lead("w").over(w).alias("next_w"), F.lead("h").over(w).alias("next_h"))
    broken = (F.abs(F.col("next_w") - F.col("w")) > s.SIZE_STEP) | (F.abs(F.col("next_h") - F.col("h")) > s.SIZE_STEP)
    return nxt.where(broken).select("l_orderkey", "l_linenumber", "w", "next_w", s.orientation(F.col("next_w"), F.col("next_h")).alias("orientation"))


def table_grid(lineitem: DataFrame) -> DataFrame:
    """Lines of an order as ragged table rows (a stand-in): padded to the widest row, first row as header, widths in
    proportion to the usable page."""
    cells = F.slice(F.array("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 1, F.col("l_linenumber") % 4 + 1)
    rows = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells")))).alias("rows"))
    rows = rows.withColumn("cols", F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))))
    wide = rows.select("l_orderkey", "cols", F.posexplode("rows").alias("row", "r"))
    padded = F.slice(F.concat("r.cells", F.array_repeat(F.lit(""), F.col("cols"))), F.lit(1), F.col("cols"))
    return wide.select("l_orderkey", "row", (F.col("row") == 0).alias("is_header"), "cols", F.array_join(padded, "|").alias("cells"), F.round((s.DEFAULT_WIDTH - s.MARGINS) / F.col("cols"), 6).alias("col_width"))


_H = "with h as (select p_brand as doc, p_partkey as ord, (p_size % 6 + 1)::int as level from part)"
_LAST = ", ".join(f"max(case when level = {k} then ord end) over w as l{k}" for k in range(1, 6))
_O = f"{_H}, x as (select *, {_LAST} from h window w as (partition by doc order by ord rows between unbounded preceding and 1 preceding)), o as (select doc, ord, level, greatest({', '.join(f'case when level > {k} then l{k} end' for k in range(1, 6))}) as parent from x)"
_I = "with i as (select user_id as page, row_number() over (partition by user_id order by ts, event_id) - 1 as i, case event_type when 'signup' then 'BT' when 'purchase' then 'ET' when 'error' then 'Do' when 'view' then 'BMC' else 'Tj' end as op, event_id::varchar as text from events)"
_B = f"""{_I}, p as (select *, max(case when op = 'BT' then i end) over w as bt, max(case when op = 'ET' then i end) over w as et from i window w as (partition by page order by i rows between unbounded preceding and 1 preceding)),
q as (select *, bt is not null and (et is null or bt > et) as inside from p),
t as (select page, bt as first, string_agg(text, '' order by i) as text from q where inside and op = 'Tj' group by all),
e as (select page, case when op = 'ET' then 'text' else 'image' end as type, case when op = 'ET' then bt else i end as first, i as last from q where (op = 'ET' and inside) or (op = 'Do' and not inside)),
b as (select page, row_number() over (partition by page order by first) - 1 as block, type, first, last, coalesce(text, '') as text from e left join t using (page, first))"""
_M = f"""with recursive d as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {t.sql_tokens('x')}) as bs, list_transform(string_split_regex(text, '[.\\n] ?'), lambda x: {t.sql_tokens('x')}) as es from documents),
"""
SQL = {
    "heading_hierarchy_issues": f"{_H}, l as (select *, lag(level) over (partition by doc order by ord) as prev from h) select doc, ord as seq, case when prev is null then 'warning' else 'error' end as severity, case when prev is null then 'Document does not start with Heading 1 (starts at H' || level || ')' else 'Skipped heading level: H' || prev || ' → H' || level || ' (missing H' || (prev + 1) || ')' end as message from l where (prev is null and level <> 1) or level > prev + 1",
    "outline_parents": f"{_O} select * from o",
    "outline_links": f"{_O}, k as (select doc, parent as ord, min(ord) as first, max(ord) as last, count(*) as n from o where parent is not null group by all), s as (select *, lag(ord) over w as prev, lead(ord) over w as next from o window w as (partition by doc, parent order by ord)) select s.doc, s.ord, s.parent, s.prev, s.next, k.first, k.last, coalesce(k.n, 0) as n_children from s left join k using (doc, ord)",
    "outline_counts": f"{_O} select o.doc, count(*) filter (o.parent is null or (u.ord is not null and u.parent is null)) as count_written, count(*) as descendants from o left join o u on u.doc = o.doc and u.ord = o.parent group by o.doc",
    "strip_marked_content": f"{_I} select page, row_number() over (partition by page order by i) - 1 as i, op, text from i where op not in ('BMC', 'BDC', 'EMC', 'MP', 'DP')",
    "content_blocks": f"{_B} select * from b",
    "artifact_islands": f"""{_B}, a as (select i.page, i.i, max(b.last) as last from i left join b on b.page = i.page and i.i between b.first and b.last group by all),
r as (select *, i - row_number() over (partition by page order by i) as run from a where last is null) select page, min(i) as first, max(i) as last, count(*) as n from r group by page, run""",
    "block_element_match": f"""{_M} m as (select doc_id, 1 as k, []::int[] as used, []::struct(block int, element int, mcid int)[] as out, bs, es from d
union all select doc_id, k + 1, case when best.score > 0.2 then list_append(used, best.e) else used end, case when best.score > 0.2 then list_append(out, {{'block': k - 1, 'element': best.e, 'mcid': len(out)::int}}) else out end, bs, es
from m, lateral (select coalesce(list_reduce(list_filter(list_transform(es, lambda x, j: {{'score': case when len(x) = 0 or len(bs[k]) = 0 or list_contains(used, (j - 1)::int) then -1.0::double else len(list_intersect(bs[k], x)) / greatest(len(bs[k]), len(x)) end, 'e': (j - 1)::int}}), lambda y: true), lambda p, q: case when q.score > p.score then q else p end), {{'score': -1.0::double, 'e': -1}}) as best) where k <= len(bs)),
f as (select doc_id, unnest(out) as x from m where k = len(bs) + 1) select doc_id, x.block as block, x.element as element, x.mcid as mcid from f""",
    "best_match": f"""{_M} b as (select doc_id, unnest(range(0, len(bs))) as block, unnest(bs) as t from d), e as (select doc_id, unnest(range(0, len(es))) as element, unnest(es) as t from d),
bt as (select doc_id, block, len(t) as n, unnest(t) as w from b), et as (select doc_id, element, len(t) as n, unnest(t) as w from e),
c as (select bt.doc_id, block, element, count(*) / greatest(bt.n, et.n) as score from bt join et on bt.doc_id = et.doc_id and bt.w = et.w group by bt.doc_id, block, element, bt.n, et.n),
r as (select *, row_number() over (partition by doc_id, block order by score desc, element) as k from c where score > 0.2) select doc_id, block, element, round(score, 9) as score from r where k = 1""",
    "page_size_breaks": "with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity < 25 then 612 else 792 end / 72.0::double as w from lineitem), n as (select *, lead(w) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, w) as next_w from s) select l_orderkey, l_linenumber, w, next_w, case when next_w > 11 then 'LANDSCAPE' else 'PORTRAIT' end as orientation from n where abs(next_w - w) > 0.1",
    "table_grid": "with c as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 as row, [l_returnflag, l_linestatus, l_partkey::varchar, l_suppkey::varchar][1:l_linenumber % 4 + 1] as cells from lineitem), m as (select *, max(len(cells)) over (partition by l_orderkey) as cols from c) select l_orderkey, row, row = 0 as is_header, cols, array_to_string(cells, '|') || repeat('|', (cols - len(cells))::int) as cells, round(7.0::double / cols, 6) as col_width from m",
}
SQL["parent_tree"] = SQL["block_element_match"].replace(" select doc_id, x.block as block, x.element as element, x.mcid as mcid from f", ", g as (select doc_id, count(*) as n_slots, string_agg(x.element::varchar, ',' order by x.mcid) as slots from f group by doc_id) select doc_id, row_number() over (order by doc_id) - 1 as tree_idx, n_slots, slots from g")


def marked_stream(instr: DataFrame) -> DataFrame:
    """page, pos, kind (open, body, close), tag, i: the stream rewritten so that every instruction lies in one marked
    sequence: of its block, or of a run of artifacts."""
    blocks = content_blocks(instr).select("page", "first", "last", F.when(F.col("type") == "text", "P").otherwise("Figure").alias("tag"))
    spans = blocks.unionByName(artifact_islands(instr).select("page", "first", "last", F.lit("Artifact").alias("tag")))
    return marked(instr, spans.withColumn("mcid", F.lit(None).cast("int"))).drop("mcid")


def marked(instr: DataFrame, spans: DataFrame) -> DataFrame:
    """page, pos, kind (open, body, close), tag, mcid, i: instructions with the markers of spans (page, first, last, tag, mcid)
    that together hold all of them."""
    none = [F.lit(None).cast("string").alias("tag"), F.lit(None).cast("int").alias("mcid")]
    opens = spans.select("page", F.col("first").alias("i"), F.lit(0).alias("step"), F.lit("open").alias("kind"), "tag", "mcid")
    body = instr.select("page", "i", F.lit(1).alias("step"), F.lit("body").alias("kind"), *none)
    closes = spans.select("page", F.col("last").alias("i"), F.lit(2).alias("step"), F.lit("close").alias("kind"), *none)
    w = Window.partitionBy("page").orderBy("i", "step")
    return opens.unionByName(body).unionByName(closes).select("page", (F.row_number().over(w) - 1).alias("pos"), "kind", "tag", "mcid", "i")


SQL["marked_stream"] = (
    SQL["artifact_islands"].replace(" select page, min(i) as first", ", z as (select page, min(i) as first")
    + """), s as (select page, first, last, case type when 'text' then 'P' else 'Figure' end as tag from b union all select page, first, last, 'Artifact' from z),
v as (select page, first as i, 0 as step, 'open' as kind, tag from s union all select page, i, 1, 'body', null from i union all select page, last, 2, 'close', null from s)
select page, row_number() over (partition by page order by i, step) - 1 as pos, kind, tag, i from v"""
)
