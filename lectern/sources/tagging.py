"""Content streams rewritten with marks: bytes to bytes, each instruction in one marked sequence.

What is marked, and how, is a table of spans that joins, windows and the matcher make (see operators/structure.py and
operators/pages.py); a page's spans then meet its bytes. Instructions are copied as they stand, so numbers, strings and
inline images keep their bytes; old marks go, and what lies between instructions becomes a line's end. A page whose stream
has a fault is kept as it is, with the fault as its error; a stream of nothing but marks becomes empty.

Nulls: a page without a number is kept as it is, with an error, as its spans can't be told. A page without bytes is an empty
stream. A page without elements, or with null elements, is all artifacts. Pages of one number are an error of the join (each
gets the spans of all): number pages apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import pages, structure
from lectern.sources import content
from lectern.sources.shared import kept

#: Operators of marked content, and those that show text.
MARKS = ("BMC", "BDC", "EMC", "MP", "DP")
NAMED = {"Artifact": b"/Artifact BMC"}


def shown(op: Column, operands: Column) -> Column:
    """Text that an instruction shows: a string, or the strings of an array; null if it shows none."""
    value = lambda k: F.try_element_at(operands, F.lit(k))["value"]
    parts = F.from_json(value(1), "array<variant>")
    words = F.transform(parts, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))
    return F.when(op.isin("Tj", "'"), value(1)).when(op == '"', value(3)).when(op == "TJ", F.array_join(words, ""))


def plain(instr: DataFrame) -> DataFrame:
    """page, i, op, text of instructions (page, i, op, operands) that are no marks; i as in the stream."""
    return instr.where(F.col("op").isNotNull() & ~F.col("op").isin(*MARKS)).select("page", "i", "op", shown(F.col("op"), F.col("operands")).alias("text"))


def spans(instr: DataFrame, elements: DataFrame) -> DataFrame:
    """page, first, last, tag, mcid: blocks with the elements (page, elements: tag and tokens) they are matched with, other
    blocks and all between them as artifacts. instr: see plain."""
    block = F.struct("block", "type", "first", "last", t.tokens(F.col("text")).alias("tokens"))
    by_page = structure.content_blocks(instr).groupBy("page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    own = pages.assign(by_page.join(elements.where("elements is not null"), "page", "left"), every=True).withColumn("tag", F.coalesce("tag", F.lit("Artifact")))
    return own.unionByName(structure.artifact_islands(instr).select("page", "first", "last", F.lit("Artifact").alias("tag"), F.lit(None).cast("int").alias("mcid")))


def rewrite(data: bytes, marks: list[dict]) -> bytes:
    """The stream with marks (first, last, tag, mcid) about its instructions; StreamError if it has a fault."""
    return _marked(data, [(i, op, begin, end) for i, (op, _, begin, end) in enumerate(content.located(data)) if op not in MARKS], marks)


def _marked(data: bytes, found: list[tuple], marks: list[dict]) -> bytes:
    opens = {m["first"]: NAMED.get(m["tag"], b"") if m["mcid"] is None else f"/{m['tag']} <</MCID {m['mcid']}>> BDC".encode() for m in marks}
    closes = {m["last"] for m in marks}
    out = []
    for i, _, begin, end in found:
        if i in opens:
            out.append(opens[i])
        out.append(data[begin:end])
        if i in closes:
            out.append(b"EMC")
    return b"\n".join(out)


def shown_by(op: str, operands: list[tuple]) -> str | None:
    """As shown(), of an instruction as the parser has it."""
    at = {"Tj": 0, "'": 0, '"': 2, "TJ": 0}.get(op)
    if at is None or len(operands) <= at:
        return None
    kind, value = operands[at]
    if op == "TJ":
        return "".join(x for x in value if isinstance(x, str) and not isinstance(x, content._Number)) if kind == "array" else None
    return content.operand(kind, value)["value"]


def tagged_page(data: bytes, elements: list[tuple[str, list[str]]]) -> tuple[bytes, list[tuple[int, str]]]:
    """A page's stream with its marks, and (mcid, tag) of these: what spans() and rewritten() make of many pages, of one whose
    elements (tag, tokens) are at hand, in one reading of its bytes. A page is one step of the matcher anyhow."""
    found, texts, blocks, bt, et = [], {}, [], None, None
    for i, (op, operands, begin, end) in enumerate(content.located(data)):
        if op in MARKS:
            continue
        found.append((i, op, begin, end))
        inside = bt is not None and (et is None or bt > et)
        if inside and op in pages.SHOW:
            texts.setdefault(bt, []).append(shown_by(op, operands) or "")
        elif op == "ET" and inside:
            blocks.append((bt, i, True))
        elif op == "Do" and not inside:
            blocks.append((i, i, False))
        bt, et = i if op == "BT" else bt, i if op == "ET" else et
    blocks.sort()
    own = dict(structure.greedy([list(dict.fromkeys("".join(texts.get(first, ())).lower().split())) if is_text else None for first, _, is_text in blocks], [tokens for _, tokens in elements]))
    marks, until, run = [], -1, None
    ids = {b: k for k, b in enumerate(own)}
    for b, (first, last, _) in enumerate(blocks):
        marks.append({"first": first, "last": last, "mcid": ids.get(b), "tag": "Artifact" if b not in own else "Figure" if own[b] < 0 else elements[own[b]][0]})
    ends = {first: last for first, last, _ in blocks}
    for i, *_ in found:
        until = ends.get(i, until)
        if until >= i:
            run = None
        elif run is None:
            marks.append(run := {"first": i, "last": i, "mcid": None, "tag": "Artifact"})
        else:
            run["last"] = i
    return _marked(data, found, marks), [(m["mcid"], m["tag"]) for m in marks if m["mcid"] is not None]


def rewritten(streams: DataFrame, marked: DataFrame) -> DataFrame:
    """page, content, error: streams (page, content) with the marks of spans (see spans)."""
    by_page = marked.groupBy("page").agg(F.collect_list(F.struct("first", "last", "tag", "mcid")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a page at a time, so that only one is held twice
                row = {c: batch.column(c)[k].as_py() for c in ("content", "marks")}
                data, error = row["content"] or b"", None
                try:
                    if not batch.column("page")[k].is_valid:
                        raise content.StreamError("page without a number")
                    data = rewrite(data, row["marks"] or [])
                except content.StreamError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([batch.column("page").slice(k, 1), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["page", "content", "error"])

    return streams.select("page", "content").join(by_page, "page", "left").mapInArrow(run, "page bigint, content binary, error string")


# ---- the query: pages of events as bytes, tagged by what matches, and read back ----


def page_streams(events: DataFrame) -> DataFrame:
    """page, content: the instructions of pages.instructions as bytes, some of them with old marks about them."""
    instr = pages.instructions(events)
    text = lambda k: F.concat(F.lit("("), F.get("operands", F.lit(k)), F.lit(")"))
    code = (
        F.when(F.col("op").isin("Tj", "'"), F.concat(text(0), F.lit(" "), F.col("op")))
        .when(F.col("op") == "TJ", F.concat(F.lit("["), text(0), F.lit(" -120 "), text(1), F.lit("] TJ")))
        .when(F.col("op") == '"', F.concat(F.lit("1 2 "), text(2), F.lit(' "')))
        .when(F.col("op") == "Do", F.lit("/Im0 Do"))
        .when(F.col("op") == "q", F.lit("/Old <</MCID 7>> BDC % as it was\nq EMC"))
        .otherwise(F.col("op"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", code.alias("code"))))
    return instr.groupBy("page").agg(F.encode(F.array_join(F.transform(ordered, lambda x: x["code"]), "\n"), "UTF-8").alias("content"))


def rewritten_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, kind (open, body, close), tag, mcid, i: what is read back of the rewritten bytes; i counts instructions that
    are no marks, a mark has that of the one beside it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    streams = kept(page_streams(events), "streams")
    instr = kept(plain(content.written(streams)), "instructions")
    out = content.written(rewritten(streams, spans(instr, pages.page_structure(events))).select("page", "content"))
    body = ~F.col("op").isin(*MARKS)
    kind = F.when(body, "body").when(F.col("op") == "EMC", "close").otherwise("open")
    name = F.when(F.col("op").isin("BMC", "BDC"), F.substring(F.get("operands", F.lit(0))["value"], 2, 100))
    mcid = F.when(F.col("op") == "BDC", F.get_json_object(F.get("operands", F.lit(1))["value"], "$['/MCID']").cast("int"))
    found = out.select("page", "i", kind.alias("kind"), name.alias("tag"), mcid.alias("mcid"))  # what the window shuffles
    before = F.count_if(F.col("kind") == "body").over(Window.partitionBy("page").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", before).select("page", F.col("i").alias("pos"), "kind", "tag", "mcid", (F.coalesce("before", F.lit(0)) - F.when(F.col("kind") == "close", 1).otherwise(0)).alias("i"))


SQL = {"rewritten_streams": pages.SQL["tagged_stream"]}
