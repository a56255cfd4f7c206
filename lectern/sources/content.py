r"""Page content streams as a partitioned data source: bytes to rows (page, i, op, operands, error).

`spark.read.format("page_content").load(folder)` reads Parquet files with columns page and content (bytes), as a store of
pages has them: a partition for each file, or each row group of a large one. Rows leave in Arrow batches of BATCH
instructions, so a stream of any length needs its bytes and one batch. What follows a fault in a stream isn't read: its
instructions up to there are rows, and the fault is a last row with op null and an error.

Operands are structs (kind, value): number (as written), name (with its slash, #xx resolved), string (decoded: UTF-16 by
its byte-order mark, else Windows-1252), bool, null, and array and dict as JSON. An inline image is one instruction.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions import text as t
from lectern.functions.scalars import decoded
from lectern.sources.shared import folder, opened

SCHEMA = "page bigint, i bigint, op string, operands array<struct<kind: string, value: string>>, error string"
ARROW = pa.schema([("page", pa.int64()), ("i", pa.int64()), ("op", pa.string()), ("operands", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))), ("error", pa.string())])
#: Instructions of a batch, and bytes of a file that make more than one partition.
BATCH, LARGE_FILE = 4096, 64 << 20

_SKIP = rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)"
#: A token and the space behind it, so that a token is one match; what is behind a string's beginning is its own.
_TOKENS = (
    rb"(?:(?P<space>" + _SKIP + rb"++)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<mark><<|>>|[\[\]])|<(?P<hex>[0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+))" + _SKIP + rb"*+|(?P<text>\()"
)
_TOKEN = re.compile(_TOKENS)
_CODE = re.compile(rb"#([0-9A-Fa-f]{2})")
_IN_TEXT = re.compile(rb"[^()\\\r]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_CONSTANTS = {b"true": ("bool", True), b"false": ("bool", False), b"null": ("null", None)}
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


class StreamError(ValueError):
    """What is wrong with a stream."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string whose opening parenthesis ends at `at`: nested parentheses, escapes, line ends as \\n."""
    out, depth = bytearray(), 1
    while m := _IN_TEXT.match(data, at):
        out += m[0]
        at = m.end()
        c = data[at : at + 1]
        at += 1
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
        elif c == b"\r":
            at += data[at : at + 1] == b"\n"
            c = b"\n"
        elif c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                c, at = bytes([int(m[0], 8) & 255]), m.end()
            elif m := re.compile(rb"\r\n|\r|\n").match(data, at):
                c, at = b"", m.end()
            else:
                c = _ESCAPES.get(data[at : at + 1], data[at : at + 1])
                at += 1
        else:
            break
        out += c
    raise StreamError("string without its end")


def _gathered(kind: str, items: list) -> tuple:
    if kind == "array":
        return "array", [x[1] for x in items]
    keys = items[::2]
    if len(items) % 2 or any(k[0] != "name" for k in keys):
        raise StreamError("dictionary without pairs")
    return "dict", {k[1]: v[1] for k, v in zip(keys, items[1::2], strict=True)}


def instructions(data: bytes) -> Iterator[tuple[str, list[tuple]]]:
    """(operator, operands) in order; StreamError at the first fault."""
    return (x[:2] for x in located(data))


def located(data: bytes) -> Iterator[tuple[str, list[tuple], int, int]]:
    """(operator, operands, begin, end): instructions and the bytes that they take, first operand to operator."""
    at, stack, kinds, begin = 0, [[]], ["operands"], None
    while at < len(data):
        if not (m := _TOKEN.match(data, at)):
            raise StreamError(f"unexpected byte {data[at]:#04x}")
        at, kind, token = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "space":
            continue
        begin = m.start() if begin is None else begin
        if kind == "number":
            stack[-1].append(("number", _Number(token.decode())))
        elif kind == "name":
            token = _CODE.sub(lambda x: bytes.fromhex(x[1].decode()), token) if b"#" in token else token
            stack[-1].append(("name", "/" + token.decode("utf-8", "replace")))
        elif kind == "hex":
            digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", token).decode()
            stack[-1].append(("string", decoded(bytes.fromhex(digits + "0" * (len(digits) % 2)))))
        elif kind == "text":
            found, at = literal(data, at)
            stack[-1].append(("string", decoded(found)))
        elif token in (b"[", b"<<"):
            stack.append([])
            kinds.append("array" if token == b"[" else "dict")
        elif kind == "mark":
            if kinds[-1] != ("array" if token == b"]" else "dict"):
                raise StreamError(f"{token.decode()} without its beginning")
            stack[-2].append(_gathered(kinds.pop(), stack.pop()))
        elif token in _CONSTANTS:
            stack[-1].append(_CONSTANTS[token])
        elif len(stack) > 1 and token not in (b"BI",):
            raise StreamError("operator within an array or a dictionary")
        elif token == b"ID":
            if not (end := _IMAGE_END.search(data, m.end("word"))):
                raise StreamError("inline image without its end")
            at, stack = end.end(), [[]]
            yield "INLINE IMAGE", [], begin, at
            begin = None
        elif token != b"BI":
            yield token.decode("latin-1"), stack[0], begin, m.end("word")
            stack, begin = [[]], None
    if len(stack) > 1:
        raise StreamError(f"{kinds[-1]} without its end")
    if stack[0]:
        raise StreamError("operands without an operator")


class _Number(str):
    """A number as it is written; in JSON as a number."""


def _json(value) -> str:
    if isinstance(value, _Number):
        return json.dumps(float(value) if "." in value else int(value))
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def operand(kind: str, value) -> dict:
    plain = kind in ("number", "name", "string")
    return {"kind": kind, "value": None if value is None else str(value) if plain else _json(value)}


def rows(page: int | None, content: bytes | None) -> Iterator[tuple]:
    i = -1
    try:
        for i, (op, operands) in enumerate(instructions(content or b"")):
            yield page, i, op, [operand(*x) for x in operands], None
    except StreamError as e:
        yield page, i + 1, None, None, str(e)


class Part(InputPartition):
    def __init__(self, path: str, group: int | None):
        self.path, self.group = path, group


class ContentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        """A file each; only large files are opened here, for their row groups."""
        fs, at = opened(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        files = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            n = pq.ParquetFile(f.path, filesystem=fs).num_row_groups if f.size > LARGE_FILE else 1
            parts += [Part(f.path, k if n > 1 else None) for k in range(n)]
        return parts or [Part("", None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = opened(self.path)
        held = []
        file = pq.ParquetFile(part.path, filesystem=fs)
        groups = None if part.group is None else [part.group]
        for batch in file.iter_batches(batch_size=16, row_groups=groups, columns=["page", "content"]):
            for page, content in zip(*(batch.column(c).to_pylist() for c in ("page", "content")), strict=True):
                for row in rows(page, content):
                    held.append(row)
                    if len(held) == BATCH:
                        yield self.batch(held)
                        held = []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), ARROW, strict=True)], schema=ARROW)


class PageContent(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_content"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContentReader:
        return ContentReader(self.options["path"])


def read_content(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PageContent)
    return spark.read.format("page_content").load(path)


def _quoted(x: Column) -> Column:
    """A text as a string operand: literal if it is ASCII, else UTF-16 in hex."""
    bare = F.regexp_replace(F.regexp_replace(x, r"([\\()])", r"\\$1"), "\t", r"\\t")
    return F.when(x.rlike(r"^[\x20-\x7E\t]*$"), F.concat(F.lit("("), bare, F.lit(")"))).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit(">")))


def document_content(docs: DataFrame) -> DataFrame:
    """page, content: each document's lines shown one by one, as a page writer lays them out; of every fiftieth document the
    last string is not closed."""
    shown = F.transform(t.lines(F.col("text")), lambda x, i: F.concat(F.lit("1 0 0 1 72 "), (720 - 12 * (i % 60)).cast("string"), F.lit(" Tm\n"), _quoted(x), F.lit(" Tj\n")))
    tail = F.when(F.col("doc_id") % 50 == 7, F.lit("(never closed Tj")).otherwise(F.lit("ET"))
    return docs.select(F.col("doc_id").alias("page"), F.encode(F.concat(F.lit("BT /F1 11 Tf\n"), F.array_join(shown, ""), tail), "UTF-8").alias("content"))


def event_content(events: DataFrame) -> DataFrame:
    """page, content: each user's events as operators of all kinds of operands, in order of time."""
    k = F.get_json_object("props", "$.k")
    name = F.col("event_type")
    one = (
        F.when(name == "click", F.concat(F.lit("/Span <</MCID "), k, F.lit(" /Lang (en\\055US) /K [1 2]>> BDC % mark\n(a\\(b\\)"), k, F.lit(") Tj EMC")))
        .when(name == "view", F.concat(F.lit("[(x"), k, F.lit(") -120 <6162> [true null]] TJ")))
        .when(name == "purchase", F.concat(F.lit("q 1 0 0 -.5 "), k, F.lit(" 0 cm /Im#31 Do Q")))
        .when(name == "signup", F.concat(F.lit("BI /W 1 /H 1 ID \x01(EIx] EI\n"), k, F.lit(" w")))
        .otherwise(F.concat(F.lit("(line\\\n end) '")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", one.alias("code"))))
    return events.groupBy(F.col("user_id").alias("page")).agg(F.encode(F.array_join(F.transform(ordered, lambda x: x["code"]), "\n"), "UTF-8").alias("content"))


def written(content: DataFrame) -> DataFrame:
    """Content streams written to the shared folder and read back as instructions."""
    at = folder(content.sparkSession, "content")
    content.write.option("compression", "zstd").parquet(at)
    return read_content(content.sparkSession, at)


def page_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, i, op, kinds, operand (the last), error: documents as content streams, read back from their bytes."""
    found = written(document_content(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("page", "i", "op", F.array_join(F.transform("operands", lambda x: x["kind"]), " ").alias("kinds"), F.try_element_at("operands", F.lit(-1))["value"].alias("operand"), "error")


def event_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, i, op, operands: operators with arrays, dictionaries, escapes and inline images, read back from their bytes."""
    found = written(event_content(spark.read.parquet(f"{sf_dir}/events.parquet")))
    return found.select("page", "i", "op", F.array_join(F.transform("operands", lambda x: F.concat(x["kind"], F.lit(" "), x["value"])), "; ").alias("operands"))


def shown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: what each page's stream shows, a line for each string; a stream with a fault up to it. The scan of pages
    to texts from bytes alone."""
    found = written(document_content(spark.read.parquet(f"{sf_dir}/documents.parquet"))).where("op in ('BT', 'Tj') or error is not null")
    line = F.when(F.col("op") == "Tj", F.struct("i", F.element_at("operands", 1)["value"].alias("x")))
    texts = found.groupBy(F.col("page").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    return texts.select("doc_id", F.array_join(F.transform("x", lambda y: y["x"]), "\n").alias("text"))


_L = f"with l as (select doc_id, {t.sql_lines('text')} as ls from documents)"
SQL = {
    "page_instructions": f"""{_L}, o as (select doc_id, list_concat([{{'op': 'BT', 'kinds': '', 'v': null}}, {{'op': 'Tf', 'kinds': 'name number', 'v': '11'}}],
  flatten(list_transform(ls, lambda x, i: [{{'op': 'Tm', 'kinds': 'number number number number number number', 'v': (720 - 12 * ((i - 1) % 60))::varchar}}, {{'op': 'Tj', 'kinds': 'string', 'v': x}}])), [{{'op': case when doc_id % 50 = 7 then null else 'ET' end, 'kinds': case when doc_id % 50 <> 7 then '' end, 'v': null}}]) as os from l),
u as (select doc_id, unnest(range(0, len(os))) as i, unnest(os) as o from o) select doc_id as page, i, o.op as op, o.kinds as kinds, o.v as operand, case when o.op is null then 'string without its end' end as error from u""",
    "event_instructions": """with e as (select user_id, ts, event_id, event_type as e, json_extract_string(props, '$.k') as k from events),
o as (select user_id, ts, event_id, case e when 'click' then [['BDC', 'name /Span; dict {"/MCID":' || k || ',"/Lang":"en-US","/K":[1,2]}'], ['Tj', 'string a(b)' || k], ['EMC', '']]
  when 'view' then [['TJ', 'array ["x' || k || '",-120,"ab",[true,null]]']] when 'purchase' then [['q', ''], ['cm', 'number 1; number 0; number 0; number -.5; number ' || k || '; number 0'], ['Do', 'name /Im1'], ['Q', '']]
  when 'signup' then [['INLINE IMAGE', ''], ['w', 'number ' || k]] else [['''', 'string line end']] end as os from e),
u as (select user_id, ts, event_id, unnest(range(0, len(os))) as j, unnest(os) as o from o) select user_id as page, row_number() over (partition by user_id order by ts, event_id, j) - 1 as i, o[1] as op, o[2] as operands from u""",
    "shown_text": f"{_L} select doc_id, array_to_string(ls, chr(10)) as text from l",
}
