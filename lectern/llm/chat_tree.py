r"""Chat formatting as a prefix tree.

Conversations that share their first turns share nodes: a node is named by the chained hash of the turns up to it. Each
node's formatted turn is emitted once, in depth-first order, as one span of its tree's stream; it carries the position ids
its tokens have in a conversation, the spans of its ancestors, which with itself are all that its tokens may attend to, and
its loss mask: spans of code points of the formatted turn, the text alone of assistant turns. A conversation, and what of
it is under the mask, is read back from the spans of its nodes.

Depth-first offsets: a node belongs to the segment of the least leaf below it (by name, a hash), so a segment is a run of
nodes down to a leaf, is emitted in one piece, and lies below few others (as many as a random sequence has records). Sizes
of what hangs below a segment, and prefix sums over the segments that branch off one, are sums over pairs (segment, segment
above), linear in the turns up to a logarithm, pre-aggregated, and in two levels (depth and bucket of the name, then within
a bucket). So neither a first turn that a third of all conversations share, nor a tree of any width, nor a conversation of
any length is squared or ends up in one task. Equal conversations are one leaf, whatever their number.

Template: `<s>[INST] role [/INST] text</s>` for each turn. In roles and texts a backslash is doubled and a backslash is put
into `<s>`, `</s>`, `[INST]` and `[/INST]` behind the first character; dropping each backslash before a character undoes
that. A token is a UTF-8 byte by default; token_count may name another count of a formatted turn.

Defined cases: a null text or role is empty; turns of a conversation are ordered by turn (null first), role, text; repeated
rows are turns of their own; each row without conv_id is a conversation of one turn, so that none gathers what has lost
its id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Turns whose text is under the loss mask.
LOSS_ROLE = "assistant"
#: Hex digits of a node's name that make a bucket of its siblings.
BUCKET_DIGITS = 3


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(out, r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), escape(role), F.lit(" [/INST] "))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(_head(role), escape(text), F.lit("</s>"))


def loss_mask(role: Column, text: Column) -> Column:
    """Spans (from, to) of code points of the formatted turn that are learnt from."""
    start = F.length(_head(role))
    span = F.struct(start.alias("from"), (start + F.length(escape(text))).alias("to"))
    return F.when(role == LOSS_ROLE, F.array(span)).otherwise(F.expr("cast(array() as array<struct<from: int, to: int>>)"))


def _named(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, role, text, node, and of its conversation: tree (first node), parent and leaf (last node)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    along = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto, whole = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.md5(F.concat_ws("|", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text").cast("binary"))
    lane = lambda k: F.xxhash64(F.lit(k), one)
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    known = turns.where("conv_id is not null").withColumn("depth", F.row_number().over(along) - 1)
    known = known.withColumn("a", lane(1)).withColumn("b", lane(2)).withColumn("node", name(F.bit_xor("a").over(upto), F.bit_xor("b").over(upto)))
    known = known.select("conv_id", "depth", "role", "text", "node", F.first("node").over(whole).alias("tree"), F.lag("node").over(along).alias("parent"), F.last("node").over(whole).alias("leaf"))
    alone = turns.where("conv_id is null").withColumn("depth", F.lit(0)).withColumn("node", name(lane(1), lane(2)))
    return known.unionByName(alone.select("conv_id", "depth", "role", "text", "node", F.col("node").alias("tree"), F.lit(None).cast("string").alias("parent"), F.col("node").alias("leaf")))


def prefix_tree(conversations: DataFrame, token_count=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, chains, members). nodes: tree, node, parent, depth, role, formatted, mask (see loss_mask), n_tokens, segment,
    start and end in the tree's stream, position (id of the first token), ancestors (array of the spans start, end that it
    may attend to besides itself, in order; neighbouring spans are one). chains: leaf, depth, node. members: conv_id, leaf."""
    tokens = token_count or F.octet_length
    named = materialize(_named(conversations))
    members = named.where("depth = 0").select("conv_id", "leaf")
    chains = materialize(named.select("leaf", "depth", "node").distinct())

    # a node belongs to the segment of the least leaf below it: a run of nodes from somewhere down to that leaf
    nodes = named.groupBy("node").agg(F.min("leaf").alias("segment"), F.first(F.struct("tree", "depth", "parent", "role", "text")).alias("x")).select("node", "segment", "x.*")
    nodes = nodes.select("node", "segment", "tree", "depth", "parent", "role", loss_mask(F.col("role"), F.col("text")).alias("mask"), format_turn(F.col("role"), F.col("text")).alias("formatted")).withColumn("n_tokens", tokens("formatted").cast("bigint"))
    along = Window.partitionBy("segment").orderBy("depth")
    nodes = materialize(nodes.withColumn("inside", F.sum("n_tokens").over(along) - F.col("n_tokens")))

    segments = nodes.groupBy("segment").agg(F.sum("n_tokens").alias("own"), F.min(F.struct("depth", "parent")).alias("top")).select("segment", "own", F.col("top.parent").alias("at"), F.col("top.depth").alias("depth"))
    holders = nodes.select(F.col("node").alias("at"), F.col("segment").alias("parent"))
    # the segments on the way to each segment, and how many tokens of them lie on it
    ways = chains.join(nodes.select("node", "segment", (F.col("inside") + F.col("n_tokens")).alias("upto")), "node").groupBy("leaf", "segment").agg(F.max("upto").alias("upto"), F.max("depth").alias("last"))
    ways = materialize(ways.join(segments.select(F.col("segment").alias("leaf"), F.col("own").alias("leaf_own")), "leaf"))
    size = ways.groupBy("segment").agg(F.sum("leaf_own").alias("size"))
    sized = segments.join(holders, "at", "left").join(size, "segment").select("segment", "own", "parent", "depth", "size", F.substring("segment", 1, BUCKET_DIGITS).alias("bucket"))
    sized = materialize(sized)

    # a segment is followed by those that branch off it, the deepest branches first
    sums = sized.where("parent is not null").groupBy("parent", "depth", "bucket").agg(F.sum("size").alias("total"))
    earlier = F.sum("total").over(Window.partitionBy("parent").orderBy(F.desc("depth"), "bucket")) - F.col("total")
    before = sums.select("parent", "depth", "bucket", earlier.alias("earlier"))
    among = F.sum("size").over(Window.partitionBy("parent", "depth", "bucket").orderBy("segment")) - F.col("size")
    skips = sized.where("parent is not null").withColumn("among", among).join(before, ["parent", "depth", "bucket"]).select("segment", "own", (F.col("among") + F.col("earlier")).alias("skip"))
    skips = skips.unionByName(sized.where("parent is null").select("segment", "own", F.lit(0).cast("bigint").alias("skip")))
    up = F.col("segment") != F.col("leaf")
    begins = ways.join(skips, "segment").groupBy("leaf").agg((F.sum("skip") + F.coalesce(F.sum(F.when(up, F.col("own"))), F.lit(0))).alias("begin"), F.coalesce(F.sum(F.when(up, F.col("upto"))), F.lit(0)).alias("position"))
    begins = materialize(begins.withColumnRenamed("leaf", "segment"))
    spans = ways.where(up).join(begins.select("segment", "begin"), "segment").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("last", F.col("begin").alias("start"), (F.col("begin") + F.col("upto")).alias("end")))).alias("x"))
    spans = spans.select(F.col("leaf").alias("segment"), F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    start = F.col("begin") + F.col("inside")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    own = F.when(F.col("inside") > 0, F.array(F.struct(F.col("begin").alias("start"), start.alias("end")))).otherwise(none)
    out = nodes.join(begins.join(spans, "segment", "left"), "segment").select(
        "tree", "node", "parent", "depth", "role", "formatted", "mask", "n_tokens", "segment", start.alias("start"), (start + F.col("n_tokens")).alias("end"),
        (F.col("position") + F.col("inside")).alias("position"), F.concat(F.coalesce("spans", none), own).alias("ancestors"),
    )
    out = materialize(out)
    for df in (nodes, ways, sized, begins):
        drop_materialized(df)
    return out, chains, members


def read_back(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """leaf, formatted, turns (role and text, unescaped) and learnt (all text under the loss mask, unescaped) of every
    distinct conversation, from the spans of its nodes."""
    spans = chains.select("leaf", "node").join(nodes.select("node", "start", "formatted", "mask"), "node")
    under = lambda x: F.array_join(F.transform(x["mask"], lambda m: unescape(F.substring(x["formatted"], m["from"] + 1, m["to"] - m["from"]))), "")
    whole = spans.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("start", "formatted", "mask"))).alias("x"))
    whole = whole.select("leaf", F.array_join(F.transform("x", lambda x: x["formatted"]), "").alias("formatted"), F.array_join(F.transform("x", under), "").alias("learnt"))
    turn = F.split(F.col("formatted"), "</s>")
    part = lambda t, k: unescape(F.regexp_extract(t, r"(?s)^<s>\[INST\] (.*?) \[/INST\] (.*)$", k))
    parts = F.transform(F.slice(turn, 1, F.size(turn) - 1), lambda t: F.struct(part(t, 1).alias("role"), part(t, 2).alias("text")))
    return whole.withColumn("turns", parts)


def digest(conversations: DataFrame) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    nodes, chains, members = prefix_tree(conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(extra))
    told = read_back(nodes, chains)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per_leaf = told.select(
        "leaf", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return members.join(per_leaf, "leaf").drop("leaf")


ORACLE = r"""
with c as (select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, null, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, null, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as et,
  regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as er from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(er) + length(et) + length('<s>[INST] ') + length(' [/INST] ') + length('</s>'))::bigint as formatted_chars
from e group by conv_id, alone
"""
