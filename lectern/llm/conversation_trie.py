r"""Conversation prefix trie over rebuilt conversations.

Every turn gets the cryptographic digest of its role and text, and every prefix of a conversation the chained digest of its
turns; a turn row is then the prefix that ends there, and grouping by (depth, digest) makes the nodes. Subtree sums come
from nodes exploded to their ancestors.

No conversation meets in one task, however long: turns are placed by a range sort and counts of its partitions; the chain
runs within blocks of CHAIN turns, and over the blocks' ends in turn (a chain of chains, so a prefix's digest still depends
on its turns alone). For the sums a node belongs to the run of its least member (by a hash that maps ids one to one), as a
node and the one below it mostly do: weights are added up along a run in two levels, and runs, not nodes, are exploded to
the runs above them, which are as few as a random sequence has records. So a trie of one conversation of n turns costs n
rows, not n * n / 2. Ids of equal conversations are joined to strings a chunk at a time and hashed as a stream.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), role, text; repeated rows are turns of
their own; rows without conv_id belong to no conversation and are left out; c - c % 5 and c % 5 take the sign of c, as in
SQL; a conversation whose rebuilt form has no turn is a member of the root alone; an empty table gives no rows, not even a
root; other columns are not read. A text's digest is taken once; texts of any length are not shuffled after the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, tidy

#: Turns of a block of the chain.
CHAIN = 256
#: Nodes of a run that are summed together first; a run's blocks follow.
RUN = 1024
#: Ids of a chunk of equal conversations.
CHUNK = 4096
#: Conversations whose first turns are exchanged: c takes those of c - c % FAMILY.
FAMILY, HEADS = 5, 9


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, bytes, n (turns of the conversation), each turn in its place. Written."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    one = F.sha2(F.concat_ws("|", F.octet_length("role").cast("string"), "role", "text"), 256)
    # the bounds of the range hold texts' beginnings only; within a partition whole texts order
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    rows = materialize(rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), one.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("k"), F.min("row").alias("first"))
    along = Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", (F.sum("k").over(along.orderBy("part")) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(along).alias("n"))
    out = materialize(rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "digest", "bytes", "n"))
    drop_materialized(rows)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): conv_id of every conversation, and the turns of its rebuilt form: conv_id, pos, digest, bytes."""
    convs = turns.where("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    heads = turns.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes", F.col("n").alias("n_base"))
    lengths = turns.where("pos = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    first = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "bytes")
    taken = convs.join(lengths, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    taken = materialize(taken, False)
    own = turns.select("conv_id", "pos", "digest", "bytes").join(taken, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    out = materialize(first.unionByName(own))
    drop_materialized(taken)
    return convs.select("conv_id"), out


def prefix_digests(items: DataFrame, longest: int) -> DataFrame:
    """conv_id, pos (from 0), digest -> the same with the chained digest of all up to pos. longest: of the positions."""
    step = lambda done, x: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), x["digest"]), 256)))
    none = F.expr("cast(array() as array<string>)")
    blocks = items.groupBy("conv_id", F.floor(F.col("pos") / CHAIN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("x"))
    blocks = blocks.select("conv_id", "block", F.aggregate("x", none, step).alias("chain"))
    spread = lambda df: df.select("conv_id", F.posexplode("chain").alias("i", "digest"), "block", "before")
    pos = (F.col("block") * CHAIN + F.col("i")).alias("pos")
    if longest < CHAIN:
        return spread(blocks.withColumn("before", F.lit(None).cast("string"))).select("conv_id", pos, "digest")
    blocks = materialize(blocks, False)
    ends = blocks.select("conv_id", F.col("block").alias("pos"), F.element_at("chain", -1).alias("digest"))
    above = prefix_digests(ends, longest // CHAIN).select("conv_id", (F.col("pos") + 1).alias("block"), F.col("digest").alias("before"))
    joined = spread(blocks.join(above, ["conv_id", "block"], "left"))
    return joined.select("conv_id", pos, F.when(F.col("before").isNull(), F.col("digest")).otherwise(F.sha2(F.concat("before", "digest"), 256)).alias("digest"))


def _halves(digest: Column, a: str, b: str) -> list[Column]:
    """The first 128 bits of a digest as two numbers, which Spark groups without objects."""
    part = lambda k: F.conv(F.substring(digest, k, 16), 16, -10).cast("bigint")
    return [part(1).alias(a), part(17).alias(b)]


def _ends(prefixes: DataFrame, last: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of nodes at which conversations end: ids in order, joined by commas."""
    key = ["depth", "a", "b"]
    ids = last.join(prefixes, ["conv_id", "depth"]).select(*key, "conv_id")
    ids = ids.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if row[:3] != node or len(held) == CHUNK:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held = row[:3], []
                held.append(row[3])
            yield rows(out)
        yield rows([(*node, held[0], ",".join(map(str, held)))] if held else [])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*key, "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *now, _, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "first", "ids")), strict=True):
                if now != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield hashed(out)
        yield hashed([(*node, state.hexdigest())] if node else [])

    def hashed(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*key, "ends_sha256"])

    parts = ids.mapInArrow(tidy(chunks), "depth bigint, a bigint, b bigint, first bigint, ids string")
    parts = parts.repartition(*key).sortWithinPartitions(*key, "first")
    return parts.mapInArrow(tidy(hashes), "depth bigint, a bigint, b bigint, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: depth, digest (128 bits in hex), parent (its digest), conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = _turns(conversations)
    convs, rows = rebuilt(turns)
    longest = rows.agg(F.max("pos")).first()[0] or 0
    chained = prefix_digests(rows.select("conv_id", "pos", "digest"), longest)
    at = chained.select("conv_id", (F.col("pos") + 1).alias("depth"), *_halves(F.col("digest"), "a", "b"))
    at = at.join(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes"), ["conv_id", "depth"])
    zero = F.lit(0).cast("bigint")
    prefixes = materialize(at.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"))))
    drop_materialized(rows)

    # a prefix and the one before it, for the parents; then nodes
    before = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    linked = prefixes.join(before, ["conv_id", "depth"], "left")
    hashed = F.xxhash64("conv_id")  # of one number: one to one
    nodes = linked.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min(hashed).alias("run"))
    nodes = materialize(nodes)
    up = nodes.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).where("depth >= 0").groupBy("depth", "a", "b").agg(F.count("*").alias("n_children"))
    weighed = nodes.join(up, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    weighed = materialize(weighed.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    drop_materialized(nodes)

    # runs are exploded to the runs above them, and their sums land on the deepest node of these on the way
    whole = weighed.groupBy("run").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    path = prefixes.select(hashed.alias("from"), "depth", "a", "b").join(weighed.select("run").distinct().withColumnRenamed("run", "from"), "from", "left_semi")
    ways = path.join(weighed.select("depth", "a", "b", "run"), ["depth", "a", "b"]).where(F.col("run") != F.col("from")).groupBy("from", "run").agg(F.max("depth").alias("depth"))
    below = ways.join(whole.withColumnRenamed("run", "from"), "from").groupBy("run", "depth").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    own = weighed.select("run", "depth", "a", "b", "leaf", "saved").join(below, ["run", "depth"], "left")
    own = materialize(own.select("run", "depth", "a", "b", F.floor(F.col("depth") / RUN).alias("block"), *[(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in ("leaf", "saved")]))
    deeper = Window.partitionBy("run").orderBy(F.desc("block"))
    blocks = own.groupBy("run", "block").agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    blocks = blocks.select("run", "block", *[(F.sum(f"t_{c}").over(deeper) - F.col(f"t_{c}")).alias(f"t_{c}") for c in ("leaf", "saved")])
    within = Window.partitionBy("run", "block").orderBy(F.desc("depth"))
    sums = own.select("run", "depth", "a", "b", "block", *[F.sum(c).over(within).alias(c) for c in ("leaf", "saved")]).join(blocks, ["run", "block"])
    sums = materialize(sums.select("depth", "a", "b", (F.col("leaf") + F.col("t_leaf")).alias("n_leaves"), (F.col("saved") + F.col("t_saved")).alias("saved_tokens")))
    drop_materialized(own)

    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = materialize(_ends(prefixes.select("conv_id", "depth", "a", "b"), last))
    parents = weighed.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    out = weighed.join(parents, ["depth", "pa", "pb"], "left").join(sums, ["depth", "a", "b"]).join(ends, ["depth", "a", "b"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("depth", name("a", "b").alias("digest"), name("pa", "pb").alias("parent"), "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    return conversation_trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = "list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({0}::varchar) + 1), lambda i: ascii(({0}::varchar)[i])::bigint)), lambda s, x: list_reduce(list_concat([xor(s, x)], range(0, 8)), lambda v, _: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end))"
ORACLE = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
k as (select conv_id, list({{'role': role, 'text': text}} order by p) as xs from t group by conv_id),
c as (select conv_id, xs, conv_id - conv_id % 5 as base, xor({_CRC.format('conv_id')}, 4294967295) % 9 as h from k),
r as (select c.conv_id, list_concat(coalesce(b.xs, [])[1:c.h], c.xs[c.h + 1:]) as xs from c left join k b on b.conv_id = c.base),
p as (select conv_id, len(xs) as n, unnest(range(0, len(xs) + 1)) as depth, xs from r),
x as (select conv_id, n, depth, case when depth = 0 then [] else xs[1:depth] end as key, case when depth > 0 then xs[1:depth - 1] end as up from p),
n as (select depth, key, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, case when depth = 0 then 0 else octet_length(encode(key[-1].text)) end as bytes, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from x group by depth, key),
m as (select n.*, coalesce(k.n_children, 0) as n_children from n left join (select depth - 1 as depth, up as key, count(*) as n_children from n where depth > 0 group by 1, 2) k on k.depth = n.depth and k.key = n.key),
a as (select m.depth, m.key, m.n_children, m.n_convs, m.bytes, unnest(range(0, m.depth + 1)) as d from m),
s as (select d as depth, case when d = 0 then [] else key[1:d] end as key, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * bytes)::bigint as saved_tokens from a group by 1, 2)
select m.conv_id, m.depth::bigint as depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
from m join s on s.depth = m.depth and s.key = m.key left join n u on u.depth = m.depth - 1 and u.key = m.up
"""
