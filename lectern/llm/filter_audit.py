r"""Filter interaction audit: what each filter removes in every order of the filters.

Documents become flags (a bit for each filter they fail) where they are read. The flags are indexed as packed bitmaps, one
of 64-bit words for each filter and label; rows are sorted by part and each part begins a new word, so a part's bitmap is a
range of words. Survivors of each set of filters are an AND-NOT of the bitmaps of a set one smaller, counted by popcount;
counts of a partition's index are summed by Spark. All orders follow from the counts of the sets of filters.

Defined cases: a null text is empty; a null part is the empty part; documents repeat an earlier one if some document of a
smaller doc_id has the same text (so rows of one id don't repeat each other, and rows without doc_id repeat none and take
part in no comparison); a label holds if any row of labels says so, rows without an id or with other values say nothing;
repeated rows count each; empty tables give no rows; other columns are not read. Texts of any length are cut to words a MB
at a time; only their distinct words are kept meanwhile.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, slices, texts, tidy, word_pieces

#: Rows of one bitmap index.
INDEX_ROWS = 1 << 20
#: Filters by letter, in the order of their bits; the last needs the whole table.
LETTERS = "ABCDE"
_SYMBOLS, _CAPITALS = b"#$%&*|", bytes(range(65, 91))
_MARKS = np.zeros(256, bool)
_MARKS[list(range(0x80, 0xC0))] = True


def short(words: int, distinct: int, text: bytes) -> bool:
    return words < 50


def repetitive(words: int, distinct: int, text: bytes) -> bool:
    return 100 * distinct < 65 * words


def shouting(words: int, distinct: int, text: bytes) -> bool:
    points = len(text) - int(_MARKS[np.frombuffer(text, np.uint8)].sum())
    return 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * points


def symbols(words: int, distinct: int, text: bytes) -> bool:
    return any(c in text for c in _SYMBOLS)


#: Conditions of a document alone: (words, distinct words, text) -> fails.
CONDITIONS = (short, repetitive, shouting, symbols)


def flags(text: bytes, conditions: tuple[Callable, ...] = CONDITIONS) -> int:
    words, seen = 0, set()
    for piece in word_pieces(text):
        found = piece.split()
        words += len(found)
        seen.update(found)
    return sum(c(words, len(seen), text) << i for i, c in enumerate(conditions))


def flagged(docs: DataFrame, labels: DataFrame, conditions: tuple[Callable, ...] = CONDITIONS) -> DataFrame:
    """doc_id, part, fails (bits; that of repeated texts follows those of the conditions), good, toxic for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            whole = texts(batch.column("text"))
            fails = pa.array([flags(t, conditions) for t in whole], pa.int64())
            same = pa.array([hashlib.sha256(t).digest() for t in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), fails, same], ["doc_id", "part", "fails", "same"])

    rows = materialize(rows.mapInArrow(tidy(run), f"doc_id {kind}, part string, fails bigint, same binary"))
    firsts = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = materialize(firsts, False)
    said = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")) == 1
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("good or toxic")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("bigint")
    no = F.lit(False)
    out = rows.join(firsts, "same", "left").withColumn("fails", F.col("fails") + repeated * (1 << len(conditions)))
    return out.join(told, "doc_id", "left").select("doc_id", "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(parts: pa.Array, fails: np.ndarray, labels: list[np.ndarray], n_filters: int) -> pa.RecordBatch:
    """part, removed (bits of the filters applied), and how many rows of each kind (all, and each label) outlast them."""
    coded = parts.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(coded.dictionary))
    words = (sizes + 63) // 64
    starts = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts * 64, sizes)

    def packed(bits: np.ndarray) -> np.ndarray:
        spread = np.zeros(int(words.sum()) * 64, np.uint8)
        spread[place] = bits[order]
        return np.packbits(spread).view(np.uint64)

    failing = [packed((fails >> f & 1).astype(np.uint8)) for f in range(n_filters)]
    kinds = [packed(np.ones(len(codes), np.uint8)), *(packed(x.astype(np.uint8)) for x in labels)]
    alive, counts = {0: kinds[0]}, []
    for removed in range(1 << n_filters):
        if removed:
            f = removed.bit_length() - 1
            alive[removed] = alive[removed & ~(1 << f)] & ~failing[f]
        counts.append([np.add.reduceat(np.bitwise_count(alive[removed] & k).astype(np.int64), starts) for k in kinds])
    table = np.array(counts).transpose(1, 2, 0)  # kind, part, set of filters
    at = np.nonzero(table[0])
    names = ["n", *(f"label{i}" for i in range(len(labels)))]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at[0])), pa.array(at[1].astype(np.int64)), *(pa.array(k[at]) for k in table)], ["part", "removed", *names])


def subset_counts(rows: DataFrame, n_filters: int, labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, removed, n, label0, ...: rows of a part that pass all filters of each set. A set that leaves none has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if held and (batch is None or size >= INDEX_ROWS):
                whole = pa.Table.from_batches(held).combine_chunks()
                column = lambda c: whole.column(c).to_numpy()  # noqa: B023, E731
                if size:
                    yield survivors(pa.concat_arrays(whole.column("part").chunks), column("fails"), [column(c) for c in labels], n_filters)
                held, size = [], 0

    schema = "part string, removed bigint, n bigint" + "".join(f", label{i} bigint" for i in range(len(labels)))
    counts = rows.select("part", "fails", *labels).mapInArrow(tidy(run), schema)
    return counts.groupBy("part", "removed").agg(*[F.sum(c).alias(c) for c in ("n", *(f"label{i}" for i in range(len(labels))))])


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every
    order of the filters, from the counts of their sets (one small array for each part)."""
    n, every = len(letters), (1 << len(letters)) - 1
    zero = F.lit(0).cast("bigint")
    tables = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("removed", c))).alias(c) for c in ("n", "label0", "label1")])
    of = lambda kind, bits: F.coalesce(F.try_element_at(kind, bits.cast("bigint")), zero)
    value = {f: [(s, s | 1 << f, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range(every + 1) if not s >> f & 1] for f in range(n)}
    shapley = F.array(*[sum(((of("n", F.lit(s)) - of("n", F.lit(t))) * w for s, t, w in value[f]), zero) for f in range(n)])
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    out = tables.withColumn("values", shapley).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    out = out.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    bits = lambda x: sum((F.when(F.contains(x, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    out = out.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("own", bits(F.col("filter"))).withColumn("after", F.col("before") + F.col("own"))
    lost = lambda kind: of(kind, F.col("before")) - of(kind, F.col("after"))
    return out.select(
        "part", "filter_order", "step", "filter", of("n", F.col("after")).alias("kept"), lost("n").alias("removed"),
        (of("n", F.lit(0)) - of("n", F.col("own")) - lost("n")).alias("redundant"), (of("n", F.lit(every) - F.col("own")) - of("n", F.lit(every))).alias("unique_fails"),
        lost("label0").alias("good_lost"), lost("label1").alias("toxic_lost"), F.element_at("values", F.instr(F.lit(letters), F.col("filter"))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = flagged(docs, labels)
    return interactions(subset_counts(rows, len(LETTERS)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(docs, labels).drop("filter")




ORACLE = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by text) as first from d),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by 1),
f as (select part, len(ws) < 50 as A, 100 * len(list_distinct(ws)) < 65 * len(ws) as B, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) as C,
  regexp_matches(text, '[#$%&*|]') as D, coalesce(w.doc_id > first, false) as E, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l on l.doc_id = w.doc_id),
g as (select part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then A when 'B' then B when 'C' then C when 'D' then D else E end) as fs, good, toxic, count(*) as k from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest(range(1, 6)) as step from o),
r as (select part, filter_order, step, filter_order[step] as f, sum(k) filter (not list_has_any(fs, string_split(filter_order[:step], ''))) as kept,
  sum(k) filter (list_contains(fs, filter_order[step]) and not list_has_any(fs, string_split(filter_order[:step - 1], ''))) as removed,
  sum(k) filter (list_contains(fs, filter_order[step]) and list_has_any(fs, string_split(filter_order[:step - 1], ''))) as redundant,
  sum(k) filter (fs = [filter_order[step]]) as unique_fails,
  sum(k) filter (good and list_contains(fs, filter_order[step]) and not list_has_any(fs, string_split(filter_order[:step - 1], ''))) as good_lost,
  sum(k) filter (toxic and list_contains(fs, filter_order[step]) and not list_has_any(fs, string_split(filter_order[:step - 1], ''))) as toxic_lost
  from g cross join s group by part, filter_order, step)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley from r
"""
