"""Line dedup: drop every line whose normalised form is found in many documents.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Python emits each row's distinct key
hashes (128 bits); Spark counts distinct documents per hash, pre-aggregated before the shuffle; the frequent hashes go
back to the rows that hold them, where lines are dropped and the others keep their order. What is joined is written to the
shared folder first, so adaptive execution splits the partition of a line that all documents hold. Joins are by merging at
every size: the frequent lines of a corpus grow with it.

Defined cases: a null or empty text is one empty line; keys shorter than min_chars (so empty lines) never go; rows with
the same doc_id, or with a null one, count as one document; repeated rows are all returned; an empty table gives an empty
result; other columns are kept as they are, whatever their names. A text is cut to lines about a MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, line_pieces, materialize, slices, text_of, texts, tidy


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip().lower() for x in text.split(b"\n")]  # bytes.strip and bytes.lower know ASCII only


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, t, keys): for rows of this id and hash of the text the hashes of their lines that go; rows that lose none
    are absent. Rows without an id are told apart by t, so none gathers the lines of others."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, t, found, rows = batch.column("doc_id"), batch.column("t"), [], []
            for i, text in enumerate(texts(batch.column("text"))):
                own: set[bytes] = set()
                for piece in line_pieces(text):
                    own.update(xxhash.xxh3_128_digest(k) for k in line_keys(piece) if _long_enough(k, min_chars))
                found += own
                rows += [i] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), t.take(at), pa.array(found, pa.binary())], ["doc_id", "t", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = materialize(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(tidy(hashes), f"doc_id {kind}, t bigint, key binary"))
    often = materialize(pairs.select("doc_id", "key").distinct().groupBy("key").count().where(F.col("count") >= min_docs).select("key"))
    keys = materialize(pairs.join(often.hint("merge"), "key").groupBy("doc_id", "t").agg(F.collect_set("key").alias("keys")))
    for df in (pairs, often):
        drop_materialized(df)
    return keys


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns with `text` reduced to the kept lines, plus n_lines and n_dropped."""
    names = docs.columns
    at = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("t"))
    keys = frequent_keys(docs, min_docs, min_chars).toDF("k2", "t2", "keys")
    joined = at.join(keys.hint("merge"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left").select("row", "keys")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row"):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(texts(text_of(batch)), batch.column("keys").to_pylist(), strict=True):
                total, dropped, parts = 0, 0, []
                gone = set(gone or ())
                for piece in line_pieces(text):
                    lines = piece.split(b"\n")
                    total += len(lines)
                    if gone:
                        rest = [x for x in lines if xxhash.xxh3_128_digest(x.strip().lower()) not in gone]
                        dropped += len(lines) - len(rest)
                        if not rest:
                            continue
                        piece = b"\n".join(rest)
                    parts.append(piece)
                kept.append(b"\n".join(parts))
                n_lines.append(total)
                n_dropped.append(dropped)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    row = docs.select(F.struct(*names).alias("row")).schema["row"].dataType.simpleString()
    out = joined.mapInArrow(tidy(rebuild), f"row {row}, kept string, n_lines bigint, n_dropped bigint")
    clash = {"n_lines", "n_dropped"}
    return out.select(*[F.col("kept").alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in names if n not in clash], "n_lines", "n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select r, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct coalesce(doc_id::varchar, 'none')) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), '')) as kept_sha256
from k left join f using (key) group by r
"""
