"""What the operators of this subpackage share: shared storage, text blocks, Arrow helpers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one block (and so one Python call) holds on average.
BLOCK_BYTES = 8 << 20


#: UTF-8 bytes of a text that are cut to words or lines at once.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, /tmp/checkpoints, if all runs in one process on
    one machine (tests); on a cluster that is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return "/tmp/checkpoints"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def materialize(df: DataFrame, collect: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation.
    collect: afterwards let go of the shuffle files of plans that ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if collect:  # shuffle files go only when both sides collect their garbage
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lectern-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_block(df: DataFrame, text: str, *keys: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add `block`: a hash of the row's keys, text and place in its file, modulo a count that grows with the bytes of text.
    Equal at every recomputation; no source, language or group of copies shares a block by design, and neither do rows that
    are equal in all columns. Rows that don't come straight from files are written first, so that they have a place."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = materialize(df)
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(math.ceil(total / block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return df.withColumn("block", F.pmod(F.xxhash64(*keys, F.md5(text), *place), F.lit(n)).cast("int"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Hand memory that a large block needed back to the system, before the worker waits for its next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that ends each task with release(), so that a worker keeps no memory from stage to stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def word_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about size bytes that begin with white space; no word is cut."""
    start = 0
    while len(text) - start > size and (m := _SPACE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def line_pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about size bytes, cut at line ends; joined by \\n they are the text."""
    start = 0
    while len(text) - start > size and (end := text.find(b"\n", start + size)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


def text_of(batch: pa.RecordBatch, name: str = "row") -> pa.Array:
    """The text column, or the text in a struct column of that name."""
    column = batch.column(name)
    return column.flatten()[column.type.get_field_index("text")] if pa.types.is_struct(column.type) else column


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about max_bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(text_of(batch, text).cast(pa.large_binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text (null: empty text), modulo."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """doc_id, y of all labelled ids, one row each. Rows that lack an id or a label don't count; an id with both labels is
    left out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("z"))
    return one.where("y = z").drop("z")


def labelled_sample(labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """At most per_class ids of each label, those of the smallest hashes: bounded and repeatable."""
    one, order = labelled(labels, target), F.xxhash64("doc_id")
    return one.where("y = 0").orderBy(order).limit(per_class).unionByName(one.where("y = 1").orderBy(order).limit(per_class))


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, y of the sampled ids (doc_id, y: few enough to broadcast): of rows with one id, the text of the least
    hash, so that what is fitted on stays bounded however often an id repeats."""
    few = F.broadcast(sample.withColumnRenamed("doc_id", "k"))
    found = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("k")).select("doc_id", "text", "y")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, root), root the least node. Alternates the large-star and
    small-star steps over DataFrames. Minima are pre-aggregated and written to the shared folder before they are joined, so
    that both sides of a join are plain exchanges: adaptive execution splits a hub's partition, however many edges it has.
    Each round's tables are deleted after it."""
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), False)
        large = materialize(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), False)
        # small-star: each node's smaller neighbours meet at the least of them
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), False)
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
        after = materialize(small.where("a <> b").distinct())
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for df in (now, low, large, least):
            drop_materialized(df)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
