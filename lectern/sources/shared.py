"""Folders that the driver and all executors share, and files in them."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below /tmp/checkpoints, if all runs in one process on one
    machine (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, kind: str) -> DataFrame:
    """Rows written to the shared folder and read again: for what is used more than once, or cuts a lineage."""
    at = folder(rows.sparkSession, kind)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def removed(spark: SparkSession, path: str) -> None:
    """The folder of any store that Spark writes to goes, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; file:/a, as Spark writes it, is file:///a."""
    if path.startswith("/") or re.match(r"file:/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)
