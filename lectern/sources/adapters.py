"""Edges of the engine: files, model answers and services as DataFrames; codecs and calls are plug-ins.

A plug-in turns an Arrow-batched column into another; none is bundled that needs a package beyond PySpark's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lectern.functions.scalars import MAX_MB


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, bytes of the files under a folder of any store; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files that land in a folder, as a stream: path, name, mb, code (400: no PDF, 413: too large, 200) without content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    name, mb = F.element_at(F.split("path", "/"), -1), F.col("length") / 1048576
    code = F.when(~F.lower(name).endswith(".pdf"), 400).when(mb > MAX_MB, 413).otherwise(200)
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", name.alias("name"), mb.alias("mb"), code.alias("code"))


def page_source(docs: DataFrame, analyzers: list[Callable[[pd.Series], pd.Series]], column: str = "text") -> DataFrame:
    """docs plus `answer` and `analyzer`: the first analyzer (local model, hosted model, rules) whose answer isn't null.
    A batch goes to the next analyzer with only those rows that are still open, so later ones are not called in vain. Input
    columns of these two names are replaced."""
    fields = [f for f in docs.schema.fields if f.name not in ("answer", "analyzer")]
    schema = StructType([*fields, StructField("answer", StringType()), StructField("analyzer", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answer, by = pd.Series(None, index=pdf.index, dtype=object), pd.Series(-1, index=pdf.index)
            for i, analyze in enumerate(analyzers):
                rest = answer.isna()
                if not rest.any():
                    break
                got = analyze(pdf.loc[rest, column])
                answer.loc[rest], by.loc[rest & answer.notna()] = got, i
            yield pdf.assign(answer=answer, analyzer=by.where(answer.notna(), -1).astype("int32"))

    return docs.select(*[f.name for f in fields]).mapInPandas(run, schema)


def write_elements(elements: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Elements by document as Parquet: the native sink that document writers read. mode: as of any Spark writer."""
    elements.write.mode(mode).parquet(path)
