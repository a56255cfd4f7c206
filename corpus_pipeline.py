"""A training corpus from raw documents: five stages, each over all that the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialize
from lectern.llm.latent_decontamination import latent_decontamination
from lectern.llm.line_dedup import line_dedup
from lectern.llm.mixing import mix
from lectern.llm.quality_rules import quality_rules
from lectern.llm.simhash_dedup import simhash_dedup_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of an operator's `row` struct."""
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _columns(quality_rules(docs, _table(spark, sf_dir, "labels")).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars, where it is a column, follows the text."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays; rows are told apart by id and text."""
    return simhash_dedup_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return _columns(latent_decontamination(docs, _table(spark, sf_dir, "benchmark")).where(F.size("items") == 0), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for a mixture of at least 95% of the greatest source entropy; a row for each time drawn."""
    drawn = mix(docs)
    added = {"n_tokens", "weight", "pass", "block", "place"}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return drawn.select(*own, "n_tokens", F.round("weight", 9).alias("weight"), *[F.col(c).cast("bigint").alias(c) for c in ("pass", "block", "place")])


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixture),
]

#: The SimHash and latent-semantic stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
