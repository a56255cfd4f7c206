"""A batch of jobs as one plan: scan of a page's bytes, analysis, tags and audit, where one bad document fails alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.functions import text as t
from lectern.operators import elements
from lectern.sources import content


def scanned(pages: DataFrame, instructions: DataFrame) -> DataFrame:
    """pages (page) and their instructions (page, i, op, operands, error) -> doc_id, message, text: what each page shows, a
    line for each string. A fault in a stream, or a stream of nothing, is the message."""
    line = F.when(F.col("op") == "Tj", F.struct("i", F.element_at("operands", 1)["value"].alias("x")))
    found = instructions.where("op in ('BT', 'Tj') or error is not null").groupBy(F.col("page").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("x"), F.max("error").alias("message"))
    found = pages.select(F.col("page").alias("doc_id")).distinct().join(found, "doc_id", "left").withColumn("message", F.when(F.col("x").isNull(), "nothing to read").otherwise(F.col("message")))
    return found.select("doc_id", "message", F.array_join(F.transform("x", lambda y: y["x"]), "\n").alias("text"))


def finished(texts: DataFrame) -> DataFrame:
    """Scanned pages (doc_id, message, text) -> job, status, progress, message, n_elements, tags, missing for each page's job.
    A job with a message has failed; the others are done."""
    made = elements.elements(texts.where("message is null")).select(
        "doc_id", F.size("elements").alias("n_elements"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("elements", lambda e: s.tag(e["type"], e["level"])))), ",").alias("tags"),
        t.coverage_words(F.array_join(F.transform("elements", lambda e: e["text"]), "\n")).alias("kept"),
    )
    found = texts.select("doc_id", "message", t.coverage_words(F.col("text")).alias("source")).join(made, "doc_id", "left")
    failed = F.col("message").isNotNull()
    return found.select(
        F.col("doc_id").alias("job"), F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, 0).otherwise(100).alias("progress"),
        "message", "n_elements", "tags", F.when(~failed, F.size(F.array_except("source", "kept"))).alias("missing"),
    )


def executed(pages: DataFrame, instructions: DataFrame) -> DataFrame:
    """The whole run of pages and their instructions (see scanned and finished)."""
    return finished(scanned(pages, instructions))


def executed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = content.document_content(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return executed(streams, content.written(streams))


_TAG = "case when e.type = 'heading' then 'H' || e.level else 'P' end"
SQL = {
    "executed_jobs": f"""{elements._L}, x as (select doc_id, list_concat(list_transform(hs, lambda h: {{'type': 'heading', 'level': h.level, 'text': h.text}}), list_transform({elements._P}, lambda p: {{'type': 'paragraph', 'level': null::int, 'text': p}})) as es, ls from e),
m as (select doc_id, es, {t.sql_coverage_words("array_to_string(ls, chr(10))")} as source, {t.sql_coverage_words("array_to_string(list_transform(es, lambda e: e.text), chr(10))")} as kept from x)
select doc_id as job, case when doc_id % 50 = 7 then 'failed' else 'done' end as status, case when doc_id % 50 = 7 then 0 else 100 end as progress, case when doc_id % 50 = 7 then 'string without its end' end as message,
  case when doc_id % 50 <> 7 then len(es) end as n_elements, case when doc_id % 50 <> 7 then array_to_string(list_sort(list_distinct(list_transform(es, lambda e: {_TAG}))), ',') end as tags,
  case when doc_id % 50 <> 7 then len(list_filter(source, lambda w: not list_contains(kept, w))) end as missing from m""",
}
