"""Model answers of any shape: JSON as variants, and pages dispatched to analyzers by what is still open.

An answer is parsed once to a variant. Each field has its default applied where it is read, and a field that is missing, null
or of another type is told apart; no schema drops what it doesn't name. Analyzers are table functions; each sees only the
pages that none before it has answered, as a filter, a lateral call and a union, written between, so none is called twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from lectern.functions import text as t
from lectern.sources.shared import folder

# ---- answers ----


def state(answer: Column, path: str, kind: str) -> Column:
    """missing, null, wrong or ok: of a field that should have a type."""
    found = F.try_variant_get(answer, path, "variant")
    return F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").when(F.try_variant_get(answer, path, kind).isNull() | ~F.schema_of_variant(found).isin(*KINDS[kind]), "wrong").otherwise("ok")


#: Variants' types that may stand where a type is asked for.
KINDS = {"int": ("BIGINT",), "string": ("STRING",), "boolean": ("BOOLEAN",)}


def field(answer: Column, path: str, kind: str, default) -> Column:
    """A field of its type; the default if it is missing, null or of another type."""
    return F.when(state(answer, path, kind) == "ok", F.try_variant_get(answer, path, kind)).otherwise(F.lit(default).cast(kind))


def parsed(answers: DataFrame) -> DataFrame:
    """id, answer (text) -> id, valid, v: the answer without its fences as a variant; of what is no JSON object, an empty page."""
    v = F.try_parse_json(t.strip_fences(F.col("answer")))
    ok = F.coalesce(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return answers.select("id", ok.alias("valid"), F.when(ok, v).otherwise(F.parse_json(F.lit('{"elements": []}'))).alias("v"))


def answers_of(events: DataFrame) -> DataFrame:
    """id, answer: answers as models give them, from events: fenced or not, cut off, a list, with fields that are missing,
    null, of another type or of no schema."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    level = F.element_at(F.array(F.lit('"level": 2, '), F.lit('"level": "two", '), F.lit('"level": null, '), F.lit(""), F.lit('"level": 2.5, ')), (e % 5 + 1).cast("int"))
    first = F.concat(F.lit('{"type": "heading", '), level, F.lit('"text": "'), F.col("event_type"), F.lit(' \\u00e9"}'))
    second = F.concat(F.lit('{"type": "table", "ordered": '), F.when(e % 2 == 0, "true").otherwise('"yes"'), F.lit(', "rows": [{"cells": ['), k, F.lit(', null, "x"]}], "note": {"k": '), k, F.lit("}}"))
    body = F.concat(F.lit('{"elements": ['), first, F.lit(", "), second, F.lit("]}"))
    body = F.when(e % 11 == 0, F.substring(body, 1, 30)).when(e % 13 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return events.select(e.alias("id"), F.when(e % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("answer"))


def answer_fields(events: DataFrame) -> DataFrame:
    """id, valid, level and its state, heading, ordered and its state, cell, note: fields of answers with their defaults."""
    rows, v = parsed(answers_of(events)), F.col("v")
    return rows.select(
        "id", "valid", field(v, "$.elements[0].level", "int", 2).alias("level"), state(v, "$.elements[0].level", "int").alias("level_state"), field(v, "$.elements[0].text", "string", "").alias("heading"),
        field(v, "$.elements[1].ordered", "boolean", False).alias("ordered"), state(v, "$.elements[1].ordered", "boolean").alias("ordered_state"),
        F.try_variant_get(v, "$.elements[1].rows[0].cells[2]", "string").alias("cell"), F.try_variant_get(v, "$.elements[1].note.k", "bigint").alias("note"),
    )


# ---- analyzers ----


class Analyzer:
    """A table function over pages. Subclasses: answer(text) -> text, or None where another backend must be asked."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("an analyzer reads text")
        return AnalyzeResult(StructType().add("answer", StringType()).add("calls", IntegerType()))

    def __init__(self):
        self.calls = 0

    def eval(self, text: str):
        self.calls += 1
        yield self.answer(text or ""), self.calls

    def answer(self, text: str) -> str | None:
        raise NotImplementedError


class Local(Analyzer):
    """Answers short pages."""

    def answer(self, text: str) -> str | None:
        return f"local:{len(text)}" if 0 < len(text) <= 600 else None


class Hosted(Analyzer):
    """Answers pages of up to 4,000 characters."""

    def answer(self, text: str) -> str | None:
        return f"hosted:{len(text)}" if 0 < len(text) <= 4000 else None


class Rules(Analyzer):
    """Answers all."""

    def answer(self, text: str) -> str | None:
        return f"rules:{len(text)}"


BACKENDS = {"local": Local, "hosted": Hosted, "rules": Rules}


def dispatched(spark: SparkSession, pages: DataFrame, backends: dict[str, type[Analyzer]]) -> DataFrame:
    """id, text -> id, backend, answer: of the first backend that answers; a page that none answers has nulls. A backend's
    answers are written before the next one is asked, with the pages still open."""
    at, done, rest = folder(spark, "answers"), [], pages.select("id", "text")
    for name, analyzer in backends.items():
        spark.udtf.register(f"analyze_{name}", udtf(analyzer))
        rest.createOrReplaceTempView("open_pages")
        asked = spark.sql(f"select p.id, p.text, a.answer from open_pages p, lateral analyze_{name}(p.text) a")
        asked.write.parquet(f"{at}/{name}")
        written = spark.read.schema(asked.schema).parquet(f"{at}/{name}")
        done.append(written.where("answer is not null").select("id", F.lit(name).alias("backend"), "answer"))
        rest = written.where("answer is null").select("id", "text")
    out = rest.select("id", F.lit(None).cast("string").alias("backend"), F.lit(None).cast("string").alias("answer"))
    for df in done:
        out = out.unionByName(df)
    return out


def dispatched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dispatched(spark, docs.select(F.col("doc_id").alias("id"), "text"), BACKENDS)


SQL = {
    "answer_fields": """with e as (select event_id as id, event_type, json_extract_string(props, '$.k') as k from events),
v as (select *, id % 11 <> 0 and id % 13 <> 0 as valid from e)
select id, valid, 2 as level, case when not valid then 'missing' when id % 5 = 0 then 'ok' when id % 5 = 2 then 'null' when id % 5 = 3 then 'missing' else 'wrong' end as level_state, case when valid then event_type || ' é' else '' end as heading,
  valid and id % 2 = 0 as ordered, case when not valid then 'missing' when id % 2 = 0 then 'ok' else 'wrong' end as ordered_state, case when valid then 'x' end as cell, case when valid then k::bigint end as note from v""",
    "dispatched_pages": "with n as (select doc_id as id, length(coalesce(text, '')) as n from documents), b as (select id, n, case when n between 1 and 600 then 'local' when n between 1 and 4000 then 'hosted' else 'rules' end as backend from n) select id, backend, backend || ':' || n as answer from b",
}
