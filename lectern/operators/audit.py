"""Audit rules as issue tables (doc, category, seq, severity, message), and the report over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.functions import text as t

from . import elements, structure

VALIDATOR = "struct<report: struct<jobs: array<struct<validationResult: struct<compliant: boolean, passedRules: int, failedRules: int, passedChecks: int, failedChecks: int, details: struct<ruleSummaries: array<struct<clause: string, testNumber: int, description: string, failedChecks: int>>>>>>>>"
ELEMENTS = "struct<page: int, elements: array<struct<type: string, level: int, text: string, rows: array<struct<is_header: boolean, cells: array<string>>>, col_widths: array<double>, items: array<string>, ordered: boolean>>>"


def report(*rules: DataFrame) -> DataFrame:
    """doc, category, first_seq, n_errors, n_warnings, passed_raw, failed_raw, status: a row for each category of each
    document. The raw counters weigh as the audit counts them: ok 2 passes, warning 1 pass, error 2 failures."""
    issues = reduce(DataFrame.unionByName, rules)
    count = lambda sev: F.count_if(F.col("severity") == sev)
    return issues.groupBy("doc", "category").agg(
        F.min("seq").alias("first_seq"), count("error").alias("n_errors"), count("warning").alias("n_warnings"),
        (2 * count("ok") + count("warning")).alias("passed_raw"), (2 * count("error")).alias("failed_raw"),
        F.when(count("error") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def report_rollup(part: DataFrame, pages: DataFrame) -> DataFrame:
    heads = structure.heading_hierarchy_issues(structure.headings(part)).select("doc", F.lit("Headings").alias("category"), "seq", "severity")
    cover = elements.text_coverage(pages).select(F.col("page_id").cast("string").alias("doc"), F.lit("Coverage").alias("category"), F.lit(0).cast("bigint").alias("seq"), "severity")
    return report(heads, cover)


def table_header_issues(lineitem: DataFrame) -> DataFrame:
    """Tables (orders; a line of tax 0 marks a header: a stand-in) without any header row."""
    by = lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_tax") == 0).alias("has_header"), F.count("*").alias("n_rows"))
    return by.where("not has_header").select("l_orderkey", "n_rows", F.lit("error").alias("severity"))


def alt_text_summary(pages: DataFrame) -> DataFrame:
    """Links of a page as images, their target as alternative text (a stand-in): how many lack it."""
    found = F.regexp_extract_all("html", F.lit(r"<a href=\"([^\"]*)\""), 1)
    missing = F.size(F.filter(found, lambda x: F.length(x) < 5))
    return pages.select("page_id", F.size(found).alias("n_images"), missing.alias("n_missing"), F.when(missing > 0, "error").otherwise("ok").alias("severity"))


def language_issues(docs: DataFrame) -> DataFrame:
    """Declared languages: documents, and those that declare none."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("lang").isNull() | (F.col("lang") == "")).alias("n_undeclared"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def pixel_similarity(embeddings: DataFrame) -> DataFrame:
    """Each vector and the next as page rasters (a stand-in): share of pixels that differ by less than 30 levels."""
    pixels = embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("px"))
    after = pixels.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("other"))
    near = F.size(F.filter(F.zip_with("px", "other", lambda a, b: F.abs(a - b)), lambda d: d < s.PIXEL_STEP)) / F.size("px")
    return pixels.join(after, "vec_id").select("vec_id", F.round(near, 9).alias("similarity"), F.when(near < s.SIMILAR_PAGE, "warning").otherwise("ok").alias("severity"))


def visual_grade(embeddings: DataFrame) -> DataFrame:
    sim = pixel_similarity(embeddings)
    mean = F.coalesce(F.avg("similarity"), F.lit(0.0))
    return sim.agg(F.count("*").alias("n_pages"), F.count_if(F.col("severity") == "warning").alias("n_low"), F.round(mean, 6).alias("mean"), F.when(mean < s.SIMILAR_MEAN, "error").otherwise("ok").alias("severity"))


def json_page_parse(events: DataFrame) -> DataFrame:
    """Model answers (fenced JSON built from events; every seventh is cut off) to pages; what can't be parsed is an empty
    page."""
    body = F.concat(F.lit('{"page": '), F.col("event_id").cast("string"), F.lit(', "elements": [{"type": "heading", "level": 2, "text": "'), F.col("event_type"), F.lit('"}, {"type": "paragraph", "text": "'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    raw = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 7 == 0, F.substring(body, 1, 20)).otherwise(body), F.lit("\n```"))
    parsed = F.from_json(t.strip_fences(raw), ELEMENTS)
    n = F.coalesce(F.size("p.elements"), F.lit(0))
    return events.select("event_id", parsed.alias("p")).select("event_id", n.alias("n_elements"), F.get("p.elements", F.lit(0))["text"].alias("heading"), F.get("p.elements", F.lit(1))["text"].alias("paragraph"))


def validator_summary(events: DataFrame) -> DataFrame:
    """Validator reports (JSON built from events) to one row: compliance, counts, and the first ten rule failures."""
    k = F.get_json_object("props", "$.k").cast("int")
    rule = lambda i: F.concat(F.lit('{"clause": "7.'), i.cast("string"), F.lit('", "testNumber": 1, "description": "rule", "failedChecks": '), (i + 1).cast("string"), F.lit("}"))
    rules = F.array_join(F.transform(F.sequence(F.lit(0), k % 13), rule), ", ")
    text = F.concat(F.lit('{"report": {"jobs": ['), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('{"validationResult": {"compliant": '), (k % 2 == 0).cast("string"), F.lit(', "passedRules": 100, "failedRules": '), (k % 13 + 1).cast("string"), F.lit(', "details": {"ruleSummaries": ['), rules, F.lit("]}}}"))), F.lit("]}}"))
    job = F.try_element_at(F.from_json(text, VALIDATOR)["report"]["jobs"], F.lit(1))["validationResult"]
    rows = events.select("event_id", job.alias("r"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0))
    first = F.transform(F.slice("r.details.ruleSummaries", 1, 10), lambda x: F.concat(x["clause"], F.lit("."), x["testNumber"].cast("string"), F.lit(" ("), x["failedChecks"].cast("string"), F.lit(")")))
    failed = F.when(~F.coalesce(F.col("r.compliant"), F.lit(False)), F.array_join(first, "; "))
    return rows.select("event_id", F.when(F.col("r").isNull(), "warning").when(F.col("r.compliant"), "ok").otherwise("error").alias("severity"), zero("passedRules").alias("passed_rules"), zero("failedRules").alias("failed_rules"), zero("failedChecks").alias("failed_checks"), F.coalesce(failed, F.lit("")).alias("failures"))


# ---- the whole audit of a document: each rule makes an array of findings from a row of `audit_inputs` ----


def _finding(severity: str, category: str, *message: Column | str) -> Column:
    """The marks that messages begin with."""
    mark = {"info": "✓ ", "warning": "⚠ ", "error": "✗ "}[severity]
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.concat(F.lit(mark), *[m.cast("string") if isinstance(m, Column) else F.lit(m) for m in message]).alias("message"))


def _some(condition: Column, finding: Column) -> Column:
    return F.filter(F.array(F.when(condition, finding)), lambda x: x.isNotNull())


def document_parts(docs: DataFrame, lineitem: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, lang, text, paras (style, text), tables (has_header, cell), alts of images.
    Lines of a document stand in for styled paragraphs (every fifth a heading; of every seventh document none), lines of an
    order for a document's tables, links of a page for its images, their text as the alternative text."""
    style = lambda i: F.when((F.col("doc_id") % 7 == 3) | (i % 5 != 0), "Normal").when(i % 15 == 10, "Heading Title").otherwise(F.concat(F.lit("Heading "), (F.pmod(F.col("doc_id") + F.floor(i / 5), F.lit(3)) + 1).cast("string")))
    paras = F.transform("lines", lambda x, i: F.struct(style(i).alias("style"), F.when(i % 25 == 20, "  ").otherwise(x).alias("text")))
    tables = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_tax") < 0.06).alias("has_header"), F.col("l_returnflag").alias("cell")))).alias("tables"))
    alts = pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)"'), 1).alias("alts"))
    alts = alts.select("doc_id", F.transform("alts", lambda x, i: F.when((F.length(x) > 2) | (i % 2 == 0), x).otherwise(" ")).alias("alts"))
    # texts alone are shuffled; what is made of them comes after the joins, in as many tasks as these have
    found = docs.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), "text").join(tables, "doc_id", "left").join(alts, "doc_id", "left")
    found = found.withColumn("lines", t.lines(F.col("text")))
    return found.select("doc_id", "lang", "text", paras.alias("paras"), "tables", "alts")


def audit_inputs(found: DataFrame) -> DataFrame:
    """doc_id, lang, source, output and missing words of parts (see document_parts), paras, levels of headings, tables (has a
    header), alts."""
    heads = F.transform(F.filter("paras", lambda p: p["style"].startswith("Heading ")), lambda p: F.element_at(F.split(p["style"], " "), -1).try_cast("int"))
    kept = F.concat_ws(" ", F.transform("paras", lambda p: p["text"]), F.transform("tables", lambda x: x["cell"]))
    found = found.select("doc_id", "lang", "paras", F.filter(heads, lambda x: x.isNotNull()).alias("levels"), F.transform("tables", lambda x: x["has_header"]).alias("tables"), "alts", t.coverage_words(F.col("text")).alias("source"), t.coverage_words(kept).alias("output"))
    # columns of their own, as the rule refers to them again and again
    return found.withColumn("missing", F.array_except("source", "output")).withColumn("n_source", F.size("source")).withColumn("n_missing", F.size("missing"))


def language_rule() -> Column:
    declared = F.coalesce(F.col("lang") != "", F.lit(False))
    return F.array(F.when(declared, _finding("info", "Language", "Document language set: ", F.coalesce("lang", F.lit("")))).otherwise(_finding("error", "Language", "Document language not declared (required for screen readers)")))


def hierarchy_rule() -> Column:
    n, first = F.size("levels"), F.get("levels", F.lit(0))
    steps = F.filter(F.zip_with(F.slice("levels", 1, F.greatest(n - 1, F.lit(0))), F.slice("levels", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] > x["a"] + 1)
    skipped = F.transform(steps, lambda x: _finding("error", "Headings", "Skipped heading level: H", x["a"], " → H", x["b"], " (missing H", x["a"] + 1, ")"))
    none = F.array(_finding("error", "Headings", "No heading styles found — document has no structure"))
    found = F.concat(F.array(_finding("info", "Headings", "Found ", n, " headings")), _some(first != 1, _finding("warning", "Headings", "Document does not start with Heading 1 (starts at H", first, ")")), skipped)
    return F.when(n == 0, none).otherwise(found)


def empty_headings_rule() -> Column:
    empty = F.size(F.filter("paras", lambda p: p["style"].startswith("Heading ") & (F.btrim(p["text"], F.lit(t.SPACES)) == "")))
    return F.array(F.when(empty > 0, _finding("error", "Headings", empty, " empty heading paragraph(s) found")).otherwise(_finding("info", "Headings", "No empty headings")))


def tables_rule() -> Column:
    n = F.size("tables")
    bare = F.filter(F.transform("tables", lambda x, i: F.when(~x, i + 1)), lambda i: i.isNotNull())
    errors = F.transform(bare, lambda i: _finding("error", "Tables", "Table ", i, ": no header row (w:tblHeader) — screen readers can't identify column headers"))
    found = F.concat(F.array(_finding("info", "Tables", "Found ", n, " table(s)")), errors, _some(F.size(bare) == 0, _finding("info", "Tables", "All tables have header rows marked")))
    return F.when(F.col("tables").isNull() | (n == 0), F.array(_finding("info", "Tables", "No tables in document"))).otherwise(found)


def alt_text_rule() -> Column:
    n, missing = F.size("alts"), F.size(F.filter("alts", lambda x: F.btrim(x, F.lit(t.SPACES)) == ""))
    found = F.when(missing > 0, _finding("error", "Alt Text", missing, "/", n, " image(s) missing alt text (descr attribute)")).otherwise(_finding("info", "Alt Text", "All ", n, " image(s) have alt text"))
    return F.array(F.when(F.col("alts").isNull() | (n == 0), _finding("info", "Alt Text", "No inline images found")).otherwise(found))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, halves to even, in whole numbers."""
    rest = 2 * F.pmod(1000 * part, whole)
    tenths = F.floor((1000 * part - F.pmod(1000 * part, whole)) / whole)
    tenths = tenths + F.when((rest > whole) | ((rest == whole) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def coverage_rule() -> Column:
    n, m = F.col("n_source"), F.col("n_missing")
    share = percent(n - m, F.greatest(n, F.lit(1)))
    covered = 1 - m / F.greatest(n, F.lit(1))
    grade = F.when(covered * 100 >= 90, _finding("info", "Coverage", "Text coverage: ", share, "% (", n, " source words)")).when(covered * 100 >= 75, _finding("warning", "Coverage", "Text coverage: ", share, "% — some content may be missing")).otherwise(_finding("error", "Coverage", "Text coverage: ", share, "% — significant content loss detected"))
    sample = _some((m >= 1) & (m <= 20), _finding("warning", "Coverage", "Missing words sample: ", F.array_join(F.array_sort("missing"), ", ")))
    return F.when(n == 0, F.array(_finding("warning", "Coverage", "Could not extract text from source PDF for comparison"))).otherwise(F.concat(F.array(grade), sample))


#: In the order in which an audit runs them.
RULES = (language_rule, hierarchy_rule, empty_headings_rule, tables_rule, alt_text_rule, coverage_rule)


def _audited(parts: DataFrame) -> DataFrame:
    return audit_inputs(parts).select("doc_id", F.concat(*[r() for r in RULES]).alias("issues"))


def audit_issues(docs: DataFrame, lineitem: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, seq, severity, category, message: all findings of all rules, in order."""
    return elements.in_order(_audited(document_parts(docs, lineitem, pages)), ["doc_id"], "issues", "seq", "i").select("doc_id", "seq", "i.severity", "i.category", "i.message")


def audit_report(docs: DataFrame, lineitem: DataFrame, pages: DataFrame) -> DataFrame:
    return report_of(document_parts(docs, lineitem, pages))


def report_of(parts: DataFrame) -> DataFrame:
    """A row for each document: the printed report (categories in the order of their first finding), its counts, the raw
    counters (see report), PASS or FAIL, and the exit code."""
    of = lambda sev: F.size(F.filter("issues", lambda i: i["severity"] == sev))
    categories = F.array_distinct(F.transform("issues", lambda i: i["category"]))
    block = lambda c: F.concat(F.lit("["), c, F.lit("]\n"), F.array_join(F.transform(F.filter("issues", lambda i: i["category"] == c), lambda i: i["message"]), "\n"))
    status = F.when(of("error") == 0, "PASS").otherwise("FAIL")
    return _audited(parts).select(
        "doc_id", of("error").alias("n_errors"), of("warning").alias("n_warnings"), (2 * of("info") + of("warning")).alias("passed_raw"), (2 * of("error")).alias("failed_raw"),
        F.array_join(F.transform(categories, block), "\n").alias("report"), status.alias("status"), F.when(of("error") == 0, 0).otherwise(1).alias("exit_code"),
    )


_K = "json_extract_string(props, '$.k')::int"
_PX = """with p as (select vec_id, list_transform(embedding, lambda x: floor((x::double + 1) * 127.5)::int) as px from embeddings),
s as (select a.vec_id, len(list_filter(range(1, len(a.px) + 1), lambda i: abs(a.px[i] - b.px[i]) < 30)) / len(a.px) as sim from p a join p b on b.vec_id = a.vec_id + 1)"""
SQL = {
    "report_rollup": f"""{structure.SQL["heading_hierarchy_issues"].replace(" select doc, ord as seq", ", hi as (select doc, ord as seq", 1)}), {elements.SQL["text_coverage"].removeprefix("with ").replace(" select page_id, len(s) as n_source", ", ci as (select page_id, len(s) as n_source", 1)}),
u as (select doc, 'Headings' as category, seq, severity from hi union all select page_id::varchar, 'Coverage', 0, severity from ci)
select doc, category, min(seq) as first_seq, count(*) filter (severity = 'error') as n_errors, count(*) filter (severity = 'warning') as n_warnings, 2 * count(*) filter (severity = 'ok') + count(*) filter (severity = 'warning') as passed_raw, 2 * count(*) filter (severity = 'error') as failed_raw, case when count(*) filter (severity = 'error') = 0 then 'PASS' else 'FAIL' end as status from u group by doc, category""",
    "table_header_issues": "select l_orderkey, count(*) as n_rows, 'error' as severity from lineitem group by l_orderkey having not bool_or(l_tax = 0)",
    "alt_text_summary": """with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as x from pages) select page_id, len(x) as n_images, len(list_filter(x, lambda y: length(y) < 5)) as n_missing, case when len(list_filter(x, lambda y: length(y) < 5)) > 0 then 'error' else 'ok' end as severity from l""",
    "language_issues": "select source, count(*) as n_docs, count(*) filter (lang is null or lang = '') as n_undeclared, string_agg(distinct lang, ',' order by lang) as langs from documents group by source",
    "pixel_similarity": f"{_PX} select vec_id, round(sim, 9) as similarity, case when sim < 0.85 then 'warning' else 'ok' end as severity from s",
    "visual_grade": f"{_PX} select count(*) as n_pages, count(*) filter (sim < 0.85) as n_low, round(coalesce(avg(round(sim, 9)), 0), 6) as mean, case when coalesce(avg(sim), 0) < 0.7 then 'error' else 'ok' end as severity from s",
    "json_page_parse": "select event_id, case when event_id % 7 = 0 then 0 else 2 end as n_elements, case when event_id % 7 <> 0 then event_type end as heading, case when event_id % 7 <> 0 then json_extract_string(props, '$.k') end as paragraph from events",
    "validator_summary": f"""with e as (select event_id, {_K} as k from events) select event_id, case when k % 5 = 0 then 'warning' when k % 2 = 0 then 'ok' else 'error' end as severity, case when k % 5 = 0 then 0 else 100 end as passed_rules, case when k % 5 = 0 then 0 else k % 13 + 1 end as failed_rules, 0 as failed_checks,
case when k % 5 = 0 or k % 2 = 0 then '' else array_to_string(list_transform(range(0, least(k % 13 + 1, 10)), lambda i: '7.' || i || '.1 (' || (i + 1) || ')'), '; ') end as failures from e""",
}

def _f(severity: str, category: str, message: str) -> str:
    mark = {"info": "✓ ", "warning": "⚠ ", "error": "✗ "}[severity]
    return f"{{'severity': '{severity}', 'category': '{category}', 'message': '{mark}' || {message}}}"


_PCT = "(((q.v - q.v % q.n) // q.n) + case when 2 * (q.v % q.n) > q.n or 2 * (q.v % q.n) = q.n and ((q.v - q.v % q.n) // q.n) % 2 = 1 then 1 else 0 end)"
_AUDIT = f"""with l as (select doc_id, case when doc_id % 9 <> 0 then lang end as lang, {t.sql_lines('text')} as ls, {t.sql_coverage_words('text')} as source from documents),
pa as (select doc_id, lang, source, list_transform(ls, lambda x, i: {{'style': case when doc_id % 7 = 3 or (i - 1) % 5 <> 0 then 'Normal' when (i - 1) % 15 = 10 then 'Heading Title' else 'Heading ' || ((doc_id + (i - 1) // 5) % 3 + 1) end, 'text': case when (i - 1) % 25 = 20 then '  ' else x end}}) as ps from l),
tb as (select l_orderkey as doc_id, list(l_tax < 0.06 order by l_linenumber, l_partkey, l_suppkey, l_tax < 0.06) as hs, string_agg(l_returnflag, ' ') as cells from lineitem group by 1),
al as (select page_id as doc_id, list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x, i: case when length(x) > 2 or (i - 1) % 2 = 0 then x else ' ' end) as xs from pages),
j as (select doc_id, lang, source, ps, hs, xs, list_filter(list_transform(list_filter(ps, lambda p: starts_with(p.style, 'Heading ')), lambda p: try_cast(string_split(p.style, ' ')[-1] as int)), lambda v: v is not null) as lv,
  array_to_string(list_transform(ps, lambda p: p.text), ' ') || ' ' || coalesce(cells, '') as kept from pa left join tb using (doc_id) left join al using (doc_id)),
k as (select *, list_filter(source, lambda w: not list_contains(ow, w)) as missing from (select *, {t.sql_coverage_words('kept')} as ow from j)),
r as (select *, len(list_filter(ps, lambda p: starts_with(p.style, 'Heading ') and {t.sql_strip('p.text')} = '')) as eh, list_filter(range(1, len(hs) + 1), lambda i: not hs[i]) as bare, len(list_filter(xs, lambda x: {t.sql_strip('x')} = '')) as na, list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1) as sk from k),
q as (select *, 1000 * (len(source) - len(missing)) as v, greatest(len(source), 1) as n from r),
z as (select *, ({_PCT} // 10) || '.' || ({_PCT} % 10) as pct, (1 - len(missing) / greatest(len(source), 1)) * 100 as cover from q),
fi as (select doc_id, list_concat(
  [case when lang <> '' then {_f('info', 'Language', "'Document language set: ' || lang")} else {_f('error', 'Language', "'Document language not declared (required for screen readers)'")} end],
  case when len(lv) = 0 then [{_f('error', 'Headings', "'No heading styles found — document has no structure'")}] else list_concat([{_f('info', 'Headings', "'Found ' || len(lv) || ' headings'")}], case when lv[1] <> 1 then [{_f('warning', 'Headings', "'Document does not start with Heading 1 (starts at H' || lv[1] || ')'")}] else [] end,
    list_transform(sk, lambda i: {_f('error', 'Headings', "'Skipped heading level: H' || lv[i - 1] || ' → H' || lv[i] || ' (missing H' || (lv[i - 1] + 1) || ')'")})) end,
  [case when eh > 0 then {_f('error', 'Headings', "eh || ' empty heading paragraph(s) found'")} else {_f('info', 'Headings', "'No empty headings'")} end],
  case when hs is null then [{_f('info', 'Tables', "'No tables in document'")}] else list_concat([{_f('info', 'Tables', "'Found ' || len(hs) || ' table(s)'")}], list_transform(bare, lambda i: {_f('error', 'Tables', "'Table ' || i || ': no header row (w:tblHeader) — screen readers can''t identify column headers'")}), case when len(bare) = 0 then [{_f('info', 'Tables', "'All tables have header rows marked'")}] else [] end) end,
  [case when xs is null or len(xs) = 0 then {_f('info', 'Alt Text', "'No inline images found'")} when na > 0 then {_f('error', 'Alt Text', "na || '/' || len(xs) || ' image(s) missing alt text (descr attribute)'")} else {_f('info', 'Alt Text', "'All ' || len(xs) || ' image(s) have alt text'")} end],
  case when len(source) = 0 then [{_f('warning', 'Coverage', "'Could not extract text from source PDF for comparison'")}] else list_concat([case when cover >= 90 then {_f('info', 'Coverage', "'Text coverage: ' || pct || '% (' || len(source) || ' source words)'")} when cover >= 75 then {_f('warning', 'Coverage', "'Text coverage: ' || pct || '% — some content may be missing'")} else {_f('error', 'Coverage', "'Text coverage: ' || pct || '% — significant content loss detected'")} end],
    case when len(missing) between 1 and 20 then [{_f('warning', 'Coverage', "'Missing words sample: ' || array_to_string(list_sort(missing), ', ')")}] else [] end) end) as xs from z)"""
_OF = lambda sev: f"len(list_filter(xs, lambda i: i.severity = '{sev}'))"
SQL["package_paragraphs"] = f"{_AUDIT}, v as (select doc_id, unnest(range(0, len(ps))) as i, unnest(ps) as p from pa) select doc_id, 'Document ' || doc_id as title, i, p.style as style, p.text as text from v"
SQL["package_tables"] = f"""{_AUDIT}, v as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_tax < 0.06, l_returnflag) - 1 as i, l_tax < 0.06 as has_header, l_returnflag as cell from lineitem)
select doc_id, coalesce(len(xs), 0) as n_images, coalesce(na, 0) as n_without_alt, i, has_header, cell from v join r using (doc_id)"""
SQL["audit_issues"] = f"{_AUDIT}, u as (select doc_id, unnest(range(0, len(xs))) as seq, unnest(xs) as i from fi) select doc_id, seq, i.severity as severity, i.category as category, i.message as message from u"
SQL["audit_report"] = f"""{_AUDIT}, u as (select doc_id, unnest(range(0, len(xs))) as seq, unnest(xs) as i from fi), g as (select doc_id, i.category as category, min(seq) as nth, '[' || i.category || ']' || chr(10) || string_agg(i.message, chr(10) order by seq) as part from u group by doc_id, i.category),
t as (select doc_id, string_agg(part, chr(10) order by nth) as report from g group by doc_id)
select doc_id, {_OF('error')} as n_errors, {_OF('warning')} as n_warnings, 2 * {_OF('info')} + {_OF('warning')} as passed_raw, 2 * {_OF('error')} as failed_raw, report, case when {_OF('error')} = 0 then 'PASS' else 'FAIL' end as status, case when {_OF('error')} = 0 then 0 else 1 end as exit_code from fi join t using (doc_id)"""
SQL["package_report"] = SQL["audit_report"]
