"""Text to page elements: lines, headings, paragraphs. All plans are narrow: arrays within a row, no shuffle.

Arrays become rows by `in_order`: a plain posexplode lets the optimizer infer a filter on the array's size, which computes
the array once more (and inside each lambda over it), so that a document of n lines is split n times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as t

FIRST_LINES, SHORT = 5, 80


def _headings(lines: Column) -> Column:
    first = F.transform(F.slice(lines, 1, FIRST_LINES), lambda x, i: F.struct(i.alias("line_no"), F.when(i == 0, 1).otherwise(2).alias("level"), x.alias("text")))
    return F.filter(first, lambda h: (F.length(h["text"]) < SHORT) & ((h["line_no"] == 0) | t.is_upper(h["text"])))


def in_order(df: DataFrame, keep: list, array: Column | str, place: str, value: str) -> DataFrame:
    """The columns keep, and a row for each value of an array with its place (0 on)."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (0 on), line: stripped lines that are not empty."""
    return in_order(docs, ["doc_id"], t.lines(F.col("text")), "line_no", "line")


def heading_candidates(docs: DataFrame) -> DataFrame:
    """Among a document's first five lines, the short ones that are first or in capitals."""
    return in_order(docs, ["doc_id"], _headings(t.lines(F.col("text"))), "i", "h").select("doc_id", "h.line_no", "h.level", F.col("h.text").alias("line"))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, heads and paragraphs (type, level, text): headings, and each line that is no heading's text and longer than
    two characters."""
    lines = docs.select("doc_id", t.lines(F.col("text")).alias("lines")).withColumn("heads", _headings(F.col("lines")))
    heads = F.transform("heads", lambda h: F.struct(F.lit("heading").alias("type"), h["level"].alias("level"), h["text"].alias("text")))
    used = F.transform("heads", lambda h: h["text"])
    paragraphs = F.transform(F.filter("lines", lambda x: ~F.array_contains(used, x) & (F.length(x) > 2)), lambda x: F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), x.alias("text")))
    return lines.select("doc_id", heads.alias("heads"), paragraphs.alias("paragraphs"))


def parts_of(text: str | None) -> tuple[list[str], list[tuple[int, str]], list[str]]:
    """(lines, headings as (level, text), paragraphs) of one text, as text_lines and parts have them: Python's line
    boundaries and white space are those of functions/text.py."""
    lines = [y for x in (text or "").splitlines() if (y := x.strip())]
    heads = [(1 if i == 0 else 2, x) for i, x in enumerate(lines[:FIRST_LINES]) if len(x) < SHORT and (i == 0 or x == x.upper() != x.lower())]
    used = {x for _, x in heads}
    return lines, heads, [x for x in lines if x not in used and len(x) > 2]


def elements(docs: DataFrame) -> DataFrame:
    """doc_id, elements: headings, then paragraphs."""
    return parts(docs).select("doc_id", F.concat("heads", "paragraphs").alias("elements"))


def page_elements(docs: DataFrame) -> DataFrame:
    return in_order(elements(docs), ["doc_id"], "elements", "ord", "e").select("doc_id", "ord", "e.type", "e.level", "e.text")


def elements_per_doc(docs: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("elements", lambda e: e["type"] == kind))
    return elements(docs).select("doc_id", F.size("elements").alias("n_elements"), of("heading").alias("n_headings"), of("paragraph").alias("n_paragraphs"))


def coverage(pages: DataFrame) -> DataFrame:
    """page_id, source and missing: distinct words of all text, and those of them that paragraphs lack."""
    out = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), 1), " ")
    bare = lambda x: F.regexp_replace(x, t.TAG, " ")
    words = pages.select("page_id", t.coverage_words(bare(F.col("html"))).alias("source"), t.coverage_words(bare(out)).alias("kept"))
    return words.select("page_id", "source", F.array_except("source", "kept").alias("missing"))


def text_coverage(pages: DataFrame) -> DataFrame:
    from lectern.functions.scalars import coverage_grade

    n, m = F.size("source"), F.size("missing")
    pct = F.when(n > 0, F.round((1 - m / n) * 100, 6))
    return coverage(pages).select("page_id", n.alias("n_source"), m.alias("n_missing"), pct.alias("pct")).withColumn("severity", F.when(F.col("n_source") == 0, "warning").otherwise(coverage_grade(F.col("pct"))))


def missing_words_sample(pages: DataFrame) -> DataFrame:
    """Sorted missing words of pages that lack 1 to 20."""
    found = coverage(pages).where((F.size("missing") >= 1) & (F.size("missing") <= 20))
    return found.select("page_id", F.array_join(F.array_sort("missing"), ", ").alias("words"))


_H = f"list_filter(list_transform(ls[1:{FIRST_LINES}], lambda x, i: {{'line_no': i - 1, 'level': case when i = 1 then 1 else 2 end, 'text': x}}), lambda h: length(h.text) < {SHORT} and (h.line_no = 0 or (h.text = upper(h.text) and h.text <> lower(h.text))))"
_L = f"with l as (select doc_id, {t.sql_lines('text')} as ls from documents), e as (select doc_id, ls, {_H} as hs from l)"
_P = "list_filter(ls, lambda x: not list_contains(list_transform(hs, lambda h: h.text), x) and length(x) > 2)"
_C = f"""with w as (select page_id, {t.sql_coverage_words("regexp_replace(html, '<[^>]*>', ' ', 'g')")} as s,
  {t.sql_coverage_words("regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' '), '<[^>]*>', ' ', 'g')")} as k from pages),
c as (select page_id, s, list_filter(s, lambda x: not list_contains(k, x)) as m from w)"""
SQL = {
    "text_lines": f"{_L} select doc_id, unnest(range(0, len(ls))) as line_no, unnest(ls) as line from l",
    "heading_candidates": f"{_L}, u as (select doc_id, unnest(hs) as h from e) select doc_id, h.line_no as line_no, h.level as level, h.text as line from u",
    "page_elements": f"""{_L}, x as (select doc_id, list_concat(list_transform(hs, lambda h: {{'type': 'heading', 'level': h.level, 'text': h.text}}), list_transform({_P}, lambda p: {{'type': 'paragraph', 'level': null::int, 'text': p}})) as es from e),
u as (select doc_id, unnest(range(0, len(es))) as ord, unnest(es) as s from x) select doc_id, ord, s.type as type, s.level as level, s.text as text from u""",
    "elements_per_doc": f"{_L} select doc_id, len(hs) + len({_P}) as n_elements, len(hs) as n_headings, len({_P}) as n_paragraphs from e",
    "text_coverage": f"{_C} select page_id, len(s) as n_source, len(m) as n_missing, case when len(s) > 0 then round((1 - len(m) / len(s)) * 100, 6) end as pct, case when len(s) = 0 then 'warning' when round((1 - len(m) / len(s)) * 100, 6) >= 90 then 'ok' when round((1 - len(m) / len(s)) * 100, 6) >= 75 then 'warning' else 'error' end as severity from c",
    "missing_words_sample": f"{_C} select page_id, array_to_string(list_sort(m), ', ') as words from c where len(m) between 1 and 20",
}


def styled_elements(docs: DataFrame) -> DataFrame:
    """doc_id, ord, style, text of what a document writer is given: headings by level (2 if unknown), list items one by one,
    figures as bracketed text; empty paragraphs and captions are left out, empty headings stay. Lines of a document stand
    in for elements, their kind by line number."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("heading", "paragraph", "list", "caption", "image_alt")]), (F.col("line_no") % 5 + 1).cast("int"))
    rows = text_lines(docs).select("doc_id", "line_no", kind.alias("type"), F.when(F.col("line_no") % 2 == 0, (F.col("line_no") % 9).cast("int")).alias("level"), F.col("line").alias("text"), (F.col("line_no") % 3 == 0).alias("ordered"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2))))
    style = F.when(F.col("type") == "heading", F.concat(F.lit("Heading "), level.cast("string"))).when(F.col("type") == "list", F.when(F.col("ordered"), "List Number").otherwise("List Bullet")).when(F.col("type") == "caption", "Caption").otherwise("Normal")
    items = F.when(F.col("type") == "list", F.filter(F.split("text", r", "), lambda x: x != "")).when(F.col("type") == "image_alt", F.array(F.concat(F.lit("[Figure: "), F.col("text"), F.lit("]")))).otherwise(F.array("text"))
    kept = rows.where(~(F.col("type").isin("paragraph", "caption") & (F.col("text") == "")))
    return kept.select("doc_id", F.col("line_no").alias("ord"), style.alias("style"), F.posexplode(items).alias("item", "text"))


def figure_alt_text(docs: DataFrame) -> DataFrame:
    """doc_id, alt: the first alternative text of a document (here: its first line with a digit), cut to 500 characters,
    "Figure" if there is none or it is empty."""
    first = F.get(F.filter(t.lines(F.col("text")), lambda x: x.rlike("[0-9]")), F.lit(0))
    return docs.select("doc_id", F.coalesce(F.nullif(F.left(first, F.lit(500)), F.lit("")), F.lit("Figure")).alias("alt"))


SQL["styled_elements"] = f"""{_L}, n as (select doc_id, unnest(range(0, len(ls))) as line_no, unnest(ls) as text from l),
k as (select *, case line_no % 5 when 0 then 'heading' when 1 then 'paragraph' when 2 then 'list' when 3 then 'caption' else 'image_alt' end as type, greatest(1, least(6, case when line_no % 2 = 0 then line_no % 9 else 2 end)) as level from n),
i as (select doc_id, line_no, case type when 'heading' then 'Heading ' || level when 'list' then case when line_no % 3 = 0 then 'List Number' else 'List Bullet' end when 'caption' then 'Caption' else 'Normal' end as style,
  case type when 'list' then list_filter(string_split(text, ', '), lambda x: x <> '') when 'image_alt' then ['[Figure: ' || text || ']'] else [text] end as items from k)
select doc_id, line_no as ord, style, unnest(range(0, len(items))) as item, unnest(items) as text from i"""
SQL["figure_alt_text"] = f"{_L}, f as (select doc_id, list_filter(ls, lambda x: regexp_matches(x, '[0-9]')) as xs from l) select doc_id, coalesce(nullif(left(xs[1], 500), ''), 'Figure') as alt from f"
