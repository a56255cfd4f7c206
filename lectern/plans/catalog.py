"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.operators import answers, audit, elements, jobs, metering, pages, rasters, runs, structure
from lectern.sources import content, docx, pdf, tagging
from lectern.streaming import desk, lifecycle, queue
from lectern.streaming import metering as streams


def _on(f, *tables):
    return lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def _heads(f):
    return lambda part: f(structure.headings(part))


def _instr(f):
    return lambda events: f(structure.instructions(events))


def element_tags(events):
    """Structure tags of elements by type and level, as matched and as written."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("heading", "paragraph", "table", "list", "caption", "image_alt", "other")]), (F.col("event_id") % 7 + 1).cast("int"))
    tag = s.tag(kind, (F.col("event_id") % 10).cast("int") - 1)
    return events.select("event_id", tag.alias("tag"), s.writable_tag(tag).alias("written"))


def decoded_strings(nation):
    """Byte strings in three encodings back to text."""
    name = F.col("n_name")
    raw = F.element_at(F.array(F.encode(name, "UTF-8"), F.concat(F.unhex(F.lit("FEFF")), F.encode(name, "UTF-16BE")), F.concat(F.unhex(F.lit("FFFE")), F.encode(name, "UTF-16LE"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return nation.select("n_nationkey", s.decode_bytes(raw).alias("name"), s.file_title(F.concat(F.lit("/in/"), F.lower(F.regexp_replace(name, " ", "_")), F.lit(".pdf"))).alias("title"))


def recheck_requests(events, orders, docs, lineitem, html):
    """Requests to audit a done job again; the document of its number is audited."""
    return jobs.recheck_requests(events, orders, audit.audit_report(docs, lineitem, html))


_QUERIES = {
    "text_lines": _on(elements.text_lines, "documents"),
    "heading_candidates": _on(elements.heading_candidates, "documents"),
    "page_elements": _on(elements.page_elements, "documents"),
    "elements_per_doc": _on(elements.elements_per_doc, "documents"),
    "text_coverage": _on(elements.text_coverage, "pages"),
    "missing_words_sample": _on(elements.missing_words_sample, "pages"),
    "styled_elements": _on(elements.styled_elements, "documents"),
    "figure_alt_text": _on(elements.figure_alt_text, "documents"),
    "heading_hierarchy_issues": _on(_heads(structure.heading_hierarchy_issues), "part"),
    "outline_parents": _on(_heads(structure.outline_parents), "part"),
    "outline_links": _on(_heads(structure.outline_links), "part"),
    "outline_counts": _on(_heads(structure.outline_counts), "part"),
    "strip_marked_content": _on(_instr(structure.strip_marked_content), "events"),
    "content_blocks": _on(_instr(structure.content_blocks), "events"),
    "artifact_islands": _on(_instr(structure.artifact_islands), "events"),
    "marked_stream": _on(_instr(structure.marked_stream), "events"),
    "block_element_match": _on(structure.block_element_match, "documents"),
    "best_match": _on(structure.best_match, "documents"),
    "parent_tree": _on(structure.parent_tree, "documents"),
    "page_size_breaks": _on(structure.page_size_breaks, "lineitem"),
    "table_grid": _on(structure.table_grid, "lineitem"),
    "element_tags": _on(element_tags, "events"),
    "decoded_strings": _on(decoded_strings, "nation"),
    "report_rollup": _on(audit.report_rollup, "part", "pages"),
    "table_header_issues": _on(audit.table_header_issues, "lineitem"),
    "alt_text_summary": _on(audit.alt_text_summary, "pages"),
    "language_issues": _on(audit.language_issues, "documents"),
    "pixel_similarity": _on(audit.pixel_similarity, "embeddings"),
    "visual_grade": _on(audit.visual_grade, "embeddings"),
    "json_page_parse": _on(audit.json_page_parse, "events"),
    "validator_summary": _on(audit.validator_summary, "events"),
    "charge_quote": _on(metering.charge_quote, "lineitem"),
    "free_tier_monthly": _on(metering.free_tier_monthly, "orders", "lineitem"),
    "free_tier_decisions": _on(metering.free_tier_decisions, "orders", "lineitem"),
    "progress_log": _on(metering.progress_log, "lineitem"),
    "cost_estimate": _on(metering.cost_estimate, "lineitem"),
    "job_status": _on(metering.job_status, "events"),
    "expired": _on(metering.expired, "events"),
    "backend_fallback": _on(metering.backend_fallback, "documents"),
    "payment_release": _on(metering.payment_release, "events", "orders"),
    "upload_gate": _on(metering.upload_gate, "documents"),
    "page_text": _on(pages.page_text, "documents"),
    "page_inputs": _on(pages.page_inputs, "documents", "lineitem"),
    "sized_pages": _on(pages.sized_pages, "documents", "lineitem"),
    "page_rows": _on(pages.page_rows, "documents", "lineitem"),
    "page_tables": _on(pages.page_tables, "lineitem"),
    "column_widths": _on(pages.column_widths, "lineitem"),
    "analyzer_elements": _on(pages.analyzer_elements, "documents", "lineitem"),
    "match_texts": _on(pages.match_texts, "documents"),
    "document_metadata": _on(pages.document_metadata, "documents"),
    "titled_documents": _on(pages.titled_documents, "documents"),
    "outline_entries": _on(pages.outline_entries, "documents"),
    "document_outline": _on(pages.document_outline, "documents"),
    "struct_elements": _on(pages.struct_elements, "events"),
    "tagged_stream": _on(pages.tagged_stream, "events"),
    "audit_issues": _on(audit.audit_issues, "documents", "lineitem", "pages"),
    "audit_report": _on(audit.audit_report, "documents", "lineitem", "pages"),
    "job_upsert": _on(jobs.job_upsert, "orders"),
    "job_timeouts": _on(jobs.job_timeouts, "orders"),
    "dashboard": _on(jobs.dashboard, "orders"),
    "status_requests": _on(jobs.status_requests, "events", "orders"),
    "download_requests": _on(jobs.download_requests, "events", "orders"),
    "recheck_requests": _on(recheck_requests, "events", "orders", "documents", "lineitem", "pages"),
    "process_requests": _on(jobs.process_requests, "events", "customer"),
    "webhook_gate": _on(jobs.webhook_gate, "events", "orders"),
    "redirects": _on(jobs.redirects, "events", "orders"),
    "usage_lookup": _on(jobs.usage_lookup, "customer", "orders", "lineitem"),
    "backend_probe": _on(jobs.backend_probe, "customer"),
    "encoded_pages": _on(jobs.encoded_pages, "documents"),
    "page_instructions": content.page_instructions,
    "event_instructions": content.event_instructions,
    "shown_text": content.shown_text,
    "rewritten_streams": tagging.rewritten_streams,
    "tagged_files": pdf.tagged_files,
    "tagged_file_pages": pdf.tagged_file_pages,
    "raster_similarity": _on(rasters.raster_similarity, "embeddings"),
    "answer_fields": _on(answers.answer_fields, "events"),
    "dispatched_pages": answers.dispatched_pages,
    "executed_jobs": runs.executed_jobs,
    "package_paragraphs": docx.package_paragraphs,
    "package_tables": docx.package_tables,
    "package_report": docx.package_report,
    "stored_jobs": streams.stored_jobs,
    "job_transitions": lifecycle.job_transitions,
    "paid_jobs": lifecycle.paid_jobs,
    "queued_jobs": queue.queued_jobs,
    "desk_answers": desk.desk_answers,
    "stream_commands": streams.stream_commands,
    "stream_releases": streams.stream_releases,
    "stream_expired": streams.stream_expired,
    "stream_progress": streams.stream_progress,
    "stream_monthly_usage": streams.stream_monthly_usage,
    "stream_job_status": streams.stream_job_status,
    "stream_payment_events": streams.stream_payment_events,
}
_SQL = {
    "element_tags": "with k as (select event_id, event_id % 7 as t, greatest(1, least(6, (event_id % 10) - 1)) as l from events), g as (select event_id, case t when 0 then 'H' || l when 1 then 'P' when 2 then 'Table' when 3 then 'L' when 4 then 'Caption' when 5 then 'Figure' else 'P' end as tag from k) select event_id, tag, case tag when 'Table' then 'Caption' when 'L' then 'P' else tag end as written from g",
    "recheck_requests": f"""{jobs._LOG}, c as (select request, r.job as job, failed_raw, case when j.status is null then 404 when j.status <> 'done' then 400 else 200 end as code from r left join j on j.job = r.job left join ({audit.SQL["audit_report"]}) rep on rep.doc_id = r.job)
select request, code, case when code = 200 then case when job % 2 = 0 then 'kept' else 'computed' end end as source, case when code = 200 then case when job % 2 = 0 then job % 6 else coalesce(failed_raw, 0) end end as failed from c""",
    "decoded_strings": "select n_nationkey, n_name as name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: regexp_replace(upper(w[1]) || w[2:], '_', ' ', 'g')), ' ') as title from nation",
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return elements.SQL | structure.SQL | pages.SQL | audit.SQL | metering.SQL | jobs.SQL | content.SQL | tagging.SQL | pdf.SQL | rasters.SQL | answers.SQL | runs.SQL | lifecycle.SQL | queue.SQL | desk.SQL | streams.SQL | _SQL
