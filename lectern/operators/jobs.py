"""Jobs, requests and releases over keyed logs: latest records, status bodies, downloads, commands, webhooks, probes.

Orders stand in for jobs (their status for how far a job has come), customers for uploads and addresses, events for requests.
Every request becomes a row with its HTTP code, also those that fail. Joins are on a job's or an upload's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars as s

from . import metering

# Labels that the status body shows for a backend, and the kinds of files that a download names.
LABELS = {"ollama": "Local AI (Ollama)", "claude": "Claude API", "mock": "Text extraction (no AI — install Ollama for better results)", "unknown": "Detecting…"}
PDF, DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MODEL = "vision:7b"
TIMEOUT = 3600
PAID = "checkout.session.completed"
#: A schema of JSON bodies that start a job.
COMMAND = "upload_id string, use_claude boolean, email string"
SECRET = "whsec_test"


def iso(ts: Column) -> Column:
    """UTC time as ISO 8601 text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def with_ids(uploads: DataFrame) -> DataFrame:
    """New jobs: uploads with a random id, queued now. Ids differ at each evaluation: write the result before it is used."""
    return uploads.select(F.expr("uuid()").alias("id"), "*", F.lit("queued").alias("status"), F.lit(0).alias("progress"), iso(F.current_timestamp()).alias("created_at"))


def paths(key: Column) -> dict[str, Column]:
    docx = F.concat(F.lit("/out/"), key.cast("string"), F.lit(s.DOCX_END))
    return {"pdf_path": F.concat(F.lit("/up/"), key.cast("string"), F.lit(".pdf")), "output_path": docx, "output_pdf": F.replace(docx, F.lit(".docx"), F.lit(s.PDF_END))}


# ---- the job store ----


def job_log(orders: DataFrame) -> DataFrame:
    """job, seq, ts, status, progress, current_page, total_pages, error: a row for each state that a job was put in."""
    k, total = F.col("o_orderkey"), (F.col("o_orderkey") % 30 + 1).cast("int")
    state = lambda seq, status, page, progress, error=None: F.struct(F.lit(seq).alias("seq"), F.make_interval(hours=F.lit(seq)).alias("after"), F.lit(status).alias("status"), progress.cast("int").alias("progress"), page.cast("int").alias("current_page"), F.lit(error).cast("string").alias("error"))
    page = F.greatest(F.lit(1), F.floor(total / 2))
    queued, running = state(0, "queued", F.lit(0), F.lit(0)), state(1, "running", page, s.progress(page, total))
    end = F.when(k % 10 == 0, state(2, "failed", page, s.progress(page, total), "broken file")).otherwise(state(2, "done", total, F.lit(100)))
    steps = F.when(F.col("o_orderstatus") == "O", F.array(queued)).when(F.col("o_orderstatus") == "P", F.array(queued, running)).otherwise(F.array(queued, running, end))
    return orders.select(k.alias("job"), "o_orderdate", total.alias("total_pages"), F.explode(steps).alias("x")).select("job", "x.seq", (F.col("o_orderdate") + F.col("x.after")).alias("ts"), "x.status", "x.progress", "x.current_page", F.when(F.col("x.seq") > 0, F.col("total_pages")).otherwise(0).alias("total_pages"), "x.error")


def latest(log: DataFrame) -> DataFrame:
    """The store after all upserts: a job's record of the greatest (ts, seq), with the time of its first and, if it has
    ended, of its last. Pre-aggregated; put again, a record changes nothing."""
    fields = [c for c in log.columns if c not in ("job", "ts", "seq")]
    now = log.groupBy("job").agg(F.max(F.struct("ts", "seq", *fields)).alias("x"), F.min("ts").alias("created"))
    return now.select("job", *[f"x.{c}" for c in fields], iso(F.col("created")).alias("created_at"), F.when(F.col("x.status").isin("done", "failed"), iso(F.col("x.ts"))).alias("completed_at"))


def job_upsert(orders: DataFrame) -> DataFrame:
    """The store that begins with the queued records and takes the later ones, every third of them twice."""
    log = job_log(orders)
    return latest(log.where("seq = 0").unionByName(log.where("seq > 0")).unionByName(log.where("seq > 0 and job % 3 = 0")))


def job_timeouts(orders: DataFrame) -> DataFrame:
    """job, waited (seconds), status: running jobs at the time of the newest record; those over TIMEOUT have failed."""
    log = job_log(orders)
    now = log.agg(F.max("ts").alias("now"))  # one row
    last = log.groupBy("job").agg(F.max(F.struct("ts", "seq", "status")).alias("x")).where("x.status = 'running'")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    waited = seconds("now") - seconds("x.ts")
    return last.join(F.broadcast(now)).select("job", waited.alias("waited"), F.when(waited > TIMEOUT, "failed").otherwise("running").alias("status"))


def _jobs(orders: DataFrame) -> DataFrame:
    backend = F.when(F.col("job") % 4 == 0, "ollama").when(F.col("job") % 4 == 1, "claude").when(F.col("job") % 4 == 2, "mock").otherwise("unknown")
    return latest(job_log(orders)).select("*", *[c.alias(n) for n, c in paths(F.col("job")).items()], backend.alias("backend"))


def output_files(orders: DataFrame) -> DataFrame:
    """path: the listing of the output folder (of every fourth job the PDF is missing, of every ninth the other)."""
    p = paths(F.col("o_orderkey"))
    some = F.array(F.when(F.col("o_orderkey") % 4 != 0, p["output_pdf"]), F.when(F.col("o_orderkey") % 9 != 0, p["output_path"]))
    return orders.where("o_orderstatus = 'F'").select(F.explode(some).alias("path")).where("path is not null")


def _with_files(jobs: DataFrame, orders: DataFrame) -> DataFrame:
    """Jobs with has_pdf and has_docx: whether the files are there, for those that are done."""
    files = output_files(orders)
    there = jobs.join(files.select(F.col("path").alias("output_pdf"), F.lit(True).alias("p")), "output_pdf", "left").join(files.select(F.col("path").alias("output_path"), F.lit(True).alias("d")), "output_path", "left")
    done = F.col("status") == "done"
    return there.select("*", (done & F.coalesce("p", F.lit(False))).alias("has_pdf"), (done & F.coalesce("d", F.lit(False))).alias("has_docx")).drop("p", "d")


def dashboard(orders: DataFrame) -> DataFrame:
    """Jobs, the newest first: id's beginning, file, status, progress, pages, times to the second, and the audit's mark."""
    jobs = _jobs(orders).withColumn("id", F.md5(F.col("job").cast("string")))
    failed = F.when(F.col("status") == "done", F.col("job") % 6)
    mark = F.when(failed == 0, "✓").when(failed > 0, "✗").otherwise("—")
    shown = jobs.orderBy(F.desc("created_at"), "job")
    return shown.select(F.concat(F.left("id", F.lit(8)), F.lit("…")).alias("id"), F.element_at(F.split("pdf_path", "/"), -1).alias("file"), "status", F.concat(F.col("progress").cast("string"), F.lit("%")).alias("progress"), F.concat_ws("/", F.col("current_page").cast("string"), F.col("total_pages").cast("string")).alias("pages"), F.left("created_at", F.lit(19)).alias("created"), F.coalesce(F.left("completed_at", F.lit(19)), F.lit("—")).alias("completed"), mark.alias("check"))


# ---- requests ----


def _requests(events: DataFrame) -> DataFrame:
    """request, job (some of none), fmt."""
    job = F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("event_id") % 400)
    return events.select(F.col("event_id").alias("request"), job.cast("bigint").alias("job"), F.when(F.col("event_id") % 3 == 0, "docx").otherwise("pdf").alias("fmt"))


def status_requests(events: DataFrame, orders: DataFrame) -> DataFrame:
    """request, code, body: a job's status as JSON, 404 where there is no such job."""
    jobs = _with_files(_jobs(orders), orders)
    done = F.col("status") == "done"
    body = F.to_json(F.struct("job", "status", "progress", "current_page", "total_pages", "error", F.when(done, F.struct((F.col("job") % 6).alias("failed"))).alias("check_report"), "completed_at", "backend", s.lookup(LABELS, F.col("backend"), F.col("backend")).alias("backend_label"), "has_pdf", "has_docx"), {"ignoreNullFields": "false"})
    found = _requests(events).join(jobs, "job", "left")
    return found.select("request", F.when(F.col("status").isNull(), 404).otherwise(200).alias("code"), F.when(F.col("status").isNotNull(), body).alias("body"))


def download_requests(events: DataFrame, orders: DataFrame) -> DataFrame:
    """request, code, path, media, filename: the PDF unless the other is asked for or it is missing; 404 without a job, 400
    before it is done, 500 where both files are missing."""
    found = _requests(events).join(_with_files(_jobs(orders), orders), "job", "left")
    pdf = (F.col("fmt") != "docx") & F.col("has_pdf")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "done", 400).when(pdf | F.col("has_docx"), 200).otherwise(500)
    stem = F.regexp_replace(F.element_at(F.split("pdf_path", "/"), -1), r"\.[^.]*$", "")
    ok = found.withColumn("code", code).withColumn("pdf", pdf)
    pick = lambda a, b: F.when(F.col("code") == 200, F.when(F.col("pdf"), a).otherwise(b))
    return ok.select("request", "code", pick(F.col("output_pdf"), F.col("output_path")).alias("path"), pick(F.lit(PDF), F.lit(DOCX)).alias("media"), pick(F.concat(stem, F.lit(s.DOWNLOAD_END)), F.element_at(F.split("output_path", "/"), -1)).alias("filename"))


def recheck_requests(events: DataFrame, orders: DataFrame, report: DataFrame) -> DataFrame:
    """request, code, source, failed: a done job's kept audit, else (for odd jobs, which have none kept) a new one by the
    document rules. report: doc_id, failed_raw."""
    made = report.select(F.col("doc_id").alias("job"), F.col("failed_raw").alias("computed"))
    found = _requests(events).join(_jobs(orders), "job", "left").join(made, "job", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "done", 400).otherwise(200)
    kept = F.col("job") % 2 == 0
    return found.select("request", code.alias("code"), F.when(code == 200, F.when(kept, "kept").otherwise("computed")).alias("source"), F.when(code == 200, F.when(kept, F.col("job") % 6).otherwise(F.coalesce("computed", F.lit(0)))).cast("bigint").alias("failed"))


def command_bodies(events: DataFrame) -> DataFrame:
    """request, body: JSON commands to process an upload; some name none, some can't be parsed."""
    upload = F.concat(F.lit('"upload_id": "'), (F.col("event_id") % 300).cast("string"), F.lit('", '))
    body = F.concat(F.lit("{"), F.when(F.col("event_id") % 13 != 0, upload).otherwise(""), F.lit('"use_claude": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', "email": " a@b.c "}'))
    return events.select(F.col("event_id").alias("request"), F.when(F.col("event_id") % 17 == 0, F.lit("{bad")).otherwise(body).alias("body"))


def process_requests(events: DataFrame, customer: DataFrame) -> DataFrame:
    """request, code, upload_id, status, pages, amount, use_claude, email and output paths: 400 without an upload id, 404 for
    an unknown upload, else a job that waits for payment or is queued."""
    c = command_bodies(events).select("request", F.from_json("body", COMMAND).alias("b")).select("request", "b.*")
    uploads = customer.where("c_custkey % 6 <> 0").select(F.col("c_custkey").cast("string").alias("upload_id"), (F.col("c_custkey") % 12 + 1).cast("int").alias("pages"))
    found = c.join(uploads, "upload_id", "left")
    code = F.when(F.col("upload_id").isNull() | (F.col("upload_id") == ""), 400).when(F.col("pages").isNull(), 404).otherwise(200)
    ok = lambda x: F.when(F.col("code") == 200, x)
    p = paths(F.col("upload_id"))
    found = found.withColumn("code", code)
    return found.select("request", "code", ok(F.col("upload_id")).alias("upload_id"), ok(F.when(s.amount(F.col("pages")) > 0, "awaiting_payment").otherwise("queued")).alias("status"), ok(F.col("pages")).alias("pages"), ok(s.amount(F.col("pages"))).alias("amount"), ok(F.coalesce("use_claude", F.lit(False)).cast("int")).alias("use_claude"), ok(F.trim(F.coalesce("email", F.lit("")))).alias("email"), ok(p["output_path"]).alias("output_path"), ok(p["output_pdf"]).alias("output_pdf"))


# ---- payments ----


def hmac(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text, from two hashes over the padded key."""
    key = secret.encode().ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def webhook_gate(events: DataFrame, orders: DataFrame) -> DataFrame:
    """request, code, job, released: payment events with their signatures; an invalid one gets 400, a paid one releases the
    job that its metadata names, if that is still queued. Delivered again, an event releases nothing more: a job is
    released by its earliest event alone."""
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "charge.refunded").otherwise(PAID)
    payload = F.concat(F.lit('{"type": "'), kind, F.lit('", "data": {"object": {"metadata": {"job_id": "'), (k % 500).cast("string"), F.lit('"}}}}'))
    sent = events.select(k.alias("request"), payload.alias("payload"), F.when(k % 7 == 0, "forged").otherwise(hmac(payload, SECRET)).alias("signature"))
    valid = F.col("signature") == hmac(F.col("payload"), SECRET)
    told = sent.select("request", F.when(valid, 200).otherwise(400).alias("code"), F.when(valid, F.from_json("payload", "type string, data struct<object: struct<metadata: struct<job_id: string>>>")).alias("e"))
    told = told.select("request", "code", F.when(F.col("e.type") == PAID, F.col("e.data.object.metadata.job_id").try_cast("bigint")).alias("job"))
    queued = latest(job_log(orders)).where("status = 'queued'").select("job", F.lit(True).alias("queued"))
    first = told.where("job is not null").groupBy("job").agg(F.min("request").alias("request"), F.lit(True).alias("earliest"))
    found = told.join(queued, "job", "left").join(first, ["job", "request"], "left")
    return found.select("request", "code", "job", (F.coalesce("queued", F.lit(False)) & F.coalesce("earliest", F.lit(False))).alias("released"))


def redirects(events: DataFrame, orders: DataFrame) -> DataFrame:
    """request, url, code, status: customers sent back after paying (a queued job runs) or not (nothing changes)."""
    r = _requests(events).withColumn("paid", F.col("request") % 2 == 0)
    found = r.join(latest(job_log(orders)).select("job", "status"), "job", "left")
    missing = F.col("paid") & F.col("status").isNull()
    url = F.when(missing, F.lit(None)).when(F.col("paid"), F.concat(F.lit("/?job_id="), F.col("job").cast("string"), F.lit("&paid=1"))).otherwise("/?cancelled=1")
    return found.select("request", url.alias("url"), F.when(missing, 404).otherwise(307).alias("code"), F.when(F.col("paid") & (F.col("status") == "queued"), "running").otherwise(F.col("status")).alias("status"))


# ---- usage and backends ----


def usage_lookup(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, month: str = "1998-01") -> DataFrame:
    """ip, month, used, remaining: of every address; one that used nothing has the whole allowance."""
    used = metering.free_tier_monthly(orders, lineitem).where(F.col("month") == month).select("ip", "used")
    n = F.coalesce("used", F.lit(0))
    return customer.select(F.col("c_custkey").alias("ip")).join(used, "ip", "left").select("ip", F.lit(month).alias("month"), n.alias("used"), F.greatest(F.lit(0), s.FREE_PAGES - n).alias("remaining"))


def backend_probe(customer: DataFrame) -> DataFrame:
    """id, ollama, claude, mock, active, cost, note: which backends a setting has (a model whose name holds MODEL; a key and
    no switch against it; rules if there is no other, or by a switch), the one that is used, and the estimate for pages."""
    k, pages = F.col("c_custkey"), (F.col("c_custkey") % 90 + 1).cast("int")
    models = F.when(k % 3 == 0, F.array(F.lit("text:1b"), F.lit(f"{MODEL}-q4"))).when(k % 3 == 1, F.array(F.lit("text:1b"))).otherwise(F.expr("cast(array() as array<string>)"))
    local = F.exists(models, lambda m: m.contains(MODEL))
    hosted = (k % 2 == 0) & (k % 10 != 0)
    cost = F.when(~local & hosted, pages * F.lit(s.MODEL_PRICE)).otherwise(0.0)
    each = F.lit(f"${s.MODEL_PRICE:.3f}/page")
    cents = F.round(pages * F.lit(25) / 10, 0).cast("int")
    note = F.when(local, F.concat(F.lit(f"Local model ({MODEL}) — $0.00"), F.when(hosted, F.concat(F.lit(" + Claude fallback at "), each, F.lit(" if needed"))).otherwise(""))).when(hosted, F.concat(F.lit("Claude API only — ~$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" ("), pages.cast("string"), F.lit(" pages × $0.025)"))).otherwise("No AI backend available — will fail")
    return customer.select(k.alias("id"), local.alias("ollama"), hosted.alias("claude"), ((~local & ~hosted) | (k % 8 == 0)).alias("mock"), F.when(local, "ollama").when(hosted, "claude").otherwise("mock").alias("active"), F.round(cost, 3).alias("cost"), note.alias("note"))


def encoded_pages(docs: DataFrame) -> DataFrame:
    """doc_id, data: bytes of a page (here its text) in base 64 without line breaks, as a model's request holds them."""
    return docs.select("doc_id", F.translate(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "\r\n", "").alias("data"))


_LOG = """with o as (select o_orderkey as job, o_orderstatus as st, o_orderdate as d, (o_orderkey % 30 + 1)::int as n, greatest(1, (o_orderkey % 30 + 1) // 2)::int as p from orders),
j as (select job, n, case st when 'O' then 'queued' when 'P' then 'running' else case when job % 10 = 0 then 'failed' else 'done' end end as status, case st when 'O' then 0 when 'P' then trunc((p - 1) / n * 88)::int else case when job % 10 = 0 then trunc((p - 1) / n * 88)::int else 100 end end as progress,
  case st when 'O' then 0 when 'P' then p else case when job % 10 = 0 then p else n end end as current_page, case when st = 'O' then 0 else n end as total_pages, case when st not in ('O', 'P') and job % 10 = 0 then 'broken file' end as error,
  strftime(d, '%Y-%m-%dT%H:%M:%S.%f+00:00') as created_at, case when st not in ('O', 'P') then strftime(d + interval 2 hour, '%Y-%m-%dT%H:%M:%S.%f+00:00') end as completed_at,
  '/up/' || job || '.pdf' as pdf_path, '/out/' || job || '_accessible.docx' as output_path, '/out/' || job || '_accessible_ada.pdf' as output_pdf, st, ['ollama', 'claude', 'mock', 'unknown'][job % 4 + 1] as backend,
  st = 'F' and job % 10 <> 0 and job % 4 <> 0 as has_pdf, st = 'F' and job % 10 <> 0 and job % 9 <> 0 as has_docx from o),
r as (select event_id as request, case when event_id % 11 = 0 then -1 else event_id % 400 end as job, case when event_id % 3 = 0 then 'docx' else 'pdf' end as fmt from events)"""
_LABEL = " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items())
_KEY = SECRET.encode().ljust(64, b"\0")
_PAD = {x: "unhex('" + bytes(b ^ x for b in _KEY).hex() + "')" for x in (0x36, 0x5C)}
SQL = {
    "job_upsert": f"{_LOG} select job, status, progress, current_page, total_pages, error, created_at, completed_at from j",
    "job_timeouts": f"{_LOG}, a as (select o_orderkey as job, o_orderdate + interval 1 hour as ts from orders where o_orderstatus = 'P'), n as (select max(o_orderdate + case o_orderstatus when 'O' then interval 0 hour when 'P' then interval 1 hour else interval 2 hour end) as now from orders), w as (select job, (floor(epoch(now)) - floor(epoch(ts)))::bigint as waited from a, n) select job, waited, case when waited > {TIMEOUT} then 'failed' else 'running' end as status from w",
    "dashboard": f"{_LOG} select left(md5(job::varchar), 8) || '…' as id, job || '.pdf' as file, status, progress || '%' as progress, current_page || '/' || total_pages as pages, left(created_at, 19) as created, coalesce(left(completed_at, 19), '—') as completed, case when status = 'done' then case when job % 6 = 0 then '✓' else '✗' end else '—' end as check from j",
    "status_requests": f"""{_LOG} select request, case when status is null then 404 else 200 end as code, case when status is not null then '{{"job":' || job || ',"status":"' || status || '","progress":' || progress || ',"current_page":' || current_page || ',"total_pages":' || total_pages || ',"error":' || coalesce('"' || error || '"', 'null') || ',"check_report":' || case when status = 'done' then '{{"failed":' || job % 6 || '}}' else 'null' end
|| ',"completed_at":' || coalesce('"' || completed_at || '"', 'null') || ',"backend":"' || backend || '","backend_label":"' || case backend {_LABEL} end || '","has_pdf":' || has_pdf || ',"has_docx":' || has_docx || '}}' end as body from r left join j using (job)""",
    "download_requests": f"""{_LOG}, x as (select request, job, fmt <> 'docx' and has_pdf as pdf, has_docx, output_pdf, output_path, case when status is null then 404 when status <> 'done' then 400 when (fmt <> 'docx' and has_pdf) or has_docx then 200 else 500 end as code from r left join j using (job))
select request, code, case when code = 200 then case when pdf then output_pdf else output_path end end as path, case when code = 200 then case when pdf then '{PDF}' else '{DOCX}' end end as media, case when code = 200 then case when pdf then job || '_ada_compliant.pdf' else job || '_accessible.docx' end end as filename from x""",
    "process_requests": """with b as (select event_id as request, case when event_id % 17 <> 0 and event_id % 13 <> 0 then event_id % 300 end as u, event_id % 2 = 0 as use_claude from events),
x as (select request, u, use_claude, (c_custkey % 12 + 1)::int as pages, case when u is null then 400 when c_custkey is null then 404 else 200 end as code from b left join (select * from customer where c_custkey % 6 <> 0) on c_custkey = u)
select request, code, case when code = 200 then u::varchar end as upload_id, case when code = 200 then case when pages > 3 then 'awaiting_payment' else 'queued' end end as status, case when code = 200 then pages end as pages, case when code = 200 then round(greatest(0, pages - 3) * 0.05::double, 2) end as amount, case when code = 200 then use_claude::int end as use_claude, case when code = 200 then 'a@b.c' end as email,
  case when code = 200 then '/out/' || u || '_accessible.docx' end as output_path, case when code = 200 then '/out/' || u || '_accessible_ada.pdf' end as output_pdf from x""",
    "webhook_gate": f"""{_LOG}, p as (select event_id as request, '{{"type": "' || case when event_id % 5 = 0 then 'charge.refunded' else '{PAID}' end || '", "data": {{"object": {{"metadata": {{"job_id": "' || event_id % 500 || '"}}}}}}}}' as payload from events),
g as (select request, payload, case when request % 7 = 0 then 'forged' else sha256({_PAD[0x5C]} || unhex(sha256({_PAD[0x36]} || encode(payload)))) end as signature from p),
v as (select request, case when signature = sha256({_PAD[0x5C]} || unhex(sha256({_PAD[0x36]} || encode(payload)))) then 200 else 400 end as code, payload from g),
t as (select request, code, case when code = 200 and json_extract_string(payload, '$.type') = '{PAID}' then json_extract_string(payload, '$.data.object.metadata.job_id')::bigint end as job from v)
select request, code, t.job as job, coalesce(status = 'queued' and request = min(request) over (partition by t.job), false) as released from t left join j on j.job = t.job""",
    "redirects": f"{_LOG} select request, case when request % 2 = 0 then case when status is null then null else '/?job_id=' || job || '&paid=1' end else '/?cancelled=1' end as url, case when request % 2 = 0 and status is null then 404 else 307 end as code, case when request % 2 = 0 and status = 'queued' then 'running' else status end as status from r left join j using (job)",
    "usage_lookup": "with u as (select o_custkey as ip, least(3, count(*))::int as used from orders join lineitem on l_orderkey = o_orderkey where strftime(o_orderdate, '%Y-%m') = '1998-01' group by 1) select c_custkey as ip, '1998-01' as month, coalesce(used, 0) as used, greatest(0, 3 - coalesce(used, 0)) as remaining from customer left join u on ip = c_custkey",
    "backend_probe": f"""with c as (select c_custkey as id, c_custkey % 3 = 0 as ollama, c_custkey % 2 = 0 and c_custkey % 10 <> 0 as claude, (c_custkey % 90 + 1)::int as pages from customer), d as (select *, floor(pages * 25 / 10 + 0.5)::int as cents from c)
select id, ollama, claude, not ollama and not claude or id % 8 = 0 as mock, case when ollama then 'ollama' when claude then 'claude' else 'mock' end as active, case when claude and not ollama then round(pages * 0.025::double, 3) else 0 end as cost,
case when ollama then 'Local model ({MODEL}) — $0.00' || case when claude then ' + Claude fallback at $0.025/page if needed' else '' end when claude then 'Claude API only — ~$' || cents // 100 || '.' || lpad((cents % 100)::varchar, 2, '0') || ' (' || pages || ' pages × $0.025)' else 'No AI backend available — will fail' end as note from d""",
    "encoded_pages": "select doc_id, base64(encode(coalesce(text, ''))) as data from documents",
}
