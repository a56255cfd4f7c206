"""Charges, monthly free tiers, jobs, expiry, backends: small projections and aggregates over keyed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as s

# Event types that stand for states of a job.
STATES = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "failed"}


def page_counts(lineitem: DataFrame) -> DataFrame:
    """Orders as documents, their lines as pages (a stand-in)."""
    return lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("pages"))


def charge_quote(lineitem: DataFrame) -> DataFrame:
    pages = F.col("pages")
    return page_counts(lineitem).select(
        "l_orderkey", "pages", F.least(pages, F.lit(s.FREE_PAGES)).alias("free"), s.billable(pages).alias("billable"), s.amount(pages).alias("amount"),
        (s.amount(pages) > 0).alias("requires_payment"), s.cents_truncated(pages).alias("cents"), (s.billable(pages) * 5).alias("cents_exact"),
        (pages > s.LARGE_PAGES).alias("large"), (pages > s.MAX_PAGES).alias("rejected"),
    )


def _usage(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """ip (customer), month, order, ts, pages."""
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("ip"), F.col("o_orderdate").alias("ts"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return o.join(page_counts(lineitem), "l_orderkey")


def free_tier_monthly(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """ip, month, used (capped), remaining. Sums are pre-aggregated; the month resets the counter."""
    used = F.least(F.lit(s.FREE_PAGES), F.sum("pages")).cast("int")
    return _usage(orders, lineitem).groupBy("ip", "month").agg(used.alias("used")).withColumn("remaining", F.greatest(F.lit(0), s.FREE_PAGES - F.col("used")))


def free_tier_decisions(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """For each document in its ip's month: what was used before it, and whether it fits what remains."""
    w = Window.partitionBy("ip", "month").orderBy("ts", "l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    before = F.least(F.lit(s.FREE_PAGES), F.coalesce(F.sum("pages").over(w), F.lit(0))).cast("int")
    return _usage(orders, lineitem).select("l_orderkey", "ip", "month", "pages", before.alias("used_before")).withColumn("allowed", F.col("pages") <= F.greatest(F.lit(0), s.FREE_PAGES - F.col("used_before")))


def job_status(events: DataFrame) -> DataFrame:
    """Latest state of each user's job (events as transitions, a stand-in), for the status view and dashboard."""
    state = s.lookup(STATES, F.col("event_type"), F.lit("queued"))
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", state.alias("status"))).alias("x"), F.count("*").cast("int").alias("events"), F.min("ts").alias("created"))
    at = F.greatest(F.lit(1), F.col("events") % 8)
    progress = F.when(F.col("x.status") == "done", 100).otherwise(s.progress(at, F.lit(7)))
    mark = F.when(F.col("x.status") == "done", "✓").when(F.col("x.status") == "failed", "✗").otherwise("—")
    return last.select("user_id", F.col("x.status").alias("status"), progress.alias("progress"), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.when(F.col("x.status").isin("done", "failed"), F.date_format("x.ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("—").alias("completed"), mark.alias("mark"))


def expired(events: DataFrame) -> DataFrame:
    """event_type, files, and those past either lifetime at the time of the newest (one row, broadcast)."""
    now = events.agg(F.max("ts").alias("now"))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.join(F.broadcast(now)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(age > s.UPLOAD_TTL).alias("uploads_expired"), F.count_if(age > s.OUTPUT_TTL).alias("outputs_expired"))


def backend_fallback(docs: DataFrame) -> DataFrame:
    """Source of each page: local model, else hosted, else text rules (whichever of these gave elements), and the
    estimate of its cost. Availability follows the id (a stand-in)."""
    local = F.when(F.col("doc_id") % 3 == 0, F.lit("ollama"))
    hosted = F.when(F.col("doc_id") % 3 == 1, F.lit("claude"))
    backend = F.coalesce(local, hosted, F.when(F.length(F.trim("text")) > 0, "mock"), F.lit("empty"))
    pages = F.ceil(F.col("n_chars") / 2000).cast("int")
    cost = F.when(backend == "claude", F.round(pages * F.lit(s.MODEL_PRICE), 3)).otherwise(0.0)
    return docs.select("doc_id", backend.alias("backend"), s.lookup(s.BACKENDS, backend, backend).alias("label"), pages.alias("pages"), cost.alias("cost"), F.length(F.left(F.col("text"), F.lit(2000))).alias("hint_chars"))


def payment_release(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Purchase events release the queued order of their number (a stand-in for payments and jobs), once each."""
    paid = events.where("event_type = 'purchase'").groupBy(F.col("event_id").alias("o_orderkey")).agg(F.min("ts").alias("paid_at"))
    return orders.where("o_orderstatus = 'O'").join(paid, "o_orderkey").select("o_orderkey", "o_custkey", "paid_at", F.lit("running").alias("status"))


def upload_gate(docs: DataFrame) -> DataFrame:
    """Documents as uploads: accepted, or why not (suffix, size in MiB, a file that can't be read, pages)."""
    name: Column = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".TXT").when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".pdf"))
    mb, pages = F.col("n_chars") * 4096 / 1048576, F.ceil(F.col("n_chars") / 20).cast("int")
    return docs.select("doc_id", F.when(~F.lower(name).endswith(".pdf"), "400").when(mb > s.MAX_MB, "413").when(F.col("doc_id") % 13 == 0, "422").when(pages > s.MAX_PAGES, "400").otherwise("200").alias("code"), F.round(mb, 6).alias("mb"), pages.alias("pages"), (pages > s.LARGE_PAGES).alias("confirm"))


_P = "with p as (select l_orderkey, count(*)::int as pages from lineitem group by 1)"
_U = f"{_P}, u as (select p.l_orderkey, o_custkey as ip, o_orderdate as ts, strftime(o_orderdate, '%Y-%m') as month, pages from orders join p on p.l_orderkey = o_orderkey)"
SQL = {
    "charge_quote": f"{_P}, b as (select *, greatest(0, pages - 3) as billable from p), a as (select *, round(billable * 0.05::double, 2) as amount from b) select l_orderkey, pages, least(pages, 3) as free, billable, amount, amount > 0 as requires_payment, case when billable > 0 then trunc(amount * 100)::int end as cents, billable * 5 as cents_exact, pages > 50 as large, pages > 500 as rejected from a",
    "free_tier_monthly": f"{_U} select ip, month, least(3, sum(pages))::int as used, greatest(0, 3 - least(3, sum(pages))::int) as remaining from u group by ip, month",
    "free_tier_decisions": f"{_U}, w as (select *, least(3, coalesce(sum(pages) over (partition by ip, month order by ts, l_orderkey rows between unbounded preceding and 1 preceding), 0))::int as used_before from u) select l_orderkey, ip, month, pages, used_before, pages <= greatest(0, 3 - used_before) as allowed from w",
    "job_status": """with e as (select *, case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'queued' end as state from events),
l as (select user_id, arg_max(state, (ts, event_id)) as status, max(ts) as last, count(*) as n, min(ts) as created from e group by user_id)
select user_id, status, case when status = 'done' then 100 else trunc((greatest(1, n % 8) - 1) / 7 * 88)::int end as progress, strftime(created, '%Y-%m-%dT%H:%M:%S') as created, case when status in ('done', 'failed') then strftime(last, '%Y-%m-%dT%H:%M:%S') else '—' end as completed, case status when 'done' then '✓' when 'failed' then '✗' else '—' end as mark from l""",
    "expired": "with n as (select max(ts) as now from events), a as (select event_type, floor(epoch(now)) - floor(epoch(ts)) as age from events, n) select event_type, count(*) as n, count(*) filter (age > 3600) as uploads_expired, count(*) filter (age > 86400) as outputs_expired from a group by event_type",
    "backend_fallback": "with b as (select *, case doc_id % 3 when 0 then 'ollama' when 1 then 'claude' else case when length(trim(text)) > 0 then 'mock' else 'empty' end end as backend, ceil(n_chars / 2000)::int as pages from documents) select doc_id, backend, case backend when 'ollama' then 'Local AI' when 'claude' then 'Hosted AI' when 'mock' then 'Text only' else backend end as label, pages, case when backend = 'claude' then round(pages * 0.025::double, 3) else 0 end as cost, length(left(text, 2000)) as hint_chars from b",
    "payment_release": "with p as (select event_id, min(ts) as paid_at from events where event_type = 'purchase' group by 1) select o_orderkey, o_custkey, paid_at, 'running' as status from orders join p on event_id = o_orderkey where o_orderstatus = 'O'",
    "upload_gate": "with m as (select doc_id, n_chars * 4096 / 1048576 as mb, ceil(n_chars / 20)::int as pages from documents) select doc_id, case when doc_id % 11 = 0 then '400' when mb > 50 then '413' when doc_id % 13 = 0 then '422' when pages > 500 then '400' else '200' end as code, round(mb, 6) as mb, pages, pages > 50 as confirm from m",
}


def progress_log(lineitem: DataFrame) -> DataFrame:
    """A job's progress rows: one for each page analysed (0 to 87 percent), then the four closing stages."""
    jobs = page_counts(lineitem)
    pages = jobs.select("l_orderkey", "pages", F.explode(F.sequence(F.lit(1), F.least("pages", F.lit(s.MAX_PAGES)))).alias("page"))
    steps = pages.select("l_orderkey", F.col("page").alias("step"), s.progress(F.col("page"), F.least("pages", F.lit(s.MAX_PAGES))).alias("progress"))
    closing = jobs.select("l_orderkey", F.col("pages").alias("n"), F.posexplode(F.array(*[F.lit(x) for x in (90, 93, 97, 100)])).alias("k", "progress"))
    return steps.unionByName(closing.select("l_orderkey", (F.least("n", F.lit(s.MAX_PAGES)) + F.col("k") + 1).alias("step"), "progress"))


def cost_estimate(lineitem: DataFrame) -> DataFrame:
    """Estimated model cost of each document by which backends there are (by order number, a stand-in)."""
    local, hosted = F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") % 2 == 0
    cost = F.when(local, 0.0).when(hosted, F.round(F.col("pages") * F.lit(s.MODEL_PRICE), 3)).otherwise(0.0)
    note = F.when(local & hosted, "local, hosted as fallback").when(local, "local").when(hosted, "hosted").otherwise("none")
    return page_counts(lineitem).select("l_orderkey", "pages", cost.alias("cost"), note.alias("note"), (F.col("pages") > s.LARGE_PAGES).alias("confirm"))


SQL["progress_log"] = f"{_P}, a as (select l_orderkey, least(pages, 500) as n from p), x as (select l_orderkey, n, unnest(range(1, n + 1)) as step from a) select l_orderkey, step, trunc((step - 1) / n * 88)::int as progress from x union all select l_orderkey, n + k, c from a, (values (1, 90), (2, 93), (3, 97), (4, 100)) as v(k, c)"
SQL["cost_estimate"] = f"{_P} select l_orderkey, pages, case when l_orderkey % 3 = 0 then 0 when l_orderkey % 2 = 0 then round(pages * 0.025::double, 3) else 0 end as cost, case when l_orderkey % 6 = 0 then 'local, hosted as fallback' when l_orderkey % 3 = 0 then 'local' when l_orderkey % 2 = 0 then 'hosted' else 'none' end as note, pages > 50 as confirm from p"
