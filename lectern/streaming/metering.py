"""Structured Streaming forms of the metered counters, the job log, commands and releases; each equals its batch form on
all final input. Results go to Parquet in the shared folder, none through the driver: rows that are final by append, rows of
a batch to a folder of its own, counters and latest states into a keyed store, of which a batch rewrites the buckets it
touches. A batch that runs again after a failure changes nothing, and no result is written anew as a whole."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.operators import jobs
from lectern.operators.metering import STATES
from lectern.sources.keyed import KeyedStore, latest_by, summed
from lectern.sources.shared import folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """All rows of a table as a stream; a table is a folder of files, or one file, which the stream finds in its folder."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_available(spark: SparkSession, df: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that is there now through a streaming query. mode: append (final rows), or rows (each() of a batch's rows, a
    folder for each batch)."""
    at = folder(spark, "stream")
    out = f"{at}/out"
    writer = df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append")
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, n: each(batch).write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.start().awaitTermination()
    if mode != "rows":
        return spark.read.schema(df.schema).parquet(out)
    found = each(spark.createDataFrame([], df.schema))
    return spark.read.schema(found.schema).parquet(out).select(*found.columns)


def run_into(spark: SparkSession, df: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame], DataFrame]) -> KeyedStore:
    """All that is there now into a keyed store: each() of a batch's rows is merged into the buckets that it touches."""
    at = folder(spark, "stream")
    store = KeyedStore(spark, f"{at}/store", keys, merge)
    writer = df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append")
    writer.foreachBatch(lambda batch, n: store.upsert(each(batch), n) and None).start().awaitTermination()
    if not store.manifest()["version"]:
        store.upsert(each(spark.createDataFrame([], df.schema)), 0)
    return store


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries that start here keep their state in RocksDB, which keyed state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def monthly_usage(rows: DataFrame) -> DataFrame:
    """user, month, n of a batch: calendar months can't be windows, so the month is a key."""
    return rows.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def stream_monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters in a keyed store, which each batch adds to once; capped as they are read."""
    keys = ["user_id", "month"]
    store = run_into(spark, stream_of(spark, sf_dir, "events"), keys, summed(keys, "n"), monthly_usage)
    return store.table().select("user_id", "month", F.least(F.lit(s.FREE_PAGES), F.col("n")).cast("int").alias("used"))


def job_states(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "ts", "event_id", s.lookup(STATES, F.col("event_type"), F.lit("queued")).alias("status"))


def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state for each user in a keyed store; repeated deliveries change nothing, as the latest (ts, event_id) wins."""
    store = run_into(spark, stream_of(spark, sf_dir, "events"), ["user_id"], latest_by(["user_id"], "ts", "event_id"), job_states)
    return store.table().select("user_id", "status")


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job store after batches of queued, running and ended records and a repeated batch: what readers of the store see."""
    store = KeyedStore(spark, f"{folder(spark, 'jobs')}/store", ["job"], merged_jobs)
    log = job_records(jobs.job_log(spark.read.parquet(f"{sf_dir}/orders.parquet")))
    for n, rows in enumerate((log.where("seq = 0"), log.where("seq = 1"), log.where("seq = 2"))):
        store.upsert(rows, n)
    store.upsert(log.where("seq = 1"), 1)
    return store.table().drop("ts", "seq")


def job_records(log: DataFrame) -> DataFrame:
    ended = F.when(F.col("status").isin("done", "failed"), jobs.iso(F.col("ts")))
    return log.select("*", jobs.iso(F.col("ts")).alias("created_at"), ended.alias("completed_at"))


def merged_jobs(rows: DataFrame) -> DataFrame:
    """Of each job the latest record, with the time of its first."""
    rest = [c for c in rows.columns if c not in ("job", "created_at")]
    now = rows.groupBy("job").agg(F.max(F.struct("ts", "seq", *[c for c in rest if c not in ("ts", "seq")])).alias("x"), F.min("created_at").alias("created_at"))
    return now.select("job", "x.*", "created_at")


def hourly_payments(rows: DataFrame) -> DataFrame:
    """hour, n, amount of a batch; amounts are rounded when they are read."""
    ts = F.col("ts").cast("timestamp_ntz")
    hour = ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("second"), ts))
    return rows.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("amount"))


def counted_once(payments: DataFrame) -> DataFrame:
    """A stream of payments that are delivered at least once, each once. Ids are kept as state for good, so no payment is
    dropped as late and no duplicate counts however late it is; payments without an id can't be told apart, each counts."""
    return payments.withColumn("_id", F.coalesce(F.col("event_id").cast("string"), F.uuid())).dropDuplicates(["_id"]).drop("_id")


def stream_payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment events of each hour, delivered at least once, counted once: a keyed store of hours, to which each batch adds,
    so the newest hours are in it as the others are, and late payments join theirs."""
    payments = stream_of(spark, sf_dir, "events").where("event_type = 'purchase'")
    with rocks(spark):
        store = run_into(spark, counted_once(payments), ["hour"], summed(["hour"], "n", "amount"), hourly_payments)
    return store.table().select("hour", "n", F.round("amount", 4).alias("amount"))


def stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands to process an upload, as they come: each batch runs the batch plan of requests, in no order but its own."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return run_available(spark, stream_of(spark, sf_dir, "events"), "rows", lambda batch: jobs.process_requests(batch, customer).select("request", "code", "status", "output_pdf"))


def stream_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid jobs: payment events, once each within the watermark, joined with the jobs that are queued."""
    ts = F.col("ts").cast("timestamp")
    once = stream_of(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("ts", ts).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    queued = jobs.latest(jobs.job_log(spark.read.parquet(f"{sf_dir}/orders.parquet"))).where("status = 'queued'").select("job")
    return run_available(spark, once.select(F.col("event_id").alias("job"), F.col("ts").cast("timestamp_ntz").alias("paid_at")).join(queued, "job"), "append")


def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files past their lifetime at the time of a sweep (the newest file's), as a stream of a folder's listing."""
    now = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.unix_timestamp(F.max("ts").cast("timestamp"))).first()[0] or 0
    age = F.lit(now) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    files = stream_of(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", "upload").otherwise("output").alias("kind"), age.alias("age"))
    return run_available(spark, files.where((F.col("age") > s.OUTPUT_TTL) | ((F.col("kind") == "upload") & (F.col("age") > s.UPLOAD_TTL))), "append")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows of jobs as their pages are analysed: percent of each page and the pages still to come."""
    pages = stream_of(spark, sf_dir, "lineitem")
    page, n = F.least(F.col("l_linenumber"), F.lit(7)).cast("int"), F.lit(7)
    return run_available(spark, pages.select("l_orderkey", "l_partkey", page.alias("page"), s.progress(page, n).alias("progress"), (n - page).alias("rest")), "append")


SQL = {
    "stream_monthly_usage": "select user_id, strftime(ts, '%Y-%m') as month, least(3, count(*))::int as used from events group by 1, 2",
    "stream_job_status": "select user_id, arg_max(case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'queued' end, (ts, event_id)) as status from events group by 1",
    "stream_payment_events": "select date_trunc('hour', ts)::timestamp as hour, count(*) as n, round(sum(value), 4) as amount from events where event_type = 'purchase' group by 1",
    "stored_jobs": jobs.SQL["job_upsert"],
    "stream_commands": jobs.SQL["process_requests"].replace("select request, code, case when code = 200 then u::varchar end as upload_id,", "select request, code, status, output_pdf from (select request, code, case when code = 200 then u::varchar end as upload_id,") + ")",
    "stream_releases": "select event_id as job, ts as paid_at from (select event_id, min(ts) as ts from events where event_type = 'purchase' group by 1) join orders on o_orderkey = event_id where o_orderstatus = 'O'",
    "stream_expired": "with a as (select event_id, case event_type when 'signup' then 'upload' else 'output' end as kind, (floor(epoch((select max(ts) from events))) - floor(epoch(ts)))::bigint as age from events) select event_id, kind, age from a where age > 86400 or kind = 'upload' and age > 3600",
    "stream_progress": "select l_orderkey, l_partkey, least(l_linenumber, 7)::int as page, trunc((least(l_linenumber, 7) - 1) / 7 * 88)::int as progress, 7 - least(l_linenumber, 7)::int as rest from lineitem",
}
