"""A queue of jobs as a folder that a stream reads in order of arrival, and a worker that runs each batch as one plan.

Jobs are put with all they need, so a worker looks nothing up. The oldest files make the next batch; its jobs run side by
side, and their records go into a keyed store. A job may be delivered any number of times, in one batch or in several: it
runs once, as a batch leaves out what the store holds, for which it opens the buckets of its own keys alone. A worker that
stops goes on where it was; a batch that broke off is run again as a whole, and one that is in the store already is not. A
batch that takes longer than the limit is cancelled, its jobs have failed, and the next batch follows. A row's own fault is
a matter of the plan (see operators/runs.py); any other error stops the worker, and the batch is left for its next start.

Without an id, all jobs are one. Of one id's rows in a batch the least counts. An empty queue makes an empty store.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import runs
from lectern.operators.jobs import TIMEOUT
from lectern.sources import content
from lectern.sources.keyed import KeyedStore
from lectern.sources.shared import folder

#: Jobs of a file at most, and files of a batch.
ROWS, FILES = 10_000, 64
RESULT = "job bigint, status string, progress int, message string, n_elements int, tags string, missing int"


def within(spark: SparkSession, seconds: float, run: Callable[[], object]) -> None:
    """run(), whose Spark jobs are cancelled when that time is over: TimeoutError then."""
    sc, tag, done, late = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            sc.cancelJobsWithTag(tag)
            while not done.wait(1):  # what it starts after that
                sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        run()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"over {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)


def once(rows: DataFrame) -> DataFrame:
    """Merge: of each job the record of its first batch, and how often it ran."""
    rest = [c for c in rows.columns if c not in ("job", "batch", "runs")]
    return rows.groupBy("job").agg(F.min(F.struct("batch", *rest)).alias("x"), F.sum("runs").alias("runs")).select("job", "x.*", "runs")


class JobQueue:
    """execute: rows of jobs (job and whatever it needs) -> records, of the columns of result (job, status, progress, message
    among them)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, execute: Callable[[DataFrame], DataFrame], result: str = RESULT):
        self.spark, self.path, self.schema, self.execute = spark, path, schema, execute
        self.result = StructType.fromDDL(result)
        self.store = KeyedStore(spark, f"{path}/store", ["job"], once)

    def put(self, jobs: DataFrame, rows: int = ROWS) -> None:
        """Add jobs behind those that wait; put again after a failure, they are delivered twice."""
        jobs.select(*self.schema.names).write.mode("append").option("maxRecordsPerFile", rows).parquet(f"{self.path}/jobs")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Jobs of a batch that have no record, each once."""
        rest = [c for c in batch.columns if c != "job"]
        one = batch.groupBy("job").agg(F.min(F.struct(*rest)).alias("x")).select("job", "x.*")
        seen = self.store.near(batch)
        return one if seen is None else one.join(seen.select(F.col("job").alias("of")), F.col("job").eqNullSafe(F.col("of")), "left_anti")

    def records(self, found: DataFrame, n: int) -> DataFrame:
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.result], F.lit(n).cast("bigint").alias("batch"), F.lit(1).cast("bigint").alias("runs"))

    def timed_out(self, jobs: DataFrame) -> DataFrame:
        known = {"job": F.col("job"), "status": F.lit("failed"), "progress": F.lit(0), "message": F.lit("timeout")}
        return jobs.select(*[known.get(f.name, F.lit(None)).alias(f.name) for f in self.result])

    def run(self, batch: DataFrame, n: int, timeout: float) -> None:
        if n <= self.store.manifest()["batch"]:
            return
        jobs = self.fresh(batch).persist()
        try:
            within(self.spark, timeout, lambda: self.store.upsert(self.records(self.execute(jobs), n), n))
        except TimeoutError:
            self.store.upsert(self.records(self.timed_out(jobs), n), n)
        finally:
            jobs.unpersist()

    def work(self, timeout: float = TIMEOUT, files: int = FILES) -> None:
        """Run all that waits now. Files wait for however long; their names stay in the stream's log."""
        waiting = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").parquet(f"{self.path}/jobs")
        writer = waiting.writeStream.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n: self.run(batch, n, timeout)).start().awaitTermination()

    def table(self) -> DataFrame:
        """Records of all jobs that ran: result's columns, batch, runs."""
        if not self.store.manifest()["version"]:
            return self.records(self.spark.createDataFrame([], self.result), 0)
        return self.store.table()


def execute_streams(jobs: DataFrame) -> DataFrame:
    """Records of jobs (job, content: a page's content stream)."""
    streams = jobs.select(F.col("job").alias("page"), "content")
    return runs.executed(streams, content.written(streams))


def queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs, all delivered twice, to a worker that stops in between: their records, and how often each ran."""
    jobs = content.document_content(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("page", "job")
    queue = JobQueue(spark, folder(spark, "queue"), jobs.schema, execute_streams)
    for _ in range(2):
        queue.put(jobs)
        queue.work()
    return queue.table().drop("batch")


SQL = {"queued_jobs": f"select *, 1::bigint as runs from ({runs.SQL['executed_jobs']})"}
