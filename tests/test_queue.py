"""The job queue: order, repeated deliveries, restarts, the limit of time, and errors that are not a row's own."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.streaming.queue import JobQueue, within

RESULT = "job bigint, status string, progress int, message string, v string"


def queue_of(spark, tmp_path, execute):
    schema = spark.createDataFrame([], "job bigint, v string").schema
    return JobQueue(spark, str(tmp_path / "q"), schema, execute, RESULT)


def put(spark, queue, *jobs):
    queue.put(spark.createDataFrame(list(jobs), "job bigint, v string").coalesce(1))
    time.sleep(0.05)  # files are told apart by their time


def done(jobs):
    return jobs.select("job", F.lit("done").alias("status"), F.lit(100).alias("progress"), F.lit(None).cast("string").alias("message"), "v")


def records(queue):
    return {x.job: (x.status, x.message, x.v, x.batch, x.runs) for x in queue.table().collect()}


def test_each_job_runs_once_in_order(spark, tmp_path):
    seen = []

    def execute(jobs):
        seen.append(sorted((x.job is not None, x.job or 0) for x in jobs.select("job").collect()))
        return done(jobs)

    queue = queue_of(spark, tmp_path, execute)
    assert queue.table().count() == 0
    put(spark, queue, (1, "a"), (2, "b"), (2, "b"), (None, "x"))
    put(spark, queue, (2, "b"), (3, None))
    queue.work(files=1)
    assert seen == [[(False, 0), (True, 1), (True, 2)], [(True, 3)]]
    again = queue_of(spark, tmp_path, execute)  # another worker goes on where that one was
    put(spark, again, (1, "a"), (4, ""), (None, "x"))
    again.work(files=1)
    again.work(files=1)
    assert seen[2:] == [[(True, 4)]]
    assert records(again) == {1: ("done", None, "a", 0, 1), 2: ("done", None, "b", 0, 1), None: ("done", None, "x", 0, 1), 3: ("done", None, None, 1, 1), 4: ("done", None, "", 2, 1)}


def test_a_batch_over_its_time_fails_alone(spark, tmp_path):
    @F.udf("string")
    def slow(v):
        import time

        time.sleep(60 if v == "slow" else 0)
        return v

    queue = queue_of(spark, tmp_path, lambda jobs: done(jobs.withColumn("v", slow("v"))))
    put(spark, queue, (1, "slow"), (2, "b"))
    put(spark, queue, (3, "c"))
    began = time.time()
    queue.work(timeout=8, files=1)
    assert time.time() - began < 50
    assert records(queue) == {1: ("failed", "timeout", None, 0, 1), 2: ("failed", "timeout", None, 0, 1), 3: ("done", None, "c", 1, 1)}


def test_a_broken_plan_stops_the_worker_and_loses_nothing(spark, tmp_path):
    broken = [True]

    def execute(jobs):
        if broken and jobs.where("job = 2").count():
            raise ValueError("no such model")
        return done(jobs)

    queue = queue_of(spark, tmp_path, execute)
    put(spark, queue, (1, "a"))
    put(spark, queue, (2, "b"))
    with pytest.raises(Exception, match="no such model"):
        queue.work(files=1)
    assert set(records(queue)) == {1}
    broken.clear()
    queue.work(files=1)
    assert records(queue) == {1: ("done", None, "a", 0, 1), 2: ("done", None, "b", 1, 1)}


def test_limit_of_time(spark):
    within(spark, 60, lambda: spark.range(10).count())
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)
    assert not spark.sparkContext.getJobTags()
