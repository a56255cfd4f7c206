"""Payments judged batch by batch: late rows, repeated deliveries, spans that come after their payments, a batch run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.streaming import lifecycle


def at(hours):
    return datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=hours)


BATCHES = [
    ([("a", 1, at(1)), ("a", 1, at(1)), ("b", 1, at(30)), ("early", 1, at(-9)), ("later", 2, at(40)), ("none", None, None)], [(1, "queued", at(0), at(24)), (1, "running", at(24), None), (8, "queued", at(60), None)]),
    ([("a", 1, at(1)), ("b", 1, at(30)), ("c", 1, at(50))], [(2, "queued", at(38), None), (2, "queued", at(-99), None)]),
    ([("c", 1, at(50)), ("d", 9, at(200))], [(1, "queued", at(198), None), (9, "queued", at(500), None), (3, "queued", None, None)]),
    ([("late", 1, at(100)), ("e", 1, at(199)), ("f", 1, at(700)), ("d", 9, at(200))], [(9, "queued", at(199), None)]),
]


def rows(spark, paid, states):
    return lifecycle.mixed(spark.createDataFrame(paid, "event string, job bigint, paid_at timestamp"), spark.createDataFrame(states, "job bigint, state string, since timestamp, until timestamp"))


def verdicts(spark, path, batches):
    judge = lifecycle.Judge(spark, path)
    for n, x in enumerate(batches):
        judge.step(rows(spark, *x), n)
    return sorted((r.event, r.state or "", r.acts) for r in judge.verdicts().collect())


def test_batches(spark, tmp_path):
    """Marks left: 5 (newest payment 40 less 35), 15, 165, 465 hours."""
    got = verdicts(spark, f"{tmp_path}/j", BATCHES)
    assert got == [
        ("a", "queued", True), ("b", "running", False), ("c", "running", False), ("d", "queued", True), ("e", "queued", True), ("e", "running", False),
        ("early", "", False), ("f", "queued", True), ("f", "running", False), ("later", "queued", True),
    ]
    kept = spark.read.parquet(f"{tmp_path}/j/state/3/payments").collect()
    assert {r.event for r in kept} == {"f"} and not (tmp_path / "j" / "state" / "1").exists()


def test_a_batch_run_again(spark, tmp_path, monkeypatch):
    judge, whole = lifecycle.Judge(spark, f"{tmp_path}/j"), lifecycle.Judge._keep
    judge.step(rows(spark, *BATCHES[0]), 0)
    monkeypatch.setattr(lifecycle.Judge, "_keep", lambda self, found, n, name: whole(self, found, n, name) if name != "spans" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        judge.step(rows(spark, *BATCHES[1]), 1)
    monkeypatch.setattr(lifecycle.Judge, "_keep", whole)
    for n in (1, 1, 2, 3):
        judge.step(rows(spark, *BATCHES[n]), n)
    assert sorted((r.event, r.state or "", r.acts) for r in judge.verdicts().collect()) == verdicts(spark, f"{tmp_path}/k", BATCHES)


def test_no_state_of_all_rows(spark, tmp_path, monkeypatch):
    """The query keeps no state for rows that the mark has passed."""
    monkeypatch.setattr(lifecycle, "folder", lambda spark, kind: f"{tmp_path}/{kind}")
    n = lifecycle.paid_jobs(spark, "/root/testdata/sf0.001").count()
    state = next((tmp_path / "stream" / "state").iterdir())
    assert n > 5000 and sum(spark.read.parquet(f"{state}/{x}").count() for x in ("payments",)) < n / 20
    assert not list((tmp_path / "stream").glob("**/*.delta")) + list((tmp_path / "stream").glob("**/*.zip"))


def test_no_rows(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    (tmp_path / "orders.parquet").mkdir()
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where(F.lit(False)).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    assert lifecycle.paid_jobs(spark, str(tmp_path)).collect() == []
