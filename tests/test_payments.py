"""Hourly payments as a stream: the newest hours, late rows, repeated deliveries, rows without a time or an id."""

import datetime

from lectern.streaming import metering

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def at(hours):
    return datetime.datetime(2024, 3, 9) + datetime.timedelta(hours=hours)


def test_all_hours_of_payments(spark, tmp_path, monkeypatch):
    """A file for each batch; the second moves time on by 40 days, the third is late and brings a payment again."""
    batches = [
        [(1, at(0), "purchase", 1.5), (2, at(0.5), "purchase", 2.0), (2, at(0.5), "purchase", 2.0), (3, at(0.2), "view", 9.0), (4, at(26.5), "purchase", 4.0)],
        [(5, at(960), "purchase", 5.0), (6, at(960.25), "purchase", None), (7, at(984), "purchase", 0.25)],
        [(8, at(0.9), "purchase", 8.0), (1, at(0), "purchase", 1.5), (None, at(984.1), "purchase", 1.0), (None, at(984.1), "purchase", 1.0), (9, None, "purchase", 3.0)],
    ]
    (tmp_path / "events.parquet").mkdir()
    for n, found in enumerate(batches):
        spark.createDataFrame([(e, ts, 1, kind, v, None) for e, ts, kind, v in found], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/new{n}")
        next((tmp_path / f"new{n}").glob("*.parquet")).rename(tmp_path / "events.parquet" / f"{n:04d}.parquet")
    monkeypatch.setattr(metering, "stream_of", lambda spark, at, table: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/{table}.parquet"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # at(26.5) is an hour that clocks there skip
    try:
        got = [tuple(x) for x in metering.stream_payment_events(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(got) == 5
    assert set(got) == {(at(0), 3, 11.5), (at(26), 1, 4.0), (at(960), 2, 5.0), (at(984), 3, 2.25), (None, 1, 3.0)}


def test_no_payments(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    assert metering.stream_payment_events(spark, str(tmp_path)).collect() == []
