"""Content streams, the keyed store, and jobs as state: faults, replays, timers, bounds."""

import datetime
import resource
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import elements
from lectern.sources import content
from lectern.sources.keyed import KeyedStore, latest_by, summed
from lectern.streaming import lifecycle

# ---- lines ----


def test_long_runs_of_spaces(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.repeat(F.lit(" "), 1 << 20), F.lit("b \n"), F.repeat(F.lit("\t "), 1 << 19), F.lit("c")).alias("text"))
    elements.text_lines(docs).count()
    began = time.time()
    got = [x.line for x in elements.text_lines(docs).collect()]
    assert time.time() - began < 5 and len(got) == 2 and got[1] == "c"
    assert docs.select(F.length(t.strip(F.concat(F.repeat(F.lit(" "), 1 << 20), F.lit("x"), F.repeat(F.lit(" "), 1 << 20))))).first()[0] == 1


# ---- content streams ----


def parsed(data):
    return [(op, [x and (x["kind"], x["value"]) for x in operands] if operands is not None else None, error) for _, _, op, operands, error in content.rows(1, data)]


@pytest.mark.parametrize(
    "data, want",
    [
        (b"", []),
        (b"q Q", [("q", [], None), ("Q", [], None)]),
        (b"-.5 +3 4. .25 re", [("re", [("number", "-.5"), ("number", "+3"), ("number", "4."), ("number", ".25")], None)]),
        (b"(a(b)\\)\\101\\7z\\\r\nq\\q) '", [("'", [("string", "a(b))A\x07zqq")], None)]),
        (b"(a\r\nb\rc) Tj", [("Tj", [("string", "a\nb\nc")], None)]),
        (b"<FEFF00e9 0> Tj<616> \"", [("Tj", [("string", "é\ufffd")], None), ('"', [("string", "a`")], None)]),
        (b"/A#20b/C gs", [("gs", [("name", "/A b"), ("name", "/C")], None)]),
        (b"[[1 (x)] << /K [null true] /N << >> >>] TJ", [("TJ", [("array", '[[1,"x"],{"/K":[null,true],"/N":{}}]')], None)]),
        (b"% note ( [\n12 w%end", [("w", [("number", "12")], None)]),
        (b"BI /W 2 ID \xff(<EI> EI Q", [("INLINE IMAGE", [], None), ("Q", [], None)]),
        (b"q (open", [("q", [], None), (None, None, "string without its end")]),
        (b"q [1 2", [("q", [], None), (None, None, "array without its end")]),
        (b"[1 2 TJ] q", [(None, None, "operator within an array or a dictionary")]),
        (b"<< /K >> BDC", [(None, None, "dictionary without pairs")]),
        (b"1 ] q", [(None, None, "] without its beginning")]),
        (b"q 1 2", [("q", [], None), (None, None, "operands without an operator")]),
        (b"BI ID xxx", [(None, None, "inline image without its end")]),
        (b"<zz> Tj", [(None, None, "unexpected byte 0x3c")]),
    ],
)
def test_streams(data, want):
    assert parsed(data) == want


def test_content_source(spark, tmp_path):
    """Files of several row groups; null and broken pages; nothing lost between batches."""
    rows = [(i, None if i % 50 == 49 else b"q " * (i % 7) + (b"(" if i % 11 == 0 else b"")) for i in range(300)] + [(None, b"q")]
    data = spark.createDataFrame(rows, "page bigint, content binary")
    data.repartition(3).write.parquet(f"{tmp_path}/c")
    got = content.read_content(spark, f"{tmp_path}/c")
    assert got.rdd.getNumPartitions() == 3
    want = [(p, i, None if e else "q", "string without its end" if e else None) for p, c in rows for n, broken in [((c or b"").count(b"q"), (c or b"").endswith(b"("))] for i, e in [*((i, False) for i in range(n)), *([(n, True)] if broken else [])]]
    assert sorted(map(str, (tuple(x) for x in got.select("page", "i", "op", "error").collect()))) == sorted(str(x) for x in want)
    spark.createDataFrame([], "page bigint, content binary").write.parquet(f"{tmp_path}/empty")
    assert content.read_content(spark, f"{tmp_path}/empty").count() == 0


def test_a_large_stream_is_read_in_batches(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    one = b"1 0 0 1 72 720 Tm (some text of a line) Tj\n"
    pq.write_table(pa.table({"page": [1], "content": [one * (20 * (1 << 20) // len(one))]}), f"{tmp_path}/x.parquet")
    reader = content.ContentReader(str(tmp_path))
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for part in reader.partitions():
        for batch in reader.read(part):
            assert batch.num_rows <= content.BATCH
            n += batch.num_rows
    assert n == 2 * (20 * (1 << 20) // len(one))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


# ---- keyed store ----


def test_store_replays_and_reads_one_bucket(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", ["k"], latest_by(["k"], "at"), buckets=8)
    rows = lambda *x: spark.createDataFrame(x, "k bigint, at int, v string")
    assert store.upsert(rows(*[(i, 1, f"a{i}") for i in range(100)], (None, 1, "none")), 0)
    first = dict(store.manifest()["buckets"])
    assert store.upsert(rows((7, 2, "b"), (7, 1, "older"), (200, 1, "new")), 1)
    assert not store.upsert(rows((7, 3, "again")), 1) and not store.upsert(rows((7, 3, "again")), 0)
    now = store.manifest()["buckets"]
    assert sum(now[k] != first.get(k) for k in now) <= 2  # the others' files are those of before
    assert store.upsert(rows(), 2) and store.manifest()["buckets"] == now
    assert {x.k: x.v for x in store.table().collect()} == {**{i: f"a{i}" for i in range(100)}, 7: "b", 200: "new", None: "none"}
    got = store.get(7)
    assert [tuple(x) for x in got.collect()] == [(7, 2, "b")] and len({f.rsplit("/", 2)[-2] for f in got.inputFiles()}) == 1
    assert store.get(None).first().v == "none" and store.get(12345).count() == 0
    # a batch that broke off before its manifest is not seen, and goes with what is old
    rows((7, 9, "lost")).write.parquet(f"{tmp_path}/store/data-000000000099-9/_bucket=1")
    assert store.get(7).first().v == "b"
    assert any("99-9" in x for x in store.vacuum(1)) and store.table().count() == 102


def test_counters_add_up_once(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", ["k"], summed(["k"], "n"))
    batch = spark.createDataFrame([(1, 2), (2, 3)], "k bigint, n bigint")
    for n in (0, 1, 1, 2, 0):
        store.upsert(batch, n)
    assert {x.k: x.n for x in store.table().collect()} == {1: 6, 2: 9}


# ---- jobs as state ----


def run_batches(spark, tmp_path, batches, make, schema):
    """Rows put down as a file for each batch, through a query with one file for each trigger; (result, states' sizes)."""
    folder, sizes = tmp_path / "in", []
    folder.mkdir()
    with lifecycle.rocks(spark):
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).outputMode("append").start()
        try:
            for n, rows in enumerate(batches):
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/new{n}")
                next((tmp_path / f"new{n}").glob("*.parquet")).rename(folder / f"{n:04d}.parquet")
                query.processAllAvailable()
                sizes.append(sum(x["numRowsTotal"] for x in query.lastProgress["stateOperators"]))
        finally:
            query.stop()
    return spark.read.parquet(str(tmp_path / "out")).collect(), sizes


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_timers_of_running_jobs(spark, tmp_path):
    """A running job fails by its timer, another by its next command; ended jobs leave the state, whatever the batches."""
    rows = [[(1, at(0), 1, "submit"), (1, at(1), 2, "start"), (2, at(0), 3, "submit"), (2, at(1), 4, "start"), (2, at(1.5), 5, "page"), (2, at(1.9), 6, "finish"), (3, at(1), 7, "submit"), (3, at(1.1), 8, "start"), (3, at(4), 9, "finish")]]
    rows += [[(100 + i, at(200 * i), 1, "submit"), (100 + i, at(200 * i + 0.5), 2, "start"), (100 + i, at(200 * i + 1), 3, "finish")] for i in range(1, 7)]
    got, sizes = run_batches(spark, tmp_path, rows, lifecycle.transitions, "job bigint, ts timestamp, event_id bigint, command string")
    seen = {j: [(x["before"], x["after"], x["pages"], x["reason"], x["at"]) for x in sorted((x for x in got if x.job == j), key=lambda x: x["at"])] for j in (1, 2, 3)}
    assert seen[1][1:] == [("queued", "running", 0, "start", at(1)), ("running", "failed", 0, "timeout", at(2))]
    assert seen[2][-1] == ("running", "done", 1, "finish", at(1.9))
    assert seen[3][-1] == ("running", "failed", 0, "timeout", at(2.1)) and len(seen[3]) == 3
    assert sizes[-1] <= sizes[1]  # one job comes, one goes


class Handle:
    """A state store's handle in memory; it counts the messages that a store in the JVM would be sent."""

    def __init__(self):
        self.value, self.timers, self.sent = None, set(), []

    def getValueState(self, name, schema):
        return self

    def _said(self, what, result=None):
        self.sent.append(what)
        return result

    def get(self):
        return self._said("get", self.value)

    def exists(self):
        return self._said("exists", self.value is not None)

    def update(self, value):
        self.value = self._said("update", tuple(value))

    def clear(self):
        self.value = self._said("clear")

    def registerTimer(self, at):
        assert at not in self.timers
        self._said("register", self.timers.add(at))

    def deleteTimer(self, at):
        self._said("delete", self.timers.remove(at))

    def listTimers(self):
        return self._said("list", iter(sorted(self.timers)))


def test_one_job_sends_few_messages():
    """A job's timer is known by its state: one look, one update and one timer a batch, none for what changes nothing; one timer
    at most, that of the state. Commands without an event are last of their time, commands that mean nothing only pass time."""
    import pandas as pd

    machine, handle, hour = lifecycle.JobMachine(), Handle(), 3600 * 1_000_000
    machine.init(handle)

    def came(*rows):
        handle.sent.clear()
        part = pd.DataFrame(rows, columns=["ts", "event_id", "command"]).assign(job=5, ts=lambda df: pd.to_datetime(df["ts"], unit="us"))
        return [tuple(x) for df in machine.handleInputRows((5,), iter([part.iloc[:1], part.iloc[1:]]), None) for x in df.itertuples(index=False)]

    assert came((0, 1, None), (1, 2, "page")) == [] and handle.sent == ["get"] and handle.value is None
    got = came((9, None, "page"), (7, 4, "start"), (9, 6, "submit"), (7, 3, "submit"), (8, 5, "page"))
    assert got == [(5, 7, "", "queued", 0, "submit"), (5, 7, "queued", "running", 0, "start")]
    assert handle.sent == ["get", "update", "register"] and handle.value == ("running", 7, 2) and handle.timers == {3600_000}
    assert came((10, 7, "page")) == [] and handle.sent == ["get", "update"] and handle.value == ("running", 7, 3)
    assert came((20, 8, "finish")) == [(5, 20, "running", "done", 3, "finish")]
    assert handle.sent == ["get", "update", "delete", "register"] and handle.timers == {86_400_000}
    assert came((21, 9, "submit"), (hour, 10, "start"), (3 * hour, 11, None)) == [(5, 21, "done", "queued", 0, "submit"), (5, hour, "queued", "running", 0, "start"), (5, 2 * hour, "running", "failed", 0, "timeout")]
    assert handle.value == ("failed", 2 * hour, 0) and handle.timers == {2 * 3600_000 + 86_400_000}


def test_transitions_in_another_time_zone(spark, tmp_path):
    """A transition is at its command's time, whatever the session's time zone."""
    schema, old = "job bigint, ts timestamp, event_id bigint, command string", spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1, at(0), 1, "submit"), (1, at(1), 2, "start")], schema)
    df.write.parquet(f"{tmp_path}/in")
    want = {(x.after, x.us) for x in df.selectExpr("case command when 'submit' then 'queued' else 'running' end as after", "unix_micros(ts) as us").collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        with lifecycle.rocks(spark):
            out = lifecycle.run_available(spark, lifecycle.transitions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "append")
        got = {(x.after, x.us) for x in out.where("reason <> 'timeout'").selectExpr("after", "unix_micros(at) as us").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == want


def test_payments_at_their_time(spark):
    when = lambda *x: [(*r[:2], at(r[2])) for r in x]
    paid = spark.createDataFrame(when(("early", 1, -50), ("in time", 1, 1), ("in time", 1, 1), ("late", 1, 30), ("of none", 9, 5)), "event string, job bigint, paid_at timestamp")
    states = spark.createDataFrame([(1, "queued", at(0), at(24)), (1, "running", at(24), None)], "job bigint, state string, since timestamp, until timestamp")
    got = {x.event: (x.state, x.acts) for x in lifecycle.judged(paid.distinct(), states).collect()}  # as a batch
    assert got == {"early": (None, False), "in time": ("queued", True), "late": ("running", False), "of none": (None, False)}
