"""Jobs as keyed state: a state machine with timers, and payments judged by a job's state at their time.

Both run on event time in append mode: a row is final when it leaves, nothing is rewritten, and state leaves with the
watermark. The state machine keeps one small record for each job under way, and forgets an ended job after its outputs'
lifetime. The judge of payments joins each batch as tables, and between batches keeps, as Parquet, only the payments and spans
that the watermark leaves able to meet: a batch of any size costs its shuffles, not a state of all its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.scalars import OUTPUT_TTL
from lectern.operators.jobs import TIMEOUT
from lectern.sources.shared import folder, removed
from lectern.streaming.metering import rocks, run_available, stream_of

#: How much later than the newest row a row may come.
DELAY = "35 hours"
DELAY_US = 35 * 3600 * 1_000_000
#: Days that a state's span and a payment for it may lie apart.
BOUND = 120
#: What an event asks of its job, and the states in which that means something.
COMMANDS = {"signup": "submit", "view": "start", "click": "page", "purchase": "finish", "error": "fail"}
TRANSITIONS = {("", "submit"): "queued", ("done", "submit"): "queued", ("failed", "submit"): "queued", ("queued", "start"): "running", ("queued", "fail"): "failed", ("running", "fail"): "failed", ("running", "finish"): "done"}

OUTPUT = "job bigint, at bigint, before string, after string, pages int, reason string"


def _out(key: tuple, found: list[tuple]) -> pd.DataFrame:
    """Rows of OUTPUT; at in microseconds, so that no time zone is converted for each job."""
    at, before, after, pages, reason = zip(*found, strict=True)
    return pd.DataFrame({"job": [key[0]] * len(found), "at": at, "before": before, "after": after, "pages": pages, "reason": reason})


def _until(state: str, since: int) -> int | None:
    """Milliseconds at which the timer of a job in this state goes off; queued jobs and those without a state have none."""
    return None if state in ("", "queued") else since // 1000 + (TIMEOUT if state == "running" else OUTPUT_TTL) * 1000


class JobMachine(StatefulProcessor):
    """States of one job. A running job that has not ended TIMEOUT seconds after its start fails then: by its next command if
    that comes first, else by a timer. An ended job is forgotten OUTPUT_TTL seconds later. A job's timer follows from its
    state (see _until), so it is not asked for; each call to the state store is a message to the JVM and back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, since bigint, pages int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = state, since, pages = self.job.get() or ("", 0, 0)
        found, parts = [], [(p["ts"].to_numpy("datetime64[us]").astype("int64"), p["event_id"].to_numpy(), p["command"].to_numpy()) for p in rows]
        ts, events, commands = (c[0] if len(c) == 1 else np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((events, ts))  # stable; commands without an event are the last of their time
        for at, command in zip(map(int, ts[order]), commands[order], strict=True):
            if state == "running" and at > since + TIMEOUT * 1_000_000:
                found.append((since + TIMEOUT * 1_000_000, state, "failed", pages, "timeout"))
                state, since = "failed", since + TIMEOUT * 1_000_000
            if state == "running" and command == "page":
                pages += 1
            elif after := TRANSITIONS.get((state, command)):
                pages = 0 if after == "queued" else pages
                found.append((at, state, after, pages, command))
                state, since = after, at
        if (state, since, pages) != old:
            self.job.update((state, since, pages))
        was, now = _until(*old[:2]), _until(state, since)
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)
        if found:
            yield _out(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since, pages = self.job.get() or ("", 0, 0)
        if state == "running":
            at = since + TIMEOUT * 1_000_000
            self.job.update(("failed", at, pages))
            self.handle.registerTimer(_until("failed", at))
            yield _out(key, [(at, "running", "failed", pages, "timeout")])
        else:
            self.job.clear()

    def close(self) -> None:
        pass


def transitions(commands: DataFrame) -> DataFrame:
    """job, at, before, after, pages, reason of a stream of commands (job, ts, event_id, command). The machine counts in
    microseconds of the session's time zone, as pandas has them."""
    late = commands.withWatermark("ts", DELAY)
    found = late.groupBy("job").transformWithStateInPandas(JobMachine(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
    return found.withColumn("at", F.to_utc_timestamp(F.timestamp_micros("at"), F.current_timezone()))


def commands_of(events: DataFrame) -> DataFrame:
    """Users' events as commands to a job of each (a stand-in)."""
    names = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    return events.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.try_element_at(names, F.col("event_type")).alias("command")).where("job is not null and ts is not null")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    with rocks(spark):
        out = run_available(spark, transitions(commands_of(stream_of(spark, sf_dir, "events"))), "append")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


# ---- payments ----


def spans(orders: DataFrame) -> DataFrame:
    """job, state, since, until: an order is a job queued on its date; it runs some days later unless its status is O."""
    leaves = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 60).cast("int"), F.lit(12))
    both = F.array(
        F.struct(F.lit("queued").alias("state"), F.col("o_orderdate").alias("since"), F.when(F.col("o_orderstatus") != "O", leaves).alias("until")),
        F.when(F.col("o_orderstatus") != "O", F.struct(F.lit("running").alias("state"), leaves.alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"))),
    )
    rows = orders.select(F.col("o_orderkey").alias("job"), F.explode(both).alias("x")).where("x is not null")
    return rows.select("job", "x.state", F.col("x.since").cast("timestamp").alias("since"), F.col("x.until").cast("timestamp").alias("until"))


def payments(lineitem: DataFrame) -> DataFrame:
    """event, job, paid_at: lines of an order as payments, some before the job is there; every third is delivered twice."""
    event = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"))
    copies = F.sequence(F.lit(1), F.when(F.col("l_partkey") % 3 == 0, 2).otherwise(1))
    at = (F.col("l_shipdate") - F.expr("interval 30 days")).cast("timestamp")
    return lineitem.select(event.alias("event"), F.col("l_orderkey").alias("job"), at.alias("paid_at"), F.explode(copies).alias("copy")).drop("copy")


def _met(paid: DataFrame, states: DataFrame, how: str) -> DataFrame:
    """Payments joined with the states of their jobs at their time."""
    near = (F.col("since") <= F.col("paid_at")) & (F.col("paid_at") <= F.col("since") + F.expr(f"interval {BOUND} days"))
    return paid.join(states.withColumnRenamed("job", "of"), (F.col("job") == F.col("of")) & near & (F.col("until").isNull() | (F.col("paid_at") < F.col("until"))), how)


def _verdict(found: DataFrame, *more: str) -> DataFrame:
    return found.select("event", "job", "paid_at", "state", F.coalesce(F.col("state") == "queued", F.lit(False)).alias("acts"), *more)


def judged(once: DataFrame, states: DataFrame) -> DataFrame:
    """event, job, paid_at, state, acts: each payment with its job's state at its time; it acts on a queued job alone."""
    return _verdict(_met(once, states, "left_outer"))


PAYMENT, SPAN = "event string, job bigint, paid_at timestamp", "job bigint, state string, since timestamp, until timestamp"
VERDICT = f"{PAYMENT}, state string, acts boolean"
CLOCK = "paid bigint, since bigint, mark bigint"


class Judge:
    """Payments (delivered at least once) and spans of states as one stream of batches, see mixed(). paid, states: what makes them
    of the rows of either kind, once a batch has them apart. Below `path`: out, a folder of verdicts for each batch, and state,
    what the last batch left. A batch's late rows are those before the mark that the
    batch before it left; its own mark is the lesser of the newest payment and the newest span, less DELAY. A job's event is
    one payment, at the first of its times, however often it comes. A verdict is out once a payment and its state are there; a
    payment that has met none is out once the mark has passed it. What is kept: payments until the mark is DELAY past them
    (then no delivery of them can come), with whether they have met a state, and spans that payments not yet passed may meet.
    A batch that broke off is run again as a whole, from the state before it."""

    def __init__(self, spark: SparkSession, path: str, paid: Callable[[DataFrame], DataFrame] = lambda rows: rows, states: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.path, self.paid, self.states = spark, path, paid, states

    def _old(self, n: int, name: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if n < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/state/{n}/{name}")

    def _keep(self, rows: DataFrame, n: int, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/state/{n}/{name}")

    def step(self, batch: DataFrame, n: int) -> None:
        utc = lambda at: F.timestamp_micros(F.lit(at).cast("bigint"))
        late = self._old(n - 1, "clock", CLOCK).first() or (None, None, None)
        came = self.paid(batch.where("kind = 'payment'")).select("event", "job", "paid_at")
        begun = self.states(batch.where("kind = 'span'")).select("job", "state", "since", "until")
        newest = [df.agg(F.unix_micros(F.max(c))).first()[0] for df, c in ((came, "paid_at"), (begun, "since"))]
        paid, since = (max((x for x in both if x is not None), default=None) for both in zip(late[:2], newest, strict=True))
        mark = max((x for x in (late[2], None if paid is None or since is None else min(paid, since) - DELAY_US) if x is not None), default=None)
        not_late = lambda at: F.col(at).isNotNull() & (F.lit(late[2] is None) | (F.col(at) >= utc(late[2])))
        passed = lambda at, by=0: F.lit(mark is not None) & (F.col(at) < utc(mark and mark - by))
        old = self._old(n - 1, "payments", f"{PAYMENT}, met boolean")
        # by job, so that the join with the spans shuffles nothing again
        new = came.where(not_late("paid_at")).repartition("job").groupBy("job", "event").agg(F.min("paid_at").alias("paid_at")).withColumns({"met": F.lit(False), "new": F.lit(True)})
        spans = begun.where(not_late("since")).withColumn("came", F.lit(True))
        if n:
            spans = spans.unionByName(self._old(n - 1, "spans", SPAN).withColumn("came", F.lit(False)))
            new = new.join(old, new["job"].eqNullSafe(old["job"]) & (new["event"] == old["event"]), "left_anti").unionByName(old.withColumn("new", F.lit(False)))
        open_ = not_late("paid_at")  # the others are there to know a payment that comes again
        final = open_ & F.when(F.col("state").isNull(), ~F.col("met") & passed("paid_at")).otherwise(F.col("new") | F.col("came"))
        found = _met(new, spans, "left_outer").withColumn("final", final).where(F.col("final") | ~passed("paid_at", DELAY_US))
        _verdict(found, "met", "final").write.mode("overwrite").parquet(f"{self.path}/out/batch={n}")

        recent = self.spark.read.schema(f"{VERDICT}, met boolean").parquet(f"{self.path}/out/batch={n}").where(~passed("paid_at", DELAY_US))
        self._keep(recent.groupBy("event", "job").agg(F.min("paid_at").alias("paid_at"), F.max(F.col("met") | F.col("state").isNotNull()).alias("met")), n, "payments")
        self._keep(spans.where(~passed("since", BOUND * 86_400_000_000)).drop("came"), n, "spans")
        self._keep(self.spark.createDataFrame([(paid, since, mark)], CLOCK), n, "clock")
        removed(self.spark, f"{self.path}/state/{n - 2}")

    def run(self, rows: DataFrame) -> DataFrame:
        """The verdicts on all that is there now of a stream (see mixed)."""
        rows.writeStream.option("checkpointLocation", f"{self.path}/stream").trigger(availableNow=True).foreachBatch(self.step).start().awaitTermination()
        self.spark.createDataFrame([], f"{VERDICT}, met boolean, final boolean").write.mode("overwrite").parquet(f"{self.path}/out/batch=-1")  # if no batch came
        return self.verdicts()

    def verdicts(self) -> DataFrame:
        return self.spark.read.schema(f"{VERDICT}, final boolean").parquet(f"{self.path}/out").where("final").drop("final", "batch")


def mixed(paid: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of payments and of states as one stream; kind says which."""
    return paid.withColumn("kind", F.lit("payment")).unionByName(states.withColumn("kind", F.lit("span")), allowMissingColumns=True)


def paid_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stream_of(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = stream_of(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    found = Judge(spark, folder(spark, "stream"), payments, spans).run(mixed(lines, orders))
    return found.withColumn("paid_at", F.col("paid_at").cast("timestamp_ntz"))


_CASES = " ".join(f"when s = '{a}' and c = '{c}' then '{b}'" for (a, c), b in TRANSITIONS.items())
_NAMES = " ".join(f"when '{k}' then '{v}'" for k, v in COMMANDS.items())
_OVER = f"s = 'running' and t.ts > r.since + interval {TIMEOUT} second"
SQL = {
    "job_transitions": f"""with recursive t as (select user_id as job, ts, case event_type {_NAMES} end as c, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
w as (select max(ts) - interval '{DELAY}' as mark from t),
r as (select job, 0::bigint as n, '' as s, null::timestamp as since, 0 as pages, []::struct("at" timestamp, before varchar, after varchar, pages int, reason varchar)[] as x from (select distinct job from t)
  union all
  select job, n, coalesce(after, s) as s, case when after is not null then ts else since end as since, case when after = 'queued' then 0 when s = 'running' and c = 'page' then pages + 1 else pages end as pages,
    list_concat(x, case when after is not null then [{{'at': ts, 'before': s, 'after': after, 'pages': case when after = 'queued' then 0 else pages end, 'reason': c}}] else [] end) as x
  from (select job, n, ts, c, s, since, pages, x, case {_CASES} end as after from (
    select t.job as job, t.n as n, t.ts as ts, t.c as c, case when {_OVER} then 'failed' else s end as s, case when {_OVER} then r.since + interval {TIMEOUT} second else r.since end as since, pages,
      case when {_OVER} then [{{'at': r.since + interval {TIMEOUT} second, 'before': 'running', 'after': 'failed', 'pages': pages, 'reason': 'timeout'}}] else [] end as x from r join t on t.job = r.job and t.n = r.n + 1))),
l as (select job, s, since, pages from r qualify row_number() over (partition by job order by n desc) = 1),
u as (select job, unnest(x) as x from r union all select job, {{'at': since + interval {TIMEOUT} second, 'before': 'running', 'after': 'failed', 'pages': pages, 'reason': 'timeout'}} from l, w where s = 'running' and since + interval {TIMEOUT} second <= mark)
select job, x."at" as "at", x.before as before, x.after as after, x.pages as pages, x.reason as reason from u""",
    "paid_jobs": f"""with p as (select distinct l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_shipdate::date as event, l_orderkey as job, (l_shipdate - interval 30 day)::timestamp as paid_at from lineitem),
o as (select o_orderkey as job, o_orderstatus as st, o_orderdate::timestamp as d, o_orderdate::timestamp + to_days((o_orderkey % 60)::int) + interval 12 hour as leaves from orders),
s as (select job, 'queued' as state, d as since, case when st <> 'O' then leaves end as until from o union all select job, 'running', leaves, null from o where st <> 'O'),
w as (select least((select max(paid_at) from p), (select max(since) from s)) - interval '{DELAY}' as mark)
select event, p.job as job, paid_at, state, coalesce(state = 'queued', false) as acts from p left join s on s.job = p.job and since <= paid_at and paid_at <= since + interval {BOUND} day and (until is null or paid_at < until)
where state is not null or paid_at < (select mark from w)""",
}
