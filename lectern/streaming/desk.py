"""Messages about jobs as a stream: commands, payments, questions. State lies in a keyed store, files in file sets.

Messages (request, kind, body, signature) are read in order of arrival. Of a batch, commands come first, then what releases
jobs, then the run of all that is queued, then the answers. Uploads and outputs are committed files, so whether one is there
is read from manifests. A batch looks up its own jobs' buckets, opens its own uploads, reads each once however many of its
jobs want it, and puts down its records by one upsert; its answers depend on its messages and on the store after it alone.
A batch that broke off is run again as a whole and gives the same answers.

Kinds, and their bodies (JSON):
- command {upload_id, email}: a job of the command's own number; 400 without an upload, 404 if it isn't there, else 200.
  It waits for payment if something is due.
- webhook, signed: a paid session's event releases the job that its metadata names; 400 if the signature is wrong, else 200.
- redirect {job_id, paid}: paid releases as well, 404 without such a job; else nothing changes. 307 with an address.
- status {job_id}: the record as JSON; 404 without such a job.
- download {job_id, format}: the first of FORMS that is there, of the asked format alone if it isn't the first; 404, 400
  before the job is done, 500 if no file is there.
Anything else, and a body that can't be read, is 400. A message delivered again changes nothing; of messages that release one
job, that of the least number in the first batch does. A message for a job whose command comes in a later batch finds none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalars as s
from lectern.operators import elements, runs
from lectern.operators.jobs import DOCX, PAID, PDF, SECRET, hmac
from lectern.sources import content, docx
from lectern.sources.files import contents, manifest, write_files
from lectern.sources.keyed import KeyedStore, latest_by
from lectern.sources.shared import folder

MESSAGE = "request bigint, kind string, body string, signature string"
BODY = "job_id string, upload_id string, email string, paid boolean, format string, type string, data struct<object: struct<metadata: struct<job_id: string>>>"
RECORD = "job bigint, seq int, status string, upload bigint, pages int, cents int, email string, released_by bigint, message string, n_elements int, tags string, missing int"
#: Formats of outputs in order of preference: media type and ending of the file.
FORMS = {"pdf": (PDF, s.PDF_END), "docx": (DOCX, s.DOCX_END)}
#: Ending of an upload's file.
UPLOAD_END = ".page"
WAITS = "awaiting_payment"


def named(key: Column, end: str) -> Column:
    return F.concat(key.cast("string"), F.lit(end))


def parsed(messages: DataFrame, secret: str = SECRET) -> DataFrame:
    """request, kind, job, b (the body), ok (it can be read, and its signature is right where it has to be), frees (whether it
    releases its job)."""
    m = messages.select("request", "kind", "body", "signature", F.from_json("body", BODY).alias("b"))
    paid = F.when(F.col("b.type") == PAID, F.col("b.data.object.metadata.job_id"))
    key = F.when(F.col("kind") == "webhook", paid).otherwise(F.col("b.job_id"))
    known = F.col("kind").isin("command", "webhook", "redirect", "status", "download") & F.get_json_object("body", "$").isNotNull()
    signed = (F.col("kind") != "webhook") | F.coalesce(F.col("signature") == hmac(F.col("body"), secret), F.lit(False))
    ok = F.coalesce(known & signed, F.lit(False))
    job = F.when(ok, F.when(F.col("kind") == "command", F.col("request")).otherwise(key.try_cast("bigint")))
    frees = (F.col("kind") == "webhook") | ((F.col("kind") == "redirect") & F.coalesce("b.paid", F.lit(False)))
    return m.select("request", "kind", "b", ok.alias("ok"), job.alias("job")).withColumn("frees", F.col("job").isNotNull() & frees)


class Desk:
    """uploads: upload (bigint), pages; their bytes are files of the set at `uploads_at`, named by upload and `end`; an end in .gz
    is a file that is packed as it is written and unpacked as it is read."""

    def __init__(self, spark: SparkSession, path: str, uploads: DataFrame, uploads_at: str, secret: str = SECRET, end: str = UPLOAD_END):
        self.spark, self.path, self.uploads_at, self.secret, self.end = spark, path, uploads_at, secret, end
        self.outputs_at = f"{path}/outputs"
        self.uploads = uploads.select("upload", F.col("pages").cast("int").alias("pages"))
        self.store = KeyedStore(spark, f"{path}/store", ["job"], latest_by(["job"], "seq"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Written to the shared folder and read again, as it is used more than once."""
        at = f"{self.path}/work/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _files(self, at: str) -> DataFrame:
        """name, path of committed files, each name once."""
        return manifest(self.spark, at).groupBy("name").agg(F.min("path").alias("path"))

    def put(self, messages: DataFrame) -> None:
        schema = self.spark.createDataFrame([], MESSAGE).schema
        messages.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").option("compression", "gzip").json(f"{self.path}/inbox")

    def _known(self, m: DataFrame) -> DataFrame:
        """Records in the buckets of a batch's jobs."""
        found = self.store.near(m.where("job is not null").select("job"))
        return self.spark.createDataFrame([], RECORD) if found is None else found

    def _commands(self, m: DataFrame) -> DataFrame:
        """request, upload, email, pages (null if the upload isn't there) of the commands that name an upload."""
        c = m.where("kind = 'command' and ok").select("request", F.col("b.upload_id").try_cast("bigint").alias("upload"), F.nullif(F.trim("b.email"), F.lit("")).alias("email"))
        there = self.uploads.withColumn("name", named(F.col("upload"), self.end)).join(self._files(self.uploads_at), "name").groupBy("upload").agg(F.max("pages").alias("pages"))
        return c.join(there, "upload", "left")

    def _started(self, m: DataFrame) -> DataFrame:
        """First records of commands."""
        one = self._commands(m).where("request is not null and pages is not null").groupBy(F.col("request").alias("job")).agg(F.min(F.struct("upload", "email", "pages")).alias("x"))
        due = s.cents_truncated(F.col("x.pages"))
        none = lambda kind: F.lit(None).cast(kind)
        return one.select(
            "job", F.when(due > 0, 0).otherwise(1).cast("int").alias("seq"), F.when(due > 0, WAITS).otherwise("queued").alias("status"), "x.upload", "x.pages", due.alias("cents"), "x.email",
            none("bigint").alias("released_by"), none("string").alias("message"), none("int").alias("n_elements"), none("string").alias("tags"), none("int").alias("missing"),
        )

    def _executed(self, queued: DataFrame) -> DataFrame:
        """Last records of queued jobs, whose outputs are written. An upload is read and analysed once for all its jobs."""
        wanted = queued.groupBy("upload").agg(F.lit(1).alias("one")).withColumn("name", named(F.col("upload"), self.end))
        at = wanted.join(self._files(self.uploads_at), "name").select(F.col("upload").alias("page"), "path")
        streams = contents(at, self.uploads_at).select("page", "content")
        texts = self._kept(runs.scanned(at, content.written(streams)))
        style = lambda e: F.when(e["type"] == "heading", F.concat(F.lit("Heading "), s.level(e["level"]).cast("string"))).otherwise("Normal")
        paras = F.transform("elements", lambda e: F.struct(style(e).alias("style"), e["text"].alias("text")))
        typed = lambda kind: F.lit(None).cast(kind)
        made = elements.elements(texts.where("message is null")).withColumn("paras", paras)
        parts = made.select("doc_id", F.lit("en-US").alias("lang"), F.get("paras", F.lit(0))["text"].alias("title"), "paras", typed("array<struct<has_header: boolean, cells: array<array<string>>>>").alias("tables"), typed("array<string>").alias("alts"))
        write_files(docx.packages(parts).select(named(F.col("doc_id"), s.DOCX_END).alias("name"), "content"), self.outputs_at)
        ended = runs.finished(texts).select(F.col("job").alias("upload"), "status", "message", "n_elements", "tags", "missing")
        return queued.drop("seq", "status", "message", "n_elements", "tags", "missing").join(ended, "upload").withColumn("seq", F.lit(2))

    def records(self, m: DataFrame) -> DataFrame:
        """What a batch puts into the store."""
        known = self._known(m)
        new = self._started(m).join(known.select("job"), "job", "left_anti").select(*known.columns)
        frees = m.where("frees").groupBy("job").agg(F.min("request").alias("by"))
        waiting = known.unionByName(new).where(F.col("status") == WAITS)
        released = waiting.join(frees, "job").withColumn("released_by", F.col("by")).withColumn("status", F.lit("queued")).select(*known.columns)
        queued = self._kept(new.where("status = 'queued'").unionByName(released))
        return new.where(F.col("status") == WAITS).unionByName(self._executed(queued).select(*known.columns))

    def answers(self, m: DataFrame) -> DataFrame:
        """request, kind, code, job, status, detail, media (of a download), released of a batch's messages."""
        record = self._known(m).select("job", F.struct(*[f.strip().split()[0] for f in RECORD.split(",")]).alias("r"))
        pages = self._commands(m).groupBy("request").agg(F.max("pages").alias("pages")).select("request", F.lit("command").alias("kind"), "pages")
        files = self._files(self.outputs_at).select("name")
        found = m.join(record, "job", "left").join(pages, ["request", "kind"], "left")
        for form, (_, end) in FORMS.items():
            there = files.select(F.col("name").alias(form))
            found = found.join(there, named(F.col("r.upload"), end) == F.col(form), "left")
        kind, status, none = F.col("kind"), F.col("r.status"), F.col("r.job").isNull()
        has = {form: F.coalesce((status == "done") & F.col(form).isNotNull(), F.lit(False)) for form in FORMS}
        first = next(iter(FORMS))
        asked = F.coalesce("b.format", F.lit(first))
        file = F.coalesce(*[F.when(has[form] & (asked.isin(form, first)), F.col(form)) for form in FORMS])
        media = F.coalesce(*[F.when(file == F.col(form), kind_of) for form, (kind_of, _) in FORMS.items()])
        paid = F.coalesce("b.paid", F.lit(False))
        code = (
            F.when(~F.col("ok"), 400)
            .when(kind == "command", F.when(F.nullif(F.col("b.upload_id"), F.lit("")).isNull(), 400).when(F.col("pages").isNull(), 404).otherwise(200))
            .when(kind == "webhook", 200)
            .when(kind == "redirect", F.when(paid & none, 404).otherwise(307))
            .when(none, 404)
            .when(kind == "status", 200)
            .otherwise(F.when(status != "done", 400).when(file.isNull(), 500).otherwise(200))
        )
        body = F.to_json(F.struct("r.job", "r.status", "r.pages", "r.cents", "r.message", "r.missing", *[x.alias(f"has_{form}") for form, x in has.items()]), {"ignoreNullFields": "false"})
        url = F.when(~paid, F.lit("/?cancelled=1")).otherwise(F.concat(F.lit("/?job_id="), F.col("job").cast("string"), F.lit("&paid=1")))
        detail = F.when(kind == "status", body).when(kind == "redirect", url).when(kind == "download", file)
        begun = F.when(kind == "command", F.when(F.col("r.cents") > 0, WAITS).otherwise("queued")).otherwise(status)
        good = F.col("code").isin(200, 307)
        out = found.withColumn("code", code)
        return out.select("request", "kind", "code", "job", F.when(good & F.col("r").isNotNull(), begun).alias("status"), F.when(good, detail).alias("detail"), F.when(good & (kind == "download"), media).alias("media"), F.coalesce(F.col("frees") & (F.col("r.released_by") == F.col("request")), F.lit(False)).alias("released"))

    def step(self, batch: DataFrame, n: int) -> None:
        m = parsed(batch, self.secret).persist()
        try:
            if n > self.store.manifest()["batch"]:
                self.store.upsert(self.records(m), n)
                self.store.vacuum()
            self.answers(m).write.mode("overwrite").parquet(f"{self.path}/answers/batch={n}")
        finally:
            m.unpersist()
            self.store.remove(f"{self.path}/work")

    def work(self, files: int = 64) -> None:
        """All messages that wait now, `files` files of them a batch."""
        waiting = self.spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").json(f"{self.path}/inbox")
        writer = waiting.writeStream.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True)
        writer.foreachBatch(self.step).start().awaitTermination()

    def answered(self) -> DataFrame:
        """Answers of all batches."""
        found = "request bigint, kind string, code int, job bigint, status string, detail string, media string, released boolean, batch bigint"
        if not self.store.has(f"{self.path}/answers"):
            return self.spark.createDataFrame([], found)
        return self.spark.read.schema(found).parquet(f"{self.path}/answers")


def desk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commands to process the document of the customer's number, then events as payments (purchases, some with a
    wrong signature), redirects (signups paid, errors not), and of each event a question for its job's status and file."""
    docs, orders, events = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "orders", "events"))
    uploads_at = f"{folder(spark, 'uploads')}/files"
    full = docs.where("text <> ''")
    write_files(content.document_content(full).select(named(F.col("page"), UPLOAD_END + ".gz").alias("name"), "content"), uploads_at)
    pages = F.least(F.greatest(F.ceil(F.coalesce("n_chars", F.lit(0)) / 800), F.lit(1)), F.lit(s.MAX_PAGES))
    desk = Desk(spark, folder(spark, "desk"), docs.select(F.col("doc_id").alias("upload"), pages.alias("pages")), uploads_at, end=UPLOAD_END + ".gz")
    no = F.lit(None).cast("string")
    upload = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string"))
    desk.put(orders.select(F.col("o_orderkey").alias("request"), F.lit("command").alias("kind"), F.to_json(F.struct(upload.alias("upload_id"), F.lit(" a@b.c ").alias("email"))).alias("body"), no.alias("signature")))
    desk.work()
    key = F.col("event_id").cast("string")
    event = F.to_json(F.struct(F.lit(PAID).alias("type"), F.struct(F.struct(F.struct(key.alias("job_id")).alias("metadata")).alias("object")).alias("data")))
    signed = F.when(F.col("value") < 5, hmac(event, "another")).otherwise(hmac(event, SECRET))
    of = lambda kind, body, sign=no: F.struct(F.lit(kind).alias("kind"), body.alias("body"), sign.alias("signature"))
    asks = F.to_json(F.struct(key.alias("job_id")))
    back = F.to_json(F.struct(key.alias("job_id"), (F.col("event_type") == "signup").alias("paid")))
    pay = F.when(F.col("event_type") == "purchase", of("webhook", event, signed)).when(F.col("event_type").isin("signup", "error"), of("redirect", back))
    sent = events.select(F.col("event_id").alias("request"), F.explode(F.array(pay, of("status", asks), of("download", asks))).alias("x"))
    desk.put(sent.where("x is not null").select("request", "x.*"))
    desk.work()
    return desk.answered().drop("batch")


SQL = {
    "desk_answers": f"""with e as ({runs.SQL["executed_jobs"]}), d as (select doc_id as upload, least(500, greatest(1, ceil(coalesce(n_chars, 0) / 800)))::int as pages from documents where text <> ''),
c as (select o_orderkey as request, case when o_orderstatus <> 'P' then o_custkey end as upload from orders),
j as (select request as job, upload, pages, case when pages > 3 then trunc(round((pages - 3) * 0.05::double, 2) * 100)::int end as cents from c join d using (upload)),
p as (select event_id as request, event_type as type, event_type = 'signup' or event_type = 'purchase' and not coalesce(value < 5, false) as frees from events),
r as (select j.job, pages, cents, coalesce(cents > 0, false) as due, coalesce(cents > 0, false) and coalesce(frees, false) as released, case when coalesce(cents > 0, false) and not coalesce(frees, false) then '{WAITS}' else e.status end as status, case when not coalesce(cents > 0, false) or coalesce(frees, false) then e.message end as message,
  case when not coalesce(cents > 0, false) or coalesce(frees, false) then e.missing end as missing, upload from j left join p on p.request = j.job left join e on e.job = upload),
q as (select p.*, r.* from p left join r on r.job = p.request)
select request, 'command' as kind, case when upload is null then 400 when j.job is null then 404 else 200 end as code, request as job, case when j.job is not null then case when cents > 0 then '{WAITS}' else 'queued' end end as status, null::varchar as detail, null::varchar as media, false as released from (select c.request, c.upload, j.job, j.cents from c left join j on j.job = c.request) j
union all select request, 'webhook', case when frees then 200 else 400 end, case when frees then request end, case when frees then status end, null, null, coalesce(frees and released, false) from q where type = 'purchase'
union all select request, 'redirect', case when type = 'signup' and job is null then 404 else 307 end, request, status, case when type = 'error' then '/?cancelled=1' when job is not null then '/?job_id=' || request || '&paid=1' end, null, coalesce(frees and released, false) from q where type in ('signup', 'error')
union all select request, 'status', case when job is null then 404 else 200 end, request, status, case when job is not null then '{{"job":' || job || ',"status":"' || status || '","pages":' || pages || ',"cents":' || coalesce(cents::varchar, 'null') || ',"message":' || coalesce('"' || message || '"', 'null') || ',"missing":' || coalesce(missing::varchar, 'null') || ',"has_pdf":false,"has_docx":' || (status = 'done') || '}}' end, null, false from q
union all select request, 'download', case when job is null then 404 when status <> 'done' then 400 else 200 end, request, case when status = 'done' then status end, case when status = 'done' then upload || '{s.DOCX_END}' end, case when status = 'done' then '{DOCX}' end, false from q""",
}
