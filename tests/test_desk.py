"""Messages about jobs: answers by hand, repeats, batches that break off, files that are missing, bodies that can't be read."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators.jobs import DOCX, PDF
from lectern.sources import docx, files
from lectern.streaming.desk import MESSAGE, Desk

SECRET = "key of the test"
GOOD, BROKEN, EMPTY = b"BT (TITLE) Tj (some longer line) Tj (x) Tj ET", b"BT (never closed", b""


def paid(job, secret=SECRET, kind="checkout.session.completed"):
    body = json.dumps({"type": kind, "data": {"object": {"metadata": {"job_id": job}}}})
    return body, hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def message(request, kind, body, signature=None):
    return request, kind, body if body is None or isinstance(body, str) else json.dumps(body), signature


@pytest.fixture
def desk(spark, tmp_path):
    sets = [("1.page", GOOD), ("2.page", BROKEN), ("3.page", EMPTY), ("4.page", GOOD)]
    files.write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in sets], "name string, content binary"), f"{tmp_path}/uploads")
    uploads = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 9), (5, 1)], "upload bigint, pages int")  # of 5 there is no file
    return Desk(spark, f"{tmp_path}/desk", uploads, f"{tmp_path}/uploads", SECRET)


def batch(spark, *rows):
    return spark.createDataFrame([message(*r) for r in rows], MESSAGE)


def answers(desk):
    return {(r.request, r.kind, r.batch): (r.code, r.job, r.status, r.detail, r.released) for r in desk.answered().collect()}


def send(spark, desk, *rows):
    desk.put(batch(spark, *rows).coalesce(1))
    desk.work()
    found = answers(desk)
    last = max(k[2] for k in found)
    return {k[:2]: v for k, v in found.items() if k[2] == last}


def test_from_command_to_download(spark, desk):
    got = send(
        spark, desk,
        (10, "command", {"upload_id": "1", "email": " a@b.c "}), (11, "command", {"upload_id": "2"}), (12, "command", {"upload_id": "3"}), (13, "command", {"upload_id": "4"}),
        (14, "command", {"upload_id": "5"}), (15, "command", {"upload_id": ""}), (16, "command", {}), (17, "command", "{bad"), (18, "command", None), (19, "greeting", {}), (None, None, None),
        (20, "command", {"upload_id": "x"}), (10, "command", {"upload_id": "1", "email": " a@b.c "}),
    )
    assert got == {
        (10, "command"): (200, 10, "queued", None, False), (11, "command"): (200, 11, "queued", None, False), (12, "command"): (200, 12, "queued", None, False), (13, "command"): (200, 13, "awaiting_payment", None, False),
        (14, "command"): (404, 14, None, None, False), (15, "command"): (400, 15, None, None, False), (16, "command"): (400, 16, None, None, False), (17, "command"): (400, None, None, None, False),
        (18, "command"): (400, None, None, None, False), (19, "greeting"): (400, None, None, None, False), (None, None): (400, None, None, None, False), (20, "command"): (404, 20, None, None, False),
    }
    records = {r.job: r for r in desk.store.table().collect()}
    assert {j: (r.status, r.message, r.tags, r.missing, r.email, r.cents) for j, r in records.items()} == {
        10: ("done", None, "H1,P", 0, "a@b.c", None), 11: ("failed", "string without its end", None, None, None, None), 12: ("failed", "nothing to read", None, None, None, None), 13: ("awaiting_payment", None, None, None, None, 30),
    }
    ask = {"job_id": "10"}
    got = send(spark, desk, (1, "status", ask), (2, "download", ask), (3, "download", ask | {"format": "docx"}), (4, "download", {"job_id": "11"}), (5, "download", {"job_id": "13"}), (6, "download", {"job_id": "99"}), (7, "status", {"job_id": "no"}), (8, "redirect", {"job_id": "13", "paid": False}), (9, "redirect", {"job_id": "99", "paid": True}))
    assert json.loads(got[1, "status"][3]) == {"job": 10, "status": "done", "pages": 2, "cents": None, "message": None, "missing": 0, "has_pdf": False, "has_docx": True}
    assert [got[k, "download"] for k in (2, 3)] == [(200, 10, "done", "1_accessible.docx", False)] * 2
    assert [got[k, "download"][0] for k in (4, 5, 6)] == [400, 400, 404]
    assert got[7, "status"] == (404, None, None, None, False)
    assert got[8, "redirect"] == (307, 13, "awaiting_payment", "/?cancelled=1", False) and got[9, "redirect"] == (404, 99, None, None, False)
    # a PDF is preferred once it is there, and not if the other is asked for
    files.write_files(spark.createDataFrame([("1_ada.pdf", bytearray(b"%"))], "name string, content binary"), desk.outputs_at)
    got = send(spark, desk, (2, "download", ask), (3, "download", ask | {"format": "docx"}))
    assert (got[2, "download"][3], got[3, "download"][3]) == ("1_ada.pdf", "1_accessible.docx")
    assert {(r.detail, r.media) for r in desk.answered().where("kind = 'download' and code = 200").collect()} == {("1_ada.pdf", PDF), ("1_accessible.docx", DOCX)}
    package = docx.read_packages(files.read_files(spark, desk.outputs_at).where("name like '%.docx'")).collect()
    assert [(r.name, r.title, [tuple(p) for p in r.paras]) for r in package] == [("1_accessible.docx", "TITLE", [("Heading 1", "TITLE"), ("Normal", "some longer line")])]


def test_a_job_is_released_once(spark, desk):
    send(spark, desk, (13, "command", {"upload_id": "4"}), (30, "command", {"upload_id": "4"}))
    assert send(spark, desk, (1, "webhook", *paid("13", "another")), (2, "webhook", paid("13")[0]), (3, "webhook", *paid("13", kind="charge.refunded")), (4, "webhook", *paid("77"))) == {
        (1, "webhook"): (400, None, None, None, False), (2, "webhook"): (400, None, None, None, False), (3, "webhook"): (200, None, None, None, False), (4, "webhook"): (200, 77, None, None, False),
    }
    assert {r.status for r in desk.store.table().collect()} == {"awaiting_payment"}
    got = send(spark, desk, (6, "webhook", *paid("13")), (5, "webhook", *paid("13")), (7, "redirect", {"job_id": "13", "paid": True}), (8, "status", {"job_id": "13"}))
    assert [got[k][4] for k in ((5, "webhook"), (6, "webhook"), (7, "redirect"))] == [True, False, False]
    assert got[8, "status"][2] == "done" and got[7, "redirect"][3] == "/?job_id=13&paid=1"
    assert not send(spark, desk, (4, "webhook", *paid("13")))[4, "webhook"][4]
    assert send(spark, desk, (9, "redirect", {"job_id": "30", "paid": True}))[9, "redirect"] == (307, 30, "done", "/?job_id=30&paid=1", True)


def test_a_batch_that_broke_off_gives_the_same(spark, desk, monkeypatch):
    send(spark, desk, (13, "command", {"upload_id": "4"}))
    whole, calls = Desk.answers, []

    def broken(self, m):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("lost")
        return whole(self, m)

    monkeypatch.setattr(Desk, "answers", broken)
    desk.put(batch(spark, (1, "webhook", *paid("13")), (40, "command", {"upload_id": "1"})).coalesce(1))
    with pytest.raises(Exception, match="lost"):
        desk.work()
    version = desk.store.manifest()["version"]
    desk.work()  # records are there; the answers are made again
    found = answers(desk)
    assert desk.store.manifest()["version"] == version and len(calls) == 2
    assert found[1, "webhook", 1] == (200, 13, "done", None, True) and found[40, "command", 1] == (200, 40, "queued", None, False)
    assert sorted(r.name for r in files.manifest(spark, desk.outputs_at).collect()) == ["1_accessible.docx", "4_accessible.docx"]


def test_file_that_went(spark, desk, tmp_path):
    send(spark, desk, (10, "command", {"upload_id": "1"}))
    for f in (tmp_path / "desk" / "outputs").glob("manifest-*.json"):
        f.unlink()
    got = send(spark, desk, (1, "download", {"job_id": "10"}), (2, "status", {"job_id": "10"}))
    assert got[1, "download"][:2] == (500, 10) and not json.loads(got[2, "status"][3])["has_docx"]


def test_an_upload_is_read_once_for_all_its_jobs(spark, desk, monkeypatch):
    seen = []
    monkeypatch.setattr("lectern.streaming.desk.contents", lambda rows, root: seen.append(rows.count()) or files.contents(rows, root))
    desk.put(batch(spark, *[(k, "command", {"upload_id": "1"}) for k in range(500)]))
    desk.work()
    assert seen == [1] and {r.status: r.n for r in desk.store.table().groupBy("status").agg(F.count("*").alias("n")).collect()} == {"done": 500}


def test_contents_open_what_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HELD", 100)
    for k in range(20):
        (tmp_path / f"{k}").write_bytes(bytes([k]) * 10 * k)
    rows = spark.createDataFrame([(k, str(k) if k != 7 else None) for k in range(21)], "k int, path string").repartition(2)
    got = {r.k: r.content for r in files.contents(rows, str(tmp_path)).collect()}
    assert got == {k: bytes([k]) * 10 * k if k not in (7, 20) else None for k in range(21)}
