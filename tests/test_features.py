"""Word packages, file sets, rasters, answers of any shape, dispatch, sweeps."""

import io
import time
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.operators import answers, rasters, runs
from lectern.sources import content, docx, files
from lectern.streaming import lifecycle, sweep

# ---- packages ----


def package(body, styles="", core=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.BODY, f'<w:document xmlns:w="{docx.W}" xmlns:wp="{docx.WP}"><w:body>{body}</w:body></w:document>')
        if styles:
            z.writestr(docx.STYLES, f'<w:styles xmlns:w="{docx.W}">{styles}</w:styles>')
        if core:
            z.writestr(docx.PROPERTIES, f'<c:p xmlns:c="{docx.CORE}" xmlns:dc="{docx.DC}">{core}</c:p>')
    return out.getvalue()


def test_packages_of_other_writers():
    p = lambda x, s="": f'<w:p>{s and f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>"}<w:r><w:t>{x}</w:t></w:r></w:p>'
    inner = f"<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}{inner}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:trPr><w:cantSplit/></w:trPr><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
    second = f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc></w:tr><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"
    image = '<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" descr="cat"/></wp:inline></w:drawing></w:r><w:r><w:drawing><wp:inline/></w:drawing></w:r></w:p>'
    styles = '<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Body"/></w:style><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style>'
    got = docx.unpack(package(p("Top", "h1") + p("one &amp; two") + p("odd", "unknown") + table + "<w:p/>" + second + image, styles, "<dc:language>de</dc:language>"))
    assert got["paras"] == [("Heading 1", "Top"), ("Body", "one & two"), ("Body", "odd"), ("Body", "")]
    assert [h for h, _ in got["tables"]] == [False, True] and got["tables"][0][1] == [["a\nb\ndeep", "c"], ["d"]]
    assert got["alts"] == ["cat", ""] and got["lang"] == "de" and got["title"] is None


def test_packages_round_trip_and_faults(spark):
    paras = [("Heading 2", "é <b> & \x07"), ("Normal", " two  spaces "), ("My style", "")]
    rows = docx.unpack(docx.pack("fr", "T & t", paras, [(True, [["a", None]]), (False, [["x"]])], ["alt \"1\"", None]))
    assert rows["paras"] == [("Heading 2", "é <b> & �"), *paras[1:]] and rows["tables"] == [[True, [["a", ""]]], [False, [["x"]]]]
    assert rows["alts"] == ['alt "1"', ""] and (rows["lang"], rows["title"]) == ("fr", "T & t")
    whole = docx.pack("en", None, [("Normal", "fine")], [], [])
    broken = [("a", whole), ("b", b"no zip"), ("c", whole[:-30]), ("d", None), ("e", package("<w:p>")), ("f", package("").replace(b"document.xml", b"documenX.xml"))]
    got = {x.name: x for x in docx.read_packages(spark.createDataFrame(broken, "name string, content binary")).collect()}
    assert got["a"].error is None and [p.text for p in got["a"].paras] == ["fine"]
    assert all(got[k].error and not got[k].paras for k in "bcdef")


# ---- file sets ----


def test_attempts_that_fail_leave_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", bytes([i])) for i in range(20)], "name string, content binary").repartition(3)
    files.write_files(rows, str(tmp_path))
    files.write_files(spark.createDataFrame([("more", b"x")], "name string, content binary"), str(tmp_path))
    assert {x.name: bytes(x.content) for x in files.read_files(spark, str(tmp_path)).collect()} == {**{f"f{i}": bytes([i]) for i in range(20)}, "more": b"x"}
    with pytest.raises(Exception, match="no name of a file"):
        files.write_files(spark.createDataFrame([("ok", b"1"), ("a/b", b"2")], "name string, content binary"), str(tmp_path))
    assert files.manifest(spark, str(tmp_path)).count() == 21
    assert len([x for x in tmp_path.iterdir() if x.is_dir()]) == 2  # the aborted job's folder is gone
    # an attempt that wrote and was lost, and the one that took its place
    writer = files.FileSetWriter(str(tmp_path))
    writer.write(iter([Row(name="late", content=b"1")]))
    writer.commit([writer.write(iter([Row(name="late", content=b"1")])), None])
    assert [bytes(x.content) for x in files.read_files(spark, str(tmp_path)).where("name = 'late'").collect()] == [b"1"]
    assert len(list((tmp_path / writer.job).iterdir())) == 1
    writer = files.FileSetWriter(str(tmp_path))
    with pytest.raises(ValueError, match="more than once"):
        writer.commit([writer.write(iter([Row(name="n", content=b"")])), writer.write(iter([Row(name="n", content=b"")]))])


# ---- rasters ----


def test_resampling_by_area(spark):
    def plain(px, h, w, th, tw):
        over = lambda k, n, to, i: max(0, min((k + 1) * n, (i + 1) * to) - max(k * n, i * to))
        return [(2 * sum(over(r, h, th, i) * over(c, w, tw, j) * px[i * w + j] for i in range(h) for j in range(w)) + h * w) // (2 * h * w) for r in range(th) for c in range(tw)]

    cases = [([(7 * i * i) % 256 for i in range(h * w)], h, w, th, tw) for h, w, th, tw in ((8, 8, 6, 5), (3, 4, 3, 4), (2, 3, 5, 7), (1, 1, 2, 2), (9, 2, 1, 1))]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "id int, px array<int>, h bigint, w bigint, th bigint, tw bigint")
    got = df.select("id", rasters.resized(*[F.col(c) for c in ("px", "h", "w", "th", "tw")]).alias("x")).collect()
    assert {r.id: r.x for r in got} == {i: plain(*x) for i, x in enumerate(cases)}


# ---- answers ----


def test_odd_answers(spark):
    texts = ["```json\n{\"elements\": [{\"level\": 3, \"text\": 5}]}\n```", "[]", "null", "{", "", None, '{"elements": {"0": 1}}', '{"elements": [{"level": 99999999999, "text": "x"}]}', '{"elements": [{"level": true}]}']
    rows = answers.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, answer string"))
    got = rows.select("id", "valid", answers.field(F.col("v"), "$.elements[0].level", "int", 2), answers.state(F.col("v"), "$.elements[0].level", "int"), answers.state(F.col("v"), "$.elements[0].text", "string")).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == [(True, 3, "ok", "wrong"), *[(False, 2, "missing", "missing")] * 5, (True, 2, "missing", "missing"), (True, 2, "wrong", "ok"), (True, 2, "wrong", "missing")]


def test_backends_see_open_pages_only(spark):
    calls = {k: spark.sparkContext.accumulator(0) for k in answers.BACKENDS}

    def counted(name):
        class Counted(answers.BACKENDS[name]):
            def answer(self, text):
                calls[name].add(1)
                return super().answer(text)

        return Counted

    pages = spark.createDataFrame([(i, t) for i, t in enumerate(["a" * 10] * 5 + ["b" * 1000] * 3 + ["c" * 9000, None])], "id int, text string")
    got = answers.dispatched(spark, pages, {k: counted(k) for k in answers.BACKENDS})
    assert sorted(x.backend for x in got.collect()) == ["hosted"] * 3 + ["local"] * 5 + ["rules"] * 2
    assert {k: a.value for k, a in calls.items()} == {"local": 10, "hosted": 5, "rules": 2}
    none = answers.dispatched(spark, pages, {"local": answers.Local})
    assert sum(x.backend is None and x.answer is None for x in none.collect()) == 5


# ---- jobs ----


def test_a_bad_document_fails_alone(spark, tmp_path):
    good = b"BT (Title) Tj (some words of text) Tj ET"
    spark.createDataFrame([(1, good), (2, good[:-8]), (3, b"[q"), (4, None), (5, good)], "page bigint, content binary").write.parquet(f"{tmp_path}/c")
    done = runs.executed(spark.read.parquet(f"{tmp_path}/c"), content.read_content(spark, f"{tmp_path}/c"))
    got = {x.job: (x.status, x.progress, x.message, x.n_elements) for x in done.collect()}
    assert got[1] == got[5] == ("done", 100, None, 2)
    assert got[2] == ("failed", 0, "string without its end", None) and got[3][:3] == ("failed", 0, "operator within an array or a dictionary") and got[4] == ("failed", 0, "nothing to read", None)


# ---- sweeps ----


@pytest.mark.parametrize("dry", [True, False])
def test_sweep(spark, tmp_path, dry):
    now = time.time()
    for name in ("old.pdf", "new.pdf", "soon.pdf", "old.docx"):
        (tmp_path / name).write_text("x")
    rows = [("old.pdf", "upload", now - 4000), ("new.pdf", "upload", now), ("soon.pdf", "upload", now - 3595), ("old.docx", "output", now - 4000), ("gone.pdf", "upload", now - 9000), ("old.pdf", "upload", now - 5000)]
    listed = spark.createDataFrame([(str(tmp_path / n), k, t) for n, k, t in rows], "path string, kind string, t double").select("path", "kind", F.timestamp_seconds("t").alias("modified"))
    listed.coalesce(1).write.parquet(f"{tmp_path}/in")
    with lifecycle.rocks(spark):
        query = sweep.sweep(spark, spark.readStream.schema(listed.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/log", dry)
        try:
            until, log = time.time() + 60, {}
            while time.time() < until and len(log) < 3:
                time.sleep(1)
                if list(tmp_path.glob("log/*/_SUCCESS")):
                    log = {x.path.rsplit("/", 1)[1]: x.deleted for x in spark.read.schema("path string, deleted boolean").parquet(f"{tmp_path}/log").collect()}
        finally:
            query.stop()
    assert log == {"old.pdf": True, "soon.pdf": True, "gone.pdf": False}
    assert sorted(x.name for x in tmp_path.glob("*.*")) == (["new.pdf", "old.docx", "old.pdf", "soon.pdf"] if dry else ["new.pdf", "old.docx"])


# ---- titles ----


def test_titles_of_documents(spark):
    """A first heading is the title; a long first line is none, and neither is no text: the file's name is taken."""
    from lectern.operators import pages

    rows = [(1, "Short title\nbody text", "en", "src1"), (2, "x" * 80 + "\nbody", "fr", "web_crawl"), (3, None, "", None), (4, " \n ", None, "a.docx"), (5, "y" * 90 + "\nALL CAPS", "de", "s"), (None, None, None, None)]
    got = {x.doc_id: (x.title, x.language, x.docx, x.pdf) for x in pages.titled_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1] == ("Short title", "en", "/out/src1_en_1_accessible.docx", "/out/src1_en_1_accessible_ada.pdf")
    assert got[2][:2] == ("Web Crawl Fr 2", "fr") and got[3][:2] == ("  3", "en-US") and got[5][0] == "ALL CAPS"
    assert got[4][2:] == ("/out/a.docx__4_accessible.docx", "/out/a_ada.pdf__4_accessible_ada.pdf")  # every ending is replaced
    assert got[None][:2] == ("  ", "en-US")
