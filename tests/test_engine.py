"""Plans, edges and hand-worked cases of pages, audits, jobs and adapters."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import audit, elements, jobs, metering, pages, structure
from lectern.sources import adapters

DIR = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# ---- plans ----


def test_lines_are_split_once(spark):
    docs = read(spark, "documents")
    for df in (elements.text_lines(docs), elements.heading_candidates(docs), elements.page_elements(docs)):
        plan = optimized(df)
        assert plan.count("split(") == 1, plan
        assert "size(" not in plan.split("Generate")[1], plan


def test_lines_equal_splitlines(spark):
    texts = ["a\r\nb\x0b c \x85\u2028d\x1c", " \t", "", None, "\n\n x\u3000\n\u00a0y z\u00a0 ", "one", "a \x1f\n\x1f b", "\ufeffa\n"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.lines(F.col("x")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [[y.strip() for y in (x or "").splitlines() if y.strip()] for x in texts]


def test_pages_are_narrow_or_keyed(spark):
    assert "Exchange" not in pages.page_text(read(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    plan = audit.audit_issues(read(spark, "documents"), read(spark, "lineitem"), read(spark, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


# ---- audit ----


def audited(spark, text, lang="en", tables=(), links=()):
    docs = spark.createDataFrame([(1, text, lang)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, i, i, i, 0.0 if x else 0.08, "N") for i, x in enumerate(tables)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_tax double, l_returnflag string")
    html = spark.createDataFrame([(1, "".join(f'<a href="/{x}">' for x in links))] if links else [], "page_id bigint, html string")
    return audit.audit_issues(docs, items, html), audit.audit_report(docs, items, html)


def test_rules(spark):
    issues, report = audited(spark, "\n".join(f"line number{i}" for i in range(30)), "", [True, False], ["abc", "x", "y"])
    told = [(r.severity, r.category, r.message) for r in issues.orderBy("seq").collect()]
    assert told == [
        ("error", "Language", "✗ Document language not declared (required for screen readers)"),
        ("info", "Headings", "✓ Found 4 headings"),
        ("warning", "Headings", "⚠ Document does not start with Heading 1 (starts at H2)"),
        ("error", "Headings", "✗ 1 empty heading paragraph(s) found"),
        ("info", "Tables", "✓ Found 2 table(s)"),
        ("error", "Tables", "✗ Table 2: no header row (w:tblHeader) — screen readers can't identify column headers"),
        ("error", "Alt Text", "✗ 1/3 image(s) missing alt text (descr attribute)"),
        ("info", "Coverage", "✓ Text coverage: 96.8% (31 source words)"),
        ("warning", "Coverage", "⚠ Missing words sample: number20"),
    ]
    r = report.first()
    assert (r.n_errors, r.n_warnings, r.passed_raw, r.failed_raw, r.status, r.exit_code) == (4, 2, 8, 8, "FAIL", 1)
    assert r.report.startswith("[Language]\n✗ Document") and r.report.count("[Headings]") == 1
    empty = {x.category: x.message for x in audited(spark, None)[0].collect()}
    assert empty["Coverage"] == "⚠ Could not extract text from source PDF for comparison" and empty["Tables"] == "✓ No tables in document"
    assert [x.message for x in audited(spark, "")[0].where("category = 'Headings'").orderBy("seq").collect()] == ["✗ No heading styles found — document has no structure", "✓ No empty headings"]


def test_percent(spark):
    rows = [(k, n) for n in (1, 3, 7, 8, 16, 200, 999) for k in range(0, n + 1, max(1, n // 7))]
    got = spark.createDataFrame(rows, "k int, n int").select("k", "n", audit.percent(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        assert abs(float(r.p) - 100 * r.k / r.n) <= 0.05 + 1e-9 and len(r.p.split(".")[1]) == 1


# ---- JSON of models and validators ----


def test_answers_by_hand(spark):
    answers = {
        '```json\n{"page": 1, "elements": [{"type": "heading", "level": 2, "text": "A \\"q\\" \\u00e9"}]}\n```': ["A \"q\" é"],
        '{"page": 1, "elements": [{"type": "paragraph", "text": "a```b"}, {"type": "list", "items": ["x", "y"], "ordered": true}]}': ["a```b", None],
        '{"page": 1, "elements": [{"type": "paragraph", "text": "cut of': [],
        '{"page": 1, "elements": "none"}': [],
        "no json at all": [],
        "": [],
        '```\n{"page": 3, "elements": [], "more": {"x": [1, {"y": 2}]}}\n```': [],
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    parsed = F.from_json(t.strip_fences(F.col("a")), audit.ELEMENTS)["elements"]
    got = df.select("i", F.coalesce(F.transform(parsed, lambda e: e["text"]), F.expr("cast(array() as array<string>)")).alias("x")).orderBy("i").collect()
    assert [list(r.x) for r in got] == list(answers.values())


def test_reports_by_hand(spark):
    rules = [{"clause": f"7.{i}", "testNumber": i, "description": "d, \"e\"", "failedChecks": 3} for i in range(12)]
    full = {"report": {"jobs": [{"validationResult": {"compliant": False, "passedRules": 9, "failedRules": 12, "passedChecks": 1, "failedChecks": 36, "details": {"ruleSummaries": rules}}}, {"validationResult": {"compliant": True}}]}}
    texts = [json.dumps(full), json.dumps({"report": {"jobs": []}}), "{", json.dumps({"report": {"jobs": [{"itemDetails": {}}]}})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    job = F.try_element_at(F.from_json("x", audit.VALIDATOR)["report"]["jobs"], F.lit(1))["validationResult"]
    got = df.select("i", job["failedChecks"].alias("n"), F.size(job["details"]["ruleSummaries"]).alias("k"), job["compliant"].alias("c")).orderBy("i").collect()
    assert [(r.n, r.c) for r in got] == [(36, False), (None, None), (None, None), (None, None)] and got[0].k == 12


# ---- pages ----


def test_shown_text(spark):
    rows = [("Tj", ["a"]), ("TJ", ["a", "b", "c"]), ("'", ["x"]), ('"', ["1", "2", "y"]), ('"', ["1"]), ("Tj", []), ("q", ["z"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, op string, o array<string>")
    assert [r[0] for r in df.orderBy("i").select(pages.shown(F.col("op"), F.col("o"))).collect()] == ["a", "abc", "x", "y", None, None, None]


def test_images_take_an_id(spark):
    e = lambda tag, words: {"tag": tag, "tokens": words.split()}
    b = lambda i, kind, words="": {"block": i, "type": kind, "tokens": words.split()}
    schema = "page int, blocks array<struct<block: int, type: string, tokens: array<string>>>, elements array<struct<tag: string, tokens: array<string>>>"
    df = spark.createDataFrame([(1, [b(0, "image"), b(1, "text", "a b"), b(2, "text"), b(3, "text", "zz"), b(4, "image"), b(5, "text", "a b")], [e("P", ""), e("H1", "a b c"), e("P", "a b c")])], schema)
    got = sorted((r.block, r.tag, r.mcid) for r in pages.assign(df).collect())
    assert got == [(0, "Figure", 0), (1, "H1", 1), (4, "Figure", 2), (5, "P", 3)]


def test_every_instruction_is_marked(spark):
    rows = pages.tagged_stream(read(spark, "events")).toPandas()
    for _, page in rows.groupby("page"):
        depth = 0
        for kind in page.sort_values("pos").kind:
            depth += {"open": 1, "close": -1, "body": 0}[kind]
            assert depth == (0 if kind == "close" else 1)
        ids = page[page.mcid.notna()].mcid
        assert sorted(ids) == list(range(len(ids)))


def test_blank_rows_and_tables_go(spark):
    rows = [(1, 1, "N", "O", 1.0), (1, 2, "A", "O", 1.0), (1, 3, "N", "F", 30.0), (2, 1, "N", "O", 1.0), (3, 1, None, None, None)]
    df = spark.createDataFrame([(o, n, 7, 8, f, s, q) for o, n, f, s, q in rows], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string, l_quantity double")
    got = sorted(tuple(r) for r in pages.page_tables(df).collect())
    assert got == [(1, 1, False, None, "A||"), (1, 2, False, None, "|F|7")]


# ---- jobs ----


def test_hmac(spark):
    rows = [("",), ("payload é",), ("x" * 300,)]
    got = spark.createDataFrame(rows, "x string").select("x", jobs.hmac(F.col("x"), "whsec_k").alias("h")).collect()
    assert all(r.h == hmac.new(b"whsec_k", r.x.encode(), hashlib.sha256).hexdigest() for r in got)


def test_put_again_changes_nothing(spark):
    log = jobs.job_log(read(spark, "orders"))
    once, twice = jobs.latest(log), jobs.latest(log.unionByName(log))
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0


def test_requests(spark):
    orders = spark.createDataFrame([(4, "O"), (5, "F"), (8, "F"), (9, "F"), (36, "F")], "o_orderkey bigint, o_orderstatus string").withColumn("o_orderdate", F.lit("1998-01-02 03:04:05.5").cast("timestamp_ntz"))
    events = spark.createDataFrame([(i,) for i in (4, 5, 8, 9, 36, 77, 7, 405)], "event_id bigint")
    got = {r.request: (r.code, r.filename) for r in jobs.download_requests(events, orders).collect()}
    assert got == {4: (400, None), 5: (200, "5_ada_compliant.pdf"), 8: (200, "8_accessible.docx"), 9: (500, None), 36: (500, None), 77: (404, None), 7: (404, None), 405: (200, "5_accessible.docx")}
    body = {r.request: r.body for r in jobs.status_requests(events, orders).collect()}
    assert json.loads(body[5])["has_pdf"] is True and json.loads(body[4])["completed_at"] is None and body[77] is None
    new = jobs.with_ids(events).collect()
    assert len({r.id for r in new}) == 8 and {r.status for r in new} == {"queued"}


def test_upload_codes(spark):
    rows = [(1, 50), (11, 50), (2, 13_000 * 1024), (26, 50), (4, 12_000)]
    got = {r.doc_id: r.code for r in metering.upload_gate(spark.createDataFrame(rows, "doc_id bigint, n_chars bigint")).collect()}
    assert got == {1: "200", 11: "400", 2: "413", 26: "422", 4: "400"}


# ---- adapters ----


def test_files_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    adapters.write_elements(rows, f"{tmp_path}/out")
    with pytest.raises(Exception, match="exists"):
        adapters.write_elements(rows, f"{tmp_path}/out")
    adapters.write_elements(rows, f"{tmp_path}/out", "append")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.pdf").write_bytes(b"12345")
    (tmp_path / "in/y.txt").write_bytes(b"1")
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in adapters.files(spark, f"{tmp_path}/in", "*.pdf").select("path", "bytes").collect()] == [("x.pdf", 5)]


def test_uploads_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.PDF", 10), ("b.txt", 10), ("c.pdf", 51 << 20)):
        (tmp_path / "in" / name).write_bytes(b"x" * n)
    out = f"{tmp_path}/out"
    adapters.uploads(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.name, r.code) for r in spark.read.parquet(out).collect()) == [("a.PDF", 200), ("b.txt", 400), ("c.pdf", 413)]


def test_dense_index_of_sparse_ids(spark):
    rows = [(i * 10**12 - 5, "a b c\na b c") for i in range(40)]
    got = structure.parent_tree(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).orderBy("doc_id").collect()
    assert [r.tree_idx for r in got] == list(range(40))


def test_source_keeps_any_schema(spark):
    df = spark.createDataFrame([(1, "a", {"x": [1]}, "old")], "i int, text string, `odd name` struct<x: array<int>>, answer string")
    got = adapters.page_source(df, [lambda x: x.str.upper()])
    assert got.columns == ["i", "text", "odd name", "answer", "analyzer"]
    assert (got.first().answer, got.first().analyzer, got.first()["odd name"].x) == ("A", 0, [1])


def test_outline_links_of_a_document(spark):
    heads = structure.headings(read(spark, "part"))
    links, parents = structure.outline_links(heads).count(), structure.outline_parents(heads).count()
    assert links == parents == heads.count()
